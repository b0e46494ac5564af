"""Quality by regularised quadratic discriminant analysis over transformed statistics of whole texts.

Each text gives the statistics of ``FEATURES``, already transformed (logarithms of counts and ratios, square roots of
shares). For each label the mean and covariance follow from sums that Spark adds up over all labelled rows; features are
scaled to unit variance, and covariances are shrunk towards a diagonal of their own and a multiple of the identity. A
score is the logistic function of the difference of the two log densities (squared Mahalanobis lengths through Cholesky
factors that are made once, with the log determinants and the labels' shares), divided by ``temperature``.

Defined cases: null text counts as empty and gets a score like any other; without a label row of either kind the score
is the share of label 1 among the labelled rows, and 1 without any; labels that are null or belong to no row count
nothing; repeated rows count each time; texts of any length are read whole, in steps, and need memory for their words (some
14 bytes for each byte), not for their bytes' classes; an empty table gives an empty table; other columns have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.bytewords import SPACES, STEP, U, buffers, mix, parts, words
from sparkwright.llm.shared import materialise, maybe_among

FEATURES = (
    "words", "word_length", "upper", "digits", "foreign", "stops", "symbols", "breaks", "repeats", "top_word",
    "doubled", "capitals", "odd_ends", "lone_symbols", "short_words", "pair_repeats", "lines", "line_repeats",
)
#: Classes of bytes: 0 lower, 1 upper, 2 digit, 3 non-ASCII, 4 full stop or comma, 5 other ASCII, 6 line break, 7 other white space.
CLASS = np.array([3 if b > 127 else 6 if b == 10 else 7 if SPACES[b] else 0 if 97 <= b < 123 else 1 if 65 <= b < 91 else 2 if 48 <= b < 58 else 4 if b in b".," else 5 for b in range(256)], np.uint8)
#: Shares are taken as if so many more words, or bytes times six, of common prose were there, so that a few words tell little.
PRIOR = 8
SAME = np.arange(256, dtype=np.uint8)
LINE = np.arange(256) == 10


def _spread(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, and how often its most frequent one occurs."""
    n = len(rows) - 1
    top = np.zeros(n, np.int64)
    if not len(hashes):
        return top, top.copy()
    owner = np.repeat(np.arange(n, dtype=np.uint64), np.diff(rows))
    key = np.sort(owner << U(40) | hashes >> U(24))
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    of = (key[start] >> U(40)).astype(np.int64)
    np.maximum.at(top, of, np.diff(np.append(start, len(key))))
    return np.bincount(of, minlength=n), top


def _edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of each class in each row, and the first and the last byte of every word, in steps of a bounded size."""
    n = len(offsets) - 1
    per, begin, end = np.zeros(n * 8), [], []
    starts = offsets[:-1]
    for a in range(0, len(data), STEP):
        b = min(a + STEP, len(data))
        kind = CLASS[data[max(a - 1, 0) : b + 1]]
        inside = kind < 6
        if not a:
            kind, inside = np.insert(kind, 0, 7), np.insert(inside, 0, False)
        if b == len(data):
            inside = np.append(inside, False)
        own, before, after = inside[1:-1], inside[:-2].copy(), inside[2:].copy()
        some = starts[np.searchsorted(starts, a) : np.searchsorted(starts, b + 1)]  # rows begin here, so words do not go on
        before[some[some < b] - a] = False
        after[some[some > a] - a - 1] = False
        begin.append(np.flatnonzero(own & ~before) + a)
        end.append(np.flatnonzero(own & ~after) + a)
        low, high = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
        owner = np.repeat(np.arange(low, high), np.diff(np.clip(offsets[low : high + 1], a, b)))
        per[low * 8 : high * 8] += np.bincount((owner - low) * 8 + kind[1 : b - a + 1], minlength=(high - low) * 8)
    none = np.zeros(0, np.int64)
    return per.reshape(n, 8), np.concatenate([none, *begin]), np.concatenate([none, *end])


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, offsets = buffers(texts)
    n, sizes = len(offsets) - 1, np.diff(offsets)
    per, begin, end = _edges(data, offsets)
    at = np.searchsorted(offsets, begin, "right") - 1
    count = np.bincount(at, minlength=n).astype(float)
    head, tail, length = CLASS[data[begin]], CLASS[data[end]], end - begin + 1
    del begin, end

    def rate(found: np.ndarray, usual: float, of: np.ndarray = count, each: int = 1) -> np.ndarray:
        return np.sqrt((found + PRIOR * each * usual) / (of + PRIOR * each))

    def share(mask: np.ndarray, usual: float) -> np.ndarray:
        return rate(np.bincount(at[mask], minlength=n), usual)

    hashes, rows = words(data, offsets, SAME)
    distinct, top = _spread(hashes, rows)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[rows[:-1][rows[:-1] < len(hashes)]] = False
    pair = mix(hashes * U(3) + np.append(hashes[1:], U(0)))
    pairs, _ = _spread(pair, rows)
    line, line_rows = words(data, offsets, SAME, LINE)
    lines, _ = _spread(line, line_rows)
    total = np.diff(line_rows).astype(float)
    letters = per[:, 0] + per[:, 1]
    columns = [
        np.log1p(count), np.log1p((per[:, :6].sum(axis=1) + PRIOR * 5.5) / (count + PRIOR)), rate(per[:, 1], 0.03, letters, 6), rate(per[:, 2], 0, sizes, 6), rate(per[:, 3], 0.03, sizes, 6), rate(per[:, 4], 0.18),
        rate(per[:, 5], 0, sizes, 6), rate(per[:, 6], 0.02), np.log1p(count) - np.log1p(distinct), rate(np.maximum(top - 1, 0), 0.05),
        share(same, 0), share(head == 1, 0.12), share(tail == 5, 0), share((length == 1) & (head == 5), 0), share(length <= 3, 0.35), np.log1p(count) - np.log1p(pairs), np.log1p(total), np.log1p(total) - np.log1p(lines),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Model:
    """Cholesky factors of the two precisions and what the log densities need; or a constant score."""

    constant: float | None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: tuple[np.ndarray, np.ndarray] | None = None
    factors: tuple[np.ndarray, np.ndarray] | None = None
    offsets: tuple[float, float] | None = None
    temperature: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.centre) / self.scale
        logs = [off - 0.5 * (((z - m) @ f) ** 2).sum(axis=1) for m, f, off in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / self.temperature, -500, 500)))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(features(part.column(1))), pa.list_(pa.float64()))], ["doc_id", "x"])


def feature_table(docs: DataFrame, key: str = "doc_id", text: str = "text", labels: DataFrame | None = None) -> DataFrame:
    """doc_id and the features x of every row, kept in the shared folder; with ``labels``, rows that surely have none are left out."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if labels is not None:
        known = labels.select(F.col(key).cast("long").alias("doc_id")).filter(~held_out(F.col("doc_id")))
        rows = maybe_among(rows, "doc_id", known).filter("maybe").select("row.*")
    return materialise(rows.mapInArrow(_feature_rows, "doc_id long, x array<double>"), "features")


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(FEATURES) + 1
    for batch in batches:
        y = batch.column(0).to_numpy()
        x = np.column_stack((np.ones(len(y)), batch.column(1).flatten().to_numpy().reshape(len(y), d - 1)))
        for label in (0, 1):
            own = x[y == label]
            yield pa.RecordBatch.from_arrays([pa.array([label] * d * d, pa.int32()), pa.array(range(d * d), pa.int32()), pa.array((own.T @ own).ravel())], ["label", "at", "v"])


def fit(table: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", shrink: float = 0.02, temperature: float = 4.0) -> Model:
    """Learn from the labelled rows of a feature table that are not held out; all of them, through sums of squares and products."""
    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    sums = table.join(known, "doc_id").select("label", "x").mapInArrow(_sums, "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v"))
    d = len(FEATURES) + 1
    m = np.zeros((2, d * d))
    for r in sums.collect():  # two square tables of the features' size
        m[r["label"], r["at"]] = r["v"]
    m = m.reshape(2, d, d)
    n = m[:, 0, 0]
    if not n.all():
        return Model(constant=float(n[1] / n.sum()) if n.any() else 1.0)
    total = m.sum(axis=0)
    centre = total[0, 1:] / n.sum()
    scale = np.sqrt(np.maximum(np.diag(total)[1:] / n.sum() - centre**2, 1e-12))
    means, factors, offsets = [], [], []
    for k in (0, 1):
        mean = m[k, 0, 1:] / n[k]
        cov = (m[k, 1:, 1:] / n[k] - np.outer(mean, mean)) / np.outer(scale, scale)
        diagonal = np.diag(np.diag(cov)) * 0.5 + np.eye(d - 1) * 0.5 * max(np.trace(cov) / (d - 1), 1e-3)
        root = np.linalg.cholesky((1 - shrink) * cov + shrink * diagonal)
        means.append((mean - centre) / scale)
        factors.append(np.linalg.inv(root).T)
        offsets.append(float(np.log(n[k] / n.sum()) - np.log(np.diag(root)).sum()))
    return Model(None, centre, scale, tuple(means), tuple(factors), tuple(offsets), temperature)


def score_table(table: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of a feature table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= least).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = table.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def kept(docs: DataFrame, model: Model, least: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of docs whose score reaches ``least``, with all their columns."""
    at = docs.columns.index(text)
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, len(names)):
                yield part.filter(pa.array(model.score(features(part.column(len(names)))) >= least)).select(names)

    given = docs.toDF(*names)
    schema = ", ".join(f"{n} {t}" for n, t in given.dtypes)
    return given.withColumn("read", F.coalesce(F.col(names[at]), F.lit(""))).mapInArrow(run, schema).toDF(*docs.columns)
