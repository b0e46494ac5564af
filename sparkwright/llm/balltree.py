"""Exact top-k inner products over shards, each with a ball tree searched by branch and bound.

The best score that a ball (centre c, radius r) can hold for a query q is q.c + |q| r. A batch of queries first lets each
query go down to the leaf of the highest bound; then a heap gives the nodes by falling bound, and each is entered only for
the queries whose k-th score of that moment its bound reaches. Queries first search the shard of their own key; the k-th
score found there goes with them to all other shards, where it prunes from the start.

Scores are whole numbers and exact while below 2**63 in size (products of doubles below 2**53, of 64-bit integers above);
vectors whose scores could be larger raise an error. The bounds carry a margin for their rounding, so no tie is lost.

A query sends at most k rows from each shard to the last step, a window over its own rows.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; vectors of different
lengths do not meet; ties go to the smaller id; rows that share the query's id are no candidates; other repeated rows
count each; queries of one id are one query, that with the smallest vector; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.llm.shared import materialise, shard_stream

LEAF = 256
#: Vectors of a shard, and the least number of shards.
SHARD, SHARDS = 200_000, 12
#: Queries that are searched together.
TOGETHER = 1024
#: A score that none has.
NONE = np.iinfo(np.int64).min


class BallTree:
    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.rows = np.arange(len(ids))
        self.longest = float(np.sqrt((self.x**2).sum(axis=1).max()))
        self.nodes: list[tuple[np.ndarray, float, int, int, int, int]] = []  # centre, radius, first row, end, children
        self._grow(0, len(ids), leaf)

    def _grow(self, first: int, end: int, leaf: int) -> int:
        own = self.x[self.rows[first:end]]
        centre = own.mean(axis=0)
        away = ((own - centre) ** 2).sum(axis=1)
        at = len(self.nodes)
        self.nodes.append((centre, float(np.sqrt(away.max())), first, end, -1, -1))
        if end - first > leaf and away.max() > 0:
            a = own[int(np.argmax(away))]
            b = own[int(np.argmax(((own - a) ** 2).sum(axis=1)))]
            middle = first + (end - first) // 2
            self.rows[first:end] = self.rows[first:end][np.argpartition(own @ (b - a), (end - first) // 2)]
            left, right = self._grow(first, middle, leaf), self._grow(middle, end, leaf)
            self.nodes[at] = (*self.nodes[at][:4], left, right)
        return at

    def search(self, ids: np.ndarray, q: np.ndarray, known: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query's place, candidate's id, score) of up to k best candidates each that reach the score already known."""
        norm = np.sqrt((q**2).sum(axis=1))
        largest = float(norm.max()) * self.longest
        if largest >= 2.0**63:
            raise ValueError("scores of 2**63 or more cannot be told exactly")
        wide = largest >= 2.0**53
        scores, rows_of = np.full((len(q), k), NONE), np.full((len(q), k), len(self.ids))
        least = known.copy()

        def bound(at: int, some: np.ndarray) -> np.ndarray:
            centre, radius = self.nodes[at][:2]
            top = q[some] @ centre + norm[some] * radius
            return top + 1e-9 * np.abs(top) + 1e-6

        def scan(at: int, some: np.ndarray) -> None:
            rows = self.rows[self.nodes[at][2] : self.nodes[at][3]]
            held = self.x[rows]
            score = q[some].astype(np.int64) @ held.astype(np.int64).T if wide else np.rint(q[some] @ held.T).astype(np.int64)
            asks, found = np.nonzero((score >= least[some][:, None]) & (self.ids[rows][None, :] != ids[some][:, None]))
            if not len(asks):
                return
            own = some[np.unique(asks)]
            held_by, held_at = np.nonzero(scores[own] > NONE)
            who = np.concatenate((np.searchsorted(own, some[asks]), held_by))
            what = np.concatenate((rows[found], rows_of[own][held_by, held_at]))
            how = np.concatenate((score[asks, found], scores[own][held_by, held_at]))
            order = np.lexsort((what, -how, who))
            who = who[order]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            best = rank < k
            scores[own[who[best]], rank[best]], rows_of[own[who[best]], rank[best]] = how[order][best], what[order][best]
            least[own] = np.maximum(least[own], scores[own, k - 1])

        place, deeper, home = np.zeros(len(q), np.int64), np.arange(len(q)), np.zeros(len(q), np.int64)
        while len(deeper):  # each to the leaf of the highest bound
            for at in np.unique(place[deeper]).tolist():
                some = deeper[place[deeper] == at]
                left, right = self.nodes[at][4:]
                home[some] = at
                place[some] = -1 if left < 0 else np.where(bound(left, some) >= bound(right, some), left, right)
            deeper = deeper[place[deeper] >= 0]
        for at in np.unique(home).tolist():
            some = np.flatnonzero(home == at)
            scan(at, some[bound(at, some) >= least[some]])
        everyone = np.arange(len(q))
        heap = [(-np.inf, 0, everyone, bound(0, everyone))]
        while heap:
            _, at, some, top = heapq.heappop(heap)
            keep = top >= least[some]
            some = some[keep]
            left, right = self.nodes[at][4:]
            if left < 0:
                some = some[home[some] != at]
                if len(some):
                    scan(at, some)
                continue
            for child in (left, right):
                top = bound(child, some)
                keep = top >= least[some]
                if keep.any():
                    heapq.heappush(heap, (-float(top[keep].max()), child, some[keep], top[keep]))
        where, column = np.nonzero(scores > NONE)
        yield where, self.ids[rows_of[where, column]], scores[where, column]


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (array of double) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter((F.size("v") > 0) & finite & F.col("id").isNotNull())


def matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) for each length of vector in a list array."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out.append((rows, column.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), size)))
    return out


def _searches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        trees: dict[int, BallTree] | None = None
        for batch in batches:
            ids, role, known = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("id", "role", "known"))
            found = matrix(batch.column(batch.schema.get_field_index("v")))
            for rows, x in found:
                own = role[rows] == 0
                if own.any():
                    held.setdefault(x.shape[1], []).append((ids[rows[own]], x[own]))
            if (role == 0).all():
                continue
            if trees is None:  # all rows of the index have come
                trees = {d: BallTree(*(np.concatenate(c) for c in zip(*parts, strict=True))) for d, parts in held.items()}
            for rows, x in found:
                asks = role[rows] == 1
                tree = trees.get(x.shape[1])
                asked, q = rows[asks], x[asks]
                for a in range(0, len(q) if tree else 0, TOGETHER):
                    part = asked[a : a + TOGETHER]
                    for where, best, score in tree.search(ids[part], q[a : a + TOGETHER], known[part], k):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[part][where], pa.int64()), pa.array(best, pa.int64()), pa.array(score, pa.int64())], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", shards: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each query; vectors of whole numbers in both frames."""
    index, asked = valid(vectors, key, vector), valid(queries, key, vector).groupBy("id").agg(F.min("v").alias("v"))
    shards = shards or max(SHARDS, -(-index.count() // SHARD))
    place = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    schema = "query_id long, vec_id long, score long"
    index = index.select(place.alias("shard"), "id", "v", F.lit(NONE).cast("long").alias("known"))
    home = asked.select(place.alias("shard"), "id", "v", F.lit(NONE).cast("long").alias("known"))
    own = index.withColumn("role", F.lit(0)).unionByName(home.withColumn("role", F.lit(1))).repartitionById(shards, F.col("shard")).sortWithinPartitions("role")
    first = materialise(own.mapInArrow(_searches(k), schema), "home")
    least = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).select("query_id", "least")
    away = asked.join(least, asked["id"] == least["query_id"], "left").select("id", "v", F.coalesce("least", F.lit(NONE).cast("long")).alias("known"), place.alias("home"))
    far = shard_stream(index.withColumn("home", F.lit(-1)), away, shards, _searches(k), schema, "home")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(far).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
