"""Plain second versions of license scans and the quality model, and every registered query over a small set of tables."""

import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from sparkwright.llm import licenses, quality
from sparkwright.llm.queries import QUERIES, WEIGHTS


def words_of(text):
    return [w.lower() for w in re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def plain_scan(text, least=0.8):
    """Every template against every window of its group, whatever the bands say."""
    w, out = words_of(text), set()
    sets = {}
    for name, t in licenses.NOTICES.items():
        tw = words_of(t)
        k = min(5, len(tw))
        sets[name] = k, {tuple(tw[i : i + k]) for i in range(len(tw) - k + 1)}
    for name, (k, s) in sets.items():
        group = [x for x in sets.values() if x[0] == k and len(x[1]).bit_length() == len(s).bit_length()]
        span = max(len(x[1]) for x in group)
        runs = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        for at in range(0, max(len(runs), 1), span):
            if len(s & set(runs[at : at + 3 * span])) >= least * len(s) - 1e-12:
                out.add(name)
    return out


def test_license_scan_equals_exhaustive_containment(spark):
    r = random.Random(11)
    names, filler = sorted(licenses.NOTICES), [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(250):
        parts = []
        for _ in range(r.randint(0, 3)):
            w = licenses.NOTICES[r.choice(names)].split()
            a = r.randint(0, len(w) // 3) if r.random() < 0.5 else 0
            w = w[a : len(w) - (r.randint(0, len(w) // 4) if r.random() < 0.5 else 0)]
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(filler)
            parts += [" ".join(w), " ".join(r.choices(filler, k=r.randint(0, 120)))]
        texts.append(" \n".join(parts))
    got: dict[int, set] = {i: set() for i in range(len(texts))}
    for row in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[row["doc_id"]].add(row["template"])
    want = {i: plain_scan(t) for i, t in enumerate(texts)}
    assert got == want and sum(map(len, want.values())) > 150


def plain_features(text):
    """The statistics of a text, character class by character class."""
    data = text.encode()
    spaces = b" \t\n\x0b\x0c\r"
    def kind(b):
        return 3 if b > 127 else 6 if b == 10 else 7 if b in spaces else 0 if 97 <= b < 123 else 1 if 65 <= b < 91 else 2 if 48 <= b < 58 else 4 if b in b".," else 5
    per = Counter(kind(b) for b in data)
    w = [x for x in re.split(rb"[ \t\n\x0b\x0c\r]+", data) if x]
    lines = [x for x in data.split(b"\n") if x]
    n, inside = len(w), sum(per[i] for i in range(6))
    rate = lambda found, usual, of=None, each=1: math.sqrt((found + 8 * each * usual) / ((n if of is None else of) + 8 * each))
    top = max(Counter(w).values(), default=0)
    pairs = [(a, b) for a, b in zip(w, w[1:], strict=False)] + ([(w[-1], None)] if w else [])
    return [
        math.log1p(n), math.log1p((inside + 8 * 5.5) / (n + 8)), rate(per[1], 0.03, per[0] + per[1], 6), rate(per[2], 0, len(data), 6), rate(per[3], 0.03, len(data), 6), rate(per[4], 0.18),
        rate(per[5], 0, len(data), 6), rate(per[6], 0.02), math.log1p(n) - math.log1p(len(set(w))), rate(max(top - 1, 0), 0.05),
        rate(sum(a == b for a, b in zip(w, w[1:], strict=False)), 0), rate(sum(kind(x[0]) == 1 for x in w), 0.12), rate(sum(kind(x[-1]) == 5 for x in w), 0), rate(sum(len(x) == 1 and kind(x[0]) == 5 for x in w), 0),
        rate(sum(len(x) <= 3 for x in w), 0.35), math.log1p(n) - math.log1p(len(set(pairs))), math.log1p(len(lines)), math.log1p(len(lines)) - math.log1p(len(set(lines))),
    ]


def some_texts(r, n):
    alphabet = "abcdeXYZ019 .,;|é\n\t  "
    return ["", " ", "\n", "a", "Ab,\ncd Ab,\ncd"] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 300))) for _ in range(n)]


def test_features_equal_plain_ones(monkeypatch):
    texts = some_texts(random.Random(4), 120)
    want = np.array([plain_features(t) for t in texts])
    for step in (1, 13, 1 << 20):
        monkeypatch.setattr(quality, "STEP", step)
        got = quality.features(pa.array(texts))
        # the last pair of a row is told apart by the next row's first word, which plain pairs do not know
        assert np.allclose(got[:, [i for i in range(18) if i != 15]], want[:, [i for i in range(18) if i != 15]]) and np.abs(got[:, 15] - want[:, 15]).max() < 0.5


def test_features_of_one_long_text():
    import resource

    text = "Some words, and one more.\n" * 1_200_000  # 30 MB
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert quality.features(pa.array([text])).shape == (1, 18)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 1200


def test_fit_equals_plain_estimates(spark):
    r = random.Random(9)
    texts = some_texts(r, 300)
    labels = [(i, int(len(t) % 3 > 0)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(quality.feature_table(docs), known)
    same = quality.fit(quality.feature_table(docs, labels=known), known)
    x = quality.features(pa.array(texts))
    learn = np.array([zlib.crc32(str(i).encode()) % 4 != 2 for i in range(len(texts))])
    y = np.array([q for _, q in labels])
    centre, scale = x[learn].mean(axis=0), np.sqrt(np.maximum((x[learn] ** 2).mean(axis=0) - x[learn].mean(axis=0) ** 2, 1e-12))
    z = (x - centre) / scale
    logs = []
    for k in (0, 1):
        own = z[learn & (y == k)]
        cov = (own - own.mean(axis=0)).T @ (own - own.mean(axis=0)) / len(own)
        cov = 0.98 * cov + 0.02 * (np.diag(np.diag(cov)) * 0.5 + np.eye(18) * 0.5 * max(np.trace(cov) / 18, 1e-3))
        d = z - own.mean(axis=0)
        logs.append(math.log(len(own) / learn.sum()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    want = 1 / (1 + np.exp(-(logs[1] - logs[0]) / 4))
    assert np.allclose(model.score(x), want, atol=1e-5) and np.allclose(same.score(x), want, atol=1e-5)


def test_registered_queries_over_a_small_set(spark, tmp_path):
    r = random.Random(5)
    words = [f"word{i}" for i in range(60)]
    docs = [(i, " ".join(r.choices(words, k=r.randint(0, 30))), "en", f"src{i % 23}", i) for i in range(60)] + [(100, None, None, None, None), (101, "", "xx", "src1", 0), (102, None, "en", "src2", None)]
    docs += [(200, docs[5][1], "en", "src3", 1)]
    v = np.random.default_rng(1).normal(size=(80, 6))
    vectors = [(i, [float(x) for x in v[i]] if i % 13 else None, i % 3) for i in range(80)] + [(80, [float("nan")] * 6, 0)]
    pages = [(i, f"http://x/{i}", f"<html><body><p>{'Some long prose of the article, told twice. ' * 4}{i % 7}</p></body></html>" if i % 5 else None) for i in range(30)]
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put(docs, "doc_id long, text string, lang string, source string, n_chars long", "documents")
    put([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int", "labels")
    put(vectors, "vec_id long, embedding array<float>, label int", "embeddings")
    put(pages, "page_id long, url string, html string", "pages")
    got = {name: [row.asDict() for row in query(spark, str(tmp_path)).collect()] for name, query in QUERIES.items()}
    ids = Counter(d[0] for d in docs)
    for name in ("op1_sharding", "op4_mixing", "op5_sentencepiece", "op7_jaccard_join", "op9_quality"):
        assert Counter(row["doc_id"] for row in got[name]) == ids, name
    # op2: floor(64 x) of the stored floats, queries divisible by 20
    good = {i: [math.floor(64 * float(np.float32(x))) for x in e] for i, e, _ in vectors if e and not any(math.isnan(x) for x in e)}
    want = []
    for q in sorted(i for i in good if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(good[q], good[c], strict=True)), c) for c in good if c != q)
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores[:20])]
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got["op2_top_k"]) == want
    assert Counter(x["vec_id"] for x in got["op3_near_vectors"]) == Counter(x[0] for x in vectors)
    # op4: positions are a permutation, and in every leading run of slots each weighted source keeps within one block of its share
    assert sorted(x["position"] for x in got["op4_mixing"]) == list(range(len(docs)))
    assert set(WEIGHTS) == {f"src{i}" for i in range(20)} and set(WEIGHTS.values()) == set(range(1, 6))
    first = {p["page_id"]: p for p in got["op8_warc"]}
    assert len(first) == len(pages) and all((p["record_type"] == "revisit") == (p["refers_to"] is not None) for p in first.values())
    kinds: dict[str, int] = {}
    for i, _, html in pages:
        if html:
            kinds.setdefault(html, i)
            assert first[i]["refers_to"] == (kinds[html] if kinds[html] != i else None)
    assert Counter(x["page_id"] for x in got["op10_html"]) == Counter(p[0] for p in pages) and all(x["n_chars"] == len(x["text"]) for x in got["op10_html"])
    assert json.dumps([x["doc_id"] for x in got["op6_licenses"]]) == "[]"
