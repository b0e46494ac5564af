"""Operators 2, 3 and 7 against brute force."""

import math
import random
import re
from itertools import combinations

import numpy as np

from sparkwright.llm import balltree, hnsw, jaccard
from sparkwright.llm.bytewords import shingle_sets

SCHEMA = "doc_id long, text string, mark string, n long"


def roots(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def plain_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_texts(seed=1, bases=14, copies=9):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for b in range(bases):
        base = [r.choice(words) for _ in range(r.choice([3, 9, 12, 15, 40, 90, 300]))]
        out.append(base)
        for _ in range(copies):
            w = list(r.choice(out[-3:]) if r.random() < 0.5 else base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                i = r.randrange(len(w))
                w[i : i + r.choice([0, 1])] = [r.choice(words)] * r.choice([0, 1])
            out.append(w or ["x"])
    return [" ".join(w) for w in out]


def check_components(spark, texts, k, num, den, **more):
    rows = [(i * 3 + 1, t, "clash", i) for i, t in enumerate(texts)]
    random.Random(3).shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA), k, num, den, **more).collect()}
    sets = {r[0]: plain_set(r[1], k) for r in rows}
    pairs = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    root = roots(sets, pairs)
    assert got == {d: (len(s), root[d]) for d, s in sets.items()}
    return len(pairs)


def test_jaccard_matches_brute_force(spark):
    texts = near_texts() + ["", None, " \t ", "A", "a", "a b", "A  B", "é É", "é É", "a b c", "A B C"]
    assert check_components(spark, texts, 3, 90, 100) > 30


def test_jaccard_of_five_words(spark):
    assert check_components(spark, near_texts(2), 5, 80, 100) > 20


def test_jaccard_in_blocks(spark):
    r = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for _ in range(60):  # one large family, many of its sets linked only through others
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(60)] = f"x{r.randrange(9)}"
        texts.append(" ".join(w))
    check_components(spark, texts, 3, 90, 100, block=300)


def test_jaccard_repeats_nulls_and_empty_tables(spark):
    rows = [(1, "one two three four", "", 1), (1, "one two three four", "", 1), (None, "one two three four", "", 1), (5, "one two three four", "", 2), (7, None, None, None)]
    got = sorted(map(tuple, jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == [(1, 2, 1), (1, 2, 1), (5, 2, 1), (7, 0, 7), (None, 2, None)]
    assert jaccard.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_link_sets_is_exact_on_random_sets():
    r = np.random.default_rng(0)
    limit = jaccard.Threshold(80, 100)
    for _ in range(30):
        base = [r.integers(0, 1 << 60, n).astype(np.uint64) for n in r.integers(5, 60, 4)]
        sets = []
        for _ in range(40):
            s = base[r.integers(4)].copy()
            for _ in range(r.integers(0, 5)):
                s[r.integers(len(s))] = r.integers(0, 1 << 60)
            sets.append(np.unique(s))
        pairs = [(a, b) for a, b in combinations(range(40), 2) if limit.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))]
        root = roots(range(40), pairs)
        assert jaccard.link_sets(sets, limit) == [root[i] for i in range(40)]


def test_linked_sets_are_tied():
    import pyarrow as pa

    r = np.random.default_rng(1)
    for num in (80, 90):
        limit = jaccard.Threshold(num, 100)
        for _ in range(60):
            base = np.unique(r.integers(0, 1 << 63, int(r.integers(2, 120))).astype(np.uint64) * np.uint64(2))
            sets = []
            for _ in range(12):
                keep = r.random(len(base)) > r.random() * 0.25
                s = np.unique(np.concatenate((base[keep], r.integers(0, 1 << 63, r.integers(0, len(base) // 6 + 1)).astype(np.uint64))))
                sets.append(s if len(s) else base)
            often = np.unique(r.choice(base, len(base) // 2 + 1))
            often = often, r.integers(1, 9, len(often)).astype(np.uint64)
            rows = [(int(t.view(np.int64)), i, len(s), int(x)) for i, s in enumerate(sets) for t, x in zip(*jaccard.short_lists(s, limit, often), strict=True)]
            once, rows = rows, sorted(rows + [r_ for r_ in rows if r_[1] % 3 == 0], key=lambda row: (row[0], row[2], row[1]))
            cut = int(r.integers(1, len(rows)))
            batches = [pa.RecordBatch.from_pylist([dict(zip(("token", "node", "n", "reach"), row, strict=True)) for row in some]) for some in (rows[:cut], rows[cut:]) if some]
            kept = [t for batch in jaccard._shared(iter(batches)) for t in batch.to_pylist()]
            meet = {row[:2] for row in once for other in once if row[0] == other[0] and row[1] != other[1] and row[2] <= other[3] and other[2] <= row[3]}
            assert meet <= {(t["token"], t["node"]) for t in kept} <= {row[:2] for row in once} and len(kept) == len({(t["token"], t["node"]) for t in kept})
            ties = [(t["node"], t["partner"]) for t in kept if t["partner"] is not None]
            assert len(ties) < len(rows)
            root = roots(range(12), ties)
            for a, b in combinations(range(12), 2):
                if limit.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])) and not np.array_equal(sets[a], sets[b]):
                    assert root[a] == root[b]
                    met = {t["token"]: t for t in kept if t["node"] == a}
                    hits = sum(t["node"] == b and t["token"] in met and t["n"] <= met[t["token"]]["reach"] and met[t["token"]]["n"] <= t["reach"] for t in kept)
                    assert hits >= min(jaccard.HITS, max(limit.least(len(sets[a])), limit.least(len(sets[b]))))


def test_unlike_texts_do_not_ask(spark, monkeypatch):
    r = random.Random(7)
    line = "the same long line of words that every text holds more than once or twice over and over again"
    words = [f"v{i}" for i in range(3000)]
    rows = [(i, f"{line} {' '.join(r.choices(words, k=r.randint(4, 60)))} {line} x{i}") for i in range(300)]
    seen = {}
    kept = jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", lambda df, label, *more: seen.setdefault(label, kept(df, label, *more)))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()
    assert all(x["component_id"] == x["doc_id"] for x in got)
    assert seen["asks"].count() <= 150 and seen["links-asked"].count() <= 150


def test_shingles_of_words_over_step_bounds(monkeypatch):
    import pyarrow as pa

    from sparkwright.llm import bytewords

    texts = ["x" * 500 + " " + "ab cd " * 80, "", "q w e", "ab cd " * 300, "é" * 90 + " end"]
    want = shingle_sets(pa.array(texts), 3)
    for step in (1, 7, 64):
        monkeypatch.setattr(bytewords, "STEP", step)
        assert all(np.array_equal(a, b) for a, b in zip(want, shingle_sets(pa.array(texts), 3), strict=True))
    assert [len(s) for s in want] == [len(plain_set(t, 3)) for t in texts]


def vectors(seed=4, n=700, d=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, d))
    x = np.concatenate([r.normal(size=(n // 2, d)), centres[r.integers(12, size=n // 2)] + r.normal(size=(n // 2, d)) * 0.08])
    rows = [(int(i * 2), [float(c) for c in v], 0) for i, v in enumerate(x.astype(np.float32))]
    rows += [(5001, rows[-1][1], 0), (5003, rows[-1][1], 0), (5005, None, 1), (5007, [0.0] * d, 1), (5009, [float("nan")] * d, 1), (5011, [], 1), (5013, [1.0] * (d - 1) + [None], 1), (5020, [1.0, 2.0], 1), (5040, [float("inf")] * d, 2)]
    return rows


def test_near_vectors_match_brute_force(spark):
    rows = vectors()
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), shards=3).collect()}
    assert len(got) == len(rows)
    good = {i: np.array(v, float) / np.linalg.norm(v) for i, v, _ in rows if v and len(v) == 12 and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted(good)
    x = np.stack([good[i] for i in ids])
    links = (x @ x.T >= 0.95) & ~np.eye(len(ids), dtype=bool)
    n = dict(zip(ids, links.sum(axis=1).tolist(), strict=True))
    found = sum(got[i]["n_links"] for i in ids)
    assert found >= 0.9 * links.sum() and all(got[i]["n_links"] <= n[i] for i in ids)
    root = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(links), strict=True)])
    assert np.mean([got[i]["component_id"] == root[i] for i in ids]) > 0.97
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (5005, 5007, 5009, 5011, 5013, 5040))
    assert hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_matches_brute_force(spark):
    rows = [(i, v and [None if c is None else float(math.floor(8 * c)) if math.isfinite(c) else c for c in v], z) for i, v, z in vectors()]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, balltree.top_k(frame, frame.filter("vec_id % 10 = 0"), 7, shards=3).collect()))
    good = {i: v for i, v, _ in rows if v and None not in v and np.isfinite(v).all()}
    want = []
    for q in sorted(i for i in good if i % 10 == 0):
        scores = sorted((-int(np.dot(good[q], good[c])), c) for c in good if c != q and len(good[c]) == len(good[q]))
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:7])]
    assert got == want
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert balltree.top_k(none, none).count() == 0


def test_top_k_of_large_scores_and_repeated_queries(spark):
    r = np.random.default_rng(3)
    for size in (1 << 25, 1 << 29):  # scores near 2**52, and near 2**60 with products that doubles cannot hold
        x = r.integers(-size, size, (700, 4)).astype(float)
        x[100:200] = x[:100]
        rows = [(int(i * 5), v.tolist(), 1, "id", "v") for i, v in enumerate(x)]
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int, id string, v string")
        asked = frame.filter("vec_id % 100 = 0")
        got = sorted(tuple(g) for g in balltree.top_k(frame, asked.unionByName(asked), 20, shards=2).collect())
        want = []
        for i, v, *_ in rows:
            if i % 100 == 0:
                scores = sorted((-sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), j) for j, w, *_ in rows if j != i)
                want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:20])]
        assert got == want


def test_top_k_in_one_large_shard():
    n = 200_000
    x = np.full((n, 2), 1e7)
    tree = balltree.BallTree(np.arange(n), np.column_stack((x[:, 0] + np.arange(n) % 3, x[:, 1])))
    q = np.array([[1e7, 1e7]])
    where, ids, scores = next(tree.search(np.array([n - 1]), q, np.array([balltree.NONE]), 20))
    assert sorted(ids.tolist()) == list(range(2, 62, 3)) and set(scores.tolist()) == {int(1e7) * int(1e7 + 2) + 10**14}
