"""Sharding and mixing: laws of the results, and brute-force versions."""

import math
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from sparkwright.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string, shard string, row long, g long"
ROWS = [(i, f"text {i % 37}" * (i % 5), f"s{i % 7 if i % 3 else 0}", "clash", i, i) for i in range(600)]
ODD = [(5, "twice", "s1", None, 1, 1), (5, "twice", "s1", None, 1, 1), (None, None, None, None, None, None), (9000, "", "unknown", "x", 0, 0), (9001, "ü" * 20_000, "s2", "x", 0, 0)]


def draw(key, s, w):
    seed = 42
    if key is not None:
        seed = xxhash.xxh64(struct.pack("<q", key), seed=seed).intdigest()
    h = xxhash.xxh64(struct.pack("<i", s), seed=seed).intdigest()
    return w / -math.log(((h >> 11) + 0.5) * 2.0**-53)


def test_shards_match_brute_force(spark):
    got = sharding.shard_rows(spark.createDataFrame(ROWS + ODD, SCHEMA)).collect()
    assert len(got) == len(ROWS + ODD)
    texts = defaultdict(list)
    for k, t, *_ in ROWS + ODD:
        texts[k].append(t)
    slots = defaultdict(list)
    for r in got:
        t = texts[r["doc_id"]][0] or ""
        if r["doc_id"] != 5:
            assert (r["size"], r["text_crc32"]) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
        draws = [draw(r["doc_id"], s, 1.0) for s in range(17)]
        assert r["shard"] == draws.index(max(draws[:16])) and r["grown_shard"] == draws.index(max(draws)) and r["law"] == "key"
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got)


def test_weighted_shards(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "'t' AS text")
    n = Counter(r["shard"] for r in sharding.shard_rows(df, (1.0, 2.0, 5.0)).collect())
    assert all(abs(n[s] / 20_000 - w / 8) < 0.02 for s, w in enumerate((1, 2, 5)))
    assert sharding.shard_rows(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_rows(df, (1.0, 0.0))


def fluid(counts, weights, slot):
    """Blocks that the fluid schedule has given each source when ``slot`` slots are over, by bisection on virtual time."""
    low, high = 0.0, max(n / w for n, w in zip(counts, weights, strict=True)) + 1
    for _ in range(200):
        v = (low + high) / 2
        low, high = (v, high) if sum(min(n, w * v) for n, w in zip(counts, weights, strict=True)) < slot else (low, v)
    return [min(n, w * low) for n, w in zip(counts, weights, strict=True)]


def greedy(counts, weights):
    """Earliest deadline first among released blocks, slot by slot, over the whole schedule."""
    done, out = [0] * len(counts), []
    for t in range(sum(counts)):
        can = []
        for k, (n, w) in enumerate(zip(counts, weights, strict=True)):
            if done[k] < n and sum(min(m * w, v * done[k]) for m, v in zip(counts, weights, strict=True)) <= t * w:
                can.append(((done[k] + 1) / w, k))
        k = min(can)[1]
        done[k] += 1
        out.append(k)
    return out


@pytest.mark.parametrize("block", [1, 3])
def test_mixing_is_pfair(spark, block):
    weights = {"s0": 5, "s1": 1, "s2": 3, "s3": 2, "absent": 4}
    docs = spark.createDataFrame(ROWS + ODD, SCHEMA)
    got = mixing.mix(docs, weights, rest=2, block=block).collect()
    assert len(got) == len(ROWS + ODD)
    names, w = [*weights, "rest"], [*weights.values(), 2]
    of = lambda s: names.index(s) if s in weights else len(names) - 1
    assert sorted(r["position"] for r in got) == list(range(len(got)))
    rows = Counter(of(r["source"]) for r in got)
    counts = [-(-rows[k] // block) for k in range(len(names))]
    slots = {}
    for r in got:
        assert r["release"] <= r["block_slot"] < r["deadline"]
        assert slots.setdefault(r["block_slot"], (of(r["source"]), r["block"])) == (of(r["source"]), r["block"])
    assert sorted(slots) == list(range(sum(counts)))
    assert [slots[t][0] for t in range(len(slots))] == greedy(counts, w)
    done = [0] * len(names)
    for t in range(len(slots)):
        done[slots[t][0]] += 1
        assert all(abs(a - b) < 1 for a, b in zip(done, fluid(counts, w, t + 1), strict=True))
    order = [slots[r["block_slot"]] for r in sorted(got, key=lambda r: r["position"])]
    assert [k for i, k in enumerate(order) if not i or order[i - 1] != k] == [slots[t] for t in range(len(slots))]


def test_mixed_rows_keep_all_columns(spark):
    docs = spark.createDataFrame(ROWS + ODD, SCHEMA)
    out = mixing.mixed_rows(docs, {"s0": 2, "s1": 1})
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert mixing.mixed_rows(spark.createDataFrame([], SCHEMA), {"s0": 2}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s0": 0})


def test_work_tables_can_be_released(spark):
    from sparkwright.llm import shared

    df = shared.materialise(spark.range(5), "numbers")
    assert df.count() == 5 and df.inputFiles()
    shared.release(spark)
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_components_match_union_find(spark, monkeypatch):
    import random

    from sparkwright.llm import shared

    r = random.Random(6)
    pairs = [(i, i + 1) for i in range(1000, 1400)] + [(i, i // 2) for i in range(2, 300)] + [(r.randrange(5000, 9000), r.randrange(5000, 9000)) for _ in range(1500)] + [(7, 7)]
    root = {n: n for p in pairs for n in p if p[0] != p[1]}
    for _ in range(600):
        before = dict(root)
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    for most in (1_000_000, 50):
        monkeypatch.setattr(shared, "CONTRACT", most)
        df = spark.createDataFrame(pairs, "a long, b long").repartition(5)
        assert {x["node"]: x["root"] for x in shared.components(df).collect()} == root
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_filter_never_misses(spark):
    from sparkwright.llm.shared import maybe_among

    ids = spark.range(0, 4000, 7).withColumnRenamed("id", "k")
    df = spark.range(4000).withColumnRenamed("id", "k").union(spark.createDataFrame([(None,)], "k long"))
    got = {r["row"]["k"]: r["maybe"] for r in maybe_among(df, "k", ids, 17).collect()}
    assert len(got) == 4001 and all(got[k] for k in range(0, 4000, 7)) and sum(got.values()) < 700
    assert not any(r["maybe"] for r in maybe_among(df, "k", ids.limit(0)).collect())
    odd = df.selectExpr("k", "k AS row", "k AS maybe", "k AS at", "k AS bits", "k AS `a.b`")
    assert maybe_among(odd, "k", ids).select("row.*").columns == odd.columns
