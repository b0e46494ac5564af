"""Words as substrings: the search word by word against the plain count in whole texts."""

import random

from sparkwright.operators import retrieval
from sparkwright.plans import catalog


def plain(corpus, queries):
    split = lambda t: [w for w in retrieval.WORD.findall((t or "").lower())]
    out = {(q, c): float(sum((text or "").lower().count(w) for w in split(asked))) for q, asked in queries for c, text in corpus}
    return {k: n for k, n in out.items() if n}


def test_substrings_equal_the_plain_count(spark, monkeypatch):
    r = random.Random(6)
    word = lambda: "".join(r.choice("aabé \U0001f600") for _ in range(r.choice([1, 2, 3, 4, 9, 90])))
    text = lambda n: "".join(word() + r.choice(" \t\n\x0b\x0c\r\x1f") for _ in range(n))
    corpus = [(i, text(r.randint(0, 12))) for i in range(120)] + [(200, None), (201, ""), (202, "  "), (203, "AAA aaaa"), (204, "a" * 400), *[(k, "aaaa b") for k in range(300, 330)]]
    queries = [(i, text(r.randint(0, 5))) for i in range(9)] + [(20, "aa AA b"), (21, None), (22, " "), (23, "é")]
    c, q = spark.createDataFrame(corpus, "chunk_id long, text string").repartition(3), spark.createDataFrame(queries, "query_id int, query string")
    want = plain(corpus, queries)
    assert {(x["query_id"], x["chunk_id"]): x["score"] for x in retrieval.substring_tf(c, q).collect()} == want
    best = lambda df: sorted(map(tuple, retrieval.best(df, 7).select("query_id", "rank", "chunk_id", "score").collect()))
    assert best(retrieval.substring_tf(c, q, 7)) == best(retrieval.substring_tf(c, q))
    # the same in small tables, pieces and memories
    asked = retrieval.substring_tf  # the batches are made here, in this process
    import pyarrow as pa

    terms = {(k, w): 0 for k, t in queries for w in retrieval.WORD.findall((t or "").lower())}
    for k, t in queries:
        for w in retrieval.WORD.findall((t or "").lower()):
            terms[k, w] += 1
    table = pa.table({"query_id": [k for k, _ in terms], "q": [w for _, w in terms], "times": list(terms.values())})
    for name, value in {"CELLS": 3 * len(set(w for _, w in terms)), "COUNTED": 4, "KEPT": 20, "PIECE": 30}.items():
        monkeypatch.setattr(retrieval, name, value)
    batch = pa.record_batch({"chunk_id": [k for k, _ in corpus], "low": [(t or "").lower() for _, t in corpus]})
    got = [x for b in retrieval._substrings(iter([batch]), table, None) for x in b.to_pylist()]
    assert asked and {(x["query_id"], x["chunk_id"]): x["score"] for x in got} == want and len(got) == len(want)


def test_texts_do_not_meet_each_word_in_a_join(spark):
    plan = catalog.QUERIES["substring_topn"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
