"""The search in blocks against the plain cosine of all pairs."""

import numpy as np
import pytest

from sparkwright.operators import retrieval
from sparkwright.plans import catalog


def same(a, b):
    plain = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], str(r["score"] + 0.0)) for r in df.select("query_id", "rank", "chunk_id", "score").collect())
    return plain(a) == plain(b)


@pytest.mark.parametrize("kind", ["normal", "ties", "odd"])
def test_nearest_equals_all_pairs(spark, kind):
    r = np.random.default_rng(5)
    x = r.normal(size=(9000 if kind == "normal" else 600, 8))
    rows = [(i, row.tolist()) for i, row in enumerate(x if kind == "normal" else np.round(x))]
    if kind == "odd":
        nan, inf = float("nan"), float("inf")
        rows += [(1000, None), (1001, [0.0] * 8), (1002, [None] * 8), (1003, []), (1004, [1.0] * 3), (1005, [1.0, 2.0, 3.0]), (1006, [nan] + [1.0] * 7), (1007, [inf] + [1.0] * 7), (1008, [1e-170] * 8), (1009, [1e200] * 8), (1010, [1.0] * 5)]
    v = spark.createDataFrame(rows, "chunk_id long, v array<double>").repartition(3)
    q = v.filter("chunk_id % 50 = 0 OR chunk_id IN (1001, 1002, 1004, 1006, 1007, 1009)").selectExpr("chunk_id AS query_id", "v AS q")
    for k in (1, 10, 700):
        if kind != "normal" or k == 10:
            want = retrieval.best(retrieval.cosine(v, q).filter("query_id <> chunk_id"), k)
            assert same(retrieval.nearest(v, q, k), want)


def test_rounding_as_spark_does(spark):
    values = [0.0000005, 0.1234565, 0.9999995, -0.1234565, 0.12345649999999999, 1.0000004999999999, float("inf"), 0.3333335, 0.7071065, *[(2 * i + 1) / 2e6 for i in range(2000)]]
    want = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").orderBy("i").selectExpr("round(x, 6)").collect()]
    assert retrieval._six(np.array(values)).tolist() == want


def test_neighbours_are_not_found_by_a_join_of_all_pairs(spark):
    plan = catalog.QUERIES["cosine_neighbours"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
