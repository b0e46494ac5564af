"""Chains longer than any fixed number of steps."""

from sparkwright.operators import graph


def test_long_chain(spark):
    n = 66
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long").coalesce(1)
    down = graph.reach(edges, spark.createDataFrame([(0,)], "node long")).collect()
    assert {(r["node"], r["depth"]) for r in down} == {(i, i) for i in range(1, n + 1)}
    path = graph.shortest_paths(edges, spark.createDataFrame([(n - 34, n)], "source long, target long")).collect()
    assert [(r["hops"], r["path"]) for r in path] == [(34, list(range(n - 34, n + 1)))]
    assert [r["path"] for r in graph.simple_paths(edges, n - 14, n).collect()] == [list(range(n - 14, n + 1))]


def test_bounds_that_are_asked_for(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long").coalesce(1)
    start = spark.createDataFrame([(0,)], "node long")
    assert [graph.reach(edges, start, n).count() for n in (1, 3)] == [1, 3]
    assert graph.shortest_paths(edges, spark.createDataFrame([(0, 4)], "source long, target long"), 3).count() == 0
    assert graph.simple_paths(edges, 0, 4, 4).count() == 1 and graph.simple_paths(edges, 0, 4, 3).count() == 0
