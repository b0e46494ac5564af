"""Traversal of property graphs: nodes and edges (src, dst) as frames, one join a step. Work tables are cut by checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their history, in the folder that all executors share; one of our own only in local mode where none is set."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or _own_folder())
    return df.checkpoint()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="sparkwright-graph-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def rounds(most: int | None) -> Iterator[int]:
    """1, 2, 3 and so on, up to ``most`` where it is given."""
    return count(1) if most is None else iter(range(1, most + 1))


def gathered(found: DataFrame, keys: list[str], step: int) -> DataFrame:
    """What the steps have found; every sixteenth step makes one table of it, so that long chains keep a short plan."""
    return found if step % 16 else cut(found.repartition(*keys))


def reach(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(start, node, depth) of all nodes that directed edges reach from each start, itself left out unless a cycle returns to it.

    A frontier loop: each step joins the nodes found last with the edges and drops what is known, until nothing is new (or ``most`` steps).
    """
    e = edges.select("src", "dst").distinct()
    front = cut(starts.select(F.col("node").alias("start"), "node").distinct().join(e, F.col("node") == e["src"]).select("start", F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(1)))
    seen = front
    for step in rounds(None if most is None else most - 1):
        front = cut(front.join(e, F.col("node") == e["src"]).select("start", F.col("dst").alias("node")).distinct().join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(step + 1)))
        if front.isEmpty():
            break
        seen = gathered(seen.unionByName(front), ["start", "node"], step)
    return seen


def ancestors(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    return reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), starts, most)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """(source, target, hops, path) by hops; of equally short paths the one that is least as a list. Pairs without a path are left out."""
    e = edges.select("src", "dst").distinct()
    wanted = pairs.select("source", "target").distinct()
    front = cut(wanted.select("source").distinct().select("source", F.col("source").alias("node"), F.array("source").alias("path")))
    found = front
    for n in rounds(most):
        step = front.join(e, F.col("node") == e["src"]).select("source", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        front = cut(step.groupBy("source", "node").agg(F.min("path").alias("path")).join(found.select("source", "node"), ["source", "node"], "left_anti"))
        if front.isEmpty():
            break
        found = gathered(found.unionByName(front), ["source", "node"], n)
    return wanted.join(found.withColumnRenamed("node", "target"), ["source", "target"]).select("source", "target", (F.size("path") - 1).alias("hops"), "path")


def simple_paths(edges: DataFrame, source, target, most: int | None = None) -> DataFrame:
    """(path) of all simple paths between two nodes, of at most ``most`` edges where it is given."""
    e = edges.select("src", "dst").distinct()
    front = e.filter(F.col("src") == source).select(F.array("src", "dst").alias("path"), F.col("dst").alias("node"))
    out = None
    for n in rounds(most):
        front = cut(front)
        hit = front.filter(F.col("node") == target).select("path")
        out = hit if out is None else gathered(out.unionByName(hit), ["path"], n)
        front = front.filter(F.col("node") != target)
        if front.isEmpty():
            break
        front = front.join(e, F.col("node") == e["src"]).filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node"))
    return out


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges, whatever their direction: the least node that they reach.

    Large-star and small-star steps: a node hands its neighbours its least one, until every node hangs on a least one of its own.
    """
    e = cut(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).filter("a <> b").distinct())
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        large = e.join(least, "b").select("a", F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        after = cut(small)
        if after.exceptAll(e).isEmpty() and e.exceptAll(after).isEmpty():
            break
        e = after
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.join(e.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("component"))


def cascade(artifacts: DataFrame, edges: DataFrame, changed: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Artifacts (id, status) and units (id, artifact, status) after some artifacts (id) have changed.

    What is derived from them (edges: src, dst), directly or not, and they themselves are INVALIDATED, and the units that made
    them are READY again; siblings on other branches keep their status.
    """
    hit = changed.select(F.col("id")).unionByName(reach(edges, changed.select(F.col("id").alias("node"))).select(F.col("node").alias("id"))).distinct().withColumn("hit", F.lit(True))
    made = artifacts.join(hit, "id", "left").withColumn("status", F.when(F.col("hit"), "INVALIDATED").otherwise(F.col("status"))).drop("hit")
    again = units.join(hit.withColumnRenamed("id", "artifact"), "artifact", "left").withColumn("status", F.when(F.col("hit"), "READY").otherwise(F.col("status"))).drop("hit")
    return made, again


def missing_tags(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted tags (tag) that no node has as its id or tag; none: the drawing is complete."""
    have = nodes.select(F.col("node_id").alias("tag")).unionByName(nodes.select("tag")).distinct()
    return wanted.select("tag").distinct().join(have, "tag", "left_anti")


def valves_on(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, tag) of the distinct valves on each path, with the place of the first."""
    steps = paths.select("source", "target", F.posexplode("path").alias("place", "node_id"))
    return steps.join(nodes.filter("kind = 'valve'").select("node_id", "tag"), "node_id").groupBy("source", "target", "tag").agg(F.min("place").alias("place"))


def predecessors(edges: DataFrame, node) -> DataFrame:
    return edges.filter(F.col("dst") == node).select("src").distinct()


def resolve(nodes: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag, node_id): nodes with that id or tag, ids with a prefix first."""
    from pyspark.sql import Window

    n = nodes.select("node_id", F.col("tag").alias("t"))
    hit = tags.join(n, F.col("tag") == F.col("node_id")).unionByName(tags.join(n, F.col("tag") == F.col("t"))).distinct()
    order = Window.partitionBy("tag").orderBy(F.when(F.col("node_id").contains("_"), 0).otherwise(1), "node_id")
    return hit.withColumn("n", F.row_number().over(order)).filter("n = 1").select("tag", "node_id")
