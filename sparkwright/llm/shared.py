"""What several operators of this folder need: shared tables, gapless numbers, components, shard streams."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only in local mode where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{_own_dir()}"


@lru_cache(maxsize=1)
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="sparkwright-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


#: Spark's bound on the bytes of an Arrow batch.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Tables that this session has written.
_written: list[str] = []


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which ``release`` deletes."""
    _written.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _written[-1]


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete the work tables of this session; frames that read them can't be used any more."""
    while _written:
        _delete(spark, _written.pop())


def materialise(df: DataFrame, label: str, after: list[str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, and lost executors do not lose it.

    ``after`` takes the new table's path; those in it before are deleted, as tables that only this one was made from.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    usual = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, "8m")  # long texts in small batches: a task holds several copies of one
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(BATCH) if usual is None else spark.conf.set(BATCH, usual)
    while after:
        _written.remove(after[-1])
        _delete(spark, after.pop())
    if after is not None:
        after.append(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, group: str, order: list[str], out: str, buckets: int = 4096) -> DataFrame:
    """Add column ``out``: numbers from 0 without gaps within each value of ``group`` (not null).

    Rows are split by a hash of ``order`` into buckets, so no task sorts a whole group: a count of each bucket gives
    its first number, and a window numbers the rows inside. Numbers follow (bucket, order); equal rows are tied in any order.
    """
    keyed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order))
    return keyed.withColumn("_inside", inside).join(starts, [group, "_bucket"]).withColumn(out, F.col("_start") + F.col("_inside") - 1).drop("_bucket", "_inside", "_start")


#: Links that a task contracts together.
CONTRACT = 1_000_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) to a forest of the same components: each node of a run of links with the least node it reaches there."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        nodes, at = np.unique(np.concatenate([x for pair in held for x in pair]), return_inverse=True)
        n = sum(len(a) for a, _ in held)
        parts, k = np.split(at, np.cumsum([len(x) for pair in held for x in pair])[:-1]), len(held)
        a, b = np.concatenate(parts[0::2]), np.concatenate(parts[1::2])
        root = np.arange(len(nodes))
        while k and n:  # the least root of both ends, then shorter ways to it, until nothing changes
            low = np.minimum(root[a], root[b])
            after = root.copy()
            np.minimum.at(after, root[a], low)
            np.minimum.at(after, root[b], low)
            np.minimum.at(after, a, low)
            np.minimum.at(after, b, low)
            after = after[after]
            if np.array_equal(after, root):
                break
            root = after
        out = np.flatnonzero(root != np.arange(len(nodes)))
        held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(nodes[out], pa.int64()), pa.array(nodes[root[out]], pa.int64())], ["a", "b"])

    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy() for i in (0, 1)))
        if sum(len(a) for a, _ in held) >= CONTRACT:
            yield from flush()
    if held:
        yield from flush()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: longs); root is the smallest node that links reach.

    Tasks first contract their own links to forests. Then large-star and small-star steps alternate until every node
    hangs on a root; a step is one aggregation and one join, whose other side has one row a node.
    """
    own = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    rounds: list[str] = []
    e = materialise(own.mapInArrow(_contracted, "a long, b long").distinct(), label, rounds)
    while True:
        several = e.groupBy("a").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("n"))
        chained = several.join(e.select(F.col("b").alias("a")), "a", "left_semi").limit(1)
        if several.filter("n > 1").limit(1).select("a").unionByName(chained.select("a")).isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = e.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b")
        e = materialise(small.mapInArrow(_contracted, "a long, b long").distinct(), label, rounds)
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def shard_stream(index: DataFrame, queries: DataFrame, shards: int, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, home: str | None = None) -> DataFrame:
    """Give each of ``shards`` tasks its own rows of ``index`` (column shard) first, then every row of ``queries``, as a stream.

    Both frames have the same columns besides ``shard``. ``run`` sees a column ``role``: 0 for index rows, 1 for queries.
    Memory is one shard of the index and one batch of queries; queries are copied once a shard, but not to the one in
    their column ``home`` if that is named.
    """
    own = index.withColumn("role", F.lit(0))
    asked = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("role", F.lit(1))
    asked = asked.filter(F.col("shard") != F.col(home)) if home else asked
    rows = own.unionByName(asked.select(*own.columns)).repartitionById(shards, F.col("shard").cast("int"))
    return rows.sortWithinPartitions("role").mapInArrow(run, schema)


def maybe_among(df: DataFrame, key: str, ids: DataFrame, bits: int = 24) -> DataFrame:
    """The rows of df as a struct ``row``, and a boolean ``maybe``: false only where the key is not in ``ids`` (column of that name).

    A filter of 2**bits bits (2 MB, whatever the data) is broadcast, so that rows which a join would drop need not be
    shuffled for it. The more ids there are, the fewer rows it spares; the join after it decides. Being in a struct, the
    columns of df may have any names.
    """
    at = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    own = ids.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32768).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
    rows = df.select(F.struct("*").alias("row"), at.alias("at"))
    held = rows.withColumn("part", F.floor(F.col("at") / 32768)).join(F.broadcast(own), "part", "left")
    byte = F.expr("CAST(conv(hex(substring(bits, CAST((at % 32768) div 8 AS INT) + 1, 1)), 16, 10) AS INT)")
    bit = byte.bitwiseAND(F.expr("shiftleft(1, CAST(at % 8 AS INT))")) != 0
    return held.select("row", F.coalesce(bit, F.lit(False)).alias("maybe"))


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def checksum(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes, unsigned; that of no bytes (0) for null."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
