"""A drawing with known truth, for tests of geometry and graphs: a chain of equipment with runs between neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("tank", "pump", "valve", "exchanger")


def drawing(spark: SparkSession, drawings: int = 1, symbols: int = 8, gap: float = 200.0, shift: float = 10.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, runs, true edges) of drawings whose symbols stand in a row; run ends are off their symbols by ``shift``."""
    d = spark.range(drawings).withColumnRenamed("id", "drawing_id")
    n = d.select("drawing_id", F.explode(F.sequence(F.lit(0), F.lit(symbols - 1))).alias("i"))
    name = lambda i: F.format_string("S-%03d", i)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("i") % len(KINDS) + 1)
    nodes = n.select("drawing_id", name(F.col("i")).alias("node_id"), kind.alias("sub_type"), (F.col("i") * gap).alias("x"), F.lit(300.0).alias("y"))
    links = n.filter(F.col("i") < symbols - 1)
    point = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    # a run leaves a pump above its centre and enters one from below, as flow does
    first = point(F.col("i") * gap + shift, 300.0 - shift)
    last = point((F.col("i") + 1) * gap - shift, 300.0 + shift)
    runs = links.select("drawing_id", F.col("i").cast("long").alias("run_id"), F.array(first, last).alias("points"), F.lit(False).alias("reverse"))
    truth = links.select("drawing_id", name(F.col("i")).alias("src"), name(F.col("i") + 1).alias("dst"))
    return nodes, runs, truth
