"""Queries of the library's own operators over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.plans import catalog_documents, catalog_records, catalog_shapes, catalog_surfaces, catalog_workbench

PARTS = (catalog_documents, catalog_records, catalog_shapes, catalog_workbench, catalog_surfaces)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in PARTS for k, v in p.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for p in PARTS for k, v in p.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval of the benchmark passages among the documents."""
    return QUERIES["hybrid_retrieve"](spark, sf_dir).withColumn("score", F.col("score"))
