"""Registered queries read their whole tables."""

from pathlib import Path

import pytest

from sparkwright.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


def test_no_subset(spark):
    docs = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").filter("text rlike '\\\\S'").collect()}
    assert {r["doc_id"] for r in catalog.QUERIES["chunk_json"](spark, str(DATA)).collect()} == docs
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert catalog.QUERIES["calc_steps"](spark, str(DATA)).count() == 5 * lines
    assert catalog.QUERIES["corrosion_life"](spark, str(DATA)).count() == lines


def test_own_bounds(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    got = catalog.QUERIES["ring_fifo"](spark, str(DATA)).collect()
    assert len(got) == events.count() and {bytes.fromhex(r["payload"]).decode() for r in got} == {r["props"] for r in events.select("props").collect()}
    assert catalog.QUERIES["fan_out"](spark, str(DATA)).groupBy("subscriber").count().selectExpr("max(`count`)").first()[0] == 128
