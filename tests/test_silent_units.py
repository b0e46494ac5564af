"""Leases of units that send nothing more, and what depends on them."""

from pyspark.sql import functions as F

from sparkwright.operators import ledger
from sparkwright.streaming import streams

UNIT = "unit_id string, status string, now double, ttl double"


def test_silent_unit(spark, tmp_path):
    batches = [[("a", "EXECUTING", 0.0, 60.0), ("c", "EXECUTING", 0.0, 500.0)], [("b", "READY", 100.0, 60.0)], [("d", "EXECUTING", 10.0, 60.0), ("c", "COMMITTED", 90.0, 60.0)]]
    (tmp_path / "u").mkdir()
    stream = spark.readStream.schema(UNIT).parquet(f"{tmp_path}/u")
    q = streams.lease_timers(stream).writeStream.format("memory").queryName("silent").option("checkpointLocation", f"{tmp_path}/ck").start()
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, UNIT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/u")
        q.processAllAvailable()
        seen.append(sorted((r["unit_id"], r["action"], r["retry_count"]) for r in spark.table("silent").collect()))
    q.stop()
    assert seen == [[], [("a", "READY", 1)], [("a", "READY", 1), ("d", "READY", 1)]]  # d comes late, with its lease past; c's row behind the clock counts


def test_sweep(spark):
    rows = [("A", "EXECUTING", 2), ("B", "READY", 0), ("C", "PROPOSED", 0), ("D", "COMMITTED", 0), ("E", "EXECUTING", 0), ("F", "READY", 0)]
    units = spark.createDataFrame(rows, "id string, status string, retry_count int").withColumns({"execution_lease_id": F.lit("L"), "lease_expires_at": F.lit("2020-01-01").cast("timestamp_ntz")})
    needs = spark.createDataFrame([("B", "A"), ("C", "B"), ("D", "A"), ("F", "E")], "id string, needs string")
    got = ledger.sweep(units, needs, F.lit("2021-01-01").cast("timestamp_ntz")).collect()
    assert {r["id"]: r["status"] for r in got} == {"A": "WAITING_HUMAN", "B": "BLOCKED", "C": "BLOCKED", "D": "COMMITTED", "E": "READY", "F": "READY"}
    assert len(got) == len(rows)
