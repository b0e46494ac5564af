"""Streams run to the end on files, with the results of their batch twins."""

from pyspark.sql import functions as F

from sparkwright.streaming import streams


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def write_events(spark, path, n=60):
    rows = spark.range(n).select(F.col("id").alias("event_id"), (F.timestamp_seconds(F.col("id") * 30)).cast("timestamp_ntz").alias("ts"), (F.col("id") % 3).alias("user_id"), F.when(F.col("id") % 2 == 0, "click").otherwise("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    rows.repartition(3).write.parquet(path)


def test_windowed_and_once(spark, tmp_path):
    write_events(spark, f"{tmp_path}/e")
    frames = run(streams.frames(streams.events(spark, f"{tmp_path}/e")), "frames")
    assert frames.count() == 60 and '"event_id"' in frames.first()["data"]
    once = run(streams.violations_once(streams.events(spark, f"{tmp_path}/e", 10), ["user_id", "event_type"]), "once")
    assert once.count() == 6
    out = run(streams.windowed(streams.events(spark, f"{tmp_path}/e", 10)), "windows", "complete")
    assert out.agg(F.sum("n")).first()[0] == 60


def test_requests_and_frames(spark, tmp_path):
    from sparkwright.operators import audit

    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.txt").write_text('{"method": "ping"}\n{broken\n\n{"method": "what"}\n')
    got = run(audit.dispatch(streams.requests(spark, f"{tmp_path}/r")), "rpc").collect()
    assert sorted((r["kind"], r["code"] or 0) for r in got) == [("error", -32700), ("error", -32601), ("result", 0)]
    write_events(spark, f"{tmp_path}/e", 4)
    assert all(r["frame"].startswith("event: ") and r["frame"].endswith("\n\n") for r in streams.sse(spark.read.parquet(f"{tmp_path}/e")).collect())


def test_leases(spark, tmp_path):
    rows = [("a", "EXECUTING", 0.0, 60.0), ("a", "EXECUTING", 100.0, 60.0), ("a", "EXECUTING", 300.0, 60.0), ("a", "READY", 900.0, 60.0), ("b", "EXECUTING", 0.0, 60.0), ("b", "COMMITTED", 30.0, 60.0)]
    spark.createDataFrame(rows, "unit_id string, status string, now double, ttl double").write.parquet(f"{tmp_path}/u")
    stream = spark.readStream.schema("unit_id string, status string, now double, ttl double").parquet(f"{tmp_path}/u")
    got = run(streams.lease_timers(stream), "leases").collect()
    assert [(r["unit_id"], r["action"], r["retry_count"]) for r in got] == [("a", "READY", 1), ("a", "READY", 2), ("a", "WAITING_HUMAN", 3)]


def test_single_writer(spark, tmp_path):
    write_events(spark, f"{tmp_path}/e")
    for _ in range(2):  # the second start finds nothing new
        q = streams.append_ledger(streams.events(spark, f"{tmp_path}/e"), f"{tmp_path}/ledger", f"{tmp_path}/ck")
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(f"{tmp_path}/ledger").count() == 60


def test_batch_twins(spark):
    rows = spark.range(2000).select(F.lit(1).alias("k"), "id", F.col("id").cast("string").alias("p"))
    kept = streams.ring(rows, "k", "id", "p")
    assert kept.count() == streams.RING and kept.agg(F.max("seq")).first()[0] == streams.RING - 1
