"""Streams of workbench events: heartbeats, bounded backlogs, violations once, lease timers."""

from __future__ import annotations

import struct
import threading
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RING, SLOT, QUEUE = 1024, 4096, 128
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """Parquet files of events as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def frames(stream: DataFrame) -> DataFrame:
    """(event_type, data) with the event as JSON; works on batches and streams."""
    return stream.select("event_type", F.to_json(F.struct("event_id", "user_id", "value", "ts")).alias("data"), "ts")


def sse(stream: DataFrame) -> DataFrame:
    """The text of each event as a server-sent frame."""
    return frames(stream).select(F.concat(F.lit("event: "), "event_type", F.lit("\ndata: "), "data", F.lit("\n\n")).alias("frame"))


def requests(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON-RPC requests as a stream (request_id: a hash of the line)."""
    return spark.readStream.text(path).filter(F.trim("value") != "").select(F.xxhash64("value").alias("request_id"), F.col("value").alias("body"))


def violations_once(stream: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Each combination of keys once within the watermark."""
    at = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return at.dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, size: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums a window and type."""
    at = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return at.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def heartbeat_gaps(rows: DataFrame, key: str, seconds: float, tie: str) -> DataFrame:
    """Batch twin of the idle heartbeat: (key, ts, beats) where the next event is more than ``seconds`` later."""
    after = F.lead("ts").over(Window.partitionBy(key).orderBy("ts", tie))
    gap = F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.withColumn("gap", gap / F.lit(1e6)).filter(F.col("gap") > seconds).select(key, tie, F.floor(F.col("gap") / seconds).alias("beats"))


def ring(rows: DataFrame, key: str, order: str, payload: str, slots: int = RING, size: int = SLOT) -> DataFrame:
    """What a bounded ring keeps when nothing is consumed: the first ``slots`` messages of a key, cut to ``size`` bytes, with their sequence from 0."""
    seq = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return rows.withColumn("seq", seq).filter(F.col("seq") < slots).select(key, "seq", F.substring(F.encode(F.coalesce(payload, F.lit("")), "UTF-8"), 1, size).alias("payload"))


def fan_out(batch: DataFrame, subscribers: DataFrame, most: int = QUEUE) -> DataFrame:
    """Each subscriber's first ``most`` events of a batch, by id; what comes when the queue is full is dropped.

    subscribers: subscriber, event_type.
    """
    rows = batch.join(subscribers, "event_type")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("subscriber").orderBy("event_id"))).filter(F.col("n") <= most).drop("n")


LEASE_OUT = "unit_id string, action string, retry_count int"
LEASE_STATE = "status string, lease_until double, retry_count int"


def lease_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of one unit: status, lease and strikes. Input: unit_id, status, now, ttl (seconds), at; an executing unit whose lease is past is reclaimed.

    Rows with ``at`` only move the clock. The lease is past when a later row of the unit or the clock of all units says so.
    """
    status, until, retries = state.get if state.exists else ("PROPOSED", 0.0, 0)
    out = []

    def reclaim() -> None:
        nonlocal status, until, retries
        retries += 1
        status, until = "WAITING_HUMAN" if retries >= 3 else "READY", 0.0
        out.append((key[0], status, retries))

    for b in batches:
        for r in b[b["at"].isna()].sort_values("now").itertuples(index=False):
            if status == "EXECUTING" and r.now > until:
                reclaim()
            if status != "WAITING_HUMAN":
                status, until = r.status, r.now + r.ttl if r.status == "EXECUTING" else 0.0
    clock = state.getCurrentWatermarkMs()
    if status == "EXECUTING" and clock > until * 1000:
        reclaim()
    state.update((status, until, retries))
    if status == "EXECUTING":
        state.setTimeoutTimestamp(max(int(until * 1000), clock, 1))
    yield pd.DataFrame(out, columns=["unit_id", "action", "retry_count"])


def lease_timers(stream: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Reclaimed leases of a stream of unit changes, also of units that send nothing more: the clock is the latest ``now`` of any unit, less ``delay``.

    Each row comes twice: as itself, without an event time, so that Spark never drops it as late, and as a tick of the clock.
    """
    ticks = F.explode(F.array(F.lit(None).cast("timestamp"), F.timestamp_seconds("now"))).alias("at")
    rows = stream.select("unit_id", "status", "now", "ttl", ticks).withWatermark("at", delay)
    return rows.groupBy("unit_id").applyInPandasWithState(lease_step, LEASE_OUT, LEASE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


#: The writer's tries, its first and longest wait (seconds), and what a caller waits for its turn.
TRIES, WAIT, LONGEST, BARRIER = 10, 0.005, 0.5, 5.0


def retried(action: Callable[[], object], busy: Callable[[Exception], bool], tries: int = TRIES, sleep: Callable[[float], None] = time.sleep):
    """The action's result; while it fails because the store is busy it is tried again, with waits that double."""
    for n in range(tries):
        try:
            return action()
        except Exception as e:
            if n == tries - 1 or not busy(e):
                raise
            sleep(min(LONGEST, WAIT * 2**n))


def append_ledger(stream: DataFrame, path: str, checkpoint: str, busy: Callable[[Exception], bool] = lambda e: "lock" in str(e).lower() or "busy" in str(e).lower()):
    """The single writer: each batch is appended once, under its own id, so that a repeated batch overwrites itself; a busy store is tried again."""

    def write(batch: DataFrame, number: int) -> None:
        retried(lambda: batch.write.mode("overwrite").parquet(f"{path}/batch={number}"), busy)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def flush(query, seconds: float = BARRIER) -> bool:
    """Wait until all that has come to a stream is written; whether it was in time."""
    done = threading.Event()
    threading.Thread(target=lambda: (query.processAllAvailable(), done.set()), daemon=True).start()
    return done.wait(seconds)


#: The kinds of events that the workbench tells its subscribers.
KINDS = ("ast_violation", "sandbox_run", "z3_evaluation", "agent_turn")
IDLE = 2.0
GREETING = '{"status": "connected", "airgap": "PASS", "wan_egress": 0}'


def told(rows: DataFrame) -> DataFrame:
    """Rows of the kinds that subscribers are told of."""
    return rows.filter(F.col("event_type").isin(*KINDS))


def sessions_of(rows: DataFrame, key: str, connected: Column, idle: float = IDLE, most: int | None = None) -> DataFrame:
    """(key, seq, event, at): what a subscriber's stream sends: a greeting, its events, a heartbeat after each ``idle`` seconds of silence.

    rows: key, ts, event_id, event_type; ``connected`` is the time of the greeting, where events before it are not seen. The stream
    stops after ``most`` messages. Heartbeats fill the gaps between messages, so they need the next event to come.
    """
    second = lambda c: F.unix_micros(c.cast("timestamp")) / F.lit(1e6)
    seen = rows.withColumn("start", second(connected)).withColumn("at", second(F.col("ts"))).filter("at >= start")
    greet = seen.groupBy(key).agg(F.min("start").alias("at")).select(key, "at", F.lit(-1).cast("long").alias("event_id"), F.lit("connect").alias("event"))
    all_ = greet.unionByName(seen.select(key, "at", F.col("event_id").cast("long"), F.col("event_type").alias("event")))
    order = Window.partitionBy(key).orderBy("at", "event_id")
    gap = F.coalesce(F.lead("at").over(order) - F.col("at"), F.lit(0.0))
    beats = F.ceil(gap / idle) - 1  # a message in the very moment comes instead of the beat
    beats = F.when(beats > 0, F.transform(F.sequence(F.lit(1), F.greatest(beats, F.lit(1))), lambda i: F.struct((F.col("at") + i * idle).alias("at"), F.lit("heartbeat").alias("event"))))
    own = F.array(F.struct("at", "event"))
    sent = all_.withColumn("b", F.concat(own, F.coalesce(beats, F.array().cast("array<struct<at:double,event:string>>")))).select(key, "event_id", F.posexplode("b").alias("place", "m"))
    out = sent.select(key, F.row_number().over(Window.partitionBy(key).orderBy("m.at", "event_id", "place")).alias("seq"), F.col("m.event").alias("event"), F.col("m.at").alias("at"))
    return out if most is None else out.filter(F.col("seq") <= most)


def pulse(spark: SparkSession, seconds: int = 5) -> DataFrame:
    """A stream of heartbeats (n, at), one each few seconds."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.filter(F.col("value") % seconds == 0).select((F.col("value") / seconds).cast("long").alias("n"), F.col("timestamp").alias("at"))


def watchdog(spark: SparkSession, sweep: Callable[[], object], seconds: float = 10.0, checkpoint: str | None = None):
    """Runs ``sweep`` every few seconds, one run after the other; stop the query that it gives back to end it."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda batch, number: sweep() and None).trigger(processingTime=f"{max(1, round(seconds * 1000))} milliseconds")
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


class RingSource(DataSource):
    """A ring file as a stream: ``spark.readStream.format("ring").option("path", file)``.

    The file holds two unsigned 64-bit numbers, messages written and slots, then slots of a length (32 bits) and SLOT bytes.
    A trigger takes all that is written since the last; messages that the writer has overwritten before are lost, as in any ring.
    """

    @classmethod
    def name(cls) -> str:
        return "ring"

    def schema(self) -> str:
        return "seq long, payload binary"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return RingReader(self.options["path"])


class RingReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def _rows(self, first: int, end: int | None) -> tuple[list[tuple[int, bytes]], int]:
        with open(self.path, "rb") as f:
            written, slots = struct.unpack("<QQ", f.read(16))
            end = written if end is None else min(end, written)
            rows = []
            for seq in range(max(first, written - slots), end):
                f.seek(16 + seq % slots * (4 + SLOT))
                size = struct.unpack("<I", f.read(4))[0]
                rows.append((seq, f.read(size)))
        return rows, end

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._rows(start["seq"], None)
        return iter(rows), {"seq": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(start["seq"], end["seq"])[0])


def ring_write(path: str, messages: Iterable[bytes], slots: int = RING) -> int:
    """Append messages to a ring file, made if it is missing; how many it has ever taken. Longer ones raise."""
    try:
        f = open(path, "r+b")
        written, slots = struct.unpack("<QQ", f.read(16))
    except FileNotFoundError:
        f, written = open(path, "w+b"), 0
    with f:
        for m in messages:
            if len(m) > SLOT:
                raise ValueError(f"a slot holds {SLOT} bytes")
            f.seek(16 + written % slots * (4 + SLOT))
            f.write(struct.pack("<I", len(m)) + m)
            written += 1
        f.seek(0)
        f.write(struct.pack("<QQ", written, slots))
    return written


def take(path: str, use: Callable[[memoryview], object], first: int = 0) -> list:
    """What a closure makes of each message from ``first`` on, over the slot's bytes without a copy of its own."""
    return [use(memoryview(payload)) for _, payload in RingReader(path)._rows(first, None)[0]]
