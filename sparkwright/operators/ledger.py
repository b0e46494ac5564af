"""Event-sourced state: hash chains, replay, transitions, leases, overrides, ready units."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.operators import graph

#: The allowed changes of a work unit's status.
TRANSITIONS: Mapping[str, tuple[str, ...]] = {
    "PROPOSED": ("READY", "INVALIDATED"),
    "READY": ("EXECUTING", "BLOCKED", "WAITING_HUMAN"),
    "EXECUTING": ("EXECUTED", "FAILED", "READY", "WAITING_HUMAN"),
    "EXECUTED": ("VERIFIED", "FAILED", "WAITING_HUMAN"),
    "VERIFIED": ("COMMITTED", "FAILED"),
    "FAILED": ("READY", "INVALIDATED", "WAITING_HUMAN"),
    "BLOCKED": ("READY", "INVALIDATED"),
    "WAITING_HUMAN": ("READY", "VERIFIED", "FAILED", "INVALIDATED"),
    "COMMITTED": ("INVALIDATED",),
    "INVALIDATED": (),
}
STRIKES, TTL, REASON = 3, 60, 20


def chain(events: DataFrame) -> DataFrame:
    """(mission, id, payload, prev_hash, hash): hash = sha256(prev_hash + payload) in order of id within a mission.

    Every hash needs the one before, so a mission's events pass through one task in their order, which holds the last hash only.
    """
    rows = events.select("mission", "id", "payload").repartition("mission").sortWithinPartitions("mission", "id")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(_chained, f"mission {kinds['mission']}, id {kinds['id']}, payload string, prev_hash string, hash string")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mission, last = object(), None
    for batch in batches:
        before, after = [], []
        for m, payload in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if m != mission:
                mission, last = m, None
            before.append(last)
            last = hashlib.sha256(((last or "") + (payload or "")).encode()).hexdigest()
            after.append(last)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], ["mission", "id", "payload", "prev_hash", "hash"])


def verify(log: DataFrame) -> DataFrame:
    """(mission, n_events, n_bad, first_bad_id). Each row is checked with the hash stored before it, so all rows are checked at once."""
    order = Window.partitionBy("mission").orderBy("id")
    last = F.lag("hash").over(order)
    rows = log.withColumn("bad", ~F.col("prev_hash").eqNullSafe(last) | (F.col("hash") != F.sha2(F.concat(F.coalesce("prev_hash", F.lit("")), F.coalesce("payload", F.lit(""))), 256)))
    return rows.groupBy("mission").agg(F.count(F.lit(1)).alias("n_events"), F.count_if("bad").alias("n_bad"), F.min(F.when(F.col("bad"), F.col("id"))).alias("first_bad_id"))


def strong_hash() -> Column:
    """A hash that also covers type, entity and time."""
    return F.sha2(F.concat_ws("|", F.coalesce("prev_hash", F.lit("")), "event_type", "entity", F.col("ts").cast("string"), "payload"), 256)


def latest(events: DataFrame, keys: list[str], value: str = "payload") -> DataFrame:
    """The last value of every entity."""
    return events.groupBy(*keys).agg(F.max("id").alias("last_id"), F.max_by(value, "id").alias(value))


def allowed(before: Column, after: Column) -> Column:
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]) if v else F.array().cast("array<string>"))])
    return F.coalesce(F.array_contains(F.try_element_at(table, before), after), F.lit(False))


def check_transitions(changes: DataFrame) -> DataFrame:
    """changes: before, after, lease_id. Adds ok (EXECUTING needs a lease) and the lease afterwards."""
    ok = allowed(F.col("before"), F.col("after")) & ((F.col("after") != "EXECUTING") | (F.coalesce("lease_id", F.lit("")) != ""))
    cleared = F.col("after").isin("READY", "COMMITTED", "WAITING_HUMAN")
    return changes.withColumns({"ok": ok, "lease_after": F.when(ok & cleared, F.lit(None).cast("string")).otherwise(F.col("lease_id"))})


def renew(units: DataFrame, lease: str, expires: Column) -> DataFrame:
    """A new expiry where the unit is executing under this lease."""
    return units.withColumn("lease_expires_at", F.when((F.col("status") == "EXECUTING") & (F.col("execution_lease_id") == lease), expires).otherwise(F.col("lease_expires_at")))


def expired(units: DataFrame, now: Column) -> DataFrame:
    return units.filter((F.col("status") == "EXECUTING") & (F.col("lease_expires_at") < now))


def reclaim(units: DataFrame, now: Column) -> DataFrame:
    """Expired units with one retry more: ready again, or waiting for a human from the third on."""
    retry = F.col("retry_count") + 1
    return expired(units, now).withColumns({"retry_count": retry, "status": F.when(retry >= STRIKES, "WAITING_HUMAN").otherwise("READY"), "execution_lease_id": F.lit(None).cast("string"), "lease_expires_at": F.lit(None).cast("timestamp_ntz")})


def boot_sweep(units: DataFrame) -> DataFrame:
    """Units left executing go back to ready without their lease."""
    return units.withColumns({"execution_lease_id": F.when(F.col("status") != "EXECUTING", F.col("execution_lease_id")), "status": F.when(F.col("status") == "EXECUTING", "READY").otherwise(F.col("status"))})


def block_downstream(units: DataFrame, dependents: DataFrame) -> DataFrame:
    """Units among ``dependents`` (id) that are ready or proposed become blocked."""
    hit = units.join(dependents.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    return hit.withColumn("status", F.when(F.col("hit") & F.col("status").isin("READY", "PROPOSED"), "BLOCKED").otherwise(F.col("status"))).drop("hit")


def sweep(units: DataFrame, dependencies: DataFrame, now: Column) -> DataFrame:
    """All units after a sweep: expired ones are reclaimed, then units that depend (id, needs), directly or not, on one that now waits for a human are blocked if ready or proposed."""
    back = reclaim(units, now)
    after = units.join(back.select("id"), "id", "left_anti").unionByName(back)
    edges, struck = dependencies.select(F.col("needs").alias("src"), F.col("id").alias("dst")), back.filter("status = 'WAITING_HUMAN'").select(F.col("id").alias("node"))
    return block_downstream(after, graph.reach(edges, struck).select(F.col("node").alias("id")))


def override(requests: DataFrame) -> DataFrame:
    """Adds accepted and the parent's status after it: APPROVE, RETRY and REJECT with a reason of 20 characters, an operator and a signature."""
    filled = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    known = F.col("resolution").isin("APPROVE", "RETRY", "REJECT")
    accepted = (F.length(F.trim(F.coalesce("justification", F.lit("")))) >= REASON) & filled("operator_id") & filled("signature") & known
    after = F.when(F.col("resolution") == "APPROVE", "VERIFIED").when(F.col("resolution") == "RETRY", "READY").otherwise("FAILED")
    return requests.withColumns({"accepted": accepted, "status_after": F.when(accepted, after)})


def apply_overrides(units: DataFrame, requests: DataFrame, dependencies: DataFrame) -> DataFrame:
    """All units (id, status, retry_count, execution_lease_id, lease_expires_at) after the accepted requests (id and what ``override`` reads).

    A unit takes the status that its request gives and loses its lease, with RETRY its strikes too; units that depend (id, needs),
    directly or not, on one approved or retried go from BLOCKED to READY. A request for an unknown unit changes nothing.
    """
    told = override(requests).filter("accepted").select("id", "resolution", "status_after")
    edges, freed = dependencies.select(F.col("needs").alias("src"), F.col("id").alias("dst")), told.filter("resolution <> 'REJECT'").join(units.select("id"), "id", "left_semi")
    free = graph.reach(edges, freed.select(F.col("id").alias("node"))).select(F.col("node").alias("id")).distinct().withColumn("free", F.lit(True))
    rows = units.join(told, "id", "left").join(free, "id", "left")
    hit = F.col("status_after").isNotNull()
    freed_now = F.col("free") & (F.col("status") == "BLOCKED")
    return rows.withColumns({
        "status": F.when(hit, F.col("status_after")).when(freed_now, "READY").otherwise(F.col("status")), "retry_count": F.when(F.col("resolution") == "RETRY", 0).otherwise(F.col("retry_count")),
        "execution_lease_id": F.when(~hit, F.col("execution_lease_id")), "lease_expires_at": F.when(~hit, F.col("lease_expires_at")),
    }).drop("resolution", "status_after", "free")


def ready(units: DataFrame, dependencies: DataFrame, artifacts: DataFrame | None = None, inputs: DataFrame | None = None) -> DataFrame:
    """Ready or proposed units whose dependencies (id, needs) and inputs (id, artifact) are all committed; what is unknown is unmet. The order is the caller's: ``first_ready`` takes the least id."""
    done = units.filter("status = 'COMMITTED'").select(F.col("id").alias("needs"))
    out = units.filter(F.col("status").isin("READY", "PROPOSED")).join(dependencies.join(done, "needs", "left_anti").select("id"), "id", "left_anti")
    if inputs is not None and artifacts is not None:
        have = artifacts.filter("status = 'COMMITTED'").select(F.col("id").alias("artifact"))
        out = out.join(inputs.join(have, "artifact", "left_anti").select("id"), "id", "left_anti")
    return out


def first_ready(units: DataFrame, key: str = "mission") -> DataFrame:
    """The ready unit with the least id of each mission."""
    return units.groupBy(key).agg(F.min("id").alias("id"))


def stalls(turns: DataFrame) -> DataFrame:
    """Adds stalled: a turn (conv_id, turn, failure) whose failure text has the hash of the one before."""
    h = F.sha2(F.coalesce("failure", F.lit("")), 256)
    return turns.withColumn("stalled", F.coalesce(h == F.lag(h).over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(False)))
