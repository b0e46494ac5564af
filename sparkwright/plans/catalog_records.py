"""Queries over events, parts and line items: ledger, compliance, audit, streams' batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators import access, audit, compliance, ledger
from sparkwright.streaming import streams

STATES = ("PROPOSED", "READY", "EXECUTING", "EXECUTED", "VERIFIED", "COMMITTED", "FAILED", "BLOCKED", "WAITING_HUMAN", "INVALIDATED")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("mission"), F.col("event_id").alias("id"), F.col("props").alias("payload"))


def state(n):
    return F.element_at(F.array(*[F.lit(s) for s in STATES]), (n % 10 + 1).cast("int"))


def units(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), state(F.col("event_id") * 7 + F.col("user_id")).alias("status"), (F.col("event_id") % 3).cast("int").alias("retry_count"), F.lit("L1").alias("execution_lease_id"), (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("event_id") % 90).cast("int"))).alias("lease_expires_at"), "ts")


def pipes(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    quality = F.element_at(F.array(*[F.lit(x) for x in (0.6, 0.8, 0.85, 1.0)]), (F.col("l_orderkey") % 4 + 1).cast("int"))
    return joined.select(
        "l_orderkey", "l_linenumber", (50 + F.col("l_quantity").cast("double") * 10).alias("P"), (2 + F.col("p_size")).cast("double").alias("D"), F.lit(20000.0).alias("S"), quality.alias("E"),
        F.lit(0.4).alias("Y"), (0.0625 * (F.col("l_linenumber") % 4)).cast("double").alias("c"), (0.05 + F.col("l_discount").cast("double") * 4).alias("t_actual"),
    )


def hash_chain(spark, d):
    return ledger.chain(log(spark, d)).select("mission", "id", "hash")


def chain_verify(spark, d):
    c = ledger.chain(log(spark, d))
    return ledger.verify(c.withColumn("payload", F.when(F.col("id") % 1000 == 7, "tampered").otherwise(F.col("payload"))))


def last_hash(spark, d):
    return ledger.latest(ledger.chain(log(spark, d)), ["mission"], "hash").select("mission", "last_id", "hash")


def replay_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("id"), F.col("props").alias("payload"))
    return ledger.latest(e, ["user_id", "event_type"])


def transitions_check(spark, d):
    e = table(spark, d, "events")
    t = e.select("event_id", state(F.col("event_id")).alias("before"), state(F.col("user_id") + F.floor(F.col("event_id") / 10)).alias("after"), F.when(F.col("event_id") % 2 == 0, "L").alias("lease_id"))
    return ledger.check_transitions(t).select("event_id", "ok", "lease_after")


def now(d):
    return F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")


def expired_leases(spark, d):
    return ledger.expired(units(spark, d), now(d)).select("id")


def reclaim_leases(spark, d):
    return ledger.reclaim(units(spark, d), now(d)).select("id", "status", "retry_count")


def boot_sweep(spark, d):
    return ledger.boot_sweep(units(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("execution_lease_id").alias("leases"))


def ready_units(spark, d):
    p = table(spark, d, "part")
    u = p.select(F.col("p_partkey").alias("id"), state(F.when(F.col("p_partkey") % 3 == 0, 1).when(F.col("p_partkey") % 2 == 0, 5).otherwise(F.col("p_size"))).alias("status"))
    deps = p.select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 2).alias("needs"))
    made = p.select(F.col("p_partkey").alias("id"), state(F.when(F.col("p_size") > 20, 5).otherwise(3)).alias("status"))
    needs = p.filter("p_partkey % 6 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") + 1).alias("artifact"))
    return ledger.ready(u, deps, made, needs).select("id", "status")


def override_gate(spark, d):
    e = table(spark, d, "events")
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (n % len(xs) + 1).cast("int"))
    r = e.select("event_id", pick(("APPROVE", "RETRY", "REJECT", "OTHER"), F.col("event_id")).alias("resolution"), pick(("too short", "  inspected on site and accepted  ", ""), F.col("user_id")).alias("justification"), F.lit("op").alias("operator_id"), pick(("sig", " "), F.col("event_id") + F.col("user_id")).alias("signature"))
    return ledger.override(r).select("event_id", "accepted", "status_after")


def audit_sessions(spark, d):
    s = access.sessions(table(spark, d, "events"), starts=F.col("event_type") == "login")
    return s.groupBy("user_id", "session_no").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


def piping_verdict(spark, d):
    return compliance.piping(pipes(spark, d)).select("l_orderkey", "l_linenumber", F.round("margin", 6).alias("margin"), "status")


def piping_checks(spark, d):
    odd = pipes(spark, d).withColumn("P", F.when(F.col("l_orderkey") % 7 == 0, -1.0).when(F.col("l_orderkey") % 7 == 1, F.lit(None)).otherwise(F.col("P"))).withColumn("E", F.when(F.col("l_orderkey") % 5 == 0, 1.5).otherwise(F.col("E")))
    return compliance.piping(odd).groupBy("status", F.array_join("violations", "; ").alias("why")).agg(F.count(F.lit(1)).alias("n"))


def piping_details(spark, d):
    p = compliance.piping_details(pipes(spark, d))
    return p.select("l_orderkey", "l_linenumber", F.round("denominator", 4).alias("denominator"), F.round("t_pressure", 6).alias("t_pressure"), F.round("ratio", 6).alias("ratio"), "thin_wall", F.round("deficit", 6).alias("deficit"))


def batch_summary(spark, d):
    p = compliance.piping(pipes(spark, d))
    return p.groupBy("E").agg(F.count_if("valid").alias("sat"), F.count_if(~F.col("valid")).alias("unsat"), F.round(F.min("margin"), 6).alias("least_margin"), F.round(F.max(F.try_divide(F.col("margin"), F.col("t_min")) * 100), 4).alias("most_percent"))


def calc_steps(spark, d):
    """The steps of every line."""
    return compliance.steps(pipes(spark, d), 9).select("l_orderkey", "l_linenumber", "step_number", "formula", "result")


def stress_tool(spark, d):
    s = compliance.stress(pipes(spark, d).withColumn("t_actual", F.when(F.col("l_orderkey") % 3 > 0, F.col("t_actual"))))
    return s.select("l_orderkey", "l_linenumber", F.round("t_used", 6).alias("t_used"), F.round("hoop", 4).alias("hoop"), F.round("stress_ratio", 6).alias("stress_ratio"), "status")


def wall(spark, d):
    return pipes(spark, d).select("l_orderkey", "l_linenumber", "P", "t_actual", F.lit(0.1).alias("t_min"), (F.col("l_linenumber") % 3 * 0.01).cast("double").alias("corrosion_rate"))


def vessel_verdict(spark, d):
    v = compliance.vessels(wall(spark, d))
    return v.select("l_orderkey", "l_linenumber", "violation", "status", F.round("margin", 6).alias("margin"), F.round("remaining_life", 4).alias("remaining_life"), F.round("interval", 4).alias("interval"))


def life_readings(spark, d):
    w = wall(spark, d)
    return w.select("l_orderkey", "l_linenumber", *[F.round(compliance.remaining_life(s), 1).alias(s) for s in ("rest", "tool", "verifier")])


def allowable_pressure(spark, d):
    p = pipes(spark, d).withColumn("corrosion_rate", F.lit(0.002)).withColumn("R", F.col("D") / 2)
    return p.select("l_orderkey", "l_linenumber", F.round(compliance.allowable_pressure(F.lit(5.0)), 3).alias("pressure"), F.round(compliance.vessel_thickness(), 6).alias("vessel_t"))


def lines(spark, d):
    ip = F.concat(F.lit("10:15:"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"), F.lit(".123456 IP 192.168.1."), (F.col("user_id") % 250).cast("string"), F.lit(".4567 > "), F.when(F.col("event_id") % 3 == 0, "127.0.0.1").otherwise(F.concat(F.lit("8.8.8."), (F.col("event_id") % 9).cast("string"))), F.lit(".443: Flags [S]"))
    return table(spark, d, "events").select(F.col("event_id").alias("line_id"), "user_id", F.when(F.col("event_id") % 11 == 0, "listening on any").otherwise(ip).alias("line"))


def packet_log(spark, d):
    return audit.packets(lines(spark, d)).select("line_id", "time", "src_ip", "src_port", "dst_ip", "dst_port", "is_egress")


def egress_verdict(spark, d):
    return audit.verdict(audit.packets(lines(spark, d), ("user_id",)), ["user_id"])


def heartbeat_gaps(spark, d):
    return streams.heartbeat_gaps(table(spark, d, "events"), "user_id", 3600.0, "event_id")


def ring_fifo(spark, d):
    """Rings of the operator's own size."""
    return streams.ring(table(spark, d, "events"), "user_id", "event_id", "props").select("user_id", "seq", F.hex("payload").alias("payload"))


def fan_out(spark, d):
    """Queues of the operator's own length."""
    subs = spark.createDataFrame([("a", "click"), ("a", "view"), ("b", "purchase"), ("c", "nothing")], "subscriber string, event_type string")
    return streams.fan_out(table(spark, d, "events"), subs).select("subscriber", "event_id")


def jsonrpc_dispatch(spark, d):
    bodies = ('{"method": "ping"}', '{"method": "tools/call", "params": {"name": "asme_stress_calc"}}', '{"method": "tools/call", "params": {}}', '{"method": "tools/call", "params": {"name": "nope"}}', "{broken", '{"method": "other"}', '{"id": 1}')
    body = F.element_at(F.array(*[F.lit(b) for b in bodies]), (F.col("event_id") % len(bodies) + 1).cast("int"))
    return audit.dispatch(table(spark, d, "events").select(F.col("event_id").alias("request_id"), body.alias("body")))


def vram_telemetry(spark, d):
    return audit.vram(spark.createDataFrame([("reasoner", 7.6, 0.0, 8.5), ("vision", 0.9, 1.3, 1.2), ("embedder", 0.5, None, 1.0)], "name string, measured_gb double, actual_gb double, limit_gb double"))


def sheet_rows(spark, d):
    return table(spark, d, "part").select("p_partkey", audit.sheet_name(F.concat(F.lit("Part [1]: a/b*"), F.col("p_name"))).alias("sheet"), audit.cell_text(F.when(F.col("p_partkey") % 5 == 0, F.lit(float("nan"))).when(F.col("p_partkey") % 5 == 1, F.lit(float("inf"))).otherwise(F.col("p_size").cast("double"))).alias("cell"))


def exit_classes(spark, d):
    code = F.element_at(F.array(*[F.lit(c) for c in (0, 1, 124, 126, 127, 137)]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").groupBy(audit.exit_class(code).alias("class")).agg(F.count(F.lit(1)).alias("n"))


SCRIPTS = (
    ("import os\nos.system('x')", 3, "line 1: import of 'os'"), ("x = 1", 0, None), ("def f(:", 1, "line 1: syntax error"), ("", 1, "line 0: empty script"), ("eval('1')", 1, "line 1: call of 'eval'"),
    ("from urllib import request", 1, "line 1: import from 'urllib'"), ("().__class__.__bases__", 2, "line 1: use of '__bases__'"), ("print(sum([1, 2]))", 0, None), ("open('a', 'w')", 1, "line 1: open() for 'w'"),
)


def ast_scan(spark, d):
    code = F.element_at(F.array(*[F.lit(c) for c, _, _ in SCRIPTS]), (F.col("event_id") % len(SCRIPTS) + 1).cast("int"))
    found = audit.scan_scripts(table(spark, d, "events").select(F.col("event_id").alias("script_id"), code.alias("code")))
    return found.select("script_id", "is_safe", F.size("findings").alias("n"), F.get("findings", F.lit(0)).alias("first"))


QUERIES = {f.__name__: f for f in (hash_chain, chain_verify, last_hash, replay_latest, transitions_check, expired_leases, reclaim_leases, boot_sweep, ready_units, override_gate, audit_sessions, piping_verdict, piping_checks, piping_details, batch_summary, calc_steps, stress_tool, vessel_verdict, life_readings, allowable_pressure, packet_log, egress_verdict, heartbeat_gaps, ring_fifo, fan_out, jsonrpc_dispatch, vram_telemetry, sheet_rows, exit_classes, ast_scan)}

STATE = "list_extract(['PROPOSED','READY','EXECUTING','EXECUTED','VERIFIED','COMMITTED','FAILED','BLOCKED','WAITING_HUMAN','INVALIDATED'], CAST(({n}) % 10 + 1 AS INTEGER))"
CHAIN = """WITH g AS (SELECT user_id AS mission, list(props ORDER BY event_id) AS ps, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY user_id),
    r AS (SELECT mission, ps, ids, unnest(range(1, len(ids) + 1)) AS i FROM g),
    c AS (SELECT mission, ids[i] AS id, ps[i] AS payload, list_reduce(list_prepend('', ps[1:i]), lambda a, p: sha256(a || p)) AS hash FROM r)"""
UNITS = f"SELECT event_id AS id, {STATE.format(n='event_id * 7 + user_id')} AS status, event_id % 3 AS retry_count, ts + to_minutes(event_id % 90) AS until FROM events"
PIPES = """WITH p AS (SELECT l_orderkey, l_linenumber, 50 + CAST(l_quantity AS DOUBLE) * 10 AS P, CAST(2 + p_size AS DOUBLE) AS D, 20000.0::DOUBLE AS S, list_extract([0.6::DOUBLE, 0.8, 0.85, 1.0], CAST(l_orderkey % 4 + 1 AS INTEGER)) AS E, 0.4::DOUBLE AS Y,
    CAST(0.0625 AS DOUBLE) * (l_linenumber % 4) AS c, CAST(0.05 AS DOUBLE) + CAST(l_discount AS DOUBLE) * 4 AS t_actual FROM lineitem JOIN part ON l_partkey = p_partkey),
    m AS (SELECT *, P * D / (2 * (S * E + P * Y)) + c AS t_min, P * D / (2 * (S * E + P * Y)) AS tp FROM p)"""
WALL = PIPES + ", w AS (SELECT l_orderkey, l_linenumber, P, t_actual, 0.1::DOUBLE AS t_min, (l_linenumber % 3) * 0.01::DOUBLE AS r FROM p)"
LINES = """WITH l AS (SELECT event_id AS line_id, user_id, '10:15:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || '.123456' AS time, '192.168.1.' || CAST(user_id % 250 AS VARCHAR) AS src_ip,
    CASE WHEN event_id % 3 = 0 THEN '127.0.0.1' ELSE '8.8.8.' || CAST(event_id % 9 AS VARCHAR) END AS dst_ip FROM events WHERE event_id % 11 <> 0)"""

SCRIPT = lambda values: "list_extract([" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values) + f"], CAST(event_id % {len(SCRIPTS)} + 1 AS INTEGER))"

ORACLE = {
    "ast_scan": f"SELECT event_id AS script_id, {SCRIPT([n for _, n, _ in SCRIPTS])} = 0 AS is_safe, CAST({SCRIPT([n for _, n, _ in SCRIPTS])} AS INTEGER) AS n, {SCRIPT([f for _, _, f in SCRIPTS])} AS first FROM events",
    "hash_chain": CHAIN + " SELECT mission, id, hash FROM c",
    "last_hash": CHAIN + " SELECT mission, max(id) AS last_id, max_by(hash, id) AS hash FROM c GROUP BY mission",
    "chain_verify": "SELECT user_id AS mission, count(*) AS n_events, count(*) FILTER (event_id % 1000 = 7) AS n_bad, min(event_id) FILTER (event_id % 1000 = 7) AS first_bad_id FROM events GROUP BY user_id",
    "replay_latest": "SELECT user_id, event_type, max(event_id) AS last_id, max_by(props, event_id) AS payload FROM events GROUP BY user_id, event_type",
    "transitions_check": f"""WITH t AS (SELECT event_id, {STATE.format(n='event_id')} AS b, {STATE.format(n='user_id + event_id // 10')} AS a, CASE WHEN event_id % 2 = 0 THEN 'L' END AS l FROM events),
        k AS (SELECT * FROM (VALUES {", ".join(f"('{b}','{a}')" for b, xs in ledger.TRANSITIONS.items() for a in xs)}) v(b, a)),
        o AS (SELECT t.*, k.b IS NOT NULL AND (t.a <> 'EXECUTING' OR l IS NOT NULL) AS ok FROM t LEFT JOIN k ON t.b = k.b AND t.a = k.a)
        SELECT event_id, ok, CASE WHEN ok AND a IN ('READY','COMMITTED','WAITING_HUMAN') THEN NULL ELSE l END AS lease_after FROM o""",
    "expired_leases": f"WITH u AS ({UNITS}) SELECT id FROM u WHERE status = 'EXECUTING' AND until < TIMESTAMP '2024-06-01 00:00:00'",
    "reclaim_leases": f"WITH u AS ({UNITS}) SELECT id, CASE WHEN retry_count + 1 >= 3 THEN 'WAITING_HUMAN' ELSE 'READY' END AS status, CAST(retry_count + 1 AS INTEGER) AS retry_count FROM u WHERE status = 'EXECUTING' AND until < TIMESTAMP '2024-06-01 00:00:00'",
    "boot_sweep": f"WITH u AS ({UNITS}) SELECT CASE WHEN status = 'EXECUTING' THEN 'READY' ELSE status END AS status, count(*) AS n, count(*) FILTER (status <> 'EXECUTING') AS leases FROM u GROUP BY 1",
    "ready_units": f"""WITH u AS (SELECT p_partkey AS id, {STATE.format(n='CASE WHEN p_partkey % 3 = 0 THEN 1 WHEN p_partkey % 2 = 0 THEN 5 ELSE p_size END')} AS status FROM part)
        SELECT u.id, status FROM u WHERE status IN ('READY','PROPOSED') AND EXISTS (SELECT 1 FROM u v WHERE v.id = u.id // 2 AND v.status = 'COMMITTED')
        AND (u.id % 6 <> 0 OR EXISTS (SELECT 1 FROM part WHERE p_partkey = u.id + 1 AND p_size > 20))""",
    "override_gate": """WITH r AS (SELECT event_id, list_extract(['APPROVE','RETRY','REJECT','OTHER'], CAST(event_id % 4 + 1 AS INTEGER)) AS r, user_id % 3 = 1 AND (event_id + user_id) % 2 = 0 AND event_id % 4 <> 3 AS ok FROM events)
        SELECT event_id, ok AS accepted, CASE WHEN ok THEN CASE r WHEN 'APPROVE' THEN 'VERIFIED' WHEN 'RETRY' THEN 'READY' ELSE 'FAILED' END END AS status_after FROM r""",
    "audit_sessions": """WITH f AS (SELECT user_id, event_id, ts, CASE WHEN row_number() OVER w = 1 OR event_type = 'login' THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT user_id, event_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM f)
        SELECT user_id, CAST(n AS BIGINT) AS session_no, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY user_id, s.n""",
    "piping_verdict": PIPES + " SELECT l_orderkey, l_linenumber, round(t_actual - t_min, 6) AS margin, CASE WHEN t_actual >= t_min THEN 'SAT' ELSE 'UNSAT' END AS status FROM m",
    "piping_checks": PIPES + """, o AS (SELECT *, CASE WHEN l_orderkey % 7 = 0 THEN -1.0::DOUBLE WHEN l_orderkey % 7 = 1 THEN NULL ELSE P END AS P2, CASE WHEN l_orderkey % 5 = 0 THEN 1.5::DOUBLE ELSE E END AS E2 FROM p),
        w AS (SELECT *, CASE WHEN P2 IS NULL THEN 'missing P' WHEN P2 <= 0 AND E2 > 1 THEN 'needs P > 0; needs 0 < E <= 1' WHEN P2 <= 0 THEN 'needs P > 0' WHEN E2 > 1 THEN 'needs 0 < E <= 1' ELSE '' END AS why FROM o)
        SELECT CASE WHEN why = '' AND t_actual >= P2 * D / (2 * (S * E2 + P2 * Y)) + c THEN 'SAT' ELSE 'UNSAT' END AS status, why, count(*) AS n FROM w GROUP BY 1, 2""",
    "piping_details": PIPES + " SELECT l_orderkey, l_linenumber, round(2 * (S * E + P * Y), 4) AS denominator, round(tp, 6) AS t_pressure, round(t_actual / D, 6) AS ratio, tp < D / 6 AS thin_wall, round(greatest(tp + c - t_actual, 0.0), 6) AS deficit FROM m",
    "batch_summary": PIPES + " SELECT E, count(*) FILTER (t_actual >= t_min) AS sat, count(*) FILTER (t_actual < t_min) AS unsat, round(min(t_actual - t_min), 6) AS least_margin, round(max((t_actual - t_min) / t_min * 100), 4) AS most_percent FROM m GROUP BY E",
    "calc_steps": PIPES + """, s AS (SELECT l_orderkey, l_linenumber, unnest([1, 2, 3, 4, 5]) AS step_number, unnest(['P * D', '2 * (S*E + P*Y)', '(P*D) / Denom', 't + c', 't_actual - tm']) AS formula, unnest([P * D, 2 * (S * E + P * Y), tp, tp + c, t_actual - tp - c]) AS v FROM m)
        SELECT l_orderkey, l_linenumber, step_number, formula, round(v, 9) + 0.0::DOUBLE AS result FROM s""",
    "stress_tool": PIPES + """, s AS (SELECT *, CASE WHEN l_orderkey % 3 > 0 THEN t_actual ELSE 0.065::DOUBLE * D END AS t FROM m)
        SELECT l_orderkey, l_linenumber, round(t, 6) AS t_used, round(P * D / (2 * t), 4) AS hoop, round(P * D / (2 * t) / (S * E), 6) AS stress_ratio, CASE WHEN t >= t_min THEN 'PASS' ELSE 'FAIL' END AS status FROM s""",
    "vessel_verdict": WALL + """, v AS (SELECT *, CASE WHEN r <= 0 THEN 'corrosion_rate' WHEN t_actual < t_min THEN 't_actual < t_min' END AS violation FROM w)
        SELECT l_orderkey, l_linenumber, violation, CASE WHEN violation IS NULL THEN 'SAT' ELSE 'UNSAT' END AS status, round(t_actual - t_min, 6) AS margin,
        CASE WHEN violation IS NULL THEN round((t_actual - t_min) / r, 4) END AS remaining_life, CASE WHEN violation IS NULL THEN round(least((t_actual - t_min) / r / 2, 10.0), 4) END AS interval FROM v""",
    "life_readings": WALL + " SELECT l_orderkey, l_linenumber, CASE WHEN r <= 0 THEN 999.0 ELSE round(round((t_actual - t_min) / r, 2), 1) END AS rest, CASE WHEN r <= 0 THEN 99.0 ELSE round(round(greatest((t_actual - t_min) / r, 0.0), 2), 1) END AS tool, CASE WHEN r > 0 THEN round((t_actual - t_min) / r, 1) END AS verifier FROM w",
    "allowable_pressure": PIPES + """, a AS (SELECT *, t_actual - 0.002::DOUBLE * 5.0 - c AS t FROM m)
        SELECT l_orderkey, l_linenumber, round(CASE WHEN t > 0 THEN 2 * S * E * t / (D - 2 * Y * t) ELSE 0.0 END, 3) AS pressure, round(P * (D / 2) / (S * E - 0.6::DOUBLE * P), 6) AS vessel_t FROM a""",
    "packet_log": LINES + " SELECT line_id, time, src_ip, CAST(4567 AS INTEGER) AS src_port, dst_ip, CAST(443 AS INTEGER) AS dst_port, dst_ip <> '127.0.0.1' AS is_egress FROM l",
    "egress_verdict": LINES + " SELECT user_id, count(*) AS packets, count(*) FILTER (dst_ip <> '127.0.0.1') AS egress, CASE WHEN count(*) FILTER (dst_ip <> '127.0.0.1') = 0 THEN 'PASS' ELSE 'WARNING' END AS verdict FROM l GROUP BY user_id",
    "heartbeat_gaps": """WITH g AS (SELECT user_id, event_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1000000.0 AS gap FROM events)
        SELECT user_id, event_id, CAST(floor(gap / 3600.0) AS BIGINT) AS beats FROM g WHERE gap > 3600.0""",
    "ring_fifo": "WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, props FROM events) SELECT user_id, CAST(seq AS INTEGER) AS seq, hex(substring(props, 1, 4096)) AS payload FROM r WHERE seq < 1024",
    "fan_out": """WITH s AS (SELECT * FROM (VALUES ('a', 'click'), ('a', 'view'), ('b', 'purchase'), ('c', 'nothing')) v(subscriber, event_type)),
        r AS (SELECT subscriber, event_id, row_number() OVER (PARTITION BY subscriber ORDER BY event_id) AS n FROM events JOIN s USING (event_type)) SELECT subscriber, event_id FROM r WHERE n <= 128""",
    "jsonrpc_dispatch": "SELECT event_id AS request_id, list_extract(['result','tool_error','error','tool_error','error','error','error'], CAST(event_id % 7 + 1 AS INTEGER)) AS kind, CAST(list_extract([NULL, NULL, -32602, NULL, -32700, -32601, -32601], CAST(event_id % 7 + 1 AS INTEGER)) AS INTEGER) AS code FROM events",
    "vram_telemetry": "SELECT 9.4::DOUBLE AS total_gb, 14.6::DOUBLE AS reserve_gb, true AS within, 'vision is over its limit' AS errors",
    "sheet_rows": "SELECT p_partkey, substring('Part -1-- a-b-' || p_name, 1, 31) AS sheet, CASE p_partkey % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN '#NUM!' ELSE CAST(p_size AS VARCHAR) || '.0000' END AS cell FROM part",
    "exit_classes": "SELECT list_extract(['ok','error','timeout','network violation','not found','out of memory'], CAST(event_id % 6 + 1 AS INTEGER)) AS class, count(*) AS n FROM events GROUP BY 1",
}
