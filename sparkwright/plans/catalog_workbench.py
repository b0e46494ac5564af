"""Queries of the smaller operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators import access, audit, chunking, compliance, retrieval, tags, workbench
from sparkwright.plans.catalog_records import PIPES, pipes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def prompts(spark, d):
    p = table(spark, d, "part")
    failure = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("  Error in "), F.col("p_name"), F.lit(" ")))
    text = workbench.prompt(F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_size").cast("string"), failure)
    return p.select("p_partkey", F.sha2(text, 256).alias("sha"))


def wall_trend(spark, d):
    o = table(spark, d, "orders")
    yearly = o.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.max(F.col("o_totalprice").cast("double")).alias("t"))
    return workbench.trend(yearly, "o_custkey", "year", "t").select("o_custkey", "year", F.round("loss", 3).alias("loss"), F.round("cumulative", 3).alias("cumulative"))


def margin_readings(spark, d):
    p = compliance.piping(pipes(spark, d))
    m = F.col("margin")
    return p.select("l_orderkey", "l_linenumber", F.round(workbench.percent_margin(m, F.col("t_min")), 8).alias("percent"), F.round(m * 25.4, 6).alias("margin_mm"), F.when(m >= 0, "SAT").otherwise("UNSAT").alias("verdict"))


def route_models(spark, d):
    p = table(spark, d, "part")
    models = p.filter("p_size > 10").select(F.format_string("m%06d", "p_partkey").alias("model_id"), F.array(pick(("coding", "vision", "routing"), F.col("p_partkey")), pick(("vision", "ocr"), F.col("p_partkey"))).alias("capabilities"), F.col("p_size").alias("priority"), (F.col("p_partkey") % 4 != 0).alias("healthy"))
    requests = table(spark, d, "events").select(F.col("event_id").alias("request_id"), pick(("coding", "ocr", "vision", "none"), F.col("event_id")).alias("capability"), ((F.col("user_id") % 10) / 10).alias("confidence"))
    return workbench.candidates(models, requests)


def model_scores(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    score = workbench.model_score(F.col("p_size").cast("double"), (k % 7) * 0.5, (k % 3) * 0.25, (k % 5) * 0.125, k % 2, (1.0, 2.0, 3.0, 4.0))
    return p.select("p_partkey", score.alias("score"), workbench.profile(F.col("p_size") * 2).alias("profile"))


def memory_peaks(spark, d):
    e = table(spark, d, "events")
    return workbench.running_peak(e.select("user_id", F.floor(F.col("event_id") / 20).alias("slot"), (F.col("event_id") % 97).alias("mb")), "user_id", "slot", "mb")


def correction_runs(spark, d):
    e = table(spark, d, "events")
    turns = e.select(F.floor(F.col("event_id") / 4).alias("run"), (F.col("event_id") % 4).alias("turn"), pick(("SCAN", "RUNTIME", "VERIFIER", "SCAN", "SUCCESS"), F.floor(F.col("event_id") / 3)).alias("kind"), F.lit("x").alias("detail"))
    return workbench.correction_loop(turns)


def symbol_aliases(spark, d):
    p = table(spark, d, "part").select("p_partkey", pick(("equipment", "valve", "instrument"), F.col("p_partkey")).alias("t"), F.concat(pick(("P-", "V-", "valve_HV-"), F.floor(F.col("p_partkey") / 3)), (F.col("p_partkey") % 100).cast("string")).alias("tag"))
    return p.select("p_partkey", F.explode(tags.aliases(F.col("t"), F.col("tag"))).alias("alias"))


def symbol_subtypes(spark, d):
    names = ("Centrifugal Pump", "Storage Tank", "Knockout Drum", "Shell HX", "Tower", "Control valve", "NRV", "Safety", "Ball valve")
    return table(spark, d, "part").select("p_partkey", tags.symbol_subtype(pick(names, F.col("p_partkey"))).alias("sub_type"))


def file_classes(spark, d):
    name = F.concat(pick(("Circ_400_", "CML-03_Degraded_", "plain_"), F.col("doc_id")), F.col("source"), pick((".csv", ".PY", ".docx", ".log"), F.floor(F.col("doc_id") / 3)))
    return access.classify_files(table(spark, d, "documents").select("doc_id", name.alias("name"))).groupBy("type", "clearance").agg(F.count(F.lit(1)).alias("n"))


def browser_scan(spark, d):
    code = pick(("import socket", "x = 1", "from subprocess import run", "import math", "import os.system", "importsocket"), F.col("event_id"))
    return table(spark, d, "events").select("event_id", audit.browser_scan(code).alias("found"))


def socket_telemetry(spark, d):
    e = table(spark, d, "events")
    s = e.select((F.col("event_id") % 5).alias("pid"), F.concat(F.lit("127.0.0.1:"), (F.col("user_id") % 7).cast("string")).alias("laddr"), F.lit("-").alias("raddr"), F.lit("LISTEN").alias("status"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("process"), F.col("event_id").alias("seq"))
    return audit.telemetry(s, "PASS", 0, 0, 1700000000)


def figure_chunks(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("figure_id"), F.concat(F.lit("Figure "), F.col("item_id").cast("string")).alias("title"), F.col("text").alias("summary"))
    return chunking.figures(b).select("figure_id", "is_parent", F.sha2("text", 256).alias("sha"))


def topology_chunks(spark, d):
    p = table(spark, d, "part")
    nodes = p.select((F.col("p_partkey") % 7).alias("drawing_id"), F.format_string("n%06d", "p_partkey").alias("node_id"), F.lit("pump").alias("kind"))
    edges = p.select((F.col("p_partkey") % 7).alias("drawing_id"), F.format_string("n%06d", "p_partkey").alias("src"), F.lit("x").alias("dst"))
    return chunking.topology_text(nodes, edges).groupBy("drawing_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.when(F.col("batch") >= 0, F.size(F.split("text", "\n")))).alias("node_lines"))


def fresh_entries(spark, d):
    e = table(spark, d, "documents").select("doc_id", F.create_map("source", (F.col("doc_id") % 3).cast("string"), F.lit("zz"), F.lit("9")).alias("versions"))
    return retrieval.valid_entries(e, {"src1": "1", "src2": "2"}).select("doc_id")


def corrosion_life(spark, d):
    """Every row against one line's specification."""
    spec = spark.createDataFrame([(400.0, 16.0, 20000.0, 1.0, 0.4, 0.0625)], "P double, D double, S double, E double, Y double, c double")
    readings = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (0.1 + F.col("l_discount").cast("double") * 3).alias("t_actual"))
    return compliance.piping(readings.join(F.broadcast(spec))).select("l_orderkey", "l_linenumber", F.round("margin", 7).alias("margin"), "status")  # one row


def graph_build(spark, d):
    e = table(spark, d, "embeddings")
    v = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double") * 1000, 2)
    drawing = (F.col("vec_id") % 10).alias("drawing_id")
    symbols = e.filter("vec_id % 4 = 0").select(drawing, F.format_string("n%05d", "vec_id").alias("node_id"), pick(("pump", "tank"), F.floor(F.col("vec_id") / 4)).alias("sub_type"), v(0).alias("x"), v(1).alias("y"))
    runs = e.filter("vec_id % 4 <> 0").select(drawing, F.col("vec_id").alias("run_id"), F.array(F.struct(v(0).alias("x"), v(1).alias("y")), F.struct(v(2).alias("x"), v(3).alias("y"))).alias("points"), (F.col("label") % 2 == 0).alias("reverse"))
    return workbench.build_graph(symbols, runs).select("drawing_id", "run_id", "src", "dst")


def pipe_lookup(spark, d):
    edges = table(spark, d, "part").select(F.col("p_partkey").alias("edge_id"), F.when(F.col("p_partkey") % 5 > 0, F.format_string("L-%d-CS", F.col("p_partkey") % 50)).otherwise("").alias("edge_tag"))
    wanted = spark.createDataFrame([("L-7-CS",), ("X L-8-CS Y",), ("none",)], "tag string")
    return workbench.pipe_attributes(edges, wanted)


QUERIES = {f.__name__: f for f in (prompts, wall_trend, margin_readings, route_models, model_scores, memory_peaks, correction_runs, symbol_aliases, symbol_subtypes, file_classes, browser_scan, socket_telemetry, figure_chunks, topology_chunks, fresh_entries, corrosion_life, graph_build, pipe_lookup)}


def _pick(values, n):
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST(({n}) % {len(values)} + 1 AS INTEGER))"


def _format(template: str, *values: str) -> str:
    parts = template.replace("\n", "~").split("%s")
    out = [f"'{parts[0]}'"]
    for v, p in zip(values, parts[1:], strict=True):
        out += [v, f"'{p}'"]
    return "replace(" + " || ".join(out) + ", '~', chr(10))"


ORACLE = {
    "prompts": f"SELECT p_partkey, sha256(CASE WHEN p_partkey % 2 = 0 THEN {_format(workbench.RETRY, 'CAST(p_partkey AS VARCHAR)', 'p_name', chr(39) + 'Error in ' + chr(39) + ' || p_name')} ELSE {_format(workbench.FIRST, 'CAST(p_partkey AS VARCHAR)', 'p_name', 'CAST(p_size AS VARCHAR)')} END) AS sha FROM part",
    "wall_trend": """WITH y AS (SELECT o_custkey, year(o_orderdate) AS year, max(CAST(o_totalprice AS DOUBLE)) AS t FROM orders GROUP BY 1, 2),
        l AS (SELECT *, lag(t) OVER (PARTITION BY o_custkey ORDER BY year) - t AS loss FROM y)
        SELECT o_custkey, CAST(year AS INTEGER) AS year, round(loss, 3) AS loss, round(coalesce(sum(loss) OVER (PARTITION BY o_custkey ORDER BY year ROWS UNBOUNDED PRECEDING), 0.0), 3) AS cumulative FROM l""",
    "margin_readings": PIPES + " SELECT l_orderkey, l_linenumber, round((t_actual - t_min) / t_min * 100, 8) AS percent, round((t_actual - t_min) * 25.4::DOUBLE, 6) AS margin_mm, CASE WHEN t_actual >= t_min THEN 'SAT' ELSE 'UNSAT' END AS verdict FROM m",
    "route_models": f"""WITH m AS (SELECT 'm' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS model_id, unnest(list_distinct([{_pick(("coding", "vision", "routing"), "p_partkey")}, {_pick(("vision", "ocr"), "p_partkey")}])) AS capability, p_size AS priority FROM part WHERE p_size > 10 AND p_partkey % 4 <> 0),
        b AS (SELECT capability, model_id FROM (SELECT *, row_number() OVER (PARTITION BY capability ORDER BY priority DESC, model_id DESC) AS n FROM m) WHERE n = 1),
        r AS (SELECT event_id, {_pick(("coding", "ocr", "vision", "none"), "event_id")} AS capability, user_id % 10 >= 8 AS sure FROM events)
        SELECT event_id AS request_id, CASE WHEN sure AND model_id IS NOT NULL THEN 'PROCEED' ELSE 'ESCALATE' END AS verdict, CASE WHEN sure THEN model_id END AS model_id FROM r LEFT JOIN b USING (capability)""",
    "model_scores": "SELECT p_partkey, CAST(p_size AS DOUBLE) - (p_partkey % 7) * 0.5::DOUBLE - 2 * (p_partkey % 3) * 0.25::DOUBLE + 3 * (p_partkey % 5) * 0.125::DOUBLE - 4 * (p_partkey % 2) AS score, CASE WHEN p_size * 2 >= 80 THEN 'multi_gpu' WHEN p_size * 2 >= 48 THEN '48gb' ELSE '24gb' END AS profile FROM part",
    "memory_peaks": """WITH t AS (SELECT user_id, event_id // 20 AS slot, CAST(sum(event_id % 97) AS BIGINT) AS total FROM events GROUP BY 1, 2)
        SELECT user_id, slot, total, max(total) OVER (PARTITION BY user_id ORDER BY slot ROWS UNBOUNDED PRECEDING) AS peak FROM t""",
    "correction_runs": f"""WITH t AS (SELECT event_id // 4 AS run, event_id % 4 AS turn, {_pick(("SCAN", "RUNTIME", "VERIFIER", "SCAN", "SUCCESS"), "event_id // 3")} AS kind FROM events),
        n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY turn) AS n, lag(kind) OVER (PARTITION BY run ORDER BY turn) AS before FROM t),
        e AS (SELECT *, CASE WHEN kind = 'SUCCESS' THEN 'SUCCESS' WHEN before = kind AND kind IN ('SCAN', 'RUNTIME') THEN 'STALLED' WHEN n >= 3 THEN 'EXHAUSTED' END AS stop FROM n)
        SELECT run, CAST(coalesce(min(n) FILTER (stop IS NOT NULL), max(n)) AS INTEGER) AS turns_used, coalesce(min_by(stop, n) FILTER (stop IS NOT NULL), 'OPEN') AS outcome FROM e GROUP BY run""",
    "symbol_aliases": f"""WITH p AS (SELECT p_partkey, {_pick(("equipment", "valve", "instrument"), "p_partkey")} AS t, {_pick(("P-", "V-", "valve_HV-"), "p_partkey // 3")} || CAST(p_partkey % 100 AS VARCHAR) AS tag FROM part),
        r AS (SELECT *, CASE WHEN starts_with(tag, 'valve_') THEN substring(tag, 7) ELSE tag END AS raw FROM p),
        a AS (SELECT p_partkey, t, tag, unnest([tag, raw, CASE WHEN t = 'equipment' OR starts_with(raw, 'V-') THEN 'equipment_' || raw END, CASE WHEN t = 'equipment' OR starts_with(raw, 'V-') THEN 'equip_' || raw END, CASE WHEN t = 'valve' THEN 'valve_' || raw END]) AS alias FROM r)
        SELECT DISTINCT p_partkey, alias FROM a WHERE alias IS NOT NULL AND alias <> t || '_' || tag""",
    "symbol_subtypes": f"SELECT p_partkey, {_pick(('pump', 'tank', 'vessel', 'heat_exchanger', 'column', 'control_valve', 'check_valve', 'relief_valve', 'Ball valve'), 'p_partkey')} AS sub_type FROM part",
    "file_classes": f"SELECT {_pick(('INSPECTION', 'SOURCE_CODE', 'TEMPLATE', 'DATA_LOG'), 'doc_id // 3')} AS type, {_pick(('CONFIDENTIAL', 'RESTRICTED', 'INTERNAL'), 'doc_id')} AS clearance, count(*) AS n FROM documents GROUP BY 1, 2",
    "browser_scan": "SELECT event_id, list_extract(['socket', NULL, 'subprocess', NULL, 'os.system', NULL], CAST(event_id % 6 + 1 AS INTEGER)) AS found FROM events",
    "socket_telemetry": "SELECT event_id % 5 AS pid, '127.0.0.1:' || CAST(user_id % 7 AS VARCHAR) AS laddr, '-' AS raddr, 'LISTEN' AS status, 'p' || CAST(min(event_id) AS VARCHAR) AS process, sha256('airgap:PASS:0:0:1700000000') AS integrity FROM events GROUP BY 1, 2",
    "figure_chunks": "SELECT item_id AS figure_id, p AS is_parent, sha256('### [FIGURE / DIAGRAM]: Figure ' || CAST(item_id AS VARCHAR) || chr(10) || chr(10) || text) AS sha FROM benchmark, (VALUES (true), (false)) v(p)",
    "topology_chunks": "SELECT p_partkey % 7 AS drawing_id, CAST(ceil(count(*) / 15.0) + 1 AS BIGINT) AS chunks, count(*) AS node_lines FROM part GROUP BY 1",
    "fresh_entries": "SELECT doc_id FROM documents WHERE NOT (source = 'src1' AND doc_id % 3 <> 1) AND NOT (source = 'src2' AND doc_id % 3 <> 2)",
    "corrosion_life": """WITH r AS (SELECT l_orderkey, l_linenumber, CAST(0.1 AS DOUBLE) + CAST(l_discount AS DOUBLE) * 3 - (400.0 * 16.0 / (2 * (20000.0 * 1.0 + 400.0 * 0.4::DOUBLE)) + 0.0625::DOUBLE) AS m FROM lineitem)
        SELECT l_orderkey, l_linenumber, round(m, 7) AS margin, CASE WHEN m >= 0 THEN 'SAT' ELSE 'UNSAT' END AS status FROM r""",
    "pipe_lookup": """SELECT tag, min(p_partkey) AS edge_id FROM (VALUES ('L-7-CS'), ('X L-8-CS Y'), ('none')) v(tag) JOIN part ON p_partkey % 5 > 0 AND (contains('L-' || CAST(p_partkey % 50 AS VARCHAR) || '-CS', tag) OR contains(tag, 'L-' || CAST(p_partkey % 50 AS VARCHAR) || '-CS')) GROUP BY tag""",
}
