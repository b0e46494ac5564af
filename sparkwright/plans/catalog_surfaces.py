"""Queries of the surfaces around the operators: endpoints, tools, caches, sessions, sweeps, audits, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators import access, audit, chunking, compliance, geometry, graph, ledger, planning, retrieval, service, surfaces, workbench
from sparkwright.plans.catalog_documents import BASE, HYBRID, LEVELS_SQL, TOK, asked, corpus, hybrid_retrieve, level, temporal_warnings
from sparkwright.plans.catalog_documents import ORACLE as DOCUMENTS
from sparkwright.plans.catalog_records import PIPES, STATE, UNITS, WALL, now, pipes, state, units, wall
from sparkwright.plans.catalog_shapes import BOX, TREE, boxes, tree
from sparkwright.plans.catalog_workbench import _pick, pick
from sparkwright.sources import files
from sparkwright.streaming import streams


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE = ("l_orderkey", "l_linenumber")


def given(spark, d, **keys):
    """Line items with the column parameters: key = input's name, or (name, remainder of l_orderkey by 3 where it is missing)."""
    pairs = []
    for key, name in keys.items():
        name, gap = name if isinstance(name, tuple) else (name, None)
        pairs += [F.lit(key), F.col(name) if gap is None else F.when(F.col("l_orderkey") % 3 != gap, F.col(name))]
    return pipes(spark, d).select(*LINE, F.create_map(*pairs).alias("parameters"))


def evaluate_rows(spark, d):
    rows = given(spark, d, design_pressure=("P", 1), P=("P", 2), D="D", S="S", E="E", corrosion_allowance="c", t_actual="t_actual")
    return surfaces.evaluate(rows).select(*LINE, "is_valid", "status", "margin", "t_min", "t_actual")


def exact_tool(spark, d):
    rows = given(spark, d, p_design="P", d_outside=("D", 2), weld_joint_eff=("E", 0), corrosion_allowance="c", t_actual=("t_actual", 2))
    return surfaces.audit_tool(rows).select(*LINE, "success", "error", "is_safe", "status", F.round("margin", 6).alias("margin"))


def native_tool(spark, d):
    rows = given(spark, d, p_design=("P", 1), d_outside=("D", 2), weld_joint_eff="E", t_actual=("t_actual", 0))
    return surfaces.native_tool(rows).select(*LINE, "is_safe", "status", "t_min", (F.col("margin") + F.lit(0.0)).alias("margin"))


def browser_fallback(spark, d):
    rows = given(spark, d, design_pressure=("P", 1), P="P", D=("D", 2), E="E", c="c", actual_thickness=("t_actual", 0))
    return surfaces.browser(rows).select(*LINE, "t_min", (F.col("margin") + F.lit(0.0)).alias("margin"), (F.round("margin_mm", 1) + F.lit(0.0)).alias("margin_mm"), "verdict")


def script_defaults(spark, d):
    rows = given(spark, d, P=("P", 1), D="D", allowable_stress=("S", 2), E="E", CA="c", t_act=("t_actual", 0))
    return surfaces.default_script(rows).select(*LINE, F.round("t_min", 6).alias("t_min"), F.round("margin", 6).alias("margin"), "verdict")


def symbolic_calc(spark, d):
    rows = pipes(spark, d).withColumns({"E": F.when(F.col("l_orderkey") % 3 > 0, F.col("E")), "c": F.when(F.col("l_orderkey") % 3 > 1, F.col("c"))})
    return surfaces.symbolic(rows).select(*LINE, "is_verified", F.round("computed_value", 6).alias("computed_value"), F.substring_index("proof_log", ".", 1).alias("log"))


def pipe_trace(spark, d):
    rows = given(spark, d, design_pressure="P", D="D", S="S", E="E", Y="Y", c="c", t_actual="t_actual")
    return surfaces.pipe_trace(rows).select(*LINE, "step_number", F.when(F.col("step_number") < 4, F.col("substituted")).alias("substituted"), (F.col("result") + F.lit(0.0)).alias("result"), "unit", "label")


def vessel_trace(spark, d):
    return surfaces.vessel_trace(wall(spark, d)).select(*LINE, "step_number", "formula", (F.round("result", 1) + F.lit(0.0)).alias("result"), "unit")


def rational_minimum(spark, d):
    return compliance.rational(pipes(spark, d)).select(*LINE, "t_min_rational")


def wall_projection(spark, d):
    o = table(spark, d, "orders")
    yearly = o.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.max(F.col("o_totalprice").cast("double")).alias("t"))
    t = workbench.trend(yearly, "o_custkey", "year", "t")
    value = workbench.projected(F.col("t"), F.coalesce("slope", F.lit(0.0)), F.lit(5.0))
    # exact halves are rounded up: the first rounding takes away what the order of summation leaves in the last digits of a slope
    return t.select("o_custkey", "year", F.round(F.round(value, 6), 0).alias("in_five_years"))


CALLS = ("z3_formal_audit", "asme_stress_calc", "pid_topology_query", "compile_ooxml_document", "nope")


def calls(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    number = lambda base, step: (F.lit(base) + (k % step)).cast("string")
    arguments = F.create_map(
        F.lit("p_design"), number(100, 700), F.lit("d_outside"), number(4, 20), F.lit("t_actual"), F.when(k % 3 > 0, F.lit("0.25")), F.lit("pressure"), number(100, 700), F.lit("diameter"), F.when(k % 7 > 0, number(4, 20)).otherwise("wide"),
        F.lit("line_tag"), F.when(k % 2 > 0, F.concat(F.lit("L-"), k.cast("string"))), F.lit("doc_type"), F.lit("xlsx"),
    )
    return e.select(k.alias("call_id"), pick(CALLS, k).alias("tool"), arguments.alias("arguments"))


def tool_calls(spark, d):
    found = service.call_tools(calls(spark, d))
    field = lambda name: F.get_json_object("result", f"$.{name}")
    return found.select("call_id", "success", "error", field("status").alias("status"), field("line_tag").alias("line_tag"), field("output_file").alias("output_file"), F.round(field("remaining_life_years").cast("double"), 1).alias("life"))


BODIES = (
    '{"method": "ping", "id": 7}', '{"method": "initialize", "id": "a"}', '{"method": "tools/call", "params": {"name": "pid_topology_query", "arguments": {"line_tag": "L-1"}}}',
    '{"method": "call_tool", "params": {}, "id": 1}', "{broken", '{"method": "other", "id": 2}', '{"method": "tools/call", "params": {"tool_name": "nope"}}',
)


def jsonrpc_bodies(spark, d):
    return service.respond(table(spark, d, "events").select(F.col("event_id").alias("request_id"), pick(BODIES, F.col("event_id")).alias("body")))


def memo_defaults(spark, d):
    kind = "array<struct<" + ", ".join(f"{c}:string" for c in service.MEMO_COLUMNS) + ">>"
    p = table(spark, d, "part")
    own = F.array(F.struct(*[F.concat(F.lit(f"{c} "), F.col("p_partkey").cast("string")).alias(c) for c in service.MEMO_COLUMNS]))
    rows = p.select(F.col("p_partkey").alias("request_id"), F.when(F.col("p_partkey") % 2 == 0, own).otherwise(F.array().cast(kind)).alias("calculations"))
    return service.memo_rows(rows).select("request_id", "place", "tag", "verdict")


def cache_entries(spark, d):
    q = asked(spark, d)
    entries = q.select(F.col("query_id").alias("seq"), "query", F.when(F.col("query_id") % 5 == 0, "global").otherwise(F.concat(F.lit("t"), (F.col("query_id") % 2).cast("string"))).alias("tenant"), F.lit(2).alias("rank"), F.create_map(F.lit("std"), (F.col("query_id") % 3).cast("string")).alias("versions"))
    again = q.filter("query_id % 4 = 0").select((F.col("query_id") + 1).alias("order"), F.concat(F.lit(" "), F.col("query"), F.lit(" ")).alias("query"), F.lit("t9").alias("tenant"), F.lit(2).alias("rank"), F.create_map(F.lit("std"), F.lit("0")).alias("versions"))
    return retrieval.cache_put(entries, again)


def cache_versions(spark, d):
    asks = asked(spark, d).select("query_id", "query", F.concat(F.lit("t"), (F.floor(F.col("query_id") / 2) % 2).cast("string")).alias("tenant"), F.lit(3).alias("rank"))
    return retrieval.cache_get(cache_entries(spark, d), asks, active={"std": "0"})


def refusals(spark, d):
    found = hybrid_retrieve(spark, d).withColumn("score", F.col("score") - 0.6).filter("query_id % 5 > 0")
    return retrieval.refusal(asked(spark, d), found).select("query_id", F.substring_index("message", "(", 1).alias("message"))


def warning_lists(spark, d):
    w = retrieval.warning_list(temporal_warnings(spark, d))
    return w.select("query_id", F.size("warnings").alias("n"), F.sha2(F.array_join("warnings", "|"), 256).alias("sha"))


def adapter_swaps(spark, d):
    words = ("capital", "asme pipe spec", "tank 12", "board memo", "pump", "Wall Thickness")
    q = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("order"), pick(words, F.floor(F.col("event_id") / 3)).alias("query"))
    return retrieval.adapter_swaps(q).select("order", "domain", "adapter", "swapped")


ACTIONS = ("Opened drawing", "Operator authenticated by key", "Ran check", "Switched active persona to Auditor", "Terminated cryptographic session", "Vault unlocked")


def named_sessions(spark, d):
    log = table(spark, d, "events").select("user_id", "event_id", pick(ACTIONS, F.floor(F.col("event_id") / 3)).alias("action"))
    return access.named_sessions(log, "user_id", "event_id")


def vault_files(spark, d):
    p = table(spark, d, "part")
    return p.select(F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").cast("long").alias("size"), (F.col("p_partkey") % 4).alias("revision"), level(F.col("p_partkey")).alias("clearance"))


def vault_orders(spark, d):
    from pyspark.sql import Window

    rows = vault_files(spark, d)
    return rows.select("name", *[F.row_number().over(Window.partitionBy(F.col("revision")).orderBy(*access.vault_order(by))).alias(f"by_{by}") for by in ("name", "size", "clearance")])


def vault_listing(spark, d):
    rows = vault_files(spark, d)
    return access.vault_list(rows.filter("revision = 0"), rows.filter("revision > 0")).groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"))


def equipment_counts(spark, d):
    nodes = table(spark, d, "part").select((F.col("p_partkey") % 11).alias("drawing_id"), pick(("pump", "tank", "vessel", "valve", "column"), F.floor(F.col("p_partkey") / 11)).alias("sub_type"))
    return access.type_counts(nodes, ("pump", "tank", "vessel"))


def metadata_defaults(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "SECRET").alias("clearance_level"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("tenant_id"), F.when(F.col("doc_id") % 5 == 0, False).alias("is_active"))
    return chunking.with_defaults(docs)


def parent_join(spark, d):
    chunks = chunking.hierarchy(table(spark, d, "documents").select("doc_id", "text", F.concat(F.col("source"), F.col("doc_id").cast("string")).alias("family")))
    hits = chunks.select("chunk_id", "doc_id", "is_parent", "section_index").distinct()
    return chunking.resolve_parents(chunks, hits).groupBy("doc_id").agg(F.countDistinct("parent_id").alias("parents"), F.sum(F.when(F.col("is_parent"), F.length("parent_text"))).alias("chars"))


def patch_points(spark, d):
    b = boxes(spark, d).withColumns({"a1": F.lit(-50.0), "b1": F.lit(-60.0), "a2": F.lit(60.0), "b2": F.lit(70.0)})
    patch = ("a1", "b1", "a2", "b2")
    inside, near = (geometry.point_to_patch(F.col("x"), F.col("y"), patch, clip) for clip in (False, True))
    back = geometry.to_drawing(("x1", "y1", "x2", "y2"), patch)
    return b.select("box_id", F.round(inside["x"], 3).alias("x_inside"), F.round(near["x"], 3).alias("x_near"), F.round(near["y"], 3).alias("y_near"), F.round(back["x1"], 3).alias("left"), F.round(back["y2"], 3).alias("bottom"))


def mask_centroids(spark, d):
    b = boxes(spark, d).select((F.col("box_id") % 7).alias("img_id"), F.floor("x").cast("int").alias("x"), F.floor("y").cast("int").alias("y"), F.when(F.col("box_id") % 7 == 3, 0).otherwise(F.col("label") % 3).alias("value"))
    m = geometry.mask_centroid(b)
    return m.select("img_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def tent_mosaic(spark, d):
    at = F.col("vec_id") % 64
    e = table(spark, d, "embeddings").select(F.lit(0).alias("img_id"), F.col("vec_id").alias("patch_id"), (F.floor(F.col("vec_id") / 64) % 3 * 32 + at).alias("x"), F.lit(0).alias("y"), F.get("embedding", F.lit(0)).cast("double").alias("value"), geometry.tent(at, F.lit(64), 32).alias("weight"))
    return geometry.mosaic(e).select("x", F.round("value", 6).alias("value"))


def connected_parts(spark, d):
    p = table(spark, d, "part")
    chains = p.filter("p_partkey % 97 <> 0").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") - 1).alias("dst"))
    return graph.connected(chains).groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), F.max("node").alias("last"))


def cascade_units(spark, d):
    p = table(spark, d, "part")
    artifacts = p.select(F.col("p_partkey").alias("id"), F.lit("COMMITTED").alias("status"))
    made = p.select((F.col("p_partkey") + 1_000_000).alias("id"), F.col("p_partkey").alias("artifact"), F.lit("COMMITTED").alias("status"))
    changed = spark.range(5, 8).select("id")
    a, u = graph.cascade(artifacts, tree(spark, d), changed, made)
    return a.select("id", "status").unionByName(u.select("id", "status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def missing_tags(spark, d):
    p = table(spark, d, "part")
    nodes = p.filter("p_partkey % 10 <> 3").select(F.concat(F.lit("valve_HV-"), F.col("p_partkey").cast("string")).alias("node_id"), F.concat(F.lit("HV-"), F.col("p_partkey").cast("string")).alias("tag"))
    return graph.missing_tags(nodes, p.select(F.concat(F.lit("HV-"), F.col("p_partkey").cast("string")).alias("tag")))


def resolve_nodes(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey").cast("string")
    named = p.select(F.concat(F.lit("equipment_P-"), k).alias("node_id"), F.concat(F.lit("P-"), k).alias("tag"))
    plain = p.filter("p_partkey % 2 = 0").select(F.concat(F.lit("P-"), k).alias("node_id"), F.concat(F.lit("P-"), k).alias("tag"))
    wanted = p.select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("equipment_P-"), k)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("P-"), k)).otherwise(F.concat(F.lit("Q-"), k)).alias("tag"))
    return graph.resolve(named.unionByName(plain), wanted)


def sweep_units(spark, d):
    u = units(spark, d)
    deps = u.filter("id > 1").select("id", F.floor(F.col("id") / 3).alias("needs"))
    return ledger.sweep(u.drop("ts"), deps, now(d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("retry_count").alias("retries"))


def override_units(spark, d):
    u = units(spark, d).drop("ts")
    deps = u.filter("id > 1").select("id", F.floor(F.col("id") / 3).alias("needs"))
    asks = u.filter("id % 101 = 1").select("id", pick(("APPROVE", "RETRY", "REJECT"), F.floor(F.col("id") / 101)).alias("resolution"), F.lit("inspected on site and accepted").alias("justification"), F.lit("op").alias("operator_id"), F.when(F.col("id") % 2 == 0, "sig").otherwise("s").alias("signature"))
    return ledger.apply_overrides(u, asks, deps).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("execution_lease_id").alias("leases"), F.sum("retry_count").alias("retries"))


def first_ready(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("mission"), F.col("event_id").alias("id"), state(F.col("event_id")).alias("status"))
    return ledger.first_ready(e.filter("status = 'READY'"))


OUTPUTS = (
    "Monitoring physical network interface: eth0\ntype filter hook output\n0 packets captured\nVERDICT: [PASS]", "12 packets captured\nNETWORK ANOMALY DETECTED",
    "10:15:01.123456 IP 192.168.1.2.4567 > 8.8.8.8.443: Flags [S]\n10:15:02.123456 IP 192.168.1.2.4567 > 127.0.0.1.443: Flags [S]", "", "Monitoring physical network interface:  wlan1 \npolicy drop",
)


def output_verdicts(spark, d):
    return audit.output_verdict(table(spark, d, "events").select(F.col("event_id").alias("run_id"), pick(OUTPUTS, F.col("event_id")).alias("output")))


ADDRESSES = ("127.8.9.1", "::1", "localhost", "10.1.2.3", "8.8.8.8:443", "2001:db8::7", "fe80::1", "0.0.0.0", "example.org", "300.1.1.1", "", "172.31.0.9", "2001:db8:0:0:0:0:0:7", "172.32.0.1")
ALLOWED = ("10.0.0.0/8", "2001:db8::/32", "nonsense")


def subnet_checks(spark, d):
    ip = pick(ADDRESSES, F.col("event_id"))
    return table(spark, d, "events").select("event_id", audit.wan(ip).alias("wan"), audit.wan(ip, ALLOWED).alias("beyond"), audit.private(ip).alias("private"))


def socket_verdicts(spark, d):
    s = table(spark, d, "events").select("user_id", F.when(F.col("user_id") % 2 == 0, "127.0.0.1").otherwise(pick(ADDRESSES, F.col("event_id"))).alias("remote_ip"))
    return audit.socket_verdict(s, ["user_id"], ALLOWED)


def telemetry_order(spark, d):
    e = table(spark, d, "events")
    s = e.select((F.col("event_id") % 5).alias("pid"), F.concat(F.lit("127.0.0.1:"), (F.col("user_id") % 7).cast("string")).alias("laddr"), F.lit("-").alias("raddr"), F.lit("LISTEN").alias("status"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("process"), F.col("event_id").alias("seq"))
    bad = s.filter("seq % 1000 = 1").withColumn("raddr", F.lit("8.8.8.8:443")).drop("seq")
    found = audit.telemetry_rows(bad, s)
    none = audit.telemetry_rows(bad.limit(0), s.limit(0)).select(F.lit(-1).alias("place"), F.lit(None).cast("long").alias("pid"), "laddr", "raddr", "status", "process")
    return found.unionByName(none)


def live_vram(spark, d):
    live = F.when(F.col("p_partkey") % 4 > 0, F.col("p_size").cast("double"))
    return table(spark, d, "part").select("p_partkey", audit.live_split(live, {"reasoner": 7.6, "vision": 0.9}).alias("s")).select("p_partkey", F.round("s.reasoner", 6).alias("reasoner"), "s.total_gb", "s.reserve_gb", "s.within")


def subscriber_sessions(spark, d):
    e = table(spark, d, "events")
    rows = e.select("user_id", "ts", "event_id", pick(streams.KINDS, F.col("event_id")).alias("event_type"))
    s = streams.sessions_of(streams.told(rows), "user_id", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), 86400.0, 40)
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sent"), F.count_if(F.col("event") == "heartbeat").alias("beats"), F.max(F.when(F.col("event") != "heartbeat", F.col("seq"))).alias("last_event"))


def sheet_widths(spark, d):
    return files.column_widths(table(spark, d, "part").select("p_partkey", "p_name", "p_size"))


def vault_trail(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("/vault/Spec_"), F.col("doc_id").cast("string"), F.lit(".csv")).alias("path"), F.encode("text", "UTF-8").alias("content"), F.octet_length("text").cast("long").alias("length"))
    return files.vault_audit(files.vault_rows(docs), "op").select("name", "actor", "action", "hash", "details")


def cosine_neighbours(spark, d):
    """The ten nearest vectors of every vector whose id is divisible by 50, among all others."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return retrieval.nearest(v, v.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q")), 10).select("query_id", "chunk_id", "score", "rank")


def index_search(spark, d):
    """Words, vectors and metadata at once; a passage's vector is that of the same number."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang")
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    q = asked(spark, d)
    near = v.join(q.select(F.col("query_id").alias("chunk_id")), "chunk_id").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"))
    return retrieval.index_search(docs, v, q, near, F.col("lang") == "en").select("query_id", "chunk_id", "rank")


def line_attributes(spark, d):
    """The attributes of every fiftieth line, every other one of them unknown to the graph, among all edges."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    attributes = F.create_map(F.lit("pipe_size"), F.when(k % 2 == 0, k.cast("double")), F.lit("P"), F.when(k % 3 == 0, F.lit(99.0)), F.lit("t_actual"), F.when(k % 5 == 0, F.lit(0.5)))
    edges = p.select(k.alias("edge_id"), F.format_string('%d"-CW-%d-CS-300', k % 20 + 1, k + 100).alias("edge_tag"), attributes.alias("attributes"))
    wanted = p.filter("p_partkey % 50 = 0").select(F.when(k % 100 == 0, F.format_string('%d"-CW-%d-CS-300', k % 20 + 1, k + 100)).otherwise(F.format_string('%d"-XX-%d-CS-300', k % 20 + 1, k + 100)).alias("tag"))
    return workbench.line_attributes(edges, wanted)


def trust_pairs(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50).alias("belief"), pick(planning.PROOFS, F.col("p_partkey")).alias("proof"))
    return p.select("p_partkey", planning.trusted(F.col("belief"), F.col("proof")).alias("committed"))


def plan_edits(spark, d):
    p = table(spark, d, "part")
    plan = p.select(F.col("p_partkey").alias("id"), F.lit("PROPOSED").alias("status"), (F.col("p_size") > 25).alias("essential"))
    deps = p.filter("p_partkey > 1").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 2).alias("needs"))
    moved = planning.reorder(deps, deps.filter("id = 9"), spark.createDataFrame([(9, 5)], "id long, needs long"))
    done = planning.approve(planning.prune(plan, p.filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("id"))), 2)
    again = planning.replan(done, moved, spark.range(5, 6).select("id"))
    return again.select("id", "status", "version")


def page_forms(spark, d):
    p = table(spark, d, "part")
    box = F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(1.0).alias("x2"), F.lit(1.0).alias("y2"))
    element = F.struct(F.lit("e1").alias("element_id"), pick((*planning.ELEMENTS, "NOISE"), F.col("p_partkey")).alias("type"), box.alias("bounding_box"), F.col("p_name").alias("text_content"), F.lit(0.5).alias("confidence"))
    page = F.struct(F.lit(1).alias("page_number"), F.col("p_size").alias("width_px"), F.lit(100).alias("height_px"), pick((*planning.MODALITIES, None), F.col("p_partkey")).alias("modality"), F.array(element).alias("elements"))
    doc = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("document_id"), F.sha2("p_name", 256).alias("sha256_hash"), F.array(page).alias("pages")))
    r = planning.read_pages(doc)
    return p.select("p_partkey", r["pages"][0]["elements"][0]["text_content"].alias("text"), r["pages"][0]["width_px"].alias("width"))


def canonical_json(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", planning.canonical(F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("key"), F.col("p_partkey").cast("string"), F.lit("brand"), F.lit('a "b"'))).alias("json"))


QUERIES = {f.__name__: f for f in (
    evaluate_rows, exact_tool, native_tool, browser_fallback, script_defaults, symbolic_calc, pipe_trace, vessel_trace, rational_minimum, wall_projection, tool_calls, jsonrpc_bodies, memo_defaults, cache_versions, refusals, warning_lists,
    adapter_swaps, named_sessions, vault_orders, vault_listing, equipment_counts, metadata_defaults, parent_join, patch_points, mask_centroids, tent_mosaic, connected_parts, cascade_units, missing_tags, resolve_nodes, sweep_units,
    override_units, first_ready, output_verdicts, subnet_checks, socket_verdicts, telemetry_order, live_vram, subscriber_sessions, sheet_widths, vault_trail, cosine_neighbours, index_search, line_attributes, trust_pairs, plan_edits, page_forms, canonical_json,
)}

GOOD = "CASE WHEN P > 0 AND D > 0 AND S > 0 AND E > 0 AND E <= 1 AND t > 0 THEN P * D / (2 * (S * E + P * Y)) + c END"
TEXT = lambda c: f"CAST({c} AS VARCHAR)"
KEYS = "l_orderkey, l_linenumber"


def _read(**columns: str) -> str:
    """Line items with inputs as given by SQL; m: their least thickness."""
    usual = {"P": "P", "D": "D", "S": "S", "E": "E", "Y": "Y", "c": "c", "t": "t_actual"} | columns
    return PIPES.replace("\n    m AS", "\n    m0 AS") + f", i AS (SELECT {KEYS}, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in usual.items())} FROM p), r AS (SELECT *, P * D / (2 * (S * E + P * Y)) + c AS m FROM i)"


UNSURE = lambda gap, v, other="NULL": f"CASE WHEN l_orderkey % 3 <> {gap} THEN {v} ELSE {other} END"
RECURSE = "r AS (SELECT s.id AS node FROM starts s UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.node)"
WORDS = ("capital", "asme pipe spec", "tank 12", "board memo", "pump", "Wall Thickness")
IPS = lambda bools: f"list_extract([{', '.join('true' if b else 'false' for b in bools)}], CAST(event_id % 14 + 1 AS INTEGER))"
WAN = [0, 0, 0, 1, 1, 1, 1, 0, 1, 1, 0, 1, 1, 1]
BEYOND = [0, 0, 0, 0, 1, 0, 1, 0, 1, 1, 0, 1, 0, 1]
OWN = [1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0]
SOCKETS = "SELECT event_id % 5 AS pid, '127.0.0.1:' || CAST(user_id % 7 AS VARCHAR) AS laddr, event_id FROM events"
VAULTED = f"SELECT p_name || '-' || CAST(p_partkey AS VARCHAR) AS name, p_size AS size, p_partkey % 4 AS revision, list_position(['PUBLIC','INTERNAL','CONFIDENTIAL','RESTRICTED','SECRET','TOP_SECRET'], {LEVELS_SQL.format(n='p_partkey')}) AS lv FROM part"
TOOL_ROWS = f"SELECT event_id AS call_id, {_pick(CALLS, 'event_id')} AS tool, 100.0::DOUBLE + event_id % 700 AS p, 4.0::DOUBLE + event_id % 20 AS d FROM events"
ANSWERS = (
    '{"jsonrpc":"2.0","id":7,"result":{}}', f'{{"jsonrpc":"2.0","id":"a","result":{{"protocolVersion":"{service.PROTOCOL}","capabilities":{{"tools":{{}}}},"serverInfo":{{"name":"sparkwright","version":"1.0.0","airgap":"ACTIVE"}}}}}}',
    '{"jsonrpc":"2.0","id":null,"result":{"content":[{"type":"text","text":"{\\"line_tag\\":\\"L-1\\",\\"status\\":\\"CONNECTED\\",\\"upstream_node\\":\\"V-101 (Pressure Vessel)\\",\\"downstream_node\\":\\"P-101A (Centrifugal Pump)\\",\\"spec\\":\\"ASME B31.3 / 150# RF\\"}"}],"isError":false}}',
    '{"jsonrpc":"2.0","id":1,"error":{"code":-32602,"message":"Missing \'name\' in tool call parameters"}}', '{"jsonrpc":"2.0","id":null,"error":{"code":-32700,"message":"Parse error"}}', '{"jsonrpc":"2.0","id":2,"error":{"code":-32601,"message":"Method \'other\' not found"}}',
    '{"jsonrpc":"2.0","id":null,"result":{"content":[{"type":"text","text":"Unknown tool: nope"}],"isError":true}}',
)
SWEPT = f"""u AS (SELECT id, status, retry_count, status = 'EXECUTING' AND until < TIMESTAMP '2024-06-01 00:00:00' AS late FROM ({UNITS})),
    edges AS (SELECT id // 3 AS src, id AS dst FROM u WHERE id > 1)"""

ORACLE = {
    "evaluate_rows": _read(P=UNSURE(1, "P", "CASE WHEN l_orderkey % 3 <> 2 THEN P END"), t="t_actual") + f""", s AS (SELECT *, {GOOD} AS g FROM r)
        SELECT {KEYS}, coalesce(t >= g, false) AS is_valid, CASE WHEN t >= g THEN 'SAT' ELSE 'UNSAT' END AS status, CASE WHEN g IS NULL THEN -999999.0 ELSE round(t - g, 6) END AS margin, round(coalesce(g, 0.0), 6) AS t_min, round(t, 6) AS t_actual FROM s""",
    "exact_tool": _read(D=UNSURE(2, "D"), E=UNSURE(0, "E", "1.0"), t=UNSURE(2, "t_actual")) + f""" SELECT {KEYS}, l_orderkey % 3 <> 2 AS success, CASE WHEN l_orderkey % 3 = 2 THEN '''d_outside''' END AS error,
        CASE WHEN l_orderkey % 3 <> 2 THEN t >= m END AS is_safe, CASE WHEN l_orderkey % 3 = 2 THEN NULL WHEN t >= m THEN 'SAT' ELSE 'UNSAT' END AS status, CASE WHEN l_orderkey % 3 <> 2 THEN round(t - m, 6) END AS margin FROM r""",
    "native_tool": _read(P=UNSURE(1, "P", "100.0"), D=UNSURE(2, "D", "4.0"), c="0.0", t=UNSURE(0, "t_actual", "0.3")) + f" SELECT {KEYS}, t >= m AS is_safe, CASE WHEN t >= m THEN 'FIT_FOR_SERVICE' ELSE 'RETIREMENT_REQUIRED' END AS status, round(m, 4) AS t_min, round(t - m, 4) + 0.0::DOUBLE AS margin FROM r",
    "browser_fallback": _read(D=UNSURE(2, "D", "16.0"), S="20000.0", c="CASE WHEN c = 0 THEN 0.0625 ELSE c END", t=UNSURE(0, "t_actual", "0.32")) + f" SELECT {KEYS}, round(m, 4) AS t_min, round(t - m, 4) + 0.0::DOUBLE AS margin, round(round((t - m) * 25.4::DOUBLE, 2), 1) + 0.0::DOUBLE AS margin_mm, CASE WHEN t - m >= 0 THEN 'SAT' ELSE 'UNSAT' END AS verdict FROM r",
    "script_defaults": _read(P=UNSURE(1, "P", "2.5"), S=UNSURE(2, "S", "137.9"), t=UNSURE(0, "t_actual", "9.52")) + f" SELECT {KEYS}, round(m, 6) AS t_min, round(t - m, 6) AS margin, CASE WHEN t - m >= 0 THEN 'SAT' ELSE 'UNSAT' END AS verdict FROM r",
    "symbolic_calc": _read(E=UNSURE(0, "E", "1.0"), c="CASE WHEN l_orderkey % 3 > 1 THEN c ELSE 0.0 END") + f" SELECT {KEYS}, t >= m AS is_verified, round(m, 6) AS computed_value, 'Z3 Status: ' || CASE WHEN t >= m THEN 'SAT' ELSE 'UNSAT' END || ' | Margin: ' || split_part(printf('%.4f', t - m), '.', 1) AS log FROM r",
    "pipe_trace": PIPES + f""", s AS (SELECT *, 2 * (S * E + P * Y) AS den FROM m), k AS (SELECT {KEYS}, unnest([1, 2, 3, 4, 5]) AS step_number,
        unnest([{TEXT('P')} || ' * ' || {TEXT('D')}, '2 * (' || {TEXT('S')} || '*' || {TEXT('E')} || ' + ' || {TEXT('P')} || '*' || {TEXT('Y')} || ')', printf('%.4f', P * D) || ' / ' || printf('%.4f', den), NULL, NULL]) AS substituted,
        unnest([P * D, den, tp, t_min, t_actual - t_min]) AS v, unnest([{', '.join(repr(u) for _, u, _ in surfaces.PIPE_STEPS)}]) AS unit, unnest([{', '.join(repr(x) for _, _, x in surfaces.PIPE_STEPS)}]) AS label FROM s)
        SELECT {KEYS}, step_number, substituted, round(v, 4) + 0.0::DOUBLE AS result, unit, label FROM k""",
    "vessel_trace": WALL + f""", k AS (SELECT {KEYS}, unnest([1, 2]) AS step_number, unnest(['t_actual - t_min', '(t_actual - t_min) / Cr']) AS formula, unnest([round(t_actual - t_min, 4), CASE WHEN r <= 0 THEN 999.0 ELSE round((t_actual - t_min) / r, 2) END]) AS v, unnest(['mm', 'years']) AS unit FROM w)
        SELECT {KEYS}, step_number, formula, round(v, 1) + 0.0::DOUBLE AS result, unit FROM k""",
    "rational_minimum": PIPES + f""", n AS (SELECT {KEYS}, CAST(P AS BIGINT) AS p, CAST(D AS BIGINT) AS d, CAST(round(E * 100) AS BIGINT) AS e, CAST(c * 16 AS BIGINT) AS c FROM m), f AS (SELECT {KEYS}, 160 * p * d + c * (4000 * e + 8 * p) AS a, 16 * (4000 * e + 8 * p) AS b FROM n)
        SELECT {KEYS}, CAST(a // gcd(a, b) AS VARCHAR) || '/' || CAST(b // gcd(a, b) AS VARCHAR) AS t_min_rational FROM f""",
    "wall_projection": """WITH y AS (SELECT o_custkey, year(o_orderdate) AS year, max(CAST(o_totalprice AS DOUBLE)) AS t FROM orders GROUP BY 1, 2), s AS (SELECT o_custkey, regr_slope(t, CAST(year AS DOUBLE)) AS slope FROM y GROUP BY 1)
        SELECT o_custkey, CAST(year AS INTEGER) AS year, round(greatest(t + CASE WHEN slope IS NULL OR isnan(slope) THEN 0.0 ELSE slope END * 5, 0.0), 0) AS in_five_years FROM y JOIN s USING (o_custkey)""",
    "tool_calls": f"""WITH c AS ({TOOL_ROWS}), x AS (SELECT *, CASE WHEN tool = 'nope' THEN 'Unknown tool: nope' WHEN tool = 'z3_formal_audit' AND call_id % 3 = 0 THEN '''t_actual''' WHEN tool = 'asme_stress_calc' AND call_id % 7 = 0 THEN 'could not convert string to float: ''wide'''
            WHEN tool = 'pid_topology_query' AND call_id % 2 = 0 THEN '''line_tag''' END AS error, p * d / (2 * (20000.0 + p * 0.4::DOUBLE)) AS m, 0.065::DOUBLE * d AS t FROM c)
        SELECT call_id, error IS NULL AS success, error, CASE WHEN error IS NOT NULL THEN NULL WHEN tool = 'z3_formal_audit' THEN CASE WHEN 0.25 >= m THEN 'SAT' ELSE 'UNSAT' END WHEN tool = 'asme_stress_calc' THEN CASE WHEN t >= m THEN 'FIT_FOR_SERVICE' ELSE 'RETIREMENT_REQUIRED' END
            WHEN tool = 'pid_topology_query' THEN 'CONNECTED' ELSE 'ACCEPTED' END AS status, CASE WHEN error IS NULL AND tool = 'pid_topology_query' THEN 'L-' || CAST(call_id AS VARCHAR) END AS line_tag, CASE WHEN tool = 'compile_ooxml_document' THEN 'mcp_output_' || CAST(call_id AS VARCHAR) || '.xlsx' END AS output_file,
            CASE WHEN error IS NULL AND tool = 'asme_stress_calc' THEN round(round(greatest(0.0, (t - m) / 0.005::DOUBLE), 2), 1) END AS life FROM x""",
    "jsonrpc_bodies": "SELECT event_id AS request_id, list_extract([" + ", ".join("'" + a.replace("'", "''") + "'" for a in ANSWERS) + "], CAST(event_id % 7 + 1 AS INTEGER)) AS response FROM events",
    "memo_defaults": "SELECT p_partkey AS request_id, CAST(0 AS INTEGER) AS place, 'tag ' || CAST(p_partkey AS VARCHAR) AS tag, 'verdict ' || CAST(p_partkey AS VARCHAR) AS verdict FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, CAST(i AS INTEGER), t, v FROM part, (VALUES (0, '16\"-P-101-CS-150', 'SAT'), (1, '12\"-P-105-CS-150', 'UNSAT')) x(i, t, v) WHERE p_partkey % 2 = 1",
    "cache_versions": f"""WITH q AS (SELECT item_id AS query_id, text AS query, 't' || CAST(item_id // 2 % 2 AS VARCHAR) AS tenant, list_distinct({TOK("text")}) AS t FROM benchmark), top AS (SELECT max(item_id) AS n FROM benchmark),
        e AS (SELECT item_id AS seq, text AS query, CASE WHEN item_id % 5 = 0 THEN 'global' ELSE 't' || CAST(item_id % 2 AS VARCHAR) END AS tenant, item_id % 3 = 0 AS fresh FROM benchmark UNION ALL SELECT n + item_id + 1, ' ' || text || ' ', 't9', true FROM benchmark, top WHERE item_id % 4 = 0),
        k AS (SELECT *, md5(lower(trim(query))) AS k, list_distinct({TOK("query")}) AS t FROM e), l AS (SELECT max(seq) AS seq FROM k GROUP BY k), v AS (SELECT * FROM k WHERE fresh),
        x AS (SELECT q.query_id, 1 AS tier, v.seq AS entry_seq FROM q JOIN v ON md5(lower(trim(q.query))) = v.k AND v.tenant IN (q.tenant, 'global') JOIN l ON l.seq = v.seq),
        a AS (SELECT q.query_id, 2 AS tier, min(v.seq) AS entry_seq FROM q JOIN v ON v.tenant IN (q.tenant, 'global') AND len(list_intersect(q.t, v.t)) >= 0.96 * (len(q.t) + len(v.t) - len(list_intersect(q.t, v.t))) WHERE len(list_intersect(q.t, v.t)) > 0 GROUP BY q.query_id)
        SELECT * FROM x UNION ALL SELECT * FROM a WHERE query_id NOT IN (SELECT query_id FROM x)""",
    "refusals": HYBRID + """, g AS (SELECT query_id, round(0.4 * avg(score - 0.6) + 0.6 * max(score - 0.6), 3) AS g FROM h WHERE query_id % 5 > 0 GROUP BY query_id)
        SELECT query_id, CASE WHEN g IS NULL THEN 'Insufficient domain context found in the air-gapped knowledge base to safely answer this query according to engineering standards.' ELSE 'Grounding score ' END AS message FROM q LEFT JOIN g USING (query_id) WHERE coalesce(g, 0.0) < 0.45""",
    "warning_lists": "WITH w AS (" + DOCUMENTS["temporal_warnings"] + ") SELECT query_id, CAST(count(*) AS INTEGER) AS n, sha256(string_agg(warning, '|' ORDER BY first_rank, warning)) AS sha FROM w GROUP BY query_id",
    "adapter_swaps": f"""WITH q AS (SELECT user_id, event_id, {_pick(('API_PETROCHEMICAL', 'ASME_MECHANICAL', 'API_PETROCHEMICAL', 'PSU_TENDER_MEMOS', 'GENERAL', 'ASME_MECHANICAL'), 'event_id // 3')} AS domain FROM events),
        a AS (SELECT *, CASE domain WHEN 'API_PETROCHEMICAL' THEN 'lora_api_v1' WHEN 'ASME_MECHANICAL' THEN 'lora_asme_v1' WHEN 'PSU_TENDER_MEMOS' THEN 'lora_psu_v1' END AS adapter FROM q)
        SELECT event_id AS "order", domain, adapter, adapter IS NOT NULL AND adapter IS DISTINCT FROM lag(adapter) OVER (PARTITION BY user_id ORDER BY event_id) AS swapped FROM a""",
    "named_sessions": f"""WITH l AS (SELECT user_id, event_id, CAST(event_id // 3 % 6 AS INTEGER) AS a FROM events), f AS (SELECT *, CASE WHEN a IN (1, 3, 4, 5) OR row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 1 ELSE 0 END AS f FROM l),
        s AS (SELECT *, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM f), g AS (SELECT user_id, session_no, min_by(a, event_id) AS a, min(event_id) AS start, count(*) AS n FROM s GROUP BY 1, 2),
        t AS (SELECT *, CASE WHEN session_no = 1 THEN 'BOOT // AIR-GAP' WHEN a = 4 THEN 'TERMINATED' WHEN a = 3 THEN 'SWITCH' WHEN a IN (1, 5) THEN 'ED25519 // VERIFIED' ELSE 'RUNTIME' END AS tag FROM g)
        SELECT user_id, session_no, CASE tag WHEN 'BOOT // AIR-GAP' THEN 'BOOT & SECURE ENCLAVE INITIALIZATION' WHEN 'TERMINATED' THEN 'SESSION TERMINATION & VAULT SEALING' WHEN 'SWITCH' THEN 'PERSONA MIGRATION // Auditor' WHEN 'ED25519 // VERIFIED' THEN 'OPERATOR SESSION #' || CAST(session_no AS VARCHAR)
            ELSE 'SESSION #' || CAST(session_no AS VARCHAR) || ' // WORKBENCH EXECUTION' END AS title, tag, start, n FROM t""",
    "vault_orders": f"WITH v AS ({VAULTED}) SELECT name, CAST(row_number() OVER (PARTITION BY revision ORDER BY name) AS INTEGER) AS by_name, CAST(row_number() OVER (PARTITION BY revision ORDER BY size DESC, name) AS INTEGER) AS by_size, CAST(row_number() OVER (PARTITION BY revision ORDER BY lv DESC, name) AS INTEGER) AS by_clearance FROM v",
    "vault_listing": f"WITH v AS ({VAULTED}) SELECT CASE WHEN revision = 0 THEN 0 ELSE 1 END AS place, count(*) AS n, min(name) AS first FROM v GROUP BY 1",
    "equipment_counts": f"WITH n AS (SELECT p_partkey % 11 AS drawing_id, {_pick(('pump', 'tank', 'vessel', 'valve', 'column'), 'p_partkey // 11')} AS t FROM part) SELECT drawing_id, count(*) FILTER (t = 'pump') AS pump, count(*) FILTER (t = 'tank') AS tank, count(*) FILTER (t = 'vessel') AS vessel, count(*) AS total FROM n GROUP BY 1",
    "metadata_defaults": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'SECRET' ELSE 'PUBLIC' END AS clearance_level, CASE WHEN doc_id % 3 = 0 THEN source ELSE 'default_tenant' END AS tenant_id, '1.0' AS version_number, substring(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS doc_family_id, doc_id % 5 <> 0 AS is_active FROM documents",
    "parent_join": "WITH s AS (" + DOCUMENTS["fixed_blocks"] + ") SELECT doc_id, count(*) AS parents, CAST(sum(n) AS BIGINT) AS chars FROM s GROUP BY doc_id",
    "patch_points": BOX + """, k AS (SELECT *, x >= -50 AND x < 60 AND y >= -60 AND y < 70 AS inside FROM b)
        SELECT box_id, CASE WHEN inside THEN round(x + 50, 3) END AS x_inside, round(CASE WHEN inside THEN x + 50 ELSE greatest(0.0, least(109.0, x + 50)) END, 3) AS x_near, round(CASE WHEN inside THEN y + 60 ELSE greatest(0.0, least(129.0, y + 60)) END, 3) AS y_near, round(x1 - 50, 3) AS "left", round(y2 - 60, 3) AS bottom FROM k""",
    "mask_centroids": BOX + ", m AS (SELECT box_id % 7 AS img_id, floor(x) AS x, floor(y) AS y, CASE WHEN box_id % 7 = 3 THEN 0 ELSE label % 3 END AS v FROM b) SELECT img_id, round(avg(x) FILTER (v > 0), 6) AS x, round(avg(y) FILTER (v > 0), 6) AS y FROM m GROUP BY img_id",
    "tent_mosaic": """WITH e AS (SELECT vec_id // 64 % 3 * 32 + vec_id % 64 AS x, least(1.0::DOUBLE, least(vec_id % 64 + 1, 64 - vec_id % 64) / 32.0::DOUBLE) AS w, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings)
        SELECT x, round(sum(w * v) / sum(w), 6) AS value FROM e GROUP BY x""",
    "connected_parts": "WITH g AS (SELECT CASE WHEN p_partkey % 97 = 0 THEN p_partkey ELSE p_partkey // 97 * 97 END AS component, p_partkey AS node FROM part WHERE p_partkey % 97 <> 0) SELECT component, count(*) + 1 AS nodes, max(node) AS last FROM g GROUP BY component",
    "cascade_units": "WITH RECURSIVE edges AS (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey > 1), starts AS (SELECT unnest(range(5, 8)) AS id), " + RECURSE + """, s AS (SELECT p_partkey AS id, p_partkey IN (SELECT node FROM r) AS hit FROM part)
        SELECT status, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT id, CASE WHEN hit THEN 'INVALIDATED' ELSE 'COMMITTED' END AS status FROM s UNION ALL SELECT id + 1000000, CASE WHEN hit THEN 'READY' ELSE 'COMMITTED' END FROM s) GROUP BY status""",
    "missing_tags": "SELECT 'HV-' || CAST(p_partkey AS VARCHAR) AS tag FROM part WHERE p_partkey % 10 = 3",
    "resolve_nodes": "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'equipment_P-' ELSE 'P-' END || CAST(p_partkey AS VARCHAR) AS tag, 'equipment_P-' || CAST(p_partkey AS VARCHAR) AS node_id FROM part WHERE p_partkey % 3 < 2",
    "sweep_units": f"WITH RECURSIVE {SWEPT}, starts AS (SELECT id FROM u WHERE late AND retry_count + 1 >= 3), r AS (SELECT e.dst AS node FROM starts s JOIN edges e ON e.src = s.id UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.node)" + """,
        k AS (SELECT id, CASE WHEN late THEN CASE WHEN retry_count + 1 >= 3 THEN 'WAITING_HUMAN' ELSE 'READY' END ELSE status END AS status, retry_count + CASE WHEN late THEN 1 ELSE 0 END AS retry_count FROM u)
        SELECT CASE WHEN status IN ('READY', 'PROPOSED') AND id IN (SELECT node FROM r) THEN 'BLOCKED' ELSE status END AS status, count(*) AS n, CAST(sum(retry_count) AS BIGINT) AS retries FROM k GROUP BY 1""",
    "override_units": f"WITH RECURSIVE {SWEPT}, asks AS (SELECT id, id // 101 % 3 AS a FROM u WHERE id % 101 = 1), starts AS (SELECT id FROM asks WHERE a < 2), r AS (SELECT e.dst AS node FROM starts s JOIN edges e ON e.src = s.id UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.node)" + """,
        k AS (SELECT u.id, a, CASE WHEN a = 0 THEN 'VERIFIED' WHEN a = 1 THEN 'READY' WHEN a = 2 THEN 'FAILED' WHEN status = 'BLOCKED' AND u.id IN (SELECT node FROM r) THEN 'READY' ELSE status END AS status, CASE WHEN a = 1 THEN 0 ELSE retry_count END AS retry_count FROM u LEFT JOIN asks USING (id))
        SELECT status, count(*) AS n, count(*) FILTER (a IS NULL) AS leases, CAST(sum(retry_count) AS BIGINT) AS retries FROM k GROUP BY status""",
    "first_ready": f"WITH e AS (SELECT user_id, event_id, {STATE.format(n='event_id')} AS status FROM events) SELECT user_id AS mission, min(event_id) AS id FROM e WHERE status = 'READY' GROUP BY user_id",
    "output_verdicts": """SELECT event_id AS run_id, list_extract(['eth0', NULL, NULL, NULL, 'wlan1'], CAST(event_id % 5 + 1 AS INTEGER)) AS interface, event_id % 5 IN (0, 4) AS policy_drop, CAST(list_extract([0, 12, 1, 0, 0], CAST(event_id % 5 + 1 AS INTEGER)) AS BIGINT) AS packets_captured,
        CAST(CASE WHEN event_id % 5 = 2 THEN 1 ELSE 0 END AS BIGINT) AS open_wan_sockets, CASE WHEN event_id % 5 IN (1, 2) THEN 'WARNING' ELSE 'PASS' END AS verdict, event_id % 5 NOT IN (1, 2) AS passed FROM events""",
    "subnet_checks": f"SELECT event_id, {IPS(WAN)} AS wan, {IPS(BEYOND)} AS beyond, {IPS(OWN)} AS private FROM events",
    "socket_verdicts": f"WITH s AS (SELECT user_id, user_id % 2 = 1 AND {IPS(BEYOND)} AS v FROM events) SELECT user_id, count(*) AS sockets, count(*) FILTER (v) AS violations, CASE WHEN count(*) FILTER (v) = 0 THEN 'PASS' ELSE 'WARNING' END AS verdict FROM s GROUP BY user_id",
    "telemetry_order": f"""WITH s AS ({SOCKETS}) SELECT 0 AS place, pid, laddr, '8.8.8.8:443' AS raddr, 'LISTEN' AS status, 'p' || CAST(event_id AS VARCHAR) AS process FROM s WHERE event_id % 1000 = 1
        UNION ALL SELECT 1, pid, laddr, '-', 'LISTEN', 'p' || CAST(min(event_id) AS VARCHAR) FROM s GROUP BY pid, laddr UNION ALL SELECT -1, NULL, a, '-', 'LISTEN', b FROM (VALUES ('127.0.0.1:8000', 'uvicorn (FastAPI Core)'), ('127.0.0.1:5173', 'node (Vite SPA)')) x(a, b)""",
    "live_vram": """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN CAST(p_size AS DOUBLE) END AS live FROM part), s AS (SELECT p_partkey, coalesce(live * (7.6::DOUBLE / 8.5::DOUBLE), 7.6::DOUBLE) AS reasoner, coalesce(live, 8.5::DOUBLE) AS total FROM p)
        SELECT p_partkey, round(reasoner, 6) AS reasoner, round(total, 3) AS total_gb, round(24.0 - total, 3) AS reserve_gb, total <= 24.0 AS within FROM s""",
    "subscriber_sessions": """WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS moment FROM events WHERE ts >= TIMESTAMP '2024-01-01 00:00:00'), a AS (SELECT user_id, event_id, moment FROM e UNION ALL SELECT DISTINCT user_id, -1, epoch_us(TIMESTAMP '2024-01-01 00:00:00') / 1000000.0::DOUBLE FROM e),
        g AS (SELECT *, lead(moment) OVER (PARTITION BY user_id ORDER BY moment, event_id) - moment AS gap FROM a), k AS (SELECT *, greatest(CAST(ceil(coalesce(gap, 0.0) / 86400.0) AS BIGINT) - 1, 0) AS beats FROM g),
        m AS (SELECT user_id, event_id, unnest(range(0, beats + 1)) AS i, moment FROM k), n AS (SELECT user_id, i, row_number() OVER (PARTITION BY user_id ORDER BY moment + i * 86400.0, event_id, i) AS seq FROM m)
        SELECT user_id, count(*) AS sent, count(*) FILTER (i > 0) AS beats, CAST(max(seq) FILTER (i = 0) AS INTEGER) AS last_event FROM n WHERE seq <= 40 GROUP BY user_id""",
    "sheet_widths": "SELECT unnest(['p_partkey', 'p_name', 'p_size']) AS column, unnest([greatest(greatest(max(length(CAST(p_partkey AS VARCHAR))), 9) + 3, 12), greatest(greatest(max(length(p_name)), 6) + 3, 12), 12]) AS width FROM part",
    "vault_trail": """WITH v AS (SELECT 'Spec_' || CAST(doc_id AS VARCHAR) || '.csv' AS name, sha256(text) AS h, octet_length(encode(text)) AS n FROM documents)
        SELECT name, 'USER' AS actor, 'Manually ingested input file: ' || name AS action, substring(h, 1, 24) || '...' AS hash, 'Size: ' || CAST(n AS VARCHAR) || ' | Type: INSPECTION | Clearance: CONFIDENTIAL | Egress: 0 WAN Packets' AS details FROM v
        UNION ALL SELECT name, 'PLATFORM', 'SHA-256 Merkle leaf registered and sealed into vault', h, 'Cryptographic zero-knowledge binding to persona: op' FROM v""",
    "cosine_neighbours": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
        SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""",
    "index_search": BASE.rstrip().rstrip(",").replace("FROM b WHERE score > 0)", "FROM b JOIN documents ON doc_id = chunk_id WHERE score > 0 AND lang = 'en')") + """,
        v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN benchmark ON item_id = a.vec_id JOIN v b ON true JOIN documents ON doc_id = b.vec_id WHERE lang = 'en'),
        nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 25),
        u AS (SELECT query_id, chunk_id, rank, 0 AS side FROM nr UNION ALL SELECT query_id, chunk_id, rank, 1 FROM br), fu AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(side * 1000 + rank) AS first FROM u GROUP BY 1, 2)
        SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank FROM fu) WHERE rank <= 25""",
    "line_attributes": """WITH k AS (SELECT p_partkey AS k, p_partkey % 100 = 0 AS known FROM part WHERE p_partkey % 50 = 0)
        SELECT CAST(k % 20 + 1 AS VARCHAR) || CASE WHEN known THEN '"-CW-' ELSE '"-XX-' END || CAST(k + 100 AS VARCHAR) || '-CS-300' AS tag, CASE WHEN known THEN k ELSE k % 20 + 1 END::DOUBLE AS outside_diameter,
        CASE WHEN known AND k % 3 = 0 THEN 99.0 ELSE CASE k + 100 WHEN 150 THEN 285.0 WHEN 400 THEN 985.0 WHEN 600 THEN 1480.0 WHEN 900 THEN 2220.0 WHEN 1500 THEN 3705.0 WHEN 2500 THEN 6170.0 ELSE 740.0 END END::DOUBLE AS design_pressure,
        CASE WHEN known THEN 0.5 ELSE 0.375 END::DOUBLE AS measured_thickness FROM k""",
    "trust_pairs": "SELECT p_partkey, p_size / 50.0::DOUBLE >= 0.85::DOUBLE AND p_partkey % 3 = 0 AS committed FROM part",
    "plan_edits": "WITH RECURSIVE edges AS (SELECT CASE WHEN p_partkey = 9 THEN 5 ELSE p_partkey // 2 END AS src, p_partkey AS dst FROM part WHERE p_partkey > 1), starts AS (SELECT 5 AS id), " + RECURSE + """
        SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 AND p_size <= 25 THEN 'PRUNED' WHEN p_partkey IN (SELECT node FROM r) THEN 'PROPOSED' ELSE 'READY' END AS status, CAST(2 AS INTEGER) AS version FROM part""",
    "page_forms": "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 6 AND p_partkey % 6 <> 5 THEN p_name END AS text, CASE WHEN p_partkey % 7 <> 6 AND p_partkey % 6 <> 5 THEN p_size END AS width FROM part",
    "canonical_json": "SELECT p_partkey, '{\"brand\":\"a \\\"b\\\"\",\"key\":\"' || CAST(p_partkey AS VARCHAR) || '\",\"size\":\"' || CAST(p_size AS VARCHAR) || '\"}' AS json FROM part",
}
