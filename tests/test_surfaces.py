"""Surfaces that the tables do not reach: files, streams, rings, images, registered functions."""

import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwright.operators import audit, compliance, graph, raster, retrieval, service, surfaces
from sparkwright.sources import files
from sparkwright.streaming import streams


def test_companion_falls_back_and_mirrors(spark, tmp_path):
    cases = {
        "a": ('{"equipment": [], "things": [{"tag": "P-1"}], "one": {"tag": "V-2", "type": "vessel"}, "n": 3}', [("P-1", "things"), ("V-2", "one")]),
        "b": ('[{"tag": "T-1", "desc": "x"}, {"tag": "T-2"}]', [("T-1", "item"), ("T-2", "item")]),
        "c": ('{"equipment": ["P-9"], "other": [{"tag": "no"}]}', [("P-9", "equipment")]),
        "d": ('{"n": 1}', []),
    }
    for name, (text, want) in cases.items():
        (tmp_path / f"{name}.json").write_text(text)
        assert sorted((r["tag"], r["kind"]) for r in files.companion(spark, f"{tmp_path}/{name}.json").collect()) == sorted(want), name
    edges = spark.createDataFrame([("P-1", "HV-2"), ("P-1", "X")], "src string, dst string")
    nodes = spark.createDataFrame([("equipment_P-1",), ("valve_HV-2",)], "node_id string")
    assert sorted(map(tuple, files.mirrored(edges, nodes).collect())) == [("P-1", "HV-2"), ("P-1", "X"), ("equipment_P-1", "valve_HV-2")]


def test_workbook_formulas_and_widths(spark, tmp_path):
    calc = spark.createDataFrame([("a", "t", 1.0, 2.0, 3.0, 1.0, 0.5)], "id string, tag string, P double, D double, S double, E double, t_min double")
    own = spark.createDataFrame([("=A1+B1", "a rather long cell")], "Value string, note string")
    files.workbook([("calc", calc), ("own", own)], f"{tmp_path}/w.xlsx")
    with zipfile.ZipFile(f"{tmp_path}/w.xlsx") as z:
        one, two = (z.read(f"xl/worksheets/sheet{i}.xml").decode() for i in (1, 2))
    assert "<f>(C2*D2)/(2*(E2*F2+C2*0.4))+0.125</f>" in one and "<f>A1+B1</f>" in two and 'width="21"' in two and 'width="12"' in one


def test_ring_as_a_stream(spark, tmp_path):
    spark.dataSource.register(streams.RingSource)
    path = f"{tmp_path}/ring"
    assert streams.ring_write(path, [b"a", b"bb"], slots=4) == 2
    q = spark.readStream.format("ring").option("path", path).load().writeStream.format("memory").queryName("ring").start()
    q.processAllAvailable()
    streams.ring_write(path, [bytes([i]) for i in range(6)])
    q.processAllAvailable()
    q.stop()
    got = {r["seq"]: bytes(r["payload"]) for r in spark.table("ring").collect()}
    assert got == {0: b"a", 1: b"bb"} | {i: bytes([i - 2]) for i in range(4, 8)}  # 2 and 3 were overwritten before they were read
    assert streams.take(path, lambda m: m[0]) == [2, 3, 4, 5]
    with pytest.raises(ValueError):
        streams.ring_write(path, [b"x" * (streams.SLOT + 1)])


def test_writer_tries_again():
    waits, fails = [], iter([1, 1, 1])

    def action():
        if next(fails, 0):
            raise OSError("database is locked")
        return "done"

    assert streams.retried(action, lambda e: "locked" in str(e), sleep=waits.append) == "done" and waits == [0.005, 0.01, 0.02]
    with pytest.raises(OSError):
        streams.retried(lambda: (_ for _ in ()).throw(OSError("locked")), lambda e: True, tries=3, sleep=waits.append)
    with pytest.raises(KeyError):
        streams.retried(lambda: {}["x"], lambda e: False, sleep=waits.append)


def test_watchdog_and_pulse(spark, tmp_path):
    swept = []
    q = streams.watchdog(spark, lambda: swept.append(time.time()), 0.2, f"{tmp_path}/ck")
    beats = streams.pulse(spark, 1).writeStream.format("memory").queryName("pulse").start()
    until = time.time() + 40
    while time.time() < until and (len(swept) < 2 or not spark.table("pulse").count()):
        time.sleep(0.3)
    assert len(swept) >= 2 and spark.table("pulse").count()
    q.stop()
    beats.stop()


def test_flush_waits(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    q = streams.append_ledger(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert streams.flush(q, 60) and spark.read.parquet(f"{tmp_path}/out").count() == 5
    q.stop()


def test_session_messages(spark):
    rows = spark.createDataFrame([(1, 10, 5.0, "ast_violation"), (1, 11, 5.5, "noise"), (1, 12, 10.0, "agent_turn"), (1, 9, -5.0, "agent_turn")], "user int, event_id int, at double, event_type string").withColumn("ts", F.timestamp_seconds("at"))
    got = [(r["event"], r["at"]) for r in streams.sessions_of(streams.told(rows), "user", F.timestamp_seconds(F.lit(0.0))).orderBy("seq").collect()]
    assert got == [("connect", 0.0), ("heartbeat", 2.0), ("heartbeat", 4.0), ("ast_violation", 5.0), ("heartbeat", 7.0), ("heartbeat", 9.0), ("agent_turn", 10.0)]
    assert streams.sessions_of(streams.told(rows), "user", F.timestamp_seconds(F.lit(0.0)), most=3).count() == 3


def cross(gap=False):
    image = np.full((60, 80), 255, np.uint8)
    image[29:32, 10:70] = 0
    image[10:50, 39:42] = 0
    if gap:
        image[29:32, 18:26] = 255
    return image


def test_gaps_are_bridged():
    holed = raster.binarise(cross(True))
    assert not holed[30, 20:24].any() and raster.bridge_lines(holed, 14)[30, 17:27].all()
    apart = np.zeros((30, 60), np.uint8)
    apart[10, 5:25] = apart[20, 30:50] = 1  # not in line with each other
    assert (raster.bridge_lines(apart) == apart).all()


def test_image_to_graph(spark):
    line = np.full((40, 120), 255, np.uint8)
    line[19:22, 10:110] = 0
    rows = spark.createDataFrame([(i, 120, 40, bytearray(line.tobytes())) for i in (1, 2)], "img_id int, width int, height int, pixels binary")
    symbols = spark.createDataFrame([(1, "P-1", "tank", 8.0, 20.0), (1, "V-1", "vessel", 112.0, 20.0)], "img_id int, node_id string, sub_type string, x double, y double")
    got = sorted((r["img_id"], *sorted((r["src"], r["dst"]))) for r in raster.image_graph(rows, symbols).collect())
    assert got == [(1, "P-1", "V-1"), (2, "term_1", "term_2")]
    lines = raster.traces(rows)
    assert raster.simplified(lines, 50.0).select(F.max(F.size("points"))).first()[0] == 2
    points = spark.createDataFrame([(1, x, 0) for x in (0, 5, 9, 17, 18)] + [(2, 3, 3)], "img_id int, x int, y int")
    assert sorted(map(tuple, raster.spread(points).collect())) == [(1, 0, 0), (1, 9, 0), (1, 18, 0), (2, 3, 3)]


def test_registry_and_table_function(spark):
    assert {"calculate", "evaluate", "asme_stress_calc", "call"} <= set(service.registry.tools)
    rows = spark.createDataFrame([({"design_pressure": 400.0, "D": 16.0, "S": 20000.0, "E": 1.0, "c": 0.0625, "t_actual": 0.32},)], "parameters map<string,double>")
    assert service.registry.run("evaluate", rows).first()["status"] == "SAT"
    with pytest.raises(KeyError):
        service.registry.run("nope", rows)
    with pytest.raises(ValueError):
        service.registry.tool("call")(lambda df: df)
    service.register(spark)
    got = spark.sql("SELECT * FROM exact_verdict(400.0D, 16.0D, 20000.0D, 1.0D, 0.4D, 0.0625D, 0.21D)").first()
    assert got["valid"] is False and got["margin"] < 0
    assert [r["status"] for r in service.health({"a": rows, "b": rows.limit(0)}).orderBy("name").collect()] == ["READY", "EMPTY"]


def test_accessor_and_fractions(spark):
    nan = float("nan")
    found = spark.createDataFrame([(1.5, 2.0), (None, 2.0), (nan, 1.0), (None, None)], "t_m double, t_min double")
    assert [r["v"] for r in found.select(surfaces.t_min(found).alias("v")).collect()] == [1.5, 2.0, 0.0, 0.0]
    pipe = "P double, D double, S double, E double, Y double, c double, t_actual double"
    rows = spark.createDataFrame([(100.0, 10.0, 20000.0, 1.0, 0.4, 0.125, 0.2), (-1.0, 10.0, 20000.0, 1.0, 0.4, 0.125, 0.2)], pipe)
    assert [r["t_min_rational"] for r in compliance.rational(rows).collect()] == ["601/4008", None]


def test_swaps_by_session(spark):
    rows = [("a", 1, "asme"), ("a", 2, "asme again"), ("a", 3, "hello"), ("a", 4, "asme"), ("b", 1, "tender")]
    got = {(r["session"], r["order"]): r["swapped"] for r in retrieval.adapter_swaps(spark.createDataFrame(rows, "session string, order int, query string")).collect()}
    assert got == {("a", 1): True, ("a", 2): False, ("a", 3): False, ("a", 4): True, ("b", 1): True}


def test_components_of_a_long_chain(spark):
    n = 150
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (2000, 2000)]
    got = {r["node"]: r["component"] for r in graph.connected(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and got[1001] == got[1000] == 1000 and got[2000] == 2000


def test_addresses(spark):
    from ipaddress import ip_address, ip_network

    texts = ["1.2.3.4", "255.255.255.255", "256.1.1.1", "1.2.3", "::", "::1", "fe80::1:2", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", "gggg::", "2001:DB8::", ":::", "12345::"]
    rows = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", audit.address_bits(F.col("ip")).alias("b"), audit.in_subnets(F.col("ip"), ["1.2.0.0/15", "2001:db8::/29", "fe80::/10"]).alias("s")).collect()
    for r in rows:
        try:
            ip = ip_address(r["ip"])
        except ValueError:
            assert r["b"] is None and not r["s"], r
            continue
        assert int(r["b"], 2) == int(ip) and len(r["b"]) == ip.max_prefixlen, r
        assert r["s"] == any(ip in ip_network(n) for n in ("1.2.0.0/15", "2001:db8::/29", "fe80::/10") if ip_network(n).version == ip.version)


def test_more_command_lines(spark, tmp_path, capsys):
    from sparkwright.__main__ import main

    (tmp_path / "s.py").write_text("import os\n")
    (tmp_path / "t.py").write_text("x = 1\n")
    (tmp_path / "b.csv").write_text("tag,P,D,t_actual\na,2.5,323.8,9.52\nb,2.5,323.8,4.5\n")
    assert main(["scan", f"{tmp_path}/s.py"]) == 1 and main(["scan", f"{tmp_path}/t.py"]) == 0
    assert main(["batch", f"{tmp_path}/b.csv"]) == 1 and "1 of 2" in capsys.readouterr().out


def test_patches_and_mosaic(spark):
    image = np.arange(30 * 50, dtype=np.int64).reshape(30, 50).astype(np.uint8)
    rows = spark.createDataFrame([(1, 50, 30, bytearray(image.tobytes()))], "img_id int, width int, height int, pixels binary")
    for mode in ("shift", "clip", "pad"):
        seen = np.zeros((30, 50), int)
        for r in raster.patches(rows, 20, 4, mode).collect():
            cut = np.frombuffer(bytes(r["pixels"]), np.uint8).reshape(r["height"], r["width"])
            inside = image[r["y1"] : r["y1"] + 20, r["x1"] : r["x1"] + 20]
            assert (cut[: inside.shape[0], : inside.shape[1]] == inside).all() and (mode != "pad" or cut.shape == (20, 20))
            seen[r["y1"] : r["y1"] + 20, r["x1"] : r["x1"] + 20] += 1
        assert seen.all()


def test_sockets_of_both_families(spark, tmp_path):
    (tmp_path / "tcp6").write_text("  sl  local_address remote_address st\n   0: 00000000000000000000000001000000:1F40 00000000000000000000000000000000:0000 0A x\n   1: 00000000000000000000000001000000:1F41 B80D0120000000000000000007000000:01BB 01 x\n")
    got = files.sockets(spark, [f"{tmp_path}/tcp6", f"{tmp_path}/missing"])
    assert [(r["laddr"], r["raddr"], r["status"]) for r in got.orderBy("seq").collect()] == [("::1:8000", "-", "LISTEN"), ("::1:8001", "2001:db8::7:443", "ESTABLISHED")]
    v = audit.socket_verdict(got).first()
    assert (v["sockets"], v["violations"], v["verdict"]) == (2, 1, "WARNING")
    assert files.sockets(spark).count() >= 0
