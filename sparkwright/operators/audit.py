"""Packet logs, verdicts, static scans of scripts, results of sandboxed runs, budgets, JSON-RPC as data."""

from __future__ import annotations

import ast
import ipaddress
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.operators import service

LINE = r"^(\d{2}:\d{2}:\d{2}\.\d+)\s+(IP6?)\s+(\S+)\s+>\s+([^\s:]+):"


def endpoint(text: Column) -> Column:
    """STRUCT(ip, port): the last dot part is a port if it is digits and the address has more than four parts (or is not IPv4)."""
    last = F.substring_index(text, ".", -1)
    has = last.rlike(r"^\d+$") & ((F.size(F.split(text, r"\.")) > 4) | text.contains(":"))
    return F.struct(F.when(has, F.substr(text, F.lit(1), F.length(text) - F.length(last) - 1)).otherwise(text).alias("ip"), F.when(has, last.try_cast("int")).alias("port"))


def loopback(ip: Column) -> Column:
    return F.coalesce(ip.startswith("127.") | ip.isin("::1", "localhost", "0:0:0:0:0:0:0:1") | ip.startswith("::ffff:127."), F.lit(False))


def address_bits(ip: Column) -> Column:
    """An IPv4 or IPv6 address as text of 32 or 128 binary digits; null for anything else. A port after an IPv4 address is left out."""
    text = F.lower(F.trim(ip))
    four = F.when(text.contains("."), F.substring_index(text, ":", 1)).otherwise(text)
    octets = F.split(four, r"\.")
    is_four = four.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    bits_four = F.array_join(F.transform(octets, lambda o: F.lpad(F.conv(o, 10, 2), 8, "0")), "")
    words = lambda part: F.transform(F.filter(F.split(part, ":"), lambda x: x != ""), lambda x: F.lpad(x, 4, "0"))
    gap = text.contains("::")
    left, right = words(F.substring_index(text, "::", 1)), F.when(gap, words(F.substring_index(text, "::", -1))).otherwise(F.array().cast("array<string>"))
    lacking = 8 - F.size(left) - F.size(right)
    is_six = text.contains(":") & ~text.contains(".") & text.rlike(r"^[0-9a-f:]+$") & ~text.rlike(r":::|::.*::|[0-9a-f]{5,}") & F.when(gap, lacking >= 1).otherwise(lacking == 0)
    all_words = F.concat(left, F.array_repeat(F.lit("0000"), F.greatest(lacking, F.lit(0))), right)
    bits_six = F.array_join(F.transform(all_words, lambda w: F.lpad(F.conv(w, 16, 2), 16, "0")), "")
    return F.when(is_four, bits_four).when(is_six, bits_six)


def in_subnets(ip: Column, subnets: Iterable[str]) -> Column:
    """Whether an address is in one of the subnets (CIDR, host bits may be set); those that cannot be read count for none."""
    bits, hit = address_bits(ip), F.lit(False)
    for subnet in subnets:
        try:
            net = ipaddress.ip_network(subnet, strict=False)
        except ValueError:
            continue
        wide = 32 if net.version == 4 else 128
        start = f"{int(net.network_address):0{wide}b}"[: net.prefixlen]
        hit = hit | ((F.length(bits) == wide) & bits.startswith(start))
    return F.coalesce(hit, F.lit(False))


#: Names of this machine.
LOCAL_NAMES = ("localhost", "ip6-localhost", "localhost6")


def wan(ip: Column, allowed: Iterable[str] = ()) -> Column:
    """Whether a destination lies outside: not null, loopback, unspecified or in an allowed subnet. A name that is no address does."""
    near = F.lower(F.trim(ip)).isin(*LOCAL_NAMES) | in_subnets(ip, ("127.0.0.0/8", "::1/128", "0.0.0.0/32", "::/128", *allowed))
    return F.coalesce((F.trim(ip) != "") & ~near, F.lit(False))


#: Private IPv4 ranges, with this machine and its link.
PRIVATE = ("127.0.0.0/8", "::1/128", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16")


def private(ip: Column) -> Column:
    return in_subnets(ip, PRIVATE) | F.coalesce(F.lower(F.trim(ip)).isin(*LOCAL_NAMES), F.lit(False))


def socket_verdict(sockets: DataFrame, keys: list[str] = (), allowed: Iterable[str] = ()) -> DataFrame:
    """Sockets (remote_ip), those that lead outside, and PASS exactly where none does."""
    out = wan(F.col("remote_ip"), allowed)
    n = sockets.groupBy(*keys).agg(F.count(F.lit(1)).alias("sockets"), F.count_if(out).alias("violations"))
    return n.withColumn("verdict", F.when(F.col("violations") == 0, "PASS").otherwise("WARNING"))


def packets(lines: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(line_id, the columns of ``carry``, time, proto, src_ip, src_port, dst_ip, dst_port, is_egress) of the lines (line_id, line) that are packets."""
    g = lambda i: F.regexp_extract("line", LINE, i)
    rows = lines.filter(F.col("line").rlike(LINE)).select("line_id", *carry, g(1).alias("time"), g(2).alias("proto"), endpoint(g(3)).alias("s"), endpoint(g(4)).alias("d"))
    return rows.select("line_id", *carry, "time", "proto", F.col("s.ip").alias("src_ip"), F.col("s.port").alias("src_port"), F.col("d.ip").alias("dst_ip"), F.col("d.port").alias("dst_port"), (~loopback(F.col("d.ip"))).alias("is_egress"))


def verdict(found: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Packets, egress packets and PASS exactly where none leaves."""
    n = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("packets"), F.count_if("is_egress").alias("egress"))
    return n.withColumn("verdict", F.when(F.col("egress") == 0, "PASS").otherwise("WARNING"))


def normalised(status: Column, packets: Column, sockets: Column) -> Column:
    """STRUCT(status, passed): a PASS with packets or sockets is a WARNING, and only a PASS has passed."""
    s = F.when((status == "PASS") & ((packets > 0) | (sockets > 0)), "WARNING").otherwise(status)
    return F.struct(s.alias("status"), (s == "PASS").alias("passed"))


def captured(output: Column) -> Column:
    return F.regexp_extract(output, r"(\d+) packets? captured", 1).try_cast("int")


#: What an audit's output says.
WARNED = ("VERDICT: [WARNING]", "NETWORK ANOMALY DETECTED")
DROPS = ("type filter hook output", "policy drop", "Strict DROP Active")


def output_verdict(outputs: DataFrame) -> DataFrame:
    """(run_id, interface, policy_drop, packets_captured, open_wan_sockets, verdict, passed) of audits' outputs (run_id, output).

    A warning in the text, captured packets or a packet line that leaves this machine make a WARNING; all else passes.
    """
    has = lambda words: F.array_max(F.array(*[F.col("output").contains(w) for w in words]))
    rows = outputs.select("run_id", F.coalesce("output", F.lit("")).alias("output"))
    interface = F.nullif(F.regexp_extract("output", r"Monitoring physical network interface:\s*([^\s\r\n]+)", 1), F.lit(""))
    rows = rows.select("run_id", interface.alias("interface"), has(DROPS).alias("policy_drop"), F.coalesce(captured(F.col("output")), F.lit(0)).alias("captured"), has(WARNED).alias("warned"), F.split("output", "\n").alias("lines"))
    lines = rows.select("run_id", F.explode("lines").alias("line")).withColumn("line_id", F.col("run_id"))
    egress = packets(lines).groupBy(F.col("line_id").alias("run_id")).agg(F.count_if("is_egress").alias("open_wan_sockets"))
    out = rows.drop("lines").join(egress, "run_id", "left").withColumn("open_wan_sockets", F.coalesce("open_wan_sockets", F.lit(0).cast("long")))
    bad = F.col("warned") | (F.col("captured") > 0) | (F.col("open_wan_sockets") > 0)
    shown = F.when(F.col("captured") > 0, F.col("captured").cast("long")).otherwise(F.col("open_wan_sockets"))
    return out.select("run_id", "interface", "policy_drop", shown.alias("packets_captured"), "open_wan_sockets", F.when(bad, "WARNING").otherwise("PASS").alias("verdict"), (~bad).alias("passed"))


def assert_no_egress(found: DataFrame) -> DataFrame:
    """The verdict's row; the query fails where a packet leaves."""
    return verdict(found).withColumn("checked", F.assert_true(F.col("egress") == 0, F.lit("packets leave this machine")))


#: What a script may not import, call, write to, reach or open for.
MODULES = frozenset((
    "socket", "requests", "urllib", "urllib3", "http", "ftplib", "telnetlib", "smtplib", "imaplib", "poplib", "nntplib", "asyncio", "aiohttp", "xmlrpc", "socketserver", "ssl", "websockets", "websocket", "httpx", "paramiko", "ftpmirror", "ipaddress",
    "subprocess", "os", "posix", "nt", "shutil", "pty", "commands", "multiprocessing", "threading", "signal", "ctypes", "cffi", "resource", "fcntl", "termios",
    "importlib", "imp", "builtins", "__builtin__", "types", "inspect", "code", "codeop", "dis", "marshal", "pickle", "shelve", "dbm", "sqlite3", "tempfile", "sys", "platform", "gc",
))
CALLS = frozenset(("eval", "exec", "compile", "__import__", "globals", "locals", "vars", "dir", "getattr", "setattr", "delattr", "breakpoint", "input", "memoryview", "help"))
FILE_METHODS = frozenset(("write_text", "write_bytes", "unlink", "rmdir", "rename", "replace", "mkdir", "touch", "chmod", "lchmod"))
PROCESS_METHODS = frozenset(("system", "popen", "spawn", "fork", "kill"))
ATTRIBUTES = frozenset((
    "__class__", "__bases__", "__base__", "__mro__", "__subclasses__", "__globals__", "__code__", "__builtins__", "__closure__", "__func__", "__self__", "__reduce__", "__reduce_ex__", "__loader__", "__spec__", "__package__", "__dict__", "modules",
))
READ_MODES = frozenset(("r", "rb", "rt", "rU"))


def _open_fault(call: ast.Call) -> str | None:
    """What is wrong with the mode of an open() call."""
    if any(isinstance(a, ast.Starred) for a in call.args) or any(k.arg is None for k in call.keywords):
        return "open() with a mode that is not a constant"
    mode = call.args[1] if len(call.args) > 1 else next((k.value for k in call.keywords if k.arg == "mode"), ast.Constant("r"))
    if not isinstance(mode, ast.Constant) or not isinstance(mode.value, str):
        return "open() with a mode that is not a constant"
    return None if mode.value in READ_MODES else f"open() for '{mode.value}'"


def _faults(node: ast.AST, called: set[int]) -> Iterator[str]:
    root = lambda name: (name or "").split(".")[0]
    match node:
        case ast.Import(names=names):
            yield from (f"import of '{n.name}'" for n in names if root(n.name) in MODULES)
        case ast.ImportFrom(module=module, names=names):
            if root(module) in MODULES:
                yield f"import from '{module}'"
            yield from (f"import of '{n.name}'" for n in names if n.name in MODULES | CALLS | ATTRIBUTES)
        case ast.Call(func=ast.Name(id=name)):
            if name in CALLS:
                yield f"call of '{name}'"
            elif name == "open" and (fault := _open_fault(node)):
                yield fault
        case ast.Call(func=ast.Attribute(attr=name)):
            if name in CALLS | FILE_METHODS | PROCESS_METHODS:
                yield f"call of '{name}'"
            elif name == "open" and (fault := _open_fault(node)):
                yield fault
        case ast.Attribute(attr=name) if name in ATTRIBUTES:
            yield f"use of '{name}'"
        case ast.Name(id=name) if id(node) not in called:
            if name in CALLS | ATTRIBUTES or name == "open" or name in ("os", "sys", "subprocess", "socket"):
                yield f"use of '{name}'"
        case ast.Subscript(slice=ast.Constant(value=str(name))) if name in CALLS | ATTRIBUTES:
            yield f"access to '{name}'"


def scan_script(code: str | None) -> list[str]:
    """Numbered findings by line, without repeats; a syntax error or an empty script is one."""
    if not code or not code.strip():
        return ["line 0: empty script"]
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError) as e:
        return [f"line {getattr(e, 'lineno', 0) or 0}: syntax error"]
    nodes = list(ast.walk(tree))
    called = {id(n.func) for n in nodes if isinstance(n, ast.Call)}
    found = sorted((getattr(n, "lineno", 0), i, what) for i, n in enumerate(nodes) for what in _faults(n, called))
    return list(dict.fromkeys(f"line {at}: {what}" for at, _, what in found))


#: Module names that the browser's plainer scan looks for.
BROWSER_NAMES = ("socket", "urllib", "requests", "http.client", "os.system", "subprocess", "shutil")


def browser_scan(code: Column) -> Column:
    """The first of BROWSER_NAMES after ``import`` or ``from``, else null."""
    return F.coalesce(*[F.when(code.contains(f"import {n}") | code.contains(f"from {n}"), F.lit(n)) for n in BROWSER_NAMES])


def telemetry(sockets: DataFrame, status: str, packets: int, wan: int, epoch: int) -> DataFrame:
    """Sockets once by (pid, laddr, raddr, status), the first by seq, with the integrity hash of the verdict."""
    first = sockets.groupBy("pid", "laddr", "raddr", "status").agg(F.min_by("process", "seq").alias("process"))
    return first.withColumn("integrity", F.sha2(F.lit(f"airgap:{status}:{packets}:{wan}:{epoch}"), 256))


#: The rows that telemetry shows where it finds no socket.
FALLBACK = ((None, "127.0.0.1:8000", "-", "LISTEN", "uvicorn (FastAPI Core)"), (None, "127.0.0.1:5173", "-", "LISTEN", "node (Vite SPA)"))


def telemetry_rows(violations: DataFrame, sockets: DataFrame) -> DataFrame:
    """(place, pid, laddr, raddr, status, process): violations (place 0), then sockets once each (1), or without either the fallback (2).

    Both have pid, laddr, raddr, status, process; sockets also seq.
    """
    names = ["pid", "laddr", "raddr", "status", "process"]
    bad = violations.select(F.lit(0).alias("place"), *names)
    kept = sockets.groupBy("pid", "laddr", "raddr", "status").agg(F.min_by("process", "seq").alias("process")).select(F.lit(1).alias("place"), *names)
    both = bad.unionByName(kept)
    usual = sockets.sparkSession.createDataFrame(list(FALLBACK), f"pid {dict(sockets.dtypes)['pid']}, laddr string, raddr string, status string, process string").select(F.lit(2).alias("place"), *names)
    some = both.agg((F.count(F.lit(1)) > 0).alias("some"))
    return both.unionByName(usual.join(F.broadcast(some)).filter("NOT some").select("place", *names))  # one row tells whether there are any


def scan_scripts(scripts: DataFrame) -> DataFrame:
    """(script_id, is_safe, findings) of (script_id, code)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [scan_script(c) for c in b["code"]]
            yield pd.DataFrame({"script_id": b["script_id"], "is_safe": [not f for f in found], "findings": found})

    return scripts.select("script_id", "code").mapInPandas(run, f"script_id {dict(scripts.dtypes)['script_id']}, is_safe boolean, findings array<string>")


def exit_class(code: Column) -> Column:
    return F.when(code == 0, "ok").when(code == 124, "timeout").when(code == 126, "network violation").when(code == 127, "not found").when(code == 137, "out of memory").otherwise("error")


def scrubbed(environment: DataFrame, names: list[str], prefixes: list[str]) -> DataFrame:
    """Environment rows (k, v) without the names and prefixes given."""
    bad = F.upper("k").isin(*names) if names else F.lit(False)
    for p in prefixes:
        bad = bad | F.upper("k").startswith(p)
    return environment.filter(~bad)


def vram(models: DataFrame, ceiling: float = 24.0) -> DataFrame:
    """One row: total (actual, or measured where actual is null or 0), reserve, within; models: name, measured_gb, actual_gb, limit_gb."""
    used = F.when(F.col("actual_gb") != 0, F.col("actual_gb")).otherwise(F.col("measured_gb"))
    over = F.concat_ws("; ", F.array_sort(F.collect_list(F.when(used > F.col("limit_gb"), F.concat("name", F.lit(" is over its limit"))))))
    return models.agg(F.round(F.sum(used), 3).alias("total_gb"), F.round(ceiling - F.sum(used), 3).alias("reserve_gb"), (F.sum(used) <= ceiling).alias("within"), over.alias("errors"))


def live_split(live_gb: Column, measured: dict[str, float], ceiling: float = 24.0) -> Column:
    """STRUCT of a live total dealt to the models by their measured weights, the reserve and whether the total is within the ceiling; measured figures where there is no live one."""
    total = sum(measured.values())
    of = {name: F.coalesce(live_gb * (gb / total if total > 0 else 0.9), F.lit(gb)) for name, gb in measured.items()}
    used = sum(of.values(), F.lit(0.0))
    return F.struct(*[v.alias(k) for k, v in of.items()], F.round(used, 3).alias("total_gb"), F.round(ceiling - used, 3).alias("reserve_gb"), (used <= ceiling).alias("within"))


def dispatch(requests: DataFrame) -> DataFrame:
    """JSON-RPC requests (request_id, body) to (request_id, kind, code) of their answers: result, tool_error, or error with its code."""
    answer = service.respond(requests).select("request_id", F.from_json("response", "struct<error struct<code int>, result struct<isError boolean>>").alias("a"))
    return answer.select("request_id", F.when(F.col("a.error").isNotNull(), "error").when(F.col("a.result.isError"), "tool_error").otherwise("result").alias("kind"), F.col("a.error.code").alias("code"))


def sheet_name(title: Column) -> Column:
    r"""The characters \ / * ? : [ ] as dashes, at most 31 characters."""
    return F.substring(F.regexp_replace(title, r"[\\/*?:\[\]]", "-"), 1, 31)


def cell_text(value: Column) -> Column:
    """N/A for null and NaN, #NUM! for infinities."""
    return F.when(value.isNull() | F.isnan(value), "N/A").when(F.abs(value) == float("inf"), "#NUM!").otherwise(F.format_string("%.4f", value))
