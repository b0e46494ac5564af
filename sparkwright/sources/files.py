"""Readers and writers of the inspection workbench's files."""

from __future__ import annotations

import zipfile
from collections.abc import Iterable
from io import BytesIO
from ipaddress import ip_address
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from sparkwright.operators.access import classify_files
from sparkwright.operators.audit import sheet_name


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def drawings(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, length) of image files."""
    return spark.read.format("binaryFile").load(path).select("path", "content", "length")


#: The lists of a companion file that hold symbols.
LISTS = ("equipment", "valves", "detected_symbols")


def companion(spark: SparkSession, path: str) -> DataFrame:
    """(tag, type, desc, kind) from a JSON file beside a drawing with lists under LISTS; without any item there, from its other lists and objects.

    A list of texts gives tags. A file that is a list itself has kind ``item``.
    """
    raw = spark.read.json(path, multiLine=True)

    def items(kind: str, column: Column, kind_of: DataType) -> DataFrame:
        held = F.explode(column) if isinstance(kind_of, ArrayType) else column
        kind_of = kind_of.elementType if isinstance(kind_of, ArrayType) else kind_of
        item = raw.select(held.alias("i"))
        fields = kind_of.fieldNames() if isinstance(kind_of, StructType) else []
        one = {f: F.col(f"i.`{f}`") if f in fields else F.lit(None) for f in ("tag", "type", "desc")}
        one["tag"] = one["tag"] if fields else F.col("i")
        return item.select(*[c.cast("string").alias(f) for f, c in one.items()], F.lit(kind).alias("kind"))

    def together(names: list[str]) -> DataFrame | None:
        out = None
        for name in names:
            kind_of = raw.schema[name].dataType
            if isinstance(kind_of, (ArrayType, StructType)):
                one = items(name, F.col(f"`{name}`"), kind_of)
                out = one if out is None else out.unionByName(one)
        return out

    if set(raw.columns) & {"tag", "type", "desc"}:  # a list of objects: Spark reads them as rows
        return items("item", F.struct(*[F.col(f"`{c}`") for c in raw.columns]), raw.schema)
    found = together([c for c in LISTS if c in raw.columns])
    if found is None or found.isEmpty():
        found = together([c for c in raw.columns if c not in LISTS])
    return found if found is not None else spark.createDataFrame([], "tag string, type string, desc string, kind string")


def mirrored(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) and, where both ends have a node (node_id) named equipment_ or valve_ before their own name, the edge between those."""
    known = nodes.select("node_id").distinct()
    named = edges
    for end in ("src", "dst"):
        for prefix in ("equipment_", "valve_"):
            named = named.join(known.withColumnRenamed("node_id", f"{prefix}{end}"), F.col(f"{prefix}{end}") == F.concat(F.lit(prefix), F.col(end)), "left")
        named = named.withColumn(f"{end}_named", F.coalesce(f"equipment_{end}", f"valve_{end}"))
    twins = named.filter("src_named IS NOT NULL AND dst_named IS NOT NULL").select(F.col("src_named").alias("src"), F.col("dst_named").alias("dst"))
    return edges.select("src", "dst").unionByName(twins).distinct()


def connections(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of the explicit connections, named from/to or source/target."""
    raw = spark.read.json(path, multiLine=True)
    if "connections" not in raw.columns:
        return spark.createDataFrame([], "src string, dst string")
    item = raw.select(F.explode("connections").alias("i"))
    fields = item.schema["i"].dataType.fieldNames()
    first = lambda *names: F.coalesce(*[F.col(f"i.`{n}`").cast("string") for n in names if n in fields], F.lit(None).cast("string"))
    return item.select(first("from", "source").alias("src"), first("to", "target").alias("dst"))


def inspection(spark: SparkSession, path: str) -> DataFrame:
    """The readings of an inspection CSV with leading comment lines."""
    schema = "Grid_Point STRING, Circumferential_Angle_Deg INT, Measured_Thickness_in DOUBLE, Nominal_Thickness_in DOUBLE, Required_t_min_in DOUBLE, Statutory_Status STRING, Corrosion_Rate_mpy DOUBLE"
    return spark.read.csv(path, header=True, comment="#", schema=schema)


def inspection_header(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the comment lines of an inspection CSV."""
    line = spark.read.text(path).filter(F.col("value").startswith("#"))
    return line.select(F.trim(F.regexp_extract("value", r"^#\s*([^:]+):\s*(.*)$", 1)).alias("key"), F.trim(F.regexp_extract("value", r"^#\s*([^:]+):\s*(.*)$", 2)).alias("value")).filter("key <> ''")


def packet_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, line) of a packet log; ids grow along each file."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("line"))


def vault_rows(files: DataFrame) -> DataFrame:
    """(name, sha256, size, type, clearance) of ingested files."""
    rows = files.select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
    return classify_files(rows)


def vault_audit(vault: DataFrame, user: str) -> DataFrame:
    """Two rows (actor, action, hash, details) for each ingested file: the user's and the platform's."""
    one = F.struct(F.lit("USER").alias("actor"), F.concat(F.lit("Manually ingested input file: "), F.col("name")).alias("action"), F.concat(F.substring("sha256", 1, 24), F.lit("...")).alias("hash"), F.format_string("Size: %s | Type: %s | Clearance: %s | Egress: 0 WAN Packets", F.col("size").cast("string"), "type", "clearance").alias("details"))
    two = F.struct(F.lit("PLATFORM").alias("actor"), F.lit("SHA-256 Merkle leaf registered and sealed into vault").alias("action"), F.col("sha256").alias("hash"), F.lit(f"Cryptographic zero-knowledge binding to persona: {user}").alias("details"))
    return vault.select("name", F.inline(F.array(one, two)))


def _cell(value) -> str:
    if value is None or value != value:
        return "N/A"
    if isinstance(value, float) and value in (float("inf"), float("-inf")):
        return "#NUM!"
    return str(value)


def column_widths(df: DataFrame) -> DataFrame:
    """(column, width) of a sheet: the longest text of each column, its heading too, and three more, 12 at least."""
    shown = [F.max(F.length(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("N/A")))).alias(f"c{i}") for i, c in enumerate(df.columns)]
    rows = [F.struct(F.lit(c).alias("column"), F.greatest(F.greatest(F.coalesce(F.col(f"c{i}"), F.lit(0)), F.lit(len(c))) + 3, F.lit(12)).alias("width")) for i, c in enumerate(df.columns)]
    return df.agg(*shown).select(F.inline(F.array(*rows)))


#: Fixed value: what column G of a calculation's sheet holds in each row.
FORMULA = "=(C{r}*D{r})/(2*(E{r}*F{r}+C{r}*0.4))+0.125"


def calculates(columns: list[str]) -> bool:
    """Whether a sheet is a calculation's: it has P, D, S and E, or seven columns with one of its inputs."""
    return {"P", "D", "S", "E"} <= {c.strip().upper() for c in columns} or (len(columns) >= 7 and bool({"P", "design_pressure", "t_min", "measured_t"} & set(columns)))


def workbook(sheets: Iterable[tuple[str, DataFrame]], path: str) -> None:
    """An .xlsx file with one sheet a frame: titles cleaned, headings in capitals, widths by the content, formulas kept, no data noted.

    Column G of a calculation's sheet is its formula. Rows stream through the driver, none are held.
    """
    names = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for i, (title, df) in enumerate(sheets, 1):
            names.append(df.sparkSession.range(1).select(sheet_name(F.lit(title))).first()[0])
            widths = [r["width"] for r in column_widths(df).collect()] if df.columns else []  # a row a column
            with out.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">')
                f.write(("<cols>" + "".join(f'<col min="{n}" max="{n}" width="{w}" customWidth="1"/>' for n, w in enumerate(widths, 1)) + "</cols>").encode() if widths else b"")
                f.write(b"<sheetData>")
                head, n = [c.upper().replace("_", " ") for c in df.columns], 1
                for row in [head, *([] if df.columns else [["No Data"]])]:
                    f.write(_row(row))
                for n, r in enumerate(df.toLocalIterator(), 2):
                    cells = [_cell(v) for v in r]
                    if calculates(df.columns):
                        cells += [""] * (7 - len(cells))
                        cells[6] = FORMULA.format(r=n)
                    f.write(_row(cells))
                if n == 1:
                    f.write(_row(["Empty Sheet"]))
                f.write(b"</sheetData></worksheet>")
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        out.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        out.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        out.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        out.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')


def _row(cells: list[str]) -> bytes:
    cell = lambda c: f"<c><f>{escape(c[1:])}</f></c>" if c.startswith("=") else f'<c t="inlineStr"><is><t>{escape(c)}</t></is></c>'
    return ("<row>" + "".join(map(cell, cells)) + "</row>").encode()


def memo(meta: dict[str, str], table: DataFrame, cites: Iterable[str]) -> bytes:
    """A .docx memo: the metadata, a table with floats to four decimals, the citations as a list, and a line to sign."""
    para = lambda t: f"<w:p><w:r><w:t>{escape(t)}</w:t></w:r></w:p>"
    cell = lambda v: f"<w:tc>{para(f'{v:.4f}' if isinstance(v, float) else '' if v is None else str(v))}</w:tc>"
    fields = ("title", "plant", "unit", "author", "date", "reference", "status")
    body = "".join(para(f"{k.title()}: {meta.get(k, 'N/A')}") for k in fields)
    rows = [table.columns, *table.toLocalIterator()]
    body += "<w:tbl>" + "".join("<w:tr>" + "".join(cell(v) for v in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    body += "".join(para(f"• {c}") for c in cites) + para("Approved by: ____________________")
    held = BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
        out.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        out.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
    return held.getvalue()


#: The kernel's tables of sockets, and its numbers of states.
SOCKET_TABLES = ("/proc/net/tcp", "/proc/net/tcp6", "/proc/net/udp", "/proc/net/udp6")
STATES = {"01": "ESTABLISHED", "02": "SYN_SENT", "03": "SYN_RECV", "04": "FIN_WAIT1", "05": "FIN_WAIT2", "06": "TIME_WAIT", "07": "CLOSE", "08": "CLOSE_WAIT", "09": "LAST_ACK", "0A": "LISTEN", "0B": "CLOSING"}


def sockets(spark: SparkSession, tables: Iterable[str] = SOCKET_TABLES) -> DataFrame:
    """(seq, laddr, raddr, status, remote_ip) of this machine's sockets of both address families, from the kernel's tables as the driver sees them; tables that are not there have none."""

    def address(text: str) -> tuple[str, int]:
        ip, port = text.split(":")
        words = b"".join(bytes.fromhex(ip[i : i + 8])[::-1] for i in range(0, len(ip), 8))  # each word has its bytes backwards
        return str(ip_address(words)), int(port, 16)

    rows = []
    for table in tables:
        try:
            with open(table) as f:
                lines = f.readlines()[1:]
        except FileNotFoundError:
            continue
        for p in map(str.split, lines):
            (ip, port), (remote, far) = address(p[1]), address(p[2])
            rows.append((len(rows), f"{ip}:{port}", f"{remote}:{far}" if far else "-", STATES.get(p[3], p[3]), remote if far else None))
    return spark.createDataFrame(rows, "seq int, laddr string, raddr string, status string, remote_ip string")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, capabilities, hardware_tiers, priority, vram_min_mb, context_length) of a model registry: a list of flat entries, parsed on the driver."""
    entries: list[dict] = []
    for line in "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()).splitlines():
        text = line.split(" #")[0].strip()
        if text.startswith("- "):
            entries.append({})
            text = text[2:].strip()
        if entries and ":" in text and not text.startswith("#"):
            k, _, v = text.partition(":")
            v = v.strip()
            entries[-1][k.strip()] = [x.strip().strip("\"'") for x in v[1:-1].split(",") if x.strip()] if v.startswith("[") else v.strip("\"'")
    number = lambda e, k: int(e[k]) if str(e.get(k, "")).isdigit() else None
    rows = [(e["model_id"], e.get("capabilities", []), e.get("hardware_tiers", []), number(e, "priority"), number(e, "hardware_vram_min_mb"), number(e, "context_length")) for e in entries if "model_id" in e]
    return spark.createDataFrame(rows, "model_id string, capabilities array<string>, hardware_tiers array<string>, priority int, vram_min_mb int, context_length int")


def line_list(spark: SparkSession, path: str) -> DataFrame:
    """A line list: CSV with a heading and any columns, all read as text."""
    return spark.read.csv(path, header=True, comment="#")


def export(df: DataFrame, path: str) -> None:
    """An audit export: JSON lines, in parts."""
    df.write.mode("overwrite").json(path)
