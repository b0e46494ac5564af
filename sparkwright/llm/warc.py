"""WARC records in ZIP packages: written by tasks, read back by byte ranges without unpacking.

A package is a ZIP file with two stored members: ``archive/data.warc.gz``, a run of WARC records that are gzip members of
their own, and ``indexes/index.cdxj``, one line a record with its place in the archive. Both may pass 4 GB (ZIP64). The
reader parses the end of the file, its ZIP64 parts and the central directory, finds the stored members, reads the index
and then ranges of records.

Of records with equal payloads of at least ``least`` bytes, that with the smallest key is a response and the others are
revisits of it, without a payload. Only digests and keys are grouped to find it, and only payloads whose digest may be shared
are shuffled to be told of it; the others go straight from their scan into a package.

Packages are written under the shared folder with names of their own, so a task that runs again never meets its own
leftovers; a table lists those of the tasks that ended well, and only they are read.

Defined cases: null html is an empty payload; a null key makes a response unless a row with a key has the same payload,
and comes back null (its record has an id of its own); rows that repeat a key and its payload are responses all, with the id of
that key; long payloads are written whole; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.shared import materialise, maybe_among, work_path

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of records after which a task starts another package, and bytes of one range that is read.
PACKAGE, RANGE = 64 << 20, 4 << 20
#: Most tasks that read packages; beyond it a task reads several.
MOST_TASKS = 20_000
TYPE = "application/http; msgtype=response"


def record(key: int | None, url: str | None, kind: str, digest: str, refers: int | None, payload: bytes, size: int) -> bytes:
    """One WARC 1.1 record. The HTTP head of a revisit keeps the length of the payload that it stands for."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{f'urn:uuid:{uuid.uuid4()}' if key is None else f'urn:page:{key}'}>",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Type: {TYPE}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
        payload = b""
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(v) for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")) if k.lower() == b"content-length")
    number = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">")) if x.startswith("<urn:page:") else None
    out = {"key": number(fields["warc-record-id"]), "kind": fields["warc-type"], "digest": fields["warc-payload-digest"].removeprefix("sha256:"), "size": size, "refers": None, "payload": payload}
    if out["kind"] == "revisit":
        out["refers"] = number(fields["warc-refers-to"])
    elif len(payload) != size or hashlib.sha256(payload).hexdigest() != out["digest"]:
        raise ValueError(f"the payload of {fields['warc-record-id']} does not have its digest")
    return out


class Package:
    """A ZIP package being written."""

    def __init__(self, folder: str):
        self.store, root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(root, recursive=True)
        self.name = f"{uuid.uuid4().hex}.zip"
        self.stream = self.store.open_output_stream(f"{root}/{self.name}")
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(ARCHIVE, "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, key: int | None, data: bytes) -> None:
        packed = gzip.compress(data, 5, mtime=0)
        self.member.write(packed)
        self.lines.append(json.dumps({"key": key, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> tuple[str, int]:
        self.member.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as out:
            for line in self.lines:
                out.write(line.encode() + b"\n")
        self.zip.close()
        self.stream.close()
        return self.name, len(self.lines)


def members(file: pa.NativeFile) -> dict[str, tuple[int, int]]:
    """Place and size of each stored member of a ZIP file, from its central directory."""
    size = file.size()

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    tail_at = max(0, size - 22 - 65535)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<10xHII", tail[end : end + 20])
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07" and (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF):
        wide = struct.unpack("<Q", tail[end - 12 : end - 4])[0]
        at = read(wide, 56)
        if at[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<32xQQQ", at)
    directory, out, at = read(start, length), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method, packed, plain, name_n, extra_n, note_n, place = struct.unpack("<10xH8xIIHHH8xI", directory[at : at + 46])
        name = directory[at + 46 : at + 46 + name_n].decode()
        extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
        while len(extra) >= 4:
            tag, n = struct.unpack("<HH", extra[:4])
            if tag == 1:
                wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                place = wide.pop(0) if place == 0xFFFFFFFF else place
            extra = extra[4 + n :]
        if method:
            raise ValueError(f"{name} is compressed; members must be stored")
        name_own, extra_own = struct.unpack("<26xHH", read(place, 30))
        out[name] = (place + 30 + name_own + extra_own, packed)
        at += 46 + name_n + extra_n + note_n
    return out


def read_package(store: fs.FileSystem, path: str) -> Iterator[dict]:
    """All records of a package, by ranges of the index."""
    with store.open_input_file(path) as file:
        found = members(file)
        base, _ = found[ARCHIVE]
        at, size = found[INDEX]
        file.seek(at)
        entries = [(e["offset"], e["length"]) for e in map(json.loads, file.read(size).splitlines())]
        while entries:
            first, n = entries[0][0], 1
            while n < len(entries) and sum(entries[n]) - first <= RANGE:
                n += 1
            file.seek(base + first)
            held = file.read(sum(entries[n - 1]) - first)
            for offset, length in entries[:n]:
                yield parse(zlib.decompress(held[offset - first : offset - first + length], 31))
            del entries[:n]


def write(pages: DataFrame, folder: str, least: int = 100, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write packages into ``folder``; the table of those written: name and records."""
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    shared = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    shared = materialise(shared, "shared")
    told = maybe_among(rows, "digest", shared)
    alone = told.filter("NOT maybe").select("row.*").withColumn("first", F.lit(None).cast("long"))
    rows = told.filter("maybe").select("row.*").join(shared.hint("merge"), "digest", "left").unionByName(alone).select("key", "url", "payload", "size", "digest", F.when(F.col("first").isNotNull() & (F.col("key").isNull() | (F.col("key") > F.col("first"))), F.col("first")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for k, u, payload, size, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                package = package or Package(folder)
                package.add(k, record(k, u, "response" if refers is None else "revisit", digest, refers, payload, size))
                if package.at >= PACKAGE:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["name", "records"])

    return materialise(rows.mapInArrow(run, "name string, records long"), "packages")


def read(packages: DataFrame, folder: str, keep: bool = False) -> DataFrame:
    """The records of the packages listed; ``keep`` adds the payload (null for revisits)."""
    names = ["key", "size", "digest", "kind", "refers", *(["payload"] if keep else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held, told = [], 0
                for r in read_package(store, f"{root}/{name}"):
                    told += 1
                    held.append([(None if k == "payload" and r["kind"] == "revisit" else r[k]) for k in names])
                    if len(held) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=False)], names)
                        held = []
                if told != records:
                    raise ValueError(f"{name} has {told} records, {records} were written")
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=False)], names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    schema = "key long, size long, digest string, kind string, refers long" + (", payload binary" if keep else "")
    return packages.repartition(max(1, min(packages.count(), MOST_TASKS))).mapInArrow(run, schema)  # a task a package, which adaptive plans leave alone


def round_trip(pages: DataFrame, least: int = 100, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages, read the packages back: key, payload_bytes, payload_digest, record_type and refers_to of every row."""
    folder = work_path(pages.sparkSession, "warc")
    back = read(write(pages, folder, least, key, url, html), folder)
    return back.select(F.col("key").alias(key), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"))
