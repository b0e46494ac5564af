"""Hierarchical chunks: sections by headings or fixed blocks, children packed by paragraphs and sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARENT, CHILD = 8000, 1600
SENTENCE = re.compile(r"(?<=[.!?])\s+", re.ASCII)


def headed(text: Column) -> Column:
    return text.rlike(r"(?m)^#{1,4}\s+\S")


def sections(docs: DataFrame, size: int = PARENT) -> DataFrame:
    """(doc_id, section_index, title, body) of texts (doc_id, text): from heading to heading, or blocks of ``size`` characters.

    Blank sections are left out; text before the first heading is the Preamble.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = F.split("text", r"(?m)(?=^#{1,4}\s+\S)")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length("text") - 1) / size), F.lit(0))), lambda i: F.substr(F.col("text"), (i * size + 1).cast("int"), F.lit(size)))
    rows = rows.select("doc_id", headed(F.col("text")).alias("headed"), F.when(headed(F.col("text")), F.filter(cut, lambda p: F.btrim(p, F.lit(" \t\r\n")) != "")).otherwise(blocks).alias("parts"))
    rows = rows.select("doc_id", "headed", F.posexplode("parts").alias("section_index", "part")).filter(F.btrim("part", F.lit(" \t\r\n")) != "")
    head = F.regexp_extract("part", r"^#{1,4}\s+([^\n]*)", 1)
    title = F.when(~F.col("headed"), F.concat(F.lit("Section "), (F.col("section_index") + 1).cast("string"))).when(F.col("part").rlike(r"^#{1,4}\s"), F.trim(head)).otherwise("Preamble")
    return rows.select("doc_id", "section_index", title.alias("title"), F.btrim("part", F.lit(" \t\r\n")).alias("body"))


def children(parents: DataFrame, text: str = "body", size: int = CHILD) -> DataFrame:
    """Adds child_index and child in place of the text: paragraphs packed up to ``size`` characters; a longer paragraph is packed by sentences.

    A sentence longer than that stays whole; a blank text is one child. Pieces are first split to sentences only where
    a paragraph is too long, and one fold then packs them all, so the tail of a long paragraph goes on filling. The fold runs in
    Arrow batches: a fold over arrays in SQL would copy its result with every child.
    """
    kept = [c for c in parents.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [pack(t, size) for t in batch.column(len(kept)).to_pylist()]
            owner = pa.array([i for i, some in enumerate(packed) for _ in some], pa.int32())
            arrays = [batch.column(i).take(owner) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([i for some in packed for i in range(len(some))], pa.int32()), pa.array([c for some in packed for c in some], pa.string())], [*kept, "child_index", "child"])

    schema = ", ".join(f"`{c}` {t}" for c, t in parents.dtypes if c != text) + ", child_index int, child string"
    return parents.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text), F.lit("")).alias(text)).mapInArrow(run, schema)


def pack(text: str, size: int) -> list[str]:
    """The children of one text."""
    done, current = [], ""
    for paragraph in text.split("\n\n"):
        paragraph = paragraph.strip(" \t\r\n")
        long = len(paragraph) > size
        for piece in SENTENCE.split(paragraph) if long else [paragraph]:
            gap = " " if long else "\n\n"
            if not piece:
                continue
            if not current:
                current = piece
            elif len(current) + len(piece) + len(gap) <= size:
                current += gap + piece
            else:
                done.append(current)
                current = piece
    return [*done, current] if current else done or [text]


def chunk_ids(parents: DataFrame, family: str = "family") -> DataFrame:
    """Adds parent_id: a hash of family, section and the first 100 characters; children add their index to it."""
    key = F.concat_ws(":", F.col(family), F.col("section_index").cast("string"), F.substring("body", 1, 100))
    return parents.withColumn("_h", F.substring(F.sha2(key, 256), 1, 12)).withColumn("parent_id", F.concat(F.lit("parent_"), "_h")).drop("_h")


def hierarchy(docs: DataFrame, family: str = "family") -> DataFrame:
    """Parents and their children as one frame (chunk_id, parent_chunk_id, is_parent, text, token_count, doc_id, section_index, child_index)."""
    parents = chunk_ids(sections(docs).join(docs.select("doc_id", family), "doc_id"), family)
    count = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda t: t != ""))
    one = parents.select(F.col("parent_id").alias("chunk_id"), F.lit(None).cast("string").alias("parent_chunk_id"), F.lit(True).alias("is_parent"), F.col("body").alias("text"), count(F.col("body")).alias("token_count"), "doc_id", "section_index", F.lit(None).cast("int").alias("child_index"))
    child_id = F.concat(F.lit("child_"), F.substring("parent_id", 8, 12), F.lit("_"), F.col("child_index").cast("string"))
    two = children(parents).select(child_id.alias("chunk_id"), F.col("parent_id").alias("parent_chunk_id"), F.lit(False).alias("is_parent"), F.col("child").alias("text"), count(F.col("child")).alias("token_count"), "doc_id", "section_index", "child_index")
    return one.unionByName(two)


def resolve_parents(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """(the columns of hits, parent_id, parent_text): each hit (chunk_id) with the parent that it is part of; a parent is its own."""
    parent = chunks.filter("is_parent").select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text")).dropDuplicates(["parent_id"])
    own = chunks.select("chunk_id", F.coalesce("parent_chunk_id", "chunk_id").alias("parent_id")).dropDuplicates(["chunk_id"])
    return hits.join(own, "chunk_id").join(parent, "parent_id")


#: What a document's metadata are where they are not given.
METADATA = {"clearance_level": "PUBLIC", "tenant_id": "default_tenant", "version_number": "1.0"}


def with_defaults(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Metadata filled in; a family is made of the key's hash (8 characters), so that it is the same in every run."""
    have = lambda c, kind: F.col(c) if c in docs.columns else F.lit(None).cast(kind)
    filled = {c: F.coalesce(have(c, "string"), F.lit(v)) for c, v in METADATA.items()}
    filled["doc_family_id"] = F.coalesce(have("doc_family_id", "string"), F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8))
    return docs.withColumns(filled | {"is_active": F.coalesce(have("is_active", "boolean"), F.lit(True))})


def figures(rows: DataFrame) -> DataFrame:
    """A parent and a child with the same text for each figure (figure_id, title, summary)."""
    text = F.format_string("### [FIGURE / DIAGRAM]: %s\n\n%s", "title", "summary")
    return rows.select("figure_id", F.explode(F.array(F.lit(True), F.lit(False))).alias("is_parent"), text.alias("text"))


def topology_text(nodes: DataFrame, edges: DataFrame, size: int = 15, most: int = 50) -> DataFrame:
    """Parents (the first ``most`` nodes and edges of a drawing) and children (``size`` nodes each, one at least) as text.

    nodes: drawing_id, node_id, kind; edges: drawing_id, src, dst.
    """
    number = lambda by: F.row_number().over(Window.partitionBy("drawing_id").orderBy(*by))
    n = nodes.withColumns({"i": number(["node_id"]) - 1, "line": F.format_string("- %s (%s)", "node_id", "kind")})
    e = edges.withColumns({"i": number(["src", "dst"]) - 1, "line": F.format_string("- %s -> %s", "src", "dst")})
    lines = lambda df: df.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n"), F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.when(F.col("i") < most, F.struct("i", "line")))), lambda x: x["line"])).alias("text"))
    both = lines(n).join(lines(e).withColumnsRenamed({"n": "m", "text": "edges"}), "drawing_id", "left")
    parents = both.select("drawing_id", F.lit(-1).alias("batch"), F.format_string("Nodes (%d):\n%s\nEdges (%d):\n%s", "n", "text", F.coalesce("m", F.lit(0).cast("long")), F.coalesce("edges", F.lit(""))).alias("text"))
    batch = n.groupBy("drawing_id", F.floor(F.col("i") / size).cast("int").alias("batch")).agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"])).alias("text"))
    return parents.unionByName(batch)
