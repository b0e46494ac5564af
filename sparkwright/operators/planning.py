"""Plans as frames: edits of a plan before and after its approval, the trust pair, the form of ingested pages, sorted JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.operators import graph

#: The belief from which a proven artifact is committed, and what a proof can say.
BELIEF = 0.85
PROOFS = ("PASS", "FAIL", "PENDING")

#: Fixed value: an ingested document with its pages and their elements.
PAGES = """document_id string, sha256_hash string, pages array<struct<page_number int, width_px int, height_px int, modality string, elements array<struct<
    element_id string, type string, bounding_box struct<x1 double, y1 double, x2 double, y2 double>, text_content string, confidence double,
    spatial_relations array<struct<target_element_id string, relation_type string>>>>>>"""
MODALITIES = ("SCANNED_PDF", "HANDWRITTEN_LOG", "PID_DRAWING", "FIELD_PHOTO", "MIXED")
ELEMENTS = ("TEXT_BLOCK", "TABLE", "HANDWRITING", "SYMBOL", "LINE_VECTOR", "PHOTO_REGION")


def trusted(belief: Column, proof: Column) -> Column:
    """Whether an artifact is committed by itself: believed enough and proven."""
    return F.coalesce((belief >= BELIEF) & (proof == "PASS"), F.lit(False))


def prune(plan: DataFrame, wanted: DataFrame) -> DataFrame:
    """The plan (id, status, essential) with the wanted nodes (id) PRUNED, as far as they are not essential."""
    hit = plan.join(wanted.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    return hit.withColumn("status", F.when(F.col("hit") & ~F.col("essential"), "PRUNED").otherwise(F.col("status"))).drop("hit")


def reorder(dependencies: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Dependencies (id, needs) without some and with others."""
    return dependencies.select("id", "needs").join(removed.select("id", "needs"), ["id", "needs"], "left_anti").unionByName(added.select("id", "needs")).distinct()


def approve(plan: DataFrame, version: int) -> DataFrame:
    """Proposed nodes become READY under the version that is approved; pruned ones stay out."""
    return plan.withColumns({"status": F.when(F.col("status") == "PROPOSED", "READY").otherwise(F.col("status")), "version": F.lit(version)})


def replan(plan: DataFrame, dependencies: DataFrame, changed: DataFrame) -> DataFrame:
    """The plan after new evidence about some nodes (id): they and what depends on them are PROPOSED again, siblings keep what they have."""
    edges = dependencies.select(F.col("needs").alias("src"), F.col("id").alias("dst"))
    hit = changed.select("id").unionByName(graph.reach(edges, changed.select(F.col("id").alias("node"))).select(F.col("node").alias("id"))).distinct().withColumn("hit", F.lit(True))
    rows = plan.join(hit, "id", "left")
    return rows.withColumn("status", F.when(F.col("hit") & (F.col("status") != "PRUNED"), "PROPOSED").otherwise(F.col("status"))).drop("hit")


def read_pages(json: Column) -> Column:
    """A document by PAGES from its JSON; null where a needed field is missing or a page or element has a kind that is not known."""
    doc = F.from_json(json, PAGES)
    element = lambda e: e["element_id"].isNotNull() & e["type"].isin(*ELEMENTS) & e["bounding_box"].isNotNull() & e["confidence"].isNotNull()
    page = lambda p: p["page_number"].isNotNull() & p["width_px"].isNotNull() & p["height_px"].isNotNull() & p["modality"].isin(*MODALITIES) & F.forall(p["elements"], element)
    good = doc["document_id"].isNotNull() & doc["sha256_hash"].isNotNull() & F.forall(doc["pages"], page)
    return F.when(F.coalesce(good, F.lit(False)), doc)


def canonical(pairs: Column) -> Column:
    """A map of texts as JSON with sorted keys, so that equal maps give equal texts."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))
