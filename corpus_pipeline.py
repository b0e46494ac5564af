"""A pipeline over documents: quality, near-duplicates, mixing, tokens.

Each stage reads what the stage before it wrote as Parquet. The first three keep the columns of documents; the last one
gives the tokens' digests of each document that is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkwright.llm import jaccard, mixing, quality, spm
from sparkwright.llm.queries import WEIGHTS
from sparkwright.llm.shared import work_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.7 or more. The classifier learns from their labels, as in its own query.

    Null and empty texts are scored like any other, long texts whole; repeated rows share their fate; null ids have no label.
    Without labels all rows stay; an empty table gives an empty table. Extra columns are carried along.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept(docs, quality.fit(quality.feature_table(docs, labels=labels), labels))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id. Shingles of five words, similarity 0.8 or more.

    Null and empty texts link with nothing and stay, as do rows without a doc_id; rows that share a doc_id are judged by their
    texts, so unlike ones stay; repeated rows go but one. Texts of any length are compared whole. Extra columns are carried along.
    """
    return jaccard.one_of_each(docs, k=5, num=80, den=100)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, stored in the order of the mixture: file after file, row after row.

    Null sources and those without a weight share one weight. Every row stays, repeated, null and empty ones too; an empty table
    gives an empty table. Extra columns are carried along.
    """
    return mixing.mixed_rows(docs, WEIGHTS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, n_tokens and the digests of its ids and of the decoded text.

    Null text counts as empty, which has the begin and end ids only; long texts are encoded whole; every row has its own result,
    repeated ones and null ids too; an empty table gives an empty table. Other columns are not read.
    """
    return spm.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("tokens", tokens_stage)]

#: SQL has neither the classifier's Cholesky factors nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_path(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}-{name}")
    return docs
