"""Rendezvous hashing of stable keys over weighted shards, in DataFrame functions only.

Every shard draws a number for every key, w / -ln(u) with u a uniform hash of (key, shard); the largest number wins.
A key therefore moves only if a shard with a larger number comes or its own shard goes: one more shard takes its share
of rows into itself and moves no others.

Defined cases: a null key is a key like any other; null text counts as no bytes (size 1, checksum 0); repeated keys go
to the same shard and have slots of their own; an empty table gives an empty table; only the named columns are read, so
other columns of any name have no effect.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.shared import checksum, numbered, utf8_size


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 ..) with the largest draw; ties go to the smaller shard."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    draws = []
    for s, w in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(s)), 11) + F.lit(0.5)) * F.lit(2.0**-53)
        draws.append(F.struct((F.lit(float(w)) / -F.log(u)).alias("draw"), F.lit(-s).alias("minus")))
    return (-F.array_max(F.array(*draws))["minus"]).cast("int")


def shard_rows(docs: DataFrame, weights: Sequence[float] = (1.0,) * 16, grown: Sequence[float] = (1.0,), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, slot and the shard after ``grown`` more shards, one row per input row.

    The text is read for its size and checksum and is not shuffled. Slots count from 0 in each shard, ordered by a hash of (key, checksum).
    """
    rows = docs.select(F.col(key).alias(key), (utf8_size(F.col(text)) + 1).alias("size"), checksum(F.col(text)).alias("text_crc32"))
    rows = rows.withColumns({"law": F.lit("key"), "shard": shard_of(F.col(key), weights), "grown_shard": shard_of(F.col(key), [*weights, *grown])})
    return numbered(rows, "shard", [key, "text_crc32"], "slot").select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
