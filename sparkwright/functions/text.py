"""Column functions for texts: tokens, masked phrases, labels by keywords."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case words between white space, in order; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")


def overlap(query: Column, terms: Column) -> Column:
    """Share of the query's distinct terms that occur among ``terms``."""
    return F.size(F.array_intersect(query, terms)) / F.greatest(F.size(F.array_distinct(query)), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


#: Patterns of instruction overrides, and what replaces each match.
INJECTIONS = (
    r"\bignore\s+(?:all\s+)?previous\s+instructions\b",
    r"\bforget\s+(?:all\s+)?previous\s+rules\b",
    r"\bsystem\s*:\s*you\s+are\s+now\b",
    r"\bDAN\s+mode\b",
    r"\bgrant\s+admin\s+access\b",
    r"\boverride\s+security\s+policy\b",
)
REDACTED = "[REDACTED INJECTION ATTEMPT]"


def threats(text: Column, patterns: Sequence[str] = INJECTIONS) -> Column:
    """The patterns, in their order, that the original text has in any case of letters."""
    return F.filter(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(p)) for p in patterns]), lambda x: x.isNotNull())


def redacted(text: Column, patterns: Sequence[str] = INJECTIONS) -> Column:
    """Every pattern replaced, each in the result of those before."""
    for p in patterns:
        text = F.regexp_replace(text, "(?i)" + p, REDACTED)
    return text


#: Substrings that route a query, in order of precedence. They match inside words, so "capital" holds "api".
DOMAINS = (
    ("ASME_MECHANICAL", ("asme", "b31.3", "wall thickness", "allowable stress", "pipe spec")),
    ("API_PETROCHEMICAL", ("api", "510", "650", "tank", "corrosion rate", "remaining life")),
    ("PSU_TENDER_MEMOS", ("psu", "approval note", "tender", "memo", "board")),
)
ADAPTERS = {"ASME_MECHANICAL": "lora_asme_v1", "API_PETROCHEMICAL": "lora_api_v1", "PSU_TENDER_MEMOS": "lora_psu_v1"}


def domain(text: Column) -> Column:
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit("GENERAL")
    for name, keys in reversed(DOMAINS):
        hit = F.lit(False)
        for k in keys:
            hit = hit | low.contains(k)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out
