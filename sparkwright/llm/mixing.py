"""Mixing sources to target weights by a Pfair schedule, in DataFrame functions only.

Weights are whole numbers a_k: source k owns a_k blocks of every cycle of sum(a) blocks while all sources last. In the
fluid schedule, at virtual time v, source k has given min(N_k, a_k * v) blocks of its N_k; when a source is used up, the
others share its place by their weights. Block j of source k is released when the fluid schedule starts it, at slot
sum_l min(N_l, a_l * j / a_k), and due when the fluid schedule ends it, rounded up. Earliest deadline first among the
released blocks keeps every source less than one block from the fluid schedule at every slot.

At whole virtual times every released block is served, so cycles are independent, and cycles with the same blocks have
the same order. There are at most 2 * sources + 1 kinds of cycle (the weights bound their tables, not the data); one
row for each kind is scheduled by a SQL fold, and every row of the data finds its slot by an equi-join.

Every row is kept exactly once. Defined cases: sources without a weight, null among them, form one source of weight
``rest``; the last block of a source may be short and takes only its own rows' room; null keys and texts order first;
repeated rows are tied in any order; an empty table gives an empty table; other columns are carried along under any name.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.shared import checksum, numbered

#: Most rows of the schedule's tables, which are broadcast.
MOST = 1_000_000


def _settled(df: DataFrame) -> DataFrame:
    """The same rows; a generator stands between, so that later expressions refer to these columns and don't repeat them."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _schedule(groups: DataFrame, weights: list[int], block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sources (one row each), the slots of each kind of cycle, and one row with the slots of the sources' last blocks."""
    n = len(weights)
    a = F.array(*[F.lit(w) for w in weights])
    counts = groups.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("g", "n"))).alias("by"))
    one = counts.select(a.alias("a"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda g: F.coalesce(F.try_element_at("by", g), F.lit(0).cast("long"))).alias("rows"))
    one = _settled(one.withColumn("blocks", F.transform("rows", lambda r: F.ceil(r / block))))
    one = one.withColumn("turns", F.zip_with("blocks", "a", lambda b, w: F.floor(b / w)))
    one = one.withColumn("starts", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), "turns", F.transform("turns", lambda q: q + 1)))))
    one = _settled(one)
    kinds = one.select("*", F.posexplode("starts").alias("kind", "first"))
    kinds = _settled(kinds)
    kinds = kinds.withColumn("own", F.zip_with("blocks", "a", lambda b, w: F.greatest(F.lit(0).cast("long"), F.least(w.cast("long"), b - w * F.col("first")))))
    kinds = _settled(kinds).withColumn("base", F.aggregate(F.zip_with("blocks", "a", lambda b, w: F.least(b, w * F.col("first"))), F.lit(0).cast("long"), lambda x, y: x + y))
    kinds = kinds.withColumn("length", F.aggregate("own", F.lit(0).cast("long"), lambda x, y: x + y)).filter("length > 0")
    kinds = kinds.withColumn("released", F.expr("transform(a, (w, k) -> transform(sequence(0, w), m -> ceil(aggregate(zip_with(own, a, (b, v) -> least(b * w, v * m)), 0L, (x, y) -> x + y) / w)))"))
    kinds = _settled(kinds)
    pick = """coalesce(
        array_min(transform(filter(sequence(0, size(a) - 1), k -> s.done[k] < own[k] AND released[k][s.done[k]] < t), k -> struct((s.done[k] + 1) / a[k] AS due, k AS k))),
        array_min(transform(filter(sequence(0, size(a) - 1), k -> s.done[k] < own[k]), k -> struct((s.done[k] + 1) / a[k] AS due, k AS k)))).k"""
    kinds = kinds.withColumn(
        "order",
        F.expr(f"""aggregate(sequence(1, CAST(length AS INT)), struct(transform(a, w -> 0) AS done, CAST(array() AS array<int>) AS picked),
            (s, t) -> transform(array({pick}), c -> struct(transform(s.done, (d, i) -> d + if(i = c, 1, 0)) AS done, concat(s.picked, array(c)) AS picked))[0],
            s -> s.picked)"""),
    )
    kinds = _settled(kinds)
    # the slot's number among those of its source: counted in the array, not by a window over one partition
    slots = kinds.select("kind", "first", "base", "length", "released", F.expr("transform(order, (g, i) -> struct(i AS slot, g AS g, size(filter(slice(order, 1, i), x -> x = g)) AS m))").alias("o"))
    slots = slots.select("kind", "first", "base", "length", "released", F.inline("o"))
    slots = slots.select("kind", "g", "m", "first", "length", "slot", "base", F.expr("released[g][m]").alias("rel"), F.expr("released[g][m + 1]").alias("due"))
    sources = one.select("starts", F.inline(F.arrays_zip(F.sequence(F.lit(0), F.lit(n - 1)).alias("g"), "a", "rows", "blocks")))
    ends = _placed(sources.filter("blocks > 0").withColumn("j", F.col("blocks") - 1), slots).select(F.struct("block_slot", (F.col("blocks") * block - F.col("rows")).alias("missing")).alias("e"))
    return sources.select("g", "a", "starts"), slots, ends.agg(F.collect_list("e").alias("ends"))


def _placed(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """rows: g, a, starts, j (block of the source from 0). Adds the block's slot, release and deadline in the whole schedule."""
    rows = rows.withColumn("_q", F.expr("j div a")).withColumn("kind", F.expr("size(filter(starts, s -> s <= _q)) - 1")).withColumn("m", F.expr("CAST(j % a AS INT)"))
    rows = rows.join(F.broadcast(slots), ["kind", "g", "m"])
    start = F.col("base") + (F.col("_q") - F.col("first")) * F.col("length")
    return rows.withColumns({"block_slot": start + F.col("slot"), "release": start + F.col("rel"), "deadline": start + F.col("due")}).drop("_q", "kind", "m", "first", "length", "slot", "base", "rel", "due")


def mix(docs: DataFrame, weights: Mapping[str, int], rest: int = 1, block: int = 16, source: str = "source", key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: key, source, block of the source, its release, deadline and slot, and the row's position in the mixture (from 0).

    ``carry`` adds the whole input row as a struct ``row``.
    """
    names, counts = list(weights), [*weights.values(), rest]
    if any(not isinstance(w, int) or w < 1 for w in counts) or block < 1:
        raise ValueError("weights are whole numbers of at least 1, and so is the block")
    if (2 * len(counts) + 1) * sum(counts) > MOST:
        raise ValueError("the weights' sum times their number is too large for the schedule's tables")
    at = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("source")) if names else F.lit(0)
    g = F.coalesce(F.when(at > 0, (at - 1).cast("int")), F.lit(len(names)))
    found = [F.col(key).alias("key"), F.col(source).cast("string").alias("source"), checksum(F.col(text)).alias("crc")]
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(*found, *whole).withColumn("g", g)
    sources, slots, ends = _schedule(docs.select(F.col(source).cast("string").alias("source")).select(g.alias("g")), counts, block)
    # the weights bound all three tables; ends is one row, read as a scalar
    sources = F.broadcast(sources.withColumn("ends", ends.scalar()))
    out = numbered(rows, "g", ["key", "crc"], "r").join(sources, "g").withColumn("j", F.expr(f"r div {block}"))
    out = _placed(out, slots)
    short = F.aggregate("ends", F.lit(0).cast("long"), lambda x, e: x + F.when(e["block_slot"] < F.col("block_slot"), e["missing"]).otherwise(0))
    out = out.withColumn("position", F.col("block_slot") * block + F.expr(f"r % {block}") - short)
    return out.select(F.col("key").alias(key), "source", F.col("j").alias("block"), "release", "deadline", "block_slot", "position", *(["row"] if carry else []))


def mixed_rows(docs: DataFrame, weights: Mapping[str, int], rest: int = 1, block: int = 16) -> DataFrame:
    """The rows of docs with their own columns, stored in the order of the mixture: partition i holds the i-th run of positions."""
    rows = mix(docs, weights, rest, block, carry=True).select("position", "row")
    total = docs.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionById(parts, F.expr("CAST(0 AS INT)") + (F.col("position") * parts / total).cast("int"))
    return dealt.sortWithinPartitions("position").select(*[F.col("row")[c].alias(c) for c in docs.columns])
