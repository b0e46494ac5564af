"""Exact n-gram Jaccard join: T-occurrence search with DivideSkip, whose short lists are dealt to tasks by their shingle.

1. Every text becomes its set of shingles (64-bit hashes). Equal sets are one from here on: their smallest id stands for them.
2. All sets order their shingles alike: those that were seen often come last (``frequent``), others by their hash. Two linked
   sets share H of the first |s| - T + H shingles of each, T being the overlap that a set needs: these are the short lists of
   T-occurrence search when T - H lists are set aside (H is ``HITS``, or T if that is less). Where they meet, at place i of s, for
   the H-th time at most, they share at most |s| - i + H - 1, so the sizes of partners end at a ``reach``; two sets of a list count
   as meeting only if each has its size within the other's reach. Postings that meet no other are dropped.
3. A list is read in the order of sizes, and each set is tied to the one before it that reaches furthest, if far enough. A set
   that is tied in H lists or more is searched together with the one it is tied to most (step 5), which finds most links of
   groups of near copies without forming their pairs. What these links connect is a cluster.
   Such a family is dealt to blocks of a bounded size, nearly always one; sets outside its largest cluster ask its other blocks.
4. A set then asks each cluster of another family with which it meets in H short lists, the smaller cluster's sets the larger
   cluster. No pair of two clusters is lost, and pairs inside a cluster have nothing to add. Nothing is closed over sets that
   merely may link, so chance meetings cost a search each and do not grow together.
5. A search builds inverted lists of a block. A query needs T common elements: the L longest lists are set aside, the others are
   merged on a heap, sets with at least T - L hits there are looked up in the long lists by binary search, and those that reach
   the overlap their two sizes require are linked. Within a block a set whose component is already the largest need not ask,
   once all others have. Blocks have a bounded size, and so have the askers of one task.

The order only decides how many sets are compared, never which are found to link, so the bound on the table of frequent
shingles loses nothing. Links with a similarity equal to the threshold count. Defined cases: null and empty texts have no
shingles and link with nothing; a text of any length is one set, which a task holds with those of its block; rows of one id
are one node; a null id links with nothing and has a null component; repeated rows stay, one result each; an empty table
gives an empty table; other columns are not read, so their names do not matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.bytewords import U, mix, parts, shingle_sets
from sparkwright.llm.shared import components, materialise, maybe_among

#: Shingles of a block, and sets that ask it in one task.
BLOCK, ASKERS = 1 << 17, 4096
#: DivideSkip's weight of a binary search against a step of the merge.
SKIP = 0.01
#: Sets that are looked up in the long lists together.
PROBED = 32
#: Shingles that a task counts together, rows that the table of frequent ones has at most, and postings that a task deals together.
COUNTED, FREQUENT, DEALT = 4_000_000, 1 << 19, 300_000
#: Short lists in which two sets meet before one asks for the other.
HITS = 4


class Threshold:
    """A Jaccard threshold num / den, and what follows from it."""

    def __init__(self, num: int = 90, den: int = 100):
        if not 0 < num <= den:
            raise ValueError("the threshold is above 0 and at most 1")
        self.num, self.den = num, den

    def linked(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)

    def least(self, size: int) -> int:
        """Elements that a set shares with any that it links with."""
        return -(-self.num * size // self.den)

    def reaches(self, size: int) -> np.ndarray:
        """For each of a set's short lists: the largest partner, if fewer than HITS of the earlier ones are shared."""
        left = size - np.arange(min(size, size - self.least(size) + HITS)) + HITS - 1
        return (self.num + self.den) * left // self.num - size

    def meetings(self, size: Column) -> Column:
        """Short lists in which a set meets any that it links with, at least."""
        return F.least(F.lit(HITS), F.ceil(size * self.num / F.lit(self.den))).cast("int")


def fingerprint(s: np.ndarray, salt: int = 1) -> np.int64:
    return mix(s + U(salt)).sum(dtype=np.uint64).view(np.int64)


def _described(k: int) -> Callable:
    """(doc_id, text) to (doc_id, n, p, q): the size of a set and two sums over it that stand for it.

    Rows with n = -1 tell shingles (p) that several sets of the task hold, and how many (q).
    """
    names = ["doc_id", "n", "p", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def counts() -> pa.RecordBatch:
            tokens = np.concatenate([*held.values(), np.zeros(0, np.uint64)])
            held.clear()
            tokens.sort()
            again = np.flatnonzero(tokens[1:] == tokens[:-1])  # most are seen once
            first = np.ones(len(again), bool)
            first[1:] = again[1:] != again[:-1] + 1
            n = np.diff(np.append(np.flatnonzero(first), len(again))) + 1
            tokens = tokens[again[first]].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), pa.array(np.full(len(n), -1)), pa.array(tokens), pa.array(n)], names)

        total = 0
        for batch in batches:
            for part in parts(batch, 1):
                sets = shingle_sets(part.column(1), k)
                prints = [np.array([fingerprint(s, salt) for s in sets], np.int64) for salt in (1, 2)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, prints)], names)
                for p, s in zip(prints[0].tolist(), sets, strict=True):
                    if p not in held:
                        held[p] = s
                        total += len(s)
                if total > COUNTED:
                    yield counts()
                    total = 0
        yield counts()

    return run


def frequent(told: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The shingles counted most often (ascending), ``most`` of them at most, and the logarithm of each count."""
    seen = told.filter("n < 0").groupBy(F.col("p").alias("token")).agg(F.sum("q").alias("n"))
    seen = materialise(seen.select("token", F.floor(F.log2("n")).cast("int").alias("step")), "frequent")
    least, rows = 64, 0
    for step, n in sorted(map(tuple, seen.groupBy("step").count().collect()), reverse=True):  # a row for each power of two
        rows += n
        if rows > most:
            break
        least = step
    table = seen.filter(F.col("step") >= least).toArrow()
    tokens = table.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], table.column("step").to_numpy()[order].astype(np.uint8)


def short_lists(s: np.ndarray, limit: Threshold, often: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set (ascending, not empty) in the common order, and the reach at each."""
    tokens, steps = often
    reach = limit.reaches(len(s))
    rank = s >> U(6)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
        rank |= np.where(tokens[at] == s, steps[at], 0).astype(np.uint64) << U(58)
    return s[np.argsort(rank, kind="stable")[: len(reach)]], reach


def _postings(k: int, limit: Threshold, often: Broadcast, buckets: int) -> Callable:
    """(doc_id, text) to postings of the short lists, as lists by bucket of the shingle: one row a batch and bucket."""

    def dealt(told: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        many = [len(t) for _, t, _ in told.values()]
        token = np.concatenate([t for _, t, _ in told.values()])
        reach = np.concatenate([r for _, _, r in told.values()])
        bucket = (mix(token) % U(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        values = token.view(np.int64), np.repeat(np.array(list(told), np.int64), many), np.repeat(np.array([n for n, _, _ in told.values()], np.int32), many), reach.astype(np.int32)
        start = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        bounds = pa.array(np.append(start, len(order)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(bucket[order][start]), *(pa.ListArray.from_arrays(bounds, pa.array(v[order])) for v in values)], ["bucket", "token", "node", "n", "reach"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        held = 0
        for batch in batches:
            for part in parts(batch, 1):
                for s in shingle_sets(part.column(1), k):
                    if len(s) and (node := int(fingerprint(s))) not in told:
                        told[node] = (len(s), *short_lists(s, limit, often.value))
                        held += len(told[node][1])
                if held > DEALT:
                    yield dealt(told)
                    told, held = {}, 0
        if told:
            yield dealt(told)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings by (token, n, node) to those that may meet another, with the node that each is tied to, or null.

    Postings of one set that several tasks have dealt are one. A posting is kept if it is tied or the next one of its list is not beyond its reach. Of a list that goes on in the next batch,
    only the sets that reached further than all before are held.
    """
    held, told, last = None, np.zeros(0, bool), None
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(4)]
        if not len(cols[0]):
            continue
        fresh = np.ones(len(cols[0]), bool)
        fresh[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
        fresh[0] = last != (cols[0][0], cols[1][0])
        last = cols[0][-1], cols[1][-1]
        cols = [c[fresh] for c in cols]
        old = len(told)
        token, node, n, reach = cols = [np.concatenate(pair) for pair in zip(held, cols, strict=True)] if held else cols
        if not len(token):
            continue
        told = np.concatenate((told, np.zeros(len(token) - old, bool)))
        place, new = np.arange(len(token)), np.diff(token, prepend=~token[0]) != 0
        base = np.cumsum(new) << 32
        furthest = np.maximum.accumulate(base + reach)
        record = np.diff(furthest, prepend=-1) > 0
        best = np.maximum.accumulate(np.where(record, place, 0))
        # sets before it, and of a size that it reaches itself
        upto = np.where(reach >= n, place, np.searchsorted(base + n, base + reach, "right")) - 1
        partner = best[np.maximum(upto, 0)]
        tied = (upto >= 0) & (place >= old) & (base[partner] == base) & (reach[partner] >= n) & (node[partner] != node)
        met = tied.copy()
        met[:-1] |= (base[1:] == base[:-1]) & (n[1:] <= reach[:-1])
        met[-1] |= not record[-1]  # the next one is not known; a record is held for it
        out = met & ~told
        yield pa.RecordBatch.from_arrays([*(pa.array(c[out]) for c in cols), pa.array(node[partner[out]], mask=~tied[out])], ["token", "node", "n", "reach", "partner"])
        keep = record & (base == base[-1])
        held, told = [c[keep] for c in cols], (told | met)[keep]


class Lists:
    """Inverted lists over some sets, and T-occurrence search in them."""

    def __init__(self, sets: list[np.ndarray], limit: Threshold):
        self.limit, self.n = limit, len(sets)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(self.n), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        self.docs = owner[order]
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        self.tokens = tokens[new]
        self.starts = np.append(np.flatnonzero(new), len(tokens))
        #: One ascending key for each posting, for the binary searches.
        self.keys = (np.cumsum(new) - 1) * max(self.n, 1) + self.docs

    def search(self, s: np.ndarray, skip: Callable[[int], bool] = lambda doc: False) -> Iterator[int]:
        """The sets linked with s, those with most hits first, besides those that ``skip`` marks when their turn comes."""
        need = self.limit.least(len(s))
        at = np.searchsorted(self.tokens, s)
        there = at < len(self.tokens)
        at = at[there][self.tokens[at[there]] == s[there]]
        if len(at) < need or not need:
            return
        sizes = self.starts[at + 1] - self.starts[at]
        at = at[np.argsort(sizes, kind="stable")]
        long = min(need - 1, int(need / (SKIP * np.log2(max(2, sizes.max())) + 1)))
        short = [self.docs[self.starts[i] : self.starts[i + 1]].tolist() for i in at[: len(at) - long]]
        found = sorted((-n, doc) for doc, same in groupby(heapq.merge(*short)) if (n := sum(1 for _ in same)) >= need - long)
        lists = np.sort(at[len(at) - long :]) * max(self.n, 1)
        for some in (found[i : i + PROBED] for i in range(0, len(found), PROBED)):
            open_ = [(n, d) for n, d in some if not skip(d)]
            if open_:
                less, doc = np.array(open_, np.int64).T
                wanted = lists + doc[:, None]
                probe = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
                common = (self.keys[probe] == wanted).sum(axis=1) - less
                for d in doc[self.limit.linked(common, len(s), self.sizes[doc])].tolist():
                    if not skip(d):
                        yield d


def link_sets(sets: list[np.ndarray], limit: Threshold) -> list[int]:
    """Of each set the smallest one (by place) that links reach."""
    lists = Lists(sets, limit)
    root, weight = list(range(len(sets))), [1] * len(sets)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    waiting, largest = list(range(len(sets))), -1
    while waiting:
        later = []
        for q in waiting:
            if find(q) == largest:  # the others ask first
                later.append(q)
                continue
            for doc in lists.search(sets[q], skip=lambda doc, q=q: find(doc) == find(q)):
                a, b = sorted((find(q), find(doc)))
                root[b] = a
                weight[a] += weight[b]
            if largest < 0 or weight[find(q)] >= weight[find(largest)]:
                largest = find(q)
            largest = find(largest)
        waiting = [q for q in later if find(q) != largest]
    return [find(x) for x in range(len(sets))]


def _search(k: int, limit: Threshold, within: bool):
    """Rows: family, block, salt, role (0: of the block, 1: asks it), doc_id, text; those of a block together, in this order.

    Gives links (a, b): of the askers with the block, and ``within`` the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, lists, last = None, [], [], None, None

        def own() -> list[tuple[int, int]]:
            roots = link_sets(sets, limit) if within and len(sets) > 1 else []
            return [(ids[i], ids[r]) for i, r in enumerate(roots) if ids[r] != ids[i]]

        for batch in batches:
            pairs: list[tuple[int, int]] = []
            for part in parts(batch, 5):
                rows = zip(*(part.column(i).to_pylist() for i in range(5)), shingle_sets(part.column(5), k), strict=True)
                for family, block, salt, role, doc, s in rows:
                    if (family, block, salt) != key:
                        pairs += own()
                        key, ids, sets, lists, last = (family, block, salt), [], [], None, None
                    if last and last[:2] == (role, doc) and np.array_equal(last[2], s):
                        continue  # a repeated row
                    last = role, doc, s
                    if role:
                        lists = lists or Lists(sets, limit)
                        pairs += [(doc, ids[j]) for j in lists.search(s) if ids[j] != doc]
                    else:
                        ids.append(doc)
                        sets.append(s)
            yield _links(pairs)
        yield _links(own())

    return run


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links reach) of every row."""
    spark, limit = docs.sparkSession, Threshold(num, den)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    told = materialise(rows.mapInArrow(_described(k), "doc_id long, n long, p long, q long"), "sets")
    some = told.filter("n > 0 AND doc_id IS NOT NULL")
    # kept as a table, so that joins with it exchange both sides and large groups of copies can be split
    alike = materialise(some.groupBy("n", "p", "q").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "alike")
    often = spark.sparkContext.broadcast(frequent(told))
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = rows.filter("doc_id IS NOT NULL")
    met = known.mapInArrow(_postings(k, limit, often, buckets), "bucket int, token array<long>, node array<long>, n array<int>, reach array<int>")
    met = met.repartition("bucket").select(F.inline(F.arrays_zip("token", "node", "n", "reach"))).sortWithinPartitions("token", "n", "node")
    shared = materialise(met.mapInArrow(_shared, "token long, node long, n int, reach int, partner long"), "shared")
    often.destroy()
    # of equal sets the first is searched for all
    member = materialise(shared.select("node").distinct().join(alike.select(F.col("p").alias("node"), "n", F.col("first").alias("doc_id")), "node"), "members")

    def search(held: DataFrame, label: str, asks: DataFrame | None = None) -> DataFrame:
        """held, asks: doc_id, family, block, salt. Most texts that are not named are not shuffled for the join."""
        named = held.withColumn("role", F.lit(0))
        named = named if asks is None else named.unionByName(asks.withColumn("role", F.lit(1)))
        named = materialise(named, f"{label}-asked")
        some_rows = maybe_among(known, "doc_id", named).filter("maybe").select("row.*").join(named.hint("merge"), "doc_id")
        some_rows = some_rows.select(F.concat_ws(" ", "family.sets", "family.root").alias("family"), "block", "salt", "role", "doc_id", "text")
        together = some_rows.repartition("family", "block", "salt").sortWithinPartitions("family", "block", "salt", "role", "doc_id")
        return materialise(together.mapInArrow(_search(k, limit, asks is None), "a long, b long"), label)

    # families of sets that are tied often, each with the one it is tied to most, in blocks; a family's first set is in all of them
    ties = shared.filter("partner IS NOT NULL").groupBy("node", "partner").agg(F.count(F.lit(1)).alias("hits"), F.first("n").alias("n"))
    ties = ties.groupBy("node").agg(F.sum("hits").alias("hits"), F.max_by("partner", F.struct("hits", "partner")).alias("partner"), F.first("n").alias("n"))
    ties = ties.filter(F.col("hits") >= limit.meetings(F.col("n"))).select(F.col("node").alias("a"), F.col("partner").alias("b"))
    tied = member.join(components(ties, "ties").withColumnRenamed("root", "tie"), "node")
    blocks = tied.groupBy("tie").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"), F.min("doc_id").alias("head"))
    tied = materialise(tied.join(blocks, "tie").withColumn("block", F.expr("pmod(xxhash64(doc_id), blocks)").cast("int")), "tied")
    of_tie = F.struct(F.lit(0).cast("long").alias("sets"), F.col("tie").alias("root")).alias("family")
    every = F.expr("sequence(0, blocks - 1)")
    own = tied.select("doc_id", of_tie, "block")
    heads = tied.filter("doc_id = head").select("doc_id", of_tie, F.explode(every).alias("block"))
    links = search(own.unionByName(heads).withColumn("salt", F.lit(0)), "links")

    # in a family of several blocks, sets outside its largest cluster ask the other blocks
    root = components(links).withColumnRenamed("node", "doc_id")
    at = tied.join(root, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    size = at.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.ceil(F.sum("n") / block).cast("int").alias("parts"))
    at = materialise(at.join(size, "root").withColumn("part", F.expr("pmod(xxhash64(doc_id), parts)").cast("int")), "clusters")
    several = at.filter("blocks > 1")
    most = several.groupBy("tie", "root").count().groupBy("tie").agg(F.max_by("root", F.struct("count", "root")).alias("most"))
    outside = several.join(most, "tie").filter("root <> most").select("doc_id", of_tie, F.col("block").alias("home"), F.explode(every).alias("block"))
    inner = outside.filter("block <> home").select("doc_id", "family", "block")

    # a set asks the clusters of other families that it meets in its short lists, the smaller cluster the larger; a set by itself is one too
    alone = F.struct(F.lit(1).cast("long").alias("sets"), F.col("node").alias("root"))
    cluster = F.when(F.col("sets") > 1, F.struct("sets", "root")).otherwise(alone)
    known_at = at.select("node", "tie", cluster.alias("cluster"), F.when(F.col("sets") > 1, F.col("part")).otherwise(0).alias("part"))
    lists = maybe_among(shared.select("token", "node", "n", "reach"), "node", known_at)
    found = lists.filter("maybe").select("row.*").join(known_at.hint("merge"), "node", "left")
    others = lists.filter("NOT maybe").select("row.*").select("*", *[F.lit(None).cast(known_at.schema[c].dataType).alias(c) for c in ("tie", "cluster", "part")])
    lists = found.unionByName(others).select("token", "node", "n", "reach", F.coalesce("tie", "node").alias("tie"), F.coalesce("cluster", alone).alias("cluster"), F.coalesce("part", F.lit(0)).alias("part"))
    lists = lists.repartition("token")
    ends = lists.groupBy("token", F.col("cluster").alias("family"), F.col("part").alias("block"), F.col("tie").alias("their_tie")).agg(F.min("n").alias("low"), F.max("reach").alias("high"))
    meets = lists.join(ends, "token").filter("cluster < family AND tie <> their_tie AND n <= high AND low <= reach")
    meets = meets.groupBy("node", "family", "block").agg(F.count(F.lit(1)).alias("hits"), F.first("n").alias("n")).filter(F.col("hits") >= limit.meetings(F.col("n")))
    asks = materialise(inner.unionByName(meets.join(member.select("node", "doc_id"), "node").select("doc_id", "family", "block")), "asks")
    salts = asks.groupBy("family", "block").agg(F.ceil(F.count(F.lit(1)) / ASKERS).cast("int").alias("salts"))
    asks = asks.join(salts, ["family", "block"]).select("doc_id", "family", "block", F.expr("pmod(xxhash64(doc_id), salts)").cast("int").alias("salt"))
    places = own.unionByName(at.filter("sets > 1").select("doc_id", F.struct("sets", "root").alias("family"), F.col("part").alias("block")))
    places = places.unionByName(member.select("doc_id", alone.alias("family"), F.lit(0).alias("block")))
    held = places.join(salts, ["family", "block"]).select("doc_id", "family", "block", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
    links = links.unionByName(search(held, "more-links", asks))

    # rows of one id are one node, whatever their sets
    named = told.filter("n >= 0").join(alike.filter("copies > 1").select("n", "p", "q", "first"), ["n", "p", "q"], "left")
    named = named.select("doc_id", "n", F.expr("CASE WHEN doc_id IS NOT NULL THEN coalesce(first, doc_id) END").alias("first"))
    named = materialise(named, "named")
    several = named.groupBy("doc_id").agg(F.min("first").alias("b"), F.max("first").alias("most")).filter("b < most").select("doc_id", "b")
    same = named.join(several, "doc_id").select(F.col("first").alias("a"), "b")
    root = components(links.unionByName(same), "components").withColumnsRenamed({"node": "first"})
    return named.join(root, "first", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "first").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each group of linked texts the row with the smallest key stays.

    Rows that share a key are judged by their own texts: unlike ones all stay, and in a group they come before keys that only one
    row has. Of rows with one key and one text one stays, if it has words. Rows without a key or without words stay; an empty
    table gives an empty table; other columns are carried as they are, whatever their names.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("key"))
    twice = materialise(rows.groupBy("key").count().filter("key IS NOT NULL AND count > 1").select("key"), "twice")
    if not twice.isEmpty():  # such rows get negative keys that stand for key and text
        told = maybe_among(rows, "key", twice)
        told = told.filter("maybe").select("row.*").join(twice.withColumn("again", F.lit(True)).hint("merge"), "key", "left").unionByName(
            told.filter("NOT maybe").select("row.*").withColumn("again", F.lit(None).cast("boolean"))
        )
        own = F.shiftrightunsigned(F.xxhash64("key", F.col("row").getField(text)), 1)
        rows = told.select("row", F.when(F.col("again"), -1 - own).otherwise(F.col("key")).alias("key"))
    linked = rows.select(F.col("key").alias("doc_id"), F.col("row").getField(text).alias("text"))
    found = materialise(jaccard_components(linked, k, num, den), "found")
    gone = materialise(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("key")).distinct(), "gone")
    told = maybe_among(rows, "key", gone)
    left = told.filter("NOT maybe").select("row.*").unionByName(told.filter("maybe").select("row.*").join(gone.hint("merge"), "key", "left_anti"))
    again = found.filter("doc_id < 0 AND n_shingles > 0 AND doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("key"))
    again = materialise(again, "again")
    if not again.isEmpty():
        one = left.join(again, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
        left = left.join(again, "key", "left_anti").unionByName(one)
    return left.select("row.*")
