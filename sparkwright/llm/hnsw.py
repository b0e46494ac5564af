"""Near-duplicate vectors by hierarchical navigable small-world graphs, one a shard; every vector asks every shard.

Equal vectors are one from the start. A shard orders its vectors by falling level, so that each layer is a leading run of
them, and inserts them in batches: a beam search for the batch finds candidates, a spread-out choice of them becomes the
links, and full link lists are chosen anew. Searches keep the best ``beam`` vectors of each query and expand those not
yet expanded. A query whose whole beam is linked asks again with twice the beam; after each batch an audit compares some
of its queries with brute force over the shard, those with no, few and many links apart and each query alike. While the mean
share of links found is below ``recall`` for any of the three, the beam of the whole batch doubles; past the shard's size the
batch is compared with the whole shard, in blocks. Every pair is confirmed by its cosine in double precision.

A shard returns the number of links of each query and, of the links themselves, a spanning forest of its own.

Defined cases: vectors that are null, empty, all zero or hold null or non-finite components link with nothing; so do
vectors of different lengths; rows of one id and different vectors are one node whose links add up; repeated rows
count as other vectors of cosine 1 and stay, one result each; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.balltree import matrix, valid
from sparkwright.llm.shared import components, materialise, shard_stream

#: Vectors of a shard, and the least number of shards.
SHARD, SHARDS = 200_000, 12
#: Links of a vector above and on the lowest layer; beams while building and while searching; vectors inserted together.
LINKS, LOWEST, BUILD, BEAM, TOGETHER = 12, 24, 40, 32, 256
#: Vectors that a search expands at once, twice the queries that an audit takes of each kind, and links that are many.
WIDTH, AUDIT, FEW = 4, 128, 8
NONE = -np.inf


class Graph:
    """One shard: unit vectors x (float64) in rows."""

    def __init__(self, x: np.ndarray, seed: int = 1):
        n = len(x)
        level = np.floor(-np.log(np.random.default_rng(seed).random(n) + 1e-300) / np.log(LINKS)).astype(int)
        self.order = np.argsort(-level, kind="stable")  # place in the graph -> row given
        self.exact, self.x, level = x[self.order], x[self.order].astype(np.float32), level[self.order]
        self.sizes = [int((level >= k).sum()) for k in range(level[0] + 1)] if n else []
        self.links = [np.full((size, LOWEST if k == 0 else LINKS), -1, np.int64) for k, size in enumerate(self.sizes)]
        self.done = 0
        for first in range(0, n, TOGETHER):
            self._insert(np.arange(first, min(n, first + TOGETHER)))

    def _insert(self, new: np.ndarray) -> None:
        entry = np.zeros((len(new), 1), np.int64)
        q = self.x[new]
        mutual = q @ q.T
        np.fill_diagonal(mutual, NONE)
        for k in range(len(self.sizes) - 1, -1, -1):
            own = new < self.sizes[k]  # the others only pass through
            there = min(self.done, self.sizes[k])
            if there:
                found, score = self.beam(q, entry, k, BUILD if own.any() else 1, there)
                entry = np.where(found[:, :4] >= 0, found[:, :4], found[:, :1])
            else:
                found, score = np.full((len(new), 0), -1, np.int64), np.zeros((len(new), 0), np.float32)
            if own.any():
                m = int(own.sum())
                near = np.argsort(-mutual[:m, :m], axis=1)[:, :16]
                found = np.concatenate((found[:m], new[near]), axis=1)
                score = np.concatenate((score[:m], np.take_along_axis(mutual[:m, :m], near, axis=1)), axis=1)
                self._link(k, new[:m], found, score)
        self.done = int(new[-1]) + 1

    def _link(self, k: int, new: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        most = self.links[k].shape[1]
        chosen = self._choose(found, score, max(4, most // 2) if k == 0 else most)
        self.links[k][new, : chosen.shape[1]] = chosen
        a, b = np.repeat(new, chosen.shape[1]), chosen.ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        start = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, int)
        heads, size = b[start], np.diff(np.append(start, len(b)))
        room = np.full((len(heads), int(size.max()) if len(size) else 0), -1, np.int64)
        room[np.repeat(np.arange(len(heads)), size), np.arange(len(b)) - np.repeat(start, size)] = a
        for at in range(0, len(heads), TOGETHER):
            own = heads[at : at + TOGETHER]
            both = np.concatenate((self.links[k][own], room[at : at + TOGETHER]), axis=1)
            both = np.sort(both, axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            sims = np.where(both >= 0, np.einsum("bd,bcd->bc", self.x[own], self.x[both]), NONE)
            few = (both >= 0).sum(axis=1) <= most
            ranked = np.take_along_axis(both, np.argsort(-sims, axis=1), axis=1)[:, :most]
            if ranked.shape[1] < most:
                ranked = np.pad(ranked, ((0, 0), (0, most - ranked.shape[1])), constant_values=-1)
            if not few.all():
                ranked[~few] = self._choose(both[~few], sims[~few], most)
            self.links[k][own] = ranked

    def _choose(self, found: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates those that are nearer to it than to any chosen before, then the nearest others."""
        order = np.argsort(-np.where(found >= 0, score, NONE), axis=1)[:, : max(BUILD + 16, most)]
        found, score = np.take_along_axis(found, order, axis=1), np.take_along_axis(score, order, axis=1)
        b, c = found.shape
        among = np.einsum("bcd,bed->bce", self.x[found], self.x[found])
        usable = (found >= 0) & (score > NONE)
        taken, nearest = np.zeros((b, c), bool), np.full((b, c), NONE)
        for i in range(c):
            good = usable[:, i] & (taken.sum(axis=1) < most) & (score[:, i] > nearest[:, i])
            taken[:, i] = good
            nearest = np.where(good[:, None], np.maximum(nearest, among[:, i]), nearest)
        rank = np.argsort(np.where(taken, 0, np.where(usable, 1, 2)), axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(usable, rank, axis=1), np.take_along_axis(found, rank, axis=1), -1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def beam(self, q: np.ndarray, entry: np.ndarray, k: int, beam: int, there: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``beam`` vectors met on layer k from ``entry`` on, and their scores, best first (-1 where fewer)."""
        n, links, each = len(q), self.links[k], np.arange(len(q))[:, None]
        seen = np.zeros((n, there), bool)
        ids = np.full((n, beam), -1, np.int64)
        score = np.full((n, beam), NONE, np.float32)
        open_ = np.zeros((n, beam), bool)
        pair = np.unique(each * there + entry)
        live = np.arange(n)
        while True:
            if len(pair):
                row, node = pair // there, pair % there
                seen[row, node] = True
                sims = np.einsum("pd,pd->p", q[row], self.x[node])
                touched, counts = np.unique(row, return_counts=True)
                place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                more, more_score = np.full((len(touched), counts.max()), -1, np.int64), np.full((len(touched), counts.max()), NONE, np.float32)
                local = np.repeat(np.arange(len(touched)), counts)
                more[local, place], more_score[local, place] = node, sims
                met = [np.concatenate(z, axis=1) for z in ((ids[touched], more), (score[touched], more_score), (open_[touched], more >= 0))]
                best = np.argpartition(-met[1], beam - 1, axis=1)[:, :beam]
                ids[touched], score[touched], open_[touched] = (np.take_along_axis(z, best, axis=1) for z in met)
            live = live[open_[live].any(axis=1)]
            if not len(live):
                break
            pending = np.where(open_[live], score[live], NONE)
            pick = np.argpartition(-pending, WIDTH - 1, axis=1)[:, :WIDTH] if beam > WIDTH else np.broadcast_to(np.arange(beam), pending.shape)
            chosen = np.where(np.take_along_axis(pending, pick, axis=1) > NONE, np.take_along_axis(ids[live], pick, axis=1), -1)
            rest = open_[live]
            np.put_along_axis(rest, pick, False, axis=1)
            open_[live] = rest
            ahead = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(live), -1)
            rows = np.broadcast_to(live[:, None], ahead.shape)
            ok = (ahead >= 0) & (ahead < there)
            rows, ahead = rows[ok], ahead[ok]
            fresh = ~seen[rows, ahead]
            pair = np.unique(rows[fresh] * there + ahead[fresh])
        order = np.argsort(-score, axis=1)
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(score, order, axis=1)

    def near(self, q: np.ndarray, least: float, beam: int) -> list[np.ndarray]:
        """Places of the vectors found whose cosine with each unit vector reaches ``least``."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
        todo, n = np.arange(len(q)), self.sizes[0]
        while len(todo):
            wide = min(beam, n)
            again = []
            step = max(8, min(TOGETHER * 2, 50_000_000 // max(n, 1)))
            for at in range(0, len(todo), step):
                own = todo[at : at + step]
                x, entry = q[own].astype(np.float32), np.zeros((len(own), 1), np.int64)
                for k in range(len(self.sizes) - 1, 0, -1):
                    entry = self.beam(x, entry, k, 1, self.sizes[k])[0]
                ids, score = self.beam(x, entry, 0, wide, n)
                close = score >= least - 1e-4
                for i, (row, good) in enumerate(zip(ids, close, strict=True)):
                    if good[0]:
                        if good.all() and wide < n:
                            again.append(own[i])
                        else:
                            hit = row[good]
                            out[own[i]] = hit[self.exact[hit] @ q[own[i]] >= least]
            todo, beam = np.array(again, np.int64), beam * 2
        return out

    def scanned(self, q: np.ndarray, least: float) -> list[np.ndarray]:
        """The places by comparing every vector, in blocks."""
        step = max(1, 8_000_000 // max(self.sizes[0], 1))
        return [np.flatnonzero(row) for at in range(0, len(q), step) for row in q[at : at + step] @ self.exact.T >= least]

    def audited(self, q: np.ndarray, least: float, recall: float) -> list[np.ndarray]:
        beam = BEAM
        while True:
            found = self.near(q, least, beam)
            n = np.array([len(f) for f in found])
            good = True
            for own in (n < 2, (n >= 2) & (n < FEW), n >= FEW):  # a vector finds itself in its own shard
                some = np.flatnonzero(own)[:: max(1, int(own.sum()) // (AUDIT // 2))]
                true = (q[some] @ self.exact.T >= least).sum(axis=1)
                good &= not len(some) or float((n[some] / np.maximum(true, n[some]).clip(1))[true > 0].sum()) >= recall * (true > 0).sum()
            if good:
                return found
            if beam >= self.sizes[0]:
                return self.scanned(q, least)  # no beam reaches nodes without links to them
            beam *= 2


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that the squares stay finite
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def find(root: list[int], x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _links(least: float, recall: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        graphs: dict[int, tuple[Graph, np.ndarray, np.ndarray, np.ndarray]] | None = None
        for batch in batches:
            ids, role, copies = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("id", "role", "copies"))
            found = matrix(batch.column(batch.schema.get_field_index("v")))
            for rows, x in found:
                own = role[rows] == 0
                if own.any():
                    held.setdefault(x.shape[1], []).append((_unit(x[own]), ids[rows[own]], copies[rows[own]]))
            if (role == 0).all():
                continue
            if graphs is None:  # all rows of the index have come
                graphs = {}
                for d, parts in held.items():
                    v, i, c = (np.concatenate(z) for z in zip(*parts, strict=True))
                    g = Graph(v)
                    graphs[d] = g, i[g.order], c[g.order], list(range(len(i)))
            for rows, x in found:
                asks = role[rows] == 1
                if not asks.any() or x.shape[1] not in graphs:
                    continue
                g, known, count, root = graphs[x.shape[1]]
                asked = ids[rows[asks]]
                out: list[tuple[int, int, int]] = []
                for q, hit in zip(asked.tolist(), g.audited(_unit(x[asks]), least, recall), strict=True):
                    hit = hit[known[hit] != q]
                    if len(hit):
                        first, n = find(root, int(hit[0])), int(count[hit].sum())
                        out.append((q, n, int(known[hit[0]])))
                        for at in hit.tolist():  # the others only where the forest lacks them
                            if (r := find(root, at)) != first:
                                out.append((q, 0, int(known[at])))
                                root[r] = first
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "n", "b"])

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.95, recall: float = 0.98, key: str = "vec_id", vector: str = "embedding", shards: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    some = valid(vectors, key, vector).filter(F.exists("v", lambda x: x != 0))
    # equal vectors by two hashes, so that only one of them travels, and none in the join below
    some = some.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), F.reverse("v"))})
    alike = materialise(some.groupBy("h", "g").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.any_value("v").alias("v")), "vectors")
    shards = shards or max(SHARDS, -(-alike.count() // SHARD))
    place = F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")
    nodes = alike.select("id", "copies", "v")
    found = materialise(shard_stream(nodes.withColumn("shard", place), nodes, shards, _links(least, recall), "a long, n long, b long"), "links")
    own = some.select("id", "h", "g").join(alike.select("h", "g", F.col("id").alias("first"), "copies"), ["h", "g"]).select("id", "first", (F.col("copies") - 1).alias("n"))
    counts = found.groupBy("a").agg(F.sum("n").alias("more"))
    per = own.join(counts, F.col("first") == F.col("a"), "left").groupBy("id").agg(F.sum(F.col("n") + F.coalesce("more", F.lit(0))).alias("n_links"))
    edges = found.select("a", "b").unionByName(own.select(F.col("id").alias("a"), F.col("first").alias("b")))
    root = components(edges).withColumnsRenamed({"node": "id", "root": "component_id"})
    rows = vectors.select(F.col(key).cast("long").alias("id")).join(per, "id", "left").join(root, "id", "left")
    component = F.coalesce("component_id", "id")
    return rows.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
