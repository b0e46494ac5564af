"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is cut where a space follows another character, since no piece of the vocabulary joins the two (checked when the
model is loaded; else whole texts are single units). Each unit is a row of symbols; an agenda of adjacent pairs, ordered
by score and then by place, says which pair merges next. Long units keep the agenda as a heap over linked symbols; the
short ones of a batch are worked off together, each with its agenda as a run of one array, one merge of every unit at a
time. Symbols outside the vocabulary become byte pieces.

Units repeat, so each worker keeps the ids of those it has met, within a bound. Whenever units are new to a batch, the
sentencepiece library encodes them too, and a difference raises. Decoding is the library's own.

Defined cases: null and empty texts encode to the begin and end ids alone and decode to an empty text; repeated rows
give repeated rows; no length is cut; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Most units that a worker remembers, and the longest that it does.
REMEMBERED, LONGEST = 600_000, 40
#: Units of this length and more use the heap; it is below 64, the room for a place in an agenda's entry.
HEAP_FROM = 48
#: Characters of text for one call of the library's decoder.
SLICE = 400_000


class Merger:
    """The merge rules of one model file."""

    def __init__(self, model_file: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = lib.get_piece_size()
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(n)]
        self.ids = {lib.id_to_piece(i): i for i in range(n) if not special[i]}
        self.rank = {p: -lib.get_score(i) for p, i in self.ids.items() if len(p) > 1}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not lib.is_byte(i) for i in self.bytes):
            raise ValueError("the vocabulary has no byte pieces")
        if lib.encode("a  b ") != lib.encode(f"a{SPACE}{SPACE}b{SPACE}") or lib.encode("Ａ") == lib.encode("A"):
            raise ValueError("only models that keep spaces and do not normalise are supported")
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        joins = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.units = (lambda t: [t]) if joins else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.known: dict[str, bytes] = {}
        self._tables()

    def _tables(self) -> None:
        """Arrays for the merging of many units: the piece of each character, and each mergeable pair's piece by hashing."""
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        pairs = [(self.ids[p[:k]] << 32 | self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        order = np.array(sorted(self.rank[p] for p in self.rank))
        self.agenda = np.zeros(len(self.char), np.int64)  # of each piece its place by score, from 1
        for p, r in self.rank.items():
            self.agenda[self.ids[p]] = 1 + np.searchsorted(order, r)
        self.bits = max(8, (8 * len(pairs)).bit_length())
        self.slot_pair, self.slot_piece = np.full((1 << self.bits) + 64, -1, np.int64), np.zeros((1 << self.bits) + 64, np.int64)
        self.probes = 1
        for pair, piece in pairs:
            h = int(self._hash(np.array([pair], np.int64))[0])
            n = next(n for n in range(64) if self.slot_pair[h + n] < 0)
            self.slot_pair[h + n], self.slot_piece[h + n] = pair, piece
            self.probes = max(self.probes, n + 1)

    def _hash(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or 0."""
        pair = a.astype(np.int64) << 32 | b
        out, at = np.zeros(len(a), np.int64), self._hash(pair)
        for n in range(self.probes):
            hit = self.slot_pair[at + n] == pair
            out[hit] = self.slot_piece[at + n][hit]
        return out

    def _many(self, units: list[str]) -> list[bytes]:
        """Ids of short units, all of whose characters are pieces."""
        none = np.int64(1) << 62
        sizes = np.array([len(u) for u in units])
        starts = np.concatenate(([0], np.cumsum(sizes)))
        n = int(starts[-1])
        sym = self.char[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)].astype(np.int64)
        owner = np.repeat(np.arange(len(units)), sizes)
        place = np.arange(n) - starts[owner]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.zeros(n + 1, bool)
        last[starts[1:] - 1] = True
        piece = np.zeros(n, np.int64)  # made by the pair that starts here
        piece[:-1] = self._merged(sym[:-1], sym[1:])
        piece[last[:n]] = 0
        entry = np.where(piece > 0, self.agenda[piece] << 6 | place, none)
        alive = np.ones(n, bool)
        live = np.arange(len(units))
        cut = starts[:-1]
        view, where = entry, None  # the agenda's part that is still worked on
        while len(live):
            best = np.minimum.reduceat(view if where is None else entry[where], cut)
            todo = best < none
            if todo.sum() < 0.5 * len(live):
                live = live[todo]
                best = best[todo]
                where = np.flatnonzero(np.isin(owner, live)) if len(live) else np.zeros(0, np.int64)
                cut = np.concatenate(([0], np.cumsum(sizes[live])[:-1])) if len(live) else cut
                if not len(live):
                    break
                units_now = live
            else:
                units_now, best = live[todo], best[todo]
            i = starts[units_now] + (best & 63)
            j = after[i]
            sym[i] = piece[i]
            alive[j], entry[j], piece[j] = False, none, 0
            ended = last[j]
            last[i] |= ended
            after[i] = after[j]
            inner = ~ended
            before[after[i[inner]]] = i[inner]
            left = before[i]
            has = (i > starts[units_now])
            for x, y in ((i[inner], after[i[inner]]), (left[has], i[has])):
                made = self._merged(sym[x], sym[y])
                piece[x] = made
                entry[x] = np.where(made > 0, self.agenda[made] << 6 | place[x], none)
            piece[i[ended]], entry[i[ended]] = 0, none
        ids = sym[alive].astype("<u4").tobytes()
        ends = np.concatenate(([0], np.cumsum(np.add.reduceat(alive, starts[:-1], dtype=np.int64) * 4))).tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def _long(self, unit: str) -> list[str]:
        rank = self.rank.get
        s: list[str | None] = list(unit)
        n = len(s)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(r, i, i + 1, 2) for i in range(n - 1) if (r := rank(unit[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            a, b = s[i], s[j] if j < n else None
            if a is None or b is None or after[i] != j or len(a) + len(b) != size:
                continue  # one of the two has merged meanwhile
            s[i], s[j] = a + b, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank(s[x] + s[y])) is not None:
                    heapq.heappush(agenda, (r, x, y, len(s[x]) + len(s[y])))
        return [x for x in s if x is not None]

    def encode_unit(self, unit: str) -> list[int]:
        out: list[int] = []
        for p in self._long(unit):
            i = self.ids.get(p)
            out += [i] if i is not None else [self.bytes[b] for b in p.encode()]
        return out

    def learn(self, units: list[str], check: bool) -> dict[str, bytes]:
        """The ids of new units, and the library's opinion on them."""
        text = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(u) for u in units])
        whole = np.minimum.reduceat(self.char[text], np.concatenate(([0], np.cumsum(sizes)[:-1]))) >= 0
        short = [u for u, ok in zip(units, (whole & (sizes < HEAP_FROM)).tolist(), strict=True) if ok]
        found = dict(zip(short, self._many(short), strict=True)) if short else {}
        found |= {u: array("I", self.encode_unit(u)).tobytes() for u in units if u not in found}
        if check:
            plain = [u for u in found if u[0] == SPACE and len(u) > 1]  # the library puts a space before each
            for u, ids in zip(plain, self.library.encode([u[1:] for u in plain], num_threads=1), strict=True):
                if array("I", ids).tobytes() != found[u]:
                    raise AssertionError(f"the library encodes {u!r} differently")
        return found

    def encode_batch(self, texts: list[str], check: bool = True) -> list[bytes]:
        """Ids of each text with begin and end, as little-endian unsigned 32-bit integers."""
        cut = [self.units(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = set().union(*cut).difference(self.known)
        if new:
            self.known.update(self.learn(list(new), check))
        get, head, tail = self.known.__getitem__, array("I", [self.begin]).tobytes(), array("I", [self.end]).tobytes()
        out = [b"".join([head, *map(get, us), tail]) for us in cut]
        for u in new:
            if len(u) > LONGEST:
                del self.known[u]
        return out


@lru_cache(maxsize=2)
def merger(model_file: str) -> Merger:
    return Merger(model_file)


def next_slice(values: pa.Array, start: int) -> list[str]:
    """The texts from ``start`` on that fill one slice, at least one."""
    ends = np.frombuffer(values.buffers()[1], np.int64 if pa.types.is_large_string(values.type) else np.int32)[values.offset :][: len(values) + 1]
    stop = max(start + 1, int(np.searchsorted(ends, ends[start] + SLICE)))
    return values.slice(start, stop - start).to_pylist()


def encode_decode(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", check: bool = True, keep: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of every text; ``keep`` adds ids (array of int) and decoded (string)."""
    kind = docs.schema[key].dataType.simpleString()
    more = ", ids array<int>, decoded string" if keep else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(model_file)
        for batch in batches:
            start = 0
            values = batch.column(1)
            while start < batch.num_rows:
                part = next_slice(values, start)
                ids = m.encode_batch(part, check)
                lists = [np.frombuffer(x, np.uint32).tolist() for x in ids]
                decoded = m.library.decode(lists, num_threads=1)
                out = [
                    batch.column(0).slice(start, len(part)),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                ]
                out += [pa.array(lists, pa.list_(pa.int32())), pa.array(decoded, pa.string())] if keep else []
                yield pa.RecordBatch.from_arrays(out, ["key", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(out)])
                start += len(part)

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = rows.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
    return out.withColumnRenamed("key", key)

