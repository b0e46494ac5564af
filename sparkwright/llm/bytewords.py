"""Words and word shingles of many texts at once, as 64-bit hashes computed by numpy on Arrow's UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes for one step of the work on bytes, which needs some tens of bytes of memory for each.
STEP = 1 << 20
U = np.uint64
_POWERS = np.power(U(0x9E3779B97F4A7C15), np.arange(64, dtype=np.uint64))

#: The white space of the contracts: space and the controls from tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
#: Lower case for A to Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def parts(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts together have about ``most`` bytes, at least one row each."""
    sizes = np.diff(buffers(batch.column(column))[1])
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most)))
        yield batch.slice(start, stop - start)
        start = stop


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of a string array without nulls."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset :][: len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = LOWER, spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the row bounds among them. ``fold`` maps bytes, ``spaces`` marks those between words."""
    gap = spaces[data]
    hashes, begins, start = [], [], 0
    ends_of_rows = offsets[1:]
    while start < len(data):
        stop = start + STEP
        if stop < len(data):  # on to the next end of a word or of a row
            row = int(ends_of_rows[np.searchsorted(ends_of_rows, stop)])
            at = start + STEP
            while at < row and not (block := gap[at : min(at + STEP, row)]).any():
                at += len(block)
            stop = at + int(np.argmax(gap[at:row])) if at < row else row
        stop = min(stop, len(data))
        inside = ~gap[start:stop]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        rows = offsets[np.searchsorted(offsets, start) : np.searchsorted(offsets, stop)] - start
        first[rows] = inside[rows]
        at = np.flatnonzero(first)
        if len(at):
            where = np.flatnonzero(inside)
            word = np.cumsum(first[where]) - 1
            place = where - at[word]
            power = _POWERS[place & 63]
            far = place > 63
            power[far] = mix(power[far] + (place[far] >> 6).astype(np.uint64)) | U(1)
            terms = (fold[data[start:stop][where]].astype(np.uint64) + U(1)) * power
            hashes.append(mix(np.add.reduceat(terms, np.searchsorted(where, at))))
            begins.append(at + start)
        start = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), offsets)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; k less than their number is left to the caller. Runs may cross rows."""
    n = len(hashes) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        out = mix(out * U(0xD6E8FEB86659FD93) + hashes[i : i + n])
    return out


def shingle_sets(texts: pa.Array, k: int, fold: np.ndarray = LOWER, spaces: np.ndarray = SPACES) -> list[np.ndarray]:
    """The distinct shingles of every text, ascending. With fewer than k words the whole sequence is one; without words, none."""
    found, rows = words(*buffers(texts), fold, spaces)
    runs = shingles(found, k)
    out = []
    for a, b in zip(rows.tolist(), rows[1:].tolist(), strict=False):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        else:
            out.append(mix(shingles(found[a:b], b - a) + U(b - a)) if b > a else np.zeros(0, np.uint64))
    return out
