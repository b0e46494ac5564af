"""Raster drawings: binarising, gap closing, thinning, crossing numbers, key pixels, traces. One image a row, numpy inside."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.operators.geometry import grid_1d, simplify
from sparkwright.operators.workbench import build_graph

AROUND = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))  # rows and columns, clockwise from above


def binarise(image: np.ndarray, light: int = 200, dark: int = 50) -> np.ndarray:
    """0 and 1: dark strokes on light paper (mean above 127), or light strokes on dark."""
    grey = image.mean(axis=2) if image.ndim == 3 else image
    return ((grey < light) if grey.mean() > 127 else (grey > dark)).astype(np.uint8)


def _slide(image: np.ndarray, size: int, axis: int, keep) -> np.ndarray:
    pad = [(size // 2, size // 2) if a == axis else (0, 0) for a in (0, 1)]
    wide = np.pad(image, pad, constant_values=0 if keep is np.max else 1)
    return keep(np.lib.stride_tricks.sliding_window_view(wide, size, axis=axis), axis=-1)


def close_gaps(image: np.ndarray, size: int = 5) -> np.ndarray:
    """Gaps of up to ``size`` pixels along rows and columns closed."""
    out = image
    for axis in (0, 1):
        out = out | _slide(_slide(image, size, axis, np.max), size, axis, np.min)
    return out


def bridge_lines(image: np.ndarray, most: int = 10) -> np.ndarray:
    """Ends of thinned lines that face each other across a gap of up to ``most`` pixels joined by a straight line.

    Two ends face each other if the gap goes on, within 30 degrees, from the last steps of both lines. Near ones are joined first,
    each end once. (A voting transform for lines joins others by chance; this one gives the same result each time.)
    """
    image = (image > 0).astype(np.uint8)
    skeleton = thin(image)
    ends = [tuple(p) for p in np.argwhere(crossings(skeleton) == 1).tolist()]
    away = {}
    for end in ends:
        path, seen = [end], {end}
        while len(path) < 6 and (ahead := [q for r, c in AROUND if (q := (path[-1][0] + r, path[-1][1] + c)) not in seen and 0 <= q[0] < image.shape[0] and 0 <= q[1] < image.shape[1] and skeleton[q]]):
            path.append(ahead[0])
            seen.add(ahead[0])
        d = np.subtract(end, path[-1])
        away[end] = d / max(float(np.hypot(*d)), 1e-9)
    pairs = sorted((float(np.hypot(a[0] - b[0], a[1] - b[1])), a, b) for i, a in enumerate(ends) for b in ends[i + 1 :] if max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= most + 1)
    used, out = set(), image.copy()
    for size, a, b in pairs:
        step = np.subtract(b, a) / max(size, 1e-9)
        if a not in used and b not in used and step @ away[a] >= 0.866 and -step @ away[b] >= 0.866:
            used |= {a, b}
            for t in np.linspace(0, 1, int(np.ceil(size)) * 2 + 1):
                y, x = np.rint(np.add(a, t * np.subtract(b, a))).astype(int)
                out[y, x] = 1
    return out


def neighbours(image: np.ndarray) -> np.ndarray:
    """The eight neighbours of each pixel, clockwise from above; 0 outside."""
    p = np.pad(image, 1)
    h, w = image.shape
    return np.stack([p[1 + r : 1 + r + h, 1 + c : 1 + c + w] for r, c in AROUND])


def thin(image: np.ndarray, wrap: bool = False) -> np.ndarray:
    """Zhang-Suen thinning until nothing changes. ``wrap`` takes neighbours across the edges."""
    image = image.astype(np.uint8).copy()
    while True:
        before = image.sum()
        for odd in (0, 1):
            n = np.stack([np.roll(image, (-r, -c), (0, 1)) for r, c in AROUND]) if wrap else neighbours(image)
            total = n.sum(axis=0)
            turns = ((n == 0) & (np.roll(n, -1, axis=0) == 1)).sum(axis=0)
            a, b = (n[0] * n[2] * n[6], n[0] * n[4] * n[6]) if odd else (n[0] * n[2] * n[4], n[2] * n[4] * n[6])
            image[(image == 1) & (total >= 2) & (total <= 6) & (turns == 1) & (a == 0) & (b == 0)] = 0
        if image.sum() == before:
            return image


def crossings(image: np.ndarray) -> np.ndarray:
    """Changes from 0 to 1 around each skeleton pixel: 1 ends a line, 3 or more join lines."""
    n = neighbours(image)
    return ((n == 0) & (np.roll(n, -1, axis=0) == 1)).sum(axis=0) * image


def apart(points: list[tuple[int, int]], others: list[tuple[int, int]] = (), near: int = 8) -> list[tuple[int, int]]:
    """Points (y, x) in order, without those within ``near`` (greater of both distances) of one kept before or of ``others``."""
    out: list[tuple[int, int]] = []
    for p in sorted(points):
        if all(max(abs(p[0] - q[0]), abs(p[1] - q[1])) > near for q in [*out, *others]):
            out.append(p)
    return out


def key_pixels(skeleton: np.ndarray, near: int = 8) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(junctions, endpoints), thinned out."""
    c = crossings(skeleton)
    joints = apart([tuple(p) for p in np.argwhere(c >= 3).tolist()], near=near)
    return joints, apart([tuple(p) for p in np.argwhere(c == 1).tolist()], joints, near)


def trace(skeleton: np.ndarray, epsilon: float = 1.5, least: float = 5.0) -> list[list[tuple[float, float]]]:
    """Branches (x, y) between key pixels over the 8-connected skeleton, and closed loops, simplified; short ones are left out."""
    c = crossings(skeleton)
    keys = {tuple(p) for p in np.argwhere((c == 1) | (c >= 3)).tolist()}
    on = {tuple(p) for p in np.argwhere(skeleton > 0).tolist()}
    steps = lambda p: [q for r, s in AROUND if (q := (p[0] + r, p[1] + s)) in on]
    used: set[frozenset] = set()
    lines = []

    def walk(a: tuple[int, int], b: tuple[int, int]) -> list[tuple[int, int]]:
        line = [a, b]
        used.add(frozenset((a, b)))
        while line[-1] not in keys and line[-1] != a:
            ahead = [q for q in steps(line[-1]) if q != line[-2] and frozenset((line[-1], q)) not in used and (q not in line or q == a)]
            if not ahead:
                break
            ahead.sort(key=lambda q: (q not in keys, abs(q[0] - line[-1][0]) + abs(q[1] - line[-1][1]), q))
            used.add(frozenset((line[-1], ahead[0])))
            line.append(ahead[0])
        return line

    for k in sorted(keys):
        for q in steps(k):
            if frozenset((k, q)) not in used:
                lines.append(walk(k, q))
    met = {p for line in lines for p in line}
    for p in sorted(on - met):
        if p not in met and steps(p):
            lines.append(walk(p, steps(p)[0]))
            met |= set(lines[-1])
    out = []
    for line in lines:
        size = sum(float(np.hypot(a[0] - b[0], a[1] - b[1])) for a, b in zip(line, line[1:], strict=False))
        if size >= least:
            out.append(simplify([(x, y) for y, x in line], epsilon))
    return out


def images(rows: DataFrame) -> DataFrame:
    """(img_id, kind, x, y): key pixels of every image (img_id, width, height, pixels BINARY grey) after binarising, closing and thinning."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                grey = _grey(r)
                joints, ends = key_pixels(thin(close_gaps(binarise(grey)))) if grey.min() != grey.max() else ([], [])
                found = [("junction", x, y) for y, x in joints] + [("endpoint", x, y) for y, x in ends]
                yield pd.DataFrame([(r.img_id, *f) for f in found], columns=["img_id", "kind", "x", "y"])

    return rows.mapInPandas(run, f"img_id {dict(rows.dtypes)['img_id']}, kind string, x int, y int")


def _grey(row) -> np.ndarray:
    return np.frombuffer(row.pixels, np.uint8).reshape(row.height, row.width)


def patches(rows: DataFrame, tile: int = 1024, overlap: int = 128, mode: str = "shift") -> DataFrame:
    """(img_id, patch_id, x1, y1, width, height, pixels) of every image (img_id, width, height, pixels) cut by ``geometry.tiles``; 0 beyond the edges with mode ``pad``.

    The tiles are told in SQL, and a task cuts the patches of its images one after another.
    """
    grid = [F.transform(grid_1d(F.col(side), tile, overlap, mode), lambda t: F.struct(t["start"].cast("int").alias("start"), t["end"].cast("int").alias("end"))).alias(name) for side, name in (("width", "xs"), ("height", "ys"))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                grey, found = _grey(r), []
                for j, y in enumerate(r.ys):
                    for i, x in enumerate(r.xs):
                        cut = np.zeros((y["end"] - y["start"], x["end"] - x["start"]), np.uint8)
                        part = grey[y["start"] : y["end"], x["start"] : x["end"]]
                        cut[: part.shape[0], : part.shape[1]] = part
                        found.append((r.img_id, j * len(r.xs) + i, x["start"], y["start"], cut.shape[1], cut.shape[0], cut.tobytes()))
                yield pd.DataFrame(found, columns=["img_id", "patch_id", "x1", "y1", "width", "height", "pixels"])

    told = rows.select("img_id", "width", "height", "pixels", *grid)
    return told.mapInPandas(run, f"img_id {dict(rows.dtypes)['img_id']}, patch_id int, x1 int, y1 int, width int, height int, pixels binary")


def traces(rows: DataFrame, epsilon: float = 1.5, least: float = 5.0) -> DataFrame:
    """(img_id, run_id, points ARRAY<STRUCT<x, y>>, reverse): the simplified lines of every image (img_id, width, height, pixels), as runs for ``workbench.build_graph``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for r in batch.itertuples(index=False):
                grey = _grey(r)
                lines = trace(thin(bridge_lines(close_gaps(binarise(grey)))), epsilon, least) if grey.min() != grey.max() else []
                found += [(r.img_id, i, [{"x": float(x), "y": float(y)} for x, y in line], False) for i, line in enumerate(lines)]
            yield pd.DataFrame(found, columns=["img_id", "run_id", "points", "reverse"])

    return rows.mapInPandas(run, f"img_id {dict(rows.dtypes)['img_id']}, run_id int, points array<struct<x:double,y:double>>, reverse boolean")


def image_graph(rows: DataFrame, symbols: DataFrame, radius: float = 40.0) -> DataFrame:
    """(img_id, run_id, src, dst, length) of images: their traced lines as edges between the symbols (img_id, node_id, sub_type, x, y) that they end at."""
    runs = traces(rows).withColumnRenamed("img_id", "drawing_id")
    return build_graph(symbols.withColumnRenamed("img_id", "drawing_id"), runs, radius).withColumnRenamed("drawing_id", "img_id")


def simplified(lines: DataFrame, epsilon: float = 1.5) -> DataFrame:
    """Lines (with points ARRAY<STRUCT<x, y>>) by Douglas-Peucker, the other columns as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["points"] = [[{"x": float(x), "y": float(y)} for x, y in simplify([(p["x"], p["y"]) for p in points], epsilon)] for points in batch["points"]]
            yield batch

    return lines.mapInPandas(run, lines.schema)


def spread(points: DataFrame, near: int = 8) -> DataFrame:
    """(img_id, x, y) of points thinned out image by image, from the upper left: none within ``near`` of one kept before."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        kept = apart(list(zip(frame["y"].tolist(), frame["x"].tolist(), strict=True)), near=near)
        return pd.DataFrame([(frame["img_id"].iloc[0], x, y) for y, x in kept], columns=["img_id", "x", "y"])

    return points.select("img_id", "x", "y").groupBy("img_id").applyInPandas(one, points.select("img_id", "x", "y").schema)


def crossing_rows(pixels: DataFrame) -> DataFrame:
    """Crossing numbers of sparse skeleton pixels (img_id, x, y), by one aggregation of the eight shifted copies; no self-join.

    Every pixel tells each neighbour which of its eight places it fills; a place pattern of eight bits gives the number.
    """
    places = F.array(*[F.struct(F.lit(-c).alias("dx"), F.lit(-r).alias("dy"), F.lit(1 << i).alias("bit")) for i, (r, c) in enumerate(AROUND)])
    told = pixels.select("img_id", "x", "y", F.inline(places)).select("img_id", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "bit", F.lit(0).alias("own"))
    own = pixels.select("img_id", "x", "y", F.lit(0).alias("bit"), F.lit(1).alias("own"))
    held = told.unionByName(own).groupBy("img_id", "x", "y").agg(F.bit_or("bit").alias("around"), F.max("own").alias("own")).filter("own = 1")
    return held.select("img_id", "x", "y", turns(F.col("around")).alias("crossing"))


def turns(around: Column) -> Column:
    """Changes from 0 to 1 along the eight bits, the last followed by the first."""
    nexts = F.shiftright(around, 1).bitwiseOR(F.shiftleft(around.bitwiseAND(F.lit(1)), 7))
    return F.bit_count(F.bitwise_not(around).bitwiseAND(nexts).bitwiseAND(F.lit(255)))
