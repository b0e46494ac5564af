"""2-D geometry over drawings: tiles, boxes, overlap pairs, suppression, clusters, stitching, snapping, simplification.

Pairs are found through grid cells and an equi-join. The greedy operators work on one drawing and label at a time, since
every choice depends on those before; their groups are bounded by what one drawing holds.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NMS, NEAR, SNAP, MERGE = 0.5, 15.0, 35.0, 8


def grid_1d(dim: Column, tile: int, overlap: int, mode: str = "shift") -> Column:
    """ARRAY of STRUCT(start, end): tiles of a length; the last one is shifted back, clipped or padded."""
    if overlap >= tile:
        raise ValueError("the overlap is smaller than the tile")
    step = tile - overlap
    n = F.greatest(F.ceil((dim - overlap) / F.lit(step)), F.lit(1))
    starts = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: i * step)
    if mode == "shift":
        starts = F.array_sort(F.array_distinct(F.transform(starts, lambda s: F.greatest(F.least(s, dim - tile), F.lit(0)))))
    end = (lambda s: s + tile) if mode == "pad" else (lambda s: F.least(s + tile, dim))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), end(s).alias("end")))


def tiles(drawings: DataFrame, tile: int = 1024, overlap: int = 128, mode: str = "shift") -> DataFrame:
    """(img_id, patch_id, x1, y1, x2, y2, name) row by row; drawings: img_id, width, height."""
    rows = drawings.select("img_id", grid_1d(F.col("width"), tile, overlap, mode).alias("xs"), F.posexplode(grid_1d(F.col("height"), tile, overlap, mode)).alias("row", "y"))
    rows = rows.select("img_id", "row", "y", F.size("xs").alias("n"), F.posexplode("xs").alias("col", "x"))
    patch = (F.col("row") * F.col("n") + F.col("col")).alias("patch_id")
    rows = rows.select("img_id", patch, F.col("x.start").alias("x1"), F.col("y.start").alias("y1"), F.col("x.end").alias("x2"), F.col("y.end").alias("y2"))
    return rows.withColumn("name", F.format_string("tile_%d_%d_%d", "patch_id", "x1", "y1"))


def to_patch(box: tuple[str, ...], patch: tuple[str, ...], clip: bool = False) -> Column:
    """STRUCT of a global box in the patch's coordinates; without ``clip`` null unless the patch contains it, with it null if they miss."""
    x1, y1, x2, y2 = (F.col(c) for c in box)
    a1, b1, a2, b2 = (F.col(c) for c in patch)
    low_x, low_y, high_x, high_y = F.greatest(x1, a1), F.greatest(y1, b1), F.least(x2, a2), F.least(y2, b2)
    ok = (low_x < high_x) & (low_y < high_y) if clip else (x1 >= a1) & (y1 >= b1) & (x2 <= a2) & (y2 <= b2)
    return F.when(ok, F.struct((low_x - a1).alias("x1"), (low_y - b1).alias("y1"), (high_x - a1).alias("x2"), (high_y - b1).alias("y2")))


def to_drawing(box: tuple[str, ...], patch: tuple[str, ...]) -> Column:
    """STRUCT of a patch's box in the drawing's coordinates; patch: its left and upper edge."""
    (x1, y1, x2, y2), (a, b) = (F.col(c) for c in box), (F.col(c) for c in patch[:2])
    return F.struct((x1 + a).alias("x1"), (y1 + b).alias("y1"), (x2 + a).alias("x2"), (y2 + b).alias("y2"))


def point_to_patch(x: Column, y: Column, patch: tuple[str, ...], clip: bool = False) -> Column:
    """STRUCT(x, y) of a drawing's point in a patch (left, top, right, bottom): null outside, or with ``clip`` the nearest pixel."""
    a1, b1, a2, b2 = (F.col(c) for c in patch)
    inside = (x >= a1) & (x < a2) & (y >= b1) & (y < b2)
    near = lambda v, low, high: F.greatest(F.lit(0.0), F.least((high - low - 1).cast("double"), (v - low).cast("double")))
    kept = F.struct((x - a1).cast("double").alias("x"), (y - b1).cast("double").alias("y"))
    return F.when(inside, kept).otherwise(F.struct(near(x, a1, a2).alias("x"), near(y, b1, b2).alias("y")) if clip else F.lit(None))


def mask_centroid(pixels: DataFrame, keys: tuple[str, ...] = ("img_id",)) -> DataFrame:
    """(keys, x, y) of masks (keys, x, y, value): the mean place of the pixels above 0, null where there is none."""
    on = F.col("value") > 0
    return pixels.groupBy(*keys).agg(F.avg(F.when(on, F.col("x"))).alias("x"), F.avg(F.when(on, F.col("y"))).alias("y"))


def tent(place: Column, size: Column, overlap: int) -> Column:
    """Weight of a pixel at a place in a patch's row or column: it falls towards the edges within the overlap, and is 1 between."""
    edge = F.least(place + 1, size - place) / F.lit(float(max(overlap, 1)))
    return F.least(F.lit(1.0), edge)


def centroid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(((x1 + x2) / 2).alias("x"), ((y1 + y2) / 2).alias("y"))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 where the union is empty."""
    wide = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    high = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda r: F.greatest(r[2] - r[0], F.lit(0.0)) * F.greatest(r[3] - r[1], F.lit(0.0))
    both = wide * high
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def overlapping(boxes: DataFrame, least: float = NMS, cell: float = 64.0) -> DataFrame:
    """(img_id, label, a, b, iou) of box pairs a < b of a drawing and label; boxes: img_id, label, box_id, x1, y1, x2, y2.

    Boxes meet in the cells they touch; a pair counts only in the cell where its intersection starts, so it comes once.
    """
    at = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    held = boxes.withColumn("cx", F.explode(at("x1", "x2"))).withColumn("cy", F.explode(at("y1", "y2")))
    other = held.select("img_id", "label", "cx", "cy", *[F.col(c).alias(f"b_{c}") for c in ("box_id", "x1", "y1", "x2", "y2")])
    pairs = held.join(other, ["img_id", "label", "cx", "cy"]).filter("box_id < b_box_id")
    first = (F.col("cx") == F.floor(F.greatest("x1", "b_x1") / cell)) & (F.col("cy") == F.floor(F.greatest("y1", "b_y1") / cell))
    value = iou(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), tuple(F.col(f"b_{c}") for c in ("x1", "y1", "x2", "y2")))
    return pairs.filter(first).select("img_id", "label", F.col("box_id").alias("a"), F.col("b_box_id").alias("b"), value.alias("iou")).filter(F.col("iou") >= least)


def _iou_rows(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    wide = np.clip(np.minimum(box[2], others[:, 2]) - np.maximum(box[0], others[:, 0]), 0, None)
    high = np.clip(np.minimum(box[3], others[:, 3]) - np.maximum(box[1], others[:, 1]), 0, None)
    area = lambda r: np.clip(r[..., 2] - r[..., 0], 0, None) * np.clip(r[..., 3] - r[..., 1], 0, None)
    union = area(box) + area(others) - wide * high
    return np.divide(wide * high, union, out=np.zeros(len(others)), where=union > 0)


def suppress(boxes: DataFrame, least: float = NMS) -> DataFrame:
    """Greedy suppression in each drawing and label: the surest box stays, boxes that overlap it go, the longest text is kept.

    boxes: img_id, label, box_id, x1, y1, x2, y2, confidence, text.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["confidence", "box_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        box, left, keep, texts = g[["x1", "y1", "x2", "y2"]].to_numpy(float), np.ones(len(g), bool), [], []
        for i in range(len(g)):
            if left[i]:
                same = left & (_iou_rows(box[i], box) >= least)
                same[i] = True
                left &= ~same
                texts.append(max(g["text"][same].fillna(""), key=len))
                keep.append(i)
        return g.iloc[keep].assign(text=texts)

    return boxes.groupBy("img_id", "label").applyInPandas(run, boxes.schema)


def cluster(points: DataFrame, near: float = NEAR) -> DataFrame:
    """Greedy clusters in each drawing and label: an anchor takes all free points within ``near``; centres are weighted by confidence.

    points: img_id, label, point_id, x, y, confidence, in order of point_id.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("point_id").reset_index(drop=True)
        x, y, w, free, out = g["x"].to_numpy(), g["y"].to_numpy(), g["confidence"].to_numpy(), np.ones(len(g), bool), []
        for i in range(len(g)):
            if free[i]:
                own = free & (np.hypot(x - x[i], y - y[i]) <= near)
                free &= ~own
                total = w[own].sum()
                cx, cy = ((x[own] * w[own]).sum() / total, (y[own] * w[own]).sum() / total) if total > 0 else (x[own].mean(), y[own].mean())
                out.append((g["img_id"][0], g["label"][0], int(g["point_id"][i]), float(cx), float(cy), float(w[own].max()), int(own.sum())))
        return pd.DataFrame(out, columns=["img_id", "label", "anchor_id", "x", "y", "confidence", "merged_count"])

    kinds = dict(points.dtypes)
    return points.groupBy("img_id", "label").applyInPandas(run, f"img_id {kinds['img_id']}, label {kinds['label']}, anchor_id long, x double, y double, confidence double, merged_count int")


def stitch_lines(lines: list[list[tuple[float, float]]], near: float = NEAR) -> list[list[tuple[float, float]]]:
    """Polylines joined end to end while two ends are within ``near``, in any of the four ways; repeated points go.

    A line takes the first of the lines behind it that one of its ends meets, again and again; the next line that is left
    follows. Those behind are still whole, so their ends stay in cells, in order, until they are taken.
    Ends that are not finite meet nothing.
    """
    lines = [list(map(tuple, p)) for p in lines if p]
    gap = lambda a, b: math.hypot(a[0] - b[0], a[1] - b[1])
    size = 1.25 * near if near > 0 else 1.0  # no rounding puts two ends that meet into cells that do not touch
    cell = lambda p: (math.floor(p[0] / size), math.floor(p[1] / size)) if math.isfinite(p[0]) and math.isfinite(p[1]) else None
    held: dict[tuple[int, int], dict[int, None]] = {}
    ends = [{c for c in (cell(p[0]), cell(p[-1])) if c} for p in lines]
    for k, cells in enumerate(ends):
        for c in cells:
            held.setdefault(c, {})[k] = None

    def take(k: int) -> None:
        left[k] = False
        for c in ends[k]:
            del held[c][k]
            if not held[c]:
                del held[c]

    def first(p: tuple[float, float], best: int) -> int:
        """The first line left that has an end near p, if it comes before ``best``."""
        if at := cell(p):
            for dx in (0, -1, 1):
                for dy in (0, -1, 1):
                    for k in held.get((at[0] + dx, at[1] + dy), ()):
                        if k >= best:
                            break
                        if gap(p, lines[k][0]) <= near or gap(p, lines[k][-1]) <= near:
                            best = k
                            break
        return best

    left, out = [True] * len(lines), []
    for i in range(len(lines)):
        if not left[i]:
            continue
        take(i)
        line, turned = deque(lines[i]), False  # turned: the line runs from the right end to the left one
        met: dict[tuple[float, float], int] = {}  # the first line that an end meets, until it is taken
        while True:
            head, tail = (line[-1], line[0]) if turned else (line[0], line[-1])
            for p in (head, tail):
                if p not in met or met[p] < len(lines) and not left[met[p]]:
                    met[p] = first(p, len(lines))
            j = min(met[head], met[tail])
            if j == len(lines):
                break
            take(j)
            b = lines[j]
            gaps = [gap(tail, b[0]), gap(tail, b[-1]), gap(head, b[0]), gap(head, b[-1])]
            way = min(range(4), key=lambda w: gaps[w] if gaps[w] == gaps[w] else math.inf)
            turned ^= way == 2  # the line's other end comes first from here on
            new = b[::-1] if way == 1 else b
            if way == 3:
                (line.extend if turned else line.extendleft)(reversed(new))
            else:
                (line.extendleft if turned else line.extend)(new)
            met = {p: met[p] for p in (head, tail)}
        out.append(list(reversed(line)) if turned else list(line))
    return [[p for k, p in enumerate(line) if not k or not gap(p, line[k - 1]) <= 1e-4] for line in out]


def stitch(lines: DataFrame, near: float = NEAR) -> DataFrame:
    """(img_id, line_no, points) of the stitched lines of each drawing; lines: img_id, line_id, points ARRAY<STRUCT<x, y>>.

    Lines without points go; a missing coordinate meets nothing.
    """
    known = lambda v: math.nan if v is None else v

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("line_id")
        out = stitch_lines([[(known(p["x"]), known(p["y"])) for p in points] if points is not None else [] for points in g["points"]], near)
        return pd.DataFrame([(g["img_id"].iloc[0], i, [{"x": float(x), "y": float(y)} for x, y in p]) for i, p in enumerate(out)], columns=["img_id", "line_no", "points"])

    return lines.groupBy("img_id").applyInPandas(run, f"img_id {dict(lines.dtypes)['img_id']}, line_no int, points array<struct<x:double,y:double>>")


def path_length(points: str) -> Column:
    return F.expr(f"aggregate(sequence(1, greatest(size({points}) - 1, 0)), 0D, (a, i) -> a + CASE WHEN i < size({points}) THEN hypot({points}[i].x - {points}[i - 1].x, {points}[i].y - {points}[i - 1].y) ELSE 0D END)")


def snap(points: DataFrame, nodes: DataFrame, radius: float = SNAP) -> DataFrame:
    """(img_id, point_id, x, y, node_id, distance): the nearest node within ``radius``, ties to the smaller id; without one the point itself.

    Both sides are put into cells of the radius; a point looks into its nine cells, so a pair meets at most once.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    asked = points.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).withColumns({"cx": cell("x") + F.col("dx"), "cy": cell("y") + F.col("dy")})
    held = nodes.select("img_id", "node_id", F.col("x").alias("nx"), F.col("y").alias("ny"), cell("x").alias("cx"), cell("y").alias("cy"))
    pairs = asked.join(held, ["img_id", "cx", "cy"]).withColumn("d", F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny"))).filter(F.col("d") <= radius)
    best = pairs.groupBy("img_id", "point_id").agg(F.min(F.struct("d", "node_id", "nx", "ny")).alias("m"))
    out = points.join(best, ["img_id", "point_id"], "left")
    return out.select("img_id", "point_id", F.coalesce("m.nx", "x").alias("x"), F.coalesce("m.ny", "y").alias("y"), "m.node_id", F.coalesce("m.d", F.lit(float("inf"))).alias("distance"))


def project(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """STRUCT(x, y, distance, t) of the nearest point on a segment; t from 0 to 1, a segment under 1e-6 counts as its start."""
    square = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.when(square < 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - ax) * (bx - ax) + (py - ay) * (by - ay), square), F.lit(0.0)))))
    x, y = ax + t * (bx - ax), ay + t * (by - ay)
    return F.struct(x.alias("x"), y.alias("y"), F.hypot(px - x, py - y).alias("distance"), t.alias("t"))


def simplify(points: Iterable[tuple[float, float]], epsilon: float = 2.0) -> list[tuple[float, float]]:
    """Ramer-Douglas-Peucker, with a stack in place of recursion."""
    p = np.array(list(points), float)
    if len(p) < 3:
        return [tuple(x) for x in p.tolist()]
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    stack = [(0, len(p) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d, inner = p[b] - p[a], p[a + 1 : b] - p[a]
        size = math.hypot(*d)
        away = np.abs(d[0] * inner[:, 1] - d[1] * inner[:, 0]) / size if size > 0 else np.hypot(inner[:, 0], inner[:, 1])
        i = int(np.argmax(away))
        if away[i] > epsilon:
            keep[a + 1 + i] = True
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return [tuple(x) for x in p[keep].tolist()]


def mosaic(pixels: DataFrame, blend: str = "linear") -> DataFrame:
    """(img_id, x, y, value) of overlapping patches' pixels (img_id, patch_id, x, y, value, weight): weighted mean, maximum or last patch."""
    value = {"linear": F.coalesce(F.try_divide(F.sum(F.col("weight") * F.col("value")), F.sum("weight")), F.lit(0.0)), "max": F.max("value"), "replace": F.max_by("value", "patch_id")}[blend]
    return pixels.groupBy("img_id", "x", "y").agg(value.alias("value"))


def colour_of(number: Column) -> Column:
    """A 24-bit id as STRUCT(r, g, b)."""
    byte = lambda k: (F.shiftright(number, k).bitwiseAND(F.lit(255))).cast("int")
    return F.struct(byte(16).alias("r"), byte(8).alias("g"), byte(0).alias("b"))


def number_of(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16) + F.shiftleft(g, 8) + b
