"""Stitching of drawings with many lines, and of odd ones."""

import math
import random
import time

from sparkwright.operators import geometry


def plain(lines, near):
    """All pairs anew after each join."""
    lines, gap = [list(p) for p in lines if p], math.dist
    while True:
        found = None
        for i, a in enumerate(lines):
            for j in range(i + 1, len(lines)):
                b = lines[j]
                best = min([(gap(a[-1], b[0]), a + b), (gap(a[-1], b[-1]), a + b[::-1]), (gap(a[0], b[0]), a[::-1] + b), (gap(a[0], b[-1]), b + a)], key=lambda w: w[0])
                if best[0] <= near:
                    found = (i, j, best[1])
                    break
            if found:
                break
        if not found:
            return [[p for k, p in enumerate(line) if not k or gap(p, line[k - 1]) > 1e-4] for line in lines]
        lines[found[0]] = found[2]
        del lines[found[1]]


def test_stitching_equals_the_plain_one():
    r = random.Random(3)
    for _ in range(300):
        span, step = r.choice([5, 60, 200]), r.choice([0.001, 1, 5])
        lines = [[tuple(step * round(r.uniform(-span, span) / step) for _ in "xy") for _ in range(r.choice([0, 1, 2, 2, 3]))] for _ in range(r.randint(0, 25))]
        assert geometry.stitch_lines(lines, 15.0) == plain(lines, 15.0)
    assert geometry.stitch_lines([[(-1e-20, 0.0)], [(15.0, 0.0)]]) == [[(-1e-20, 0.0), (15.0, 0.0)]]


def test_stitching_many_lines():
    """Five times more lines than took the all-pairs loop 12 s, in the same place; each joins once."""
    r = random.Random(4)
    places = [(r.gauss(0, 125), r.gauss(0, 125)) for _ in range(2500)]
    began = time.time()
    got = geometry.stitch_lines([[(x - 10, y), (x + 10, y)] for x, y in places])
    assert time.time() - began < 10 and sum(map(len, got)) == 5000
    assert all(math.dist(a[e], b[f]) > 15 for k, a in enumerate(got) for b in got[k + 1 :] for e in (0, -1) for f in (0, -1))


def test_missing_coordinates(spark):
    """They meet nothing, and the other lines of the drawing are stitched."""
    rows = [(1, 1, [(0.0, 0.0), (10.0, 0.0)]), (1, 2, [(None, None), (None, None)]), (1, 3, [(20.0, 0.0), (30.0, 0.0)]), (1, 4, None), (1, 5, [(math.nan, 1.0), (31.0, 0.0)]), (2, 1, None)]
    got = geometry.stitch(spark.createDataFrame(rows, "img_id int, line_id int, points array<struct<x:double,y:double>>")).collect()
    assert sorted((r["img_id"], r["line_no"], len(r["points"])) for r in got) == [(1, 0, 6), (1, 1, 2)]
