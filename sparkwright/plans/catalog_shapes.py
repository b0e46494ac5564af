"""Queries over tags, boxes, points, graphs and rasters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.operators import geometry, graph, raster, tags


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_tags(spark, d):
    k = F.col("p_partkey")
    forms = F.array(
        F.format_string(' %d"-p-%d_CS-150', "p_size", 100 + k % 900), F.format_string("HV %d", 100 + k % 900), F.format_string("P-%dA", 100 + k % 900), F.format_string("10-E-%d-CS", 100 + k % 900),
        F.format_string("FIC__%d", 100 + k % 900), F.concat(F.lit("V-I"), F.lpad((k % 90).cast("string"), 2, "0")), F.lit("TK-S00"), F.lit("no tag here"), F.format_string('1/2"-IA-%d-CU', 100 + k % 900), F.format_string('%d"-CW-%d-A1-600', "p_size", 100 + k % 900),
    )
    return table(spark, d, "part").select("p_partkey", F.element_at(forms, (k % 10 + 1).cast("int")).alias("raw"))


def tag_clean(spark, d):
    return raw_tags(spark, d).select("p_partkey", tags.cleaned(F.col("raw")).alias("tag"))


def tag_repair(spark, d):
    return raw_tags(spark, d).select("p_partkey", tags.repaired(F.col("raw")).alias("tag"))


def tag_parse(spark, d):
    p = raw_tags(spark, d).select("p_partkey", tags.parsed(F.col("raw")).alias("t"))
    return p.select("p_partkey", "t.category", "t.tag", "t.code", "t.sequence")


def pipe_attrs(spark, d):
    c = tags.cleaned(F.col("raw"))
    return raw_tags(spark, d).select("p_partkey", tags.outside_diameter(c).alias("diameter"), tags.design_pressure(c).alias("pressure"))


def boxes(spark, d):
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    x, y = F.round(1000 * v(0), 3), F.round(1000 * v(1), 3)
    return table(spark, d, "embeddings").select(F.lit(0).alias("img_id"), "label", F.col("vec_id").alias("box_id"), (x - 10).alias("x1"), (y - 10).alias("y1"), (x + 10).alias("x2"), (y + 10).alias("y2"), F.round(F.abs(v(2)), 4).alias("confidence"), F.lpad(F.lit(""), 3, "x").alias("text"), x.alias("x"), y.alias("y"))


def tile_grid(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("img_id"), (500 + F.col("p_partkey") % 4000).alias("width"), (300 + F.col("p_size") * 61).cast("long").alias("height"))
    return geometry.tiles(p).select("img_id", "patch_id", "x1", "y1", "x2", "y2")


def bbox_map(spark, d):
    b = boxes(spark, d).withColumns({"a1": F.lit(-50.0), "b1": F.lit(-60.0), "a2": F.lit(60.0), "b2": F.lit(70.0)})
    names = ("x1", "y1", "x2", "y2")
    clipped = geometry.to_patch(names, ("a1", "b1", "a2", "b2"), clip=True)
    inside = geometry.to_patch(names, ("a1", "b1", "a2", "b2"))
    return b.select("box_id", inside.isNotNull().alias("inside"), F.round(clipped["x1"], 3).alias("left"), F.round(clipped["y2"], 3).alias("bottom"))


def iou_pairs(spark, d):
    return geometry.overlapping(boxes(spark, d), 0.2).select("label", "a", "b", F.round("iou", 5).alias("iou"))


def nodes_points(spark, d):
    b = boxes(spark, d)
    return b.filter("box_id % 2 = 1").select("img_id", F.col("box_id").alias("point_id"), "x", "y"), b.filter("box_id % 2 = 0").select("img_id", F.col("box_id").alias("node_id"), "x", "y")


def snap_nearest(spark, d):
    points, nodes = nodes_points(spark, d)
    return geometry.snap(points, nodes).filter("node_id IS NOT NULL").select("point_id", "node_id", F.round("distance", 4).alias("distance"))


def project_segment(spark, d):
    p = geometry.project(F.col("x"), F.col("y"), F.lit(-100.0), F.lit(-50.0), F.lit(100.0), F.lit(50.0))
    return boxes(spark, d).select("box_id", F.round(p["distance"], 4).alias("distance"), F.round(p["t"], 5).alias("t"))


def nms(spark, d):
    return geometry.suppress(boxes(spark, d).drop("x", "y"), 0.3).select("label", "box_id", "confidence")


def cluster(spark, d):
    return geometry.cluster(boxes(spark, d).select("img_id", "label", F.col("box_id").alias("point_id"), "x", "y", "confidence")).select("label", "anchor_id", "merged_count")


def stitch(spark, d):
    line = F.array(F.struct(F.col("x1").alias("x"), F.col("y").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y").alias("y")))
    b = boxes(spark, d).select((F.col("box_id") % 20).alias("img_id"), F.col("box_id").alias("line_id"), line.alias("points"))
    return geometry.stitch(b).select("img_id", "line_no", F.size("points").alias("n"), F.round(geometry.path_length("points"), 4).alias("length"))


def mosaic_linear(spark, d):
    b = boxes(spark, d).select(F.lit(0).alias("img_id"), F.col("box_id").alias("patch_id"), F.floor(F.col("x") / 50).alias("x"), F.floor(F.col("y") / 50).alias("y"), F.col("confidence").alias("value"), (F.col("box_id") % 5 + 1).alias("weight"))
    return geometry.mosaic(b).select("x", "y", F.round("value", 6).alias("value"))


def colour_codes(spark, d):
    c = geometry.colour_of(F.col("p_partkey") * 131)
    rows = table(spark, d, "part").select("p_partkey", c.alias("c"))
    return rows.select("p_partkey", "c.r", "c.g", "c.b", geometry.number_of(F.col("c.r"), F.col("c.g"), F.col("c.b")).alias("back"))


def tree(spark, d):
    p = table(spark, d, "part")
    return p.filter("p_partkey > 1").select(F.floor(F.col("p_partkey") / 2).alias("src"), F.col("p_partkey").alias("dst"))


def downstream(spark, d):
    starts = spark.range(3, 6).select(F.col("id").alias("node"))
    return graph.reach(tree(spark, d), starts)


def ancestors(spark, d):
    return graph.ancestors(tree(spark, d), table(spark, d, "part").filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("node")))


def shortest_path(spark, d):
    pairs = table(spark, d, "part").filter("p_partkey % 40 = 0").select(F.lit(1).cast("long").alias("source"), F.col("p_partkey").alias("target"))
    out = graph.shortest_paths(tree(spark, d), pairs)
    return out.select("source", "target", "hops", F.array_join("path", ">").alias("path"))


def simple_paths(spark, d):
    """From the first part to the last."""
    last = table(spark, d, "part").agg(F.max("p_partkey")).first()[0]
    return graph.simple_paths(tree(spark, d), 1, last).select(F.array_join("path", ">").alias("path"))


def predecessors(spark, d):
    return graph.predecessors(tree(spark, d), 7).select("src")


def crossing_number(spark, d):
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 12).cast("int").alias("x"), (F.col("vec_id") * 7 % 11).cast("int").alias("y"), (F.col("vec_id") % 3).cast("int").alias("img_id")).filter((F.col("x") * F.col("y")) % 4 != 1).distinct()
    return raster.crossing_rows(e)


def thinning(spark, d):
    """Key pixels of a drawn cross in each of a few images."""
    rows = []
    for i in range(4):
        image = [[255] * 60 for _ in range(60)]
        for t in range(50):
            for w in range(3):
                image[28 + w][5 + t] = 0
                image[5 + t][20 + 3 * i + w] = 0
        rows.append((i, 60, 60, bytearray(b for line in image for b in line)))
    return raster.images(spark.createDataFrame(rows, "img_id int, width int, height int, pixels binary"))


QUERIES = {f.__name__: f for f in (tag_clean, tag_repair, tag_parse, pipe_attrs, tile_grid, bbox_map, iou_pairs, snap_nearest, project_segment, nms, cluster, stitch, mosaic_linear, colour_codes, downstream, ancestors, shortest_path, simple_paths, predecessors, crossing_number, thinning)}

N = "CAST(100 + p_partkey % 900 AS VARCHAR)"
I90 = "lpad(CAST(p_partkey % 90 AS VARCHAR), 2, '0')"
Z = "CAST(p_size AS VARCHAR)"


def _tag_list(*items: str) -> str:
    return f"SELECT p_partkey, list_extract([{', '.join(items)}], CAST(p_partkey % 10 + 1 AS INTEGER)) AS tag FROM part"


CLEAN = _tag_list(f"{Z} || '\"-P-' || {N} || '-CS-150'", f"'HV-' || {N}", f"'P-' || {N} || 'A'", f"'10-E-' || {N} || '-CS'", f"'FIC-' || {N}", f"'V-I' || {I90}", "'TK-S00'", "'NO-TAG-HERE'", f"'1/2\"-IA-' || {N} || '-CU'", f"{Z} || '\"-CW-' || {N} || '-A1-600'")
REPAIR = _tag_list(f"{Z} || '\"-P-' || {N} || '-CS-150'", f"'HV-' || {N}", f"'P-' || {N} || 'A'", f"'10-E-' || {N} || '-CS'", f"'FIC-' || {N}", f"'V-1' || {I90}", "'TK-500'", "'NO-TAG-HERE'", f"'1/2\"-IA-' || {N} || '-CU'", f"{Z} || '\"-CW-' || {N} || '-A1-600'")
PARSE = f"""SELECT p_partkey, list_extract(['pipe_line','valve','equipment','equipment','instrument','equipment','equipment',NULL,'pipe_line','pipe_line'], CAST(p_partkey % 10 + 1 AS INTEGER)) AS category,
    CASE WHEN p_partkey % 10 = 7 THEN NULL ELSE tag END AS tag, list_extract(['P','HV','P','E','FIC','V','TK',NULL,'IA','CW'], CAST(p_partkey % 10 + 1 AS INTEGER)) AS code,
    CASE p_partkey % 10 WHEN 7 THEN NULL WHEN 5 THEN '1' || {I90} WHEN 6 THEN '500' ELSE {N} END AS sequence FROM part JOIN ({REPAIR}) USING (p_partkey)"""
ATTRS = f"""SELECT p_partkey, CAST(CASE p_partkey % 10 WHEN 0 THEN p_size WHEN 9 THEN p_size WHEN 8 THEN 0.5 WHEN 3 THEN 10 WHEN 1 THEN 100 + p_partkey % 900 WHEN 4 THEN 100 + p_partkey % 900 ELSE 16 END AS DOUBLE) AS diameter,
    CASE WHEN p_partkey % 10 = 9 THEN 1480.0::DOUBLE WHEN p_partkey % 10 = 0 THEN CASE 100 + p_partkey % 900 WHEN 150 THEN 285.0 WHEN 300 THEN 740.0 WHEN 400 THEN 985.0 WHEN 600 THEN 1480.0 WHEN 900 THEN 2220.0 ELSE 285.0 END::DOUBLE
    WHEN p_partkey % 10 IN (1, 2, 3, 4, 8) THEN CASE WHEN p_partkey % 10 = 2 THEN 285.0 ELSE CASE 100 + p_partkey % 900 WHEN 150 THEN 285.0 WHEN 300 THEN 740.0 WHEN 400 THEN 985.0 WHEN 600 THEN 1480.0 WHEN 900 THEN 2220.0 ELSE 285.0 END END::DOUBLE ELSE 285.0::DOUBLE END AS pressure FROM part"""
ATTRS = ATTRS.replace("WHEN p_partkey % 10 = 9 THEN 1480.0::DOUBLE", "WHEN p_partkey % 10 = 9 THEN CASE 100 + p_partkey % 900 WHEN 150 THEN 285.0 WHEN 300 THEN 740.0 WHEN 400 THEN 985.0 WHEN 900 THEN 2220.0 ELSE 1480.0 END::DOUBLE")
BOX = """WITH e AS (SELECT vec_id AS box_id, label, round(1000 * CAST(embedding[1] AS DOUBLE), 3) AS x, round(1000 * CAST(embedding[2] AS DOUBLE), 3) AS y, round(abs(CAST(embedding[3] AS DOUBLE)), 4) AS confidence FROM embeddings),
    b AS (SELECT *, x - 10 AS x1, y - 10 AS y1, x + 10 AS x2, y + 10 AS y2 FROM e)"""
TILE = "list_sort(list_distinct(list_transform(range(0, CAST(greatest(ceil(({d} - 128) / 896.0), 1) AS BIGINT)), lambda i: greatest(least(i * 896, {d} - 1024), 0))))"
TREE = "WITH RECURSIVE t AS (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey > 1)"

ORACLE = {
    "tag_clean": CLEAN,
    "tag_repair": REPAIR,
    "tag_parse": PARSE,
    "pipe_attrs": ATTRS,
    "tile_grid": f"""WITH p AS (SELECT p_partkey AS img_id, 500 + p_partkey % 4000 AS w, CAST(300 + p_size * 61 AS BIGINT) AS h FROM part),
        s AS (SELECT img_id, w, h, {TILE.format(d="w")} AS xs, {TILE.format(d="h")} AS ys FROM p),
        y AS (SELECT *, unnest(range(1, len(ys) + 1)) AS j FROM s), x AS (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM y)
        SELECT img_id, (j - 1) * len(xs) + i - 1 AS patch_id, xs[i] AS x1, ys[j] AS y1, least(xs[i] + 1024, w) AS x2, least(ys[j] + 1024, h) AS y2 FROM x""",
    "bbox_map": BOX + """ SELECT box_id, x1 >= -50 AND y1 >= -60 AND x2 <= 60 AND y2 <= 70 AS inside, CASE WHEN greatest(x1, -50) < least(x2, 60) AND greatest(y1, -60) < least(y2, 70) THEN round(greatest(x1, -50.0::DOUBLE) + 50, 3) END AS "left",
        CASE WHEN greatest(x1, -50) < least(x2, 60) AND greatest(y1, -60) < least(y2, 70) THEN round(least(y2, 70.0::DOUBLE) + 60, 3) END AS bottom FROM b""",
    "iou_pairs": BOX + """, p AS (SELECT a.label, a.box_id AS a, c.box_id AS b, greatest(least(a.x2, c.x2) - greatest(a.x1, c.x1), 0) * greatest(least(a.y2, c.y2) - greatest(a.y1, c.y1), 0) AS i FROM b a JOIN b c ON a.label = c.label AND a.box_id < c.box_id)
        SELECT label, a, b, round(i / (800 - i), 5) AS iou FROM p WHERE i > 0 AND i / (800 - i) >= 0.2""",
    "snap_nearest": BOX + """, d AS (SELECT p.box_id AS point_id, n.box_id AS node_id, sqrt((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y)) AS d FROM b p JOIN b n ON p.box_id % 2 = 1 AND n.box_id % 2 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, node_id) AS k FROM d WHERE d <= 35) SELECT point_id, node_id, round(d, 4) AS distance FROM r WHERE k = 1""",
    "project_segment": BOX + """, p AS (SELECT box_id, x, y, greatest(0.0, least(1.0, ((x + 100) * 200 + (y + 50) * 100) / 50000.0)) AS t FROM b)
        SELECT box_id, round(sqrt((x - (-100 + t * 200)) * (x - (-100 + t * 200)) + (y - (-50 + t * 100)) * (y - (-50 + t * 100))), 4) AS distance, round(t, 5) AS t FROM p""",
    # a fold over the boxes, surest first: one is kept if none kept before overlaps it
    "nms": BOX + """, g AS (SELECT label, list([{'id': box_id, 'x': x, 'y': y, 'c': confidence}] ORDER BY confidence DESC, box_id) AS l FROM b GROUP BY label),
        k AS (SELECT label, unnest(list_reduce(list_prepend(list_filter(l[1], lambda z: false), l), lambda s, p: CASE WHEN len(list_filter(s, lambda k: greatest(20 - abs(k.x - p[1].x), 0.0) * greatest(20 - abs(k.y - p[1].y), 0.0) >= 0.3 * (800 - greatest(20 - abs(k.x - p[1].x), 0.0) * greatest(20 - abs(k.y - p[1].y), 0.0)))) > 0 THEN s ELSE list_concat(s, p) END)) AS k FROM g)
        SELECT label, k.id AS box_id, k.c AS confidence FROM k""",
    # anchors by a fold in order of ids; a point belongs to the first anchor near it
    "cluster": BOX + """, g AS (SELECT label, list([{'id': box_id, 'x': x, 'y': y}] ORDER BY box_id) AS l FROM b GROUP BY label),
        k AS (SELECT label, unnest(list_reduce(list_prepend(list_filter(l[1], lambda z: false), l), lambda s, p: CASE WHEN len(list_filter(s, lambda k: sqrt((k.x - p[1].x) * (k.x - p[1].x) + (k.y - p[1].y) * (k.y - p[1].y)) <= 15)) > 0 THEN s ELSE list_concat(s, p) END)) AS k FROM g),
        o AS (SELECT b.label, b.box_id, min(k.k.id) AS anchor_id FROM b JOIN k ON b.label = k.label AND sqrt((k.k.x - b.x) * (k.k.x - b.x) + (k.k.y - b.y) * (k.k.y - b.y)) <= 15 GROUP BY 1, 2)
        SELECT label, anchor_id, count(*) AS merged_count FROM o GROUP BY 1, 2""",
    "mosaic_linear": BOX + " SELECT CAST(floor(x / 50) AS BIGINT) AS x, CAST(floor(y / 50) AS BIGINT) AS y, round(sum((box_id % 5 + 1) * confidence) / sum(box_id % 5 + 1), 6) AS value FROM b GROUP BY 1, 2",
    "colour_codes": "SELECT p_partkey, CAST((p_partkey * 131) // 65536 % 256 AS INTEGER) AS r, CAST((p_partkey * 131) // 256 % 256 AS INTEGER) AS g, CAST((p_partkey * 131) % 256 AS INTEGER) AS b, CAST((p_partkey * 131) % 16777216 AS INTEGER) AS back FROM part",
    "downstream": TREE + ", r AS (SELECT s.i AS start, t.dst AS node, 1 AS depth FROM t JOIN (SELECT unnest(range(3, 6)) AS i) s ON t.src = s.i UNION ALL SELECT r.start, t.dst, r.depth + 1 FROM r JOIN t ON t.src = r.node) SELECT start, node, depth FROM r",
    "ancestors": TREE + ", r AS (SELECT t.dst AS start, t.src AS node, 1 AS depth FROM t WHERE t.dst % 50 = 0 UNION ALL SELECT r.start, t.src, r.depth + 1 FROM r JOIN t ON t.dst = r.node) SELECT start, node, depth FROM r",
    "shortest_path": TREE + ", r AS (SELECT t.dst AS target, t.src AS node, 1 AS hops, CAST(t.src AS VARCHAR) || '>' || CAST(t.dst AS VARCHAR) AS path FROM t WHERE t.dst % 40 = 0 UNION ALL SELECT r.target, t.src, r.hops + 1, CAST(t.src AS VARCHAR) || '>' || r.path FROM r JOIN t ON t.dst = r.node) SELECT CAST(1 AS BIGINT) AS source, target, hops, path FROM r WHERE node = 1",
    "simple_paths": TREE + ", r AS (SELECT t.src AS node, CAST(t.src AS VARCHAR) || '>' || CAST(t.dst AS VARCHAR) AS path FROM t WHERE t.dst = (SELECT max(p_partkey) FROM part) UNION ALL SELECT t.src, CAST(t.src AS VARCHAR) || '>' || r.path FROM r JOIN t ON t.dst = r.node) SELECT path FROM r WHERE node = 1",
    "predecessors": "SELECT CAST(3 AS BIGINT) AS src",
    "crossing_number": """WITH e AS (SELECT DISTINCT CAST(vec_id % 12 AS INTEGER) AS x, CAST(vec_id * 7 % 11 AS INTEGER) AS y, CAST(vec_id % 3 AS INTEGER) AS img_id FROM embeddings WHERE ((vec_id % 12) * (vec_id * 7 % 11)) % 4 <> 1),
        o AS (SELECT * FROM (VALUES (0, 0, -1), (1, 1, -1), (2, 1, 0), (3, 1, 1), (4, 0, 1), (5, -1, 1), (6, -1, 0), (7, -1, -1)) v(i, dx, dy)),
        n AS (SELECT e.img_id, e.x, e.y, o.i, CASE WHEN f.x IS NULL THEN 0 ELSE 1 END AS v FROM e CROSS JOIN o LEFT JOIN e f ON f.img_id = e.img_id AND f.x = e.x + o.dx AND f.y = e.y + o.dy)
        SELECT a.img_id, a.x, a.y, CAST(count(*) FILTER (a.v = 0 AND b.v = 1) AS INTEGER) AS crossing FROM n a JOIN n b ON a.img_id = b.img_id AND a.x = b.x AND a.y = b.y AND b.i = (a.i + 1) % 8 GROUP BY a.img_id, a.x, a.y""",
}
