"""More registered queries: layers, wall classes, entities, orders, and walls carried on to each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.functions import geometry
from sheetwise.operators import layers, repair, sets
from sheetwise.plans.catalog import query
from sheetwise.sources import driver_tables as t
from sheetwise.sources.driver_tables import drawing

_WANTED = "SELECT 'n' AS layer UNION ALL SELECT 'af' UNION ALL SELECT 'AF'"
_LINE_LAYERS = "SELECT DISTINCT sheet_id, CASE WHEN x0 < 100 THEN layer ELSE lower(layer) END AS layer, x0, y0, x1, y1, entity_type FROM (" + t.LINES + ")"


@query(f"SELECT sheet_id, layer, count(*) AS n FROM ({_LINE_LAYERS}) WHERE lower(layer) IN (SELECT lower(layer) FROM ({_WANTED})) GROUP BY 1, 2")
def layer_filter(spark, sf):
    return layers.by_layer(drawing(spark, sf, _LINE_LAYERS), spark.sql(_WANTED)).groupBy("sheet_id", "layer").agg(F.count("*").alias("n"))


_LABELS = "SELECT CAST(p_partkey % 50 AS BIGINT) AS sheet_id, concat('T-', p_size % 7) AS layer FROM part"


@query(f"SELECT sheet_id, layer FROM ({_LINE_LAYERS}) UNION SELECT sheet_id, layer FROM ({_LABELS})")
def distinct_layers(spark, sf):
    return layers.layer_names(drawing(spark, sf, _LINE_LAYERS), drawing(spark, sf, _LABELS))


@query(f"SELECT layer_id, name, role FROM ({t.LAYERS}) WHERE role IN ('door', 'column') AND confidence >= 0.06")
def role_layers(spark, sf):
    return layers.layers_for_roles(drawing(spark, sf, t.LAYERS), ["door", "column"], 0.06).select("layer_id", "name", "role")


_SCALES = "SELECT CAST(n_nationkey AS BIGINT) AS sheet_id, CAST(n_nationkey % 4 AS DOUBLE) * 12 AS units_per_foot FROM nation"


@query(f"SELECT box_id, round(x0 / u, 9) AS x0, round(y0 / u, 9) AS y0, round(x1 / u, 9) AS x1, round(y1 / u, 9) AS y1 FROM ({t.BOXES}) b JOIN (SELECT sheet_id AS s, units_per_foot AS u FROM ({_SCALES}) WHERE units_per_foot > 0) ON s = sheet_id")
def feet_boxes(spark, sf):
    sides = ["x0", "y0", "x1", "y1"]
    return layers.to_feet(drawing(spark, sf, t.BOXES), drawing(spark, sf, _SCALES), sides).select("box_id", *[F.round(c, 9).alias(c) for c in sides])


_CLASSED = f"SELECT wall_id, sheet_id, CASE WHEN wall_id % 37 = 36 THEN 0.0 ELSE length_ft END AS length_ft, thickness_ft, CASE wall_id % 8 WHEN 0 THEN 'parapet' WHEN 1 THEN 'railing' WHEN 2 THEN 'site_wall' WHEN 3 THEN 'pool_edge' WHEN 4 THEN 'window' WHEN 5 THEN 'door' WHEN 6 THEN '' END AS wall_class, CAST(sheet_id % 5 + 8 AS DOUBLE) AS storey_ft FROM ({t.WALLS})"


@query(f"""SELECT wall_id, CASE WHEN wall_class IN ('parapet', 'railing') THEN 3.5 WHEN wall_class = 'site_wall' THEN 6.0 WHEN wall_class = 'pool_edge' THEN 5.0 ELSE storey_ft END AS height_ft, CASE wall_class WHEN 'pool_edge' THEN -5.0 ELSE 0.0 END AS offset_ft,
  CASE wall_class WHEN 'railing' THEN 'IfcRailing' ELSE 'IfcWallStandardCase' END AS entity, CASE wall_class WHEN 'railing' THEN 'GUARDRAIL' WHEN 'parapet' THEN 'PARAPET' END AS kind FROM ({_CLASSED})""")
def class_heights(spark, sf):
    name, kind = F.col("wall_class"), layers.class_type(F.col("wall_class"))
    return drawing(spark, sf, _CLASSED).select("wall_id", layers.class_height(name, F.col("storey_ft")).alias("height_ft"), layers.class_offset(name).alias("offset_ft"), kind["entity"].alias("entity"), kind["kind"].alias("kind"))


@query(f"""WITH w AS ({_CLASSED}), o AS (SELECT * FROM w WHERE wall_class IN ('window', 'door') AND length_ft > 0.000001)
SELECT wall_id, length_ft, CAST(NULL AS VARCHAR) AS opening, CASE WHEN wall_id IN (SELECT wall_id FROM o) THEN '' ELSE wall_class END AS wall_class, CAST(NULL AS DOUBLE) AS opening_confidence FROM w
UNION ALL SELECT wall_id, length_ft, wall_class, '', 0.7 FROM o""")
def class_openings(spark, sf):
    return layers.split_openings(drawing(spark, sf, _CLASSED)).select("wall_id", "length_ft", "opening", "wall_class", "opening_confidence")


@query(f"SELECT sheet_id, layer, entity_type AS kind, x0, y0, x1, y1 FROM ({t.LINES}) WHERE entity_type NOT IN ('T3', 'T7') AND greatest(x0, x1) >= 20 AND least(x0, x1) <= 40 AND greatest(y0, y1) >= 3 AND least(y0, y1) <= 9")
def crop_filter(spark, sf):
    return layers.crop(drawing(spark, sf, t.LINES).withColumnRenamed("entity_type", "kind"), (20.0, 3.0, 40.0, 9.0), ["T3", "T7"])


_ENTITIES = "SELECT p_partkey % 20 AS sheet_id, p_partkey AS source_id, p_type AS kind, p_brand AS block FROM part"


@query(f"SELECT c.sheet_id, element_id, c.source_id, e.kind AS entity_kind, block FROM ({t.CLAIMS}) c LEFT JOIN ({_ENTITIES}) e ON e.sheet_id = c.sheet_id AND e.source_id = c.source_id")
def entity_join(spark, sf):
    known = drawing(spark, sf, _ENTITIES).withColumnRenamed("kind", "entity_kind")
    claims = drawing(spark, sf, t.CLAIMS).select("sheet_id", "element_id", "source_id")
    return layers.attach_entities(claims.repartition(t.parts(spark, sf), "sheet_id", "source_id"), known)


_TURNED = f"SELECT sheet_id, wall_id, CASE WHEN wall_id % 3 = 0 THEN x1 ELSE x0 END AS x0, CASE WHEN wall_id % 3 = 0 THEN y1 ELSE y0 END AS y0, CASE WHEN wall_id % 3 = 0 THEN x0 ELSE x1 END AS x1, CASE WHEN wall_id % 3 = 0 THEN y0 ELSE y1 END AS y1, CAST(wall_id % 4 AS DOUBLE) / 8 AS thickness_ft, concat('L', wall_id % 5) AS layer FROM ({t.CROSS_WALLS})"


@query(f"""SELECT w.sheet_id, w.wall_id, row_number() OVER (PARTITION BY w.sheet_id ORDER BY c.x0, c.y0, c.x1, c.y1, thickness_ft, layer, w.wall_id) AS place FROM ({_TURNED}) w JOIN ({t.CROSS_WALLS}) c ON c.wall_id = w.wall_id""")
def wall_order(spark, sf):
    return layers.wall_order(drawing(spark, sf, _TURNED)).select("sheet_id", "wall_id", "place")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY length_ft DESC, wall_id) AS k FROM ({t.WALLS}))
SELECT sheet_id, count(*) AS n, string_agg(printf('''%s'' %.1fft', layer, length_ft), ', ' ORDER BY k) FILTER (k <= 5) AS longest FROM r GROUP BY 1""")
def longest_rejected(spark, sf):
    return layers.longest_named(drawing(spark, sf, t.WALLS))


_RIVALS = f"SELECT sheet_id, layer_id, CASE WHEN layer_id % 3 = 0 THEN 'competing_wall_layers' ELSE 'low_confidence' END AS reason, layer_id * 7 % 100 AS rank FROM ({t.LAYERS})"


@query(f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, reason ORDER BY rank, layer_id) AS i, count(*) FILTER (reason LIKE 'comp%') OVER (PARTITION BY sheet_id) AS rivals FROM ({_RIVALS}))
SELECT sheet_id, layer_id, CAST((i - 1) // 4 + CASE WHEN reason LIKE 'comp%' THEN 0 ELSE (rivals + 3) // 4 END AS BIGINT) AS batch FROM k""")
def rival_batches(spark, sf):
    return layers.rival_batches(drawing(spark, sf, _RIVALS)).select("sheet_id", "layer_id", "batch")


_ISSUES = "SELECT o_custkey % 40 AS sheet_id, o_orderkey AS issue_no, concat(o_orderpriority, o_orderstatus) AS code FROM orders"


@query(f"SELECT sheet_id, code, row_number() OVER (PARTITION BY sheet_id ORDER BY min(issue_no)) AS place FROM ({_ISSUES}) GROUP BY 1, 2")
def first_issues(spark, sf):
    return layers.first_of_each(drawing(spark, sf, _ISSUES), ["code"], ["issue_no"]).select("sheet_id", "code", "place")


_SHAPES = "SELECT s_suppkey AS shape_id, concat('f', s_suppkey % 17) AS fingerprint FROM supplier"
_APPROVED = "SELECT concat('f', n_nationkey) AS fingerprint FROM nation WHERE n_regionkey = 1"


@query(f"SELECT shape_id, fingerprint FROM ({_SHAPES}) WHERE fingerprint NOT IN (SELECT fingerprint FROM ({_APPROVED}))")
def hidden_approved(spark, sf):
    return layers.hide_approved(drawing(spark, sf, _SHAPES), drawing(spark, sf, _APPROVED)).select("shape_id", "fingerprint")


_OUTLINES = "SELECT p_partkey AS part_id, CAST(p_size AS DOUBLE) AS w, CAST(p_size % 7 + 1 AS DOUBLE) AS h, CASE p_partkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0000001 ELSE 0.01 END AS noise FROM part"


@query(f"SELECT part_id, noise < 0.001 AND noise <= w * h * 1e-9 + 2 * (w + h) * 2e-8 AS rectangular, round(2 * (w + h) / sqrt(w * w + h * h), 9) AS form FROM ({_OUTLINES})")
def outline_form(spark, sf):
    d = drawing(spark, sf, _OUTLINES)
    w, h, zero = F.col("w"), F.col("h"), F.lit(0.0)
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring, edge = F.array(corner(zero, zero), corner(w, zero), corner(w, h), corner(zero, h)), 2 * (w + h)
    return d.select("part_id", layers.is_rectangular(w * h - F.col("noise"), w * h, edge).alias("rectangular"), F.round(layers.form_factor(ring, edge), 9).alias("form"))


_METADATA = "SELECT s_suppkey, s_suppkey % 5 AS a, s_suppkey % 3 AS b, s_suppkey % 7 AS c FROM supplier"


@query(f"SELECT s_suppkey, CASE WHEN c > 3 THEN c ELSE a END AS scale, b AS units FROM ({_METADATA})")
def metadata_map(spark, sf):
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    entries = F.array(entry(F.lit("scale"), F.col("a")), entry(F.lit("units"), F.col("b")), entry(F.when(F.col("c") > 3, "scale").otherwise("other"), F.col("c")))
    found = layers.as_map(entries)
    return drawing(spark, sf, _METADATA).select("s_suppkey", found["scale"].alias("scale"), found["units"].alias("units"))


_PROPERTIES = "SELECT s_suppkey, concat(chr(123), '\"opening_start_ft\": ', s_suppkey % 9, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat(', \"opening_end_ft\": ', s_suppkey % 9 + 3, '.5') END, ', \"note\": \"x\"', chr(125)) AS properties FROM supplier"


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN CAST(s_suppkey % 9 AS DOUBLE) END AS start_ft, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 9 + CAST(3.5 AS DOUBLE) END AS end_ft FROM supplier")
def opening_properties(spark, sf):
    span = layers.opening_span(F.col("properties"))
    return drawing(spark, sf, _PROPERTIES).select("s_suppkey", span["start_ft"].alias("start_ft"), span["end_ft"].alias("end_ft"))


@query(f"""WITH w AS ({t.CROSS_WALLS}), e AS (SELECT *, 0 AS k, x0 AS px, y0 AS py, x1 AS qx, y1 AS qy FROM w UNION ALL SELECT *, 1, x1, y1, x0, y0 FROM w),
h AS (SELECT e.wall_id, k, px, py, qx, qy, CASE WHEN e.x0 = e.x1 THEN e.x0 ELSE o.x0 END AS hx, CASE WHEN e.x0 = e.x1 THEN o.y0 ELSE e.y0 END AS hy, o.x0 AS a, o.y0 AS b, o.x1 AS c, o.y1 AS d
      FROM e JOIN w o ON o.sheet_id = e.sheet_id AND (o.x0 = o.x1) <> (e.x0 = e.x1)),
m AS (SELECT *, round(abs(px - hx) + abs(py - hy), 9) AS away FROM h WHERE abs(px - hx) + abs(py - hy) <= 10 + 1e-9 AND abs(qx - hx) + abs(qy - hy) > 1e-9 AND greatest(a - hx, hx - c, b - hy, hy - d) <= 10 + 1e-9),
n AS (SELECT wall_id, k, hx, hy FROM (SELECT *, row_number() OVER (PARTITION BY wall_id, k ORDER BY away, hx, hy) AS i FROM m) WHERE i = 1),
j AS (SELECT w.*, coalesce(s.hx, x0) AS a, coalesce(s.hy, y0) AS b, coalesce(f.hx, x1) AS c, coalesce(f.hy, y1) AS d FROM w LEFT JOIN n s ON s.wall_id = w.wall_id AND s.k = 0 LEFT JOIN n f ON f.wall_id = w.wall_id AND f.k = 1)
SELECT sheet_id, wall_id, CASE WHEN a + b < c + d THEN a ELSE x0 END AS x0, CASE WHEN a + b < c + d THEN b ELSE y0 END AS y0, CASE WHEN a + b < c + d THEN c ELSE x1 END AS x1, CASE WHEN a + b < c + d THEN d ELSE y1 END AS y1 FROM j""")
def extended_walls(spark, sf):
    return repair.extend_ends(drawing(spark, sf, t.CROSS_WALLS), 120.0, 20.0)


_STATED = f"""SELECT sheet_id, wall_id AS dim_id, x0, y0 + CAST(wall_id % 3 AS DOUBLE) / 10 AS y0, x1, y1 + CAST(wall_id % 3 AS DOUBLE) / 10 AS y1,
  CASE WHEN wall_id % 11 > 0 THEN x1 - x0 + y1 - y0 + CAST(wall_id % 5 AS DOUBLE) / 20 END AS expected_ft, CASE WHEN wall_id % 7 = 0 THEN 'ocr-associated' ELSE 'native' END AS source FROM ({t.CROSS_WALLS})"""


@query(f"""WITH w AS ({t.CROSS_WALLS}), s AS ({_STATED}), e AS (SELECT sheet_id, dim_id, 0 AS k, x0 AS px, y0 AS py FROM s UNION ALL SELECT sheet_id, dim_id, 1, x1, y1 FROM s),
n AS (SELECT dim_id, k, greatest(x0, least(x1, px)) AS fx, greatest(y0, least(y1, py)) AS fy, px, py FROM e JOIN w ON w.sheet_id = e.sheet_id),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dim_id, k ORDER BY round(sqrt((px - fx) ** 2 + (py - fy) ** 2), 9), fx, fy) AS i FROM n WHERE sqrt((px - fx) ** 2 + (py - fy) ** 2) <= 2 / 12.0) WHERE i = 1),
a AS (SELECT s.*, CASE WHEN expected_ft IS NOT NULL THEN round(sqrt((g.fx - f.fx) ** 2 + (g.fy - f.fy) ** 2), 9) END AS actual_ft FROM s LEFT JOIN f ON f.dim_id = s.dim_id AND f.k = 0 LEFT JOIN f g ON g.dim_id = s.dim_id AND g.k = 1)
SELECT sheet_id, dim_id, expected_ft, actual_ft, round(abs(actual_ft - expected_ft) * 12, 6) AS error_in, CASE WHEN actual_ft IS NULL THEN 'unverified'
  WHEN actual_ft = 0 OR abs(actual_ft - expected_ft) * 12 > 2.00001 OR abs(x1 - x0 + y1 - y0 - expected_ft) * 12 > 2.00001 THEN 'failed' WHEN source LIKE 'ocr%' THEN 'unverified' ELSE 'verified' END AS status FROM a""")
def verified_dimensions(spark, sf):
    return repair.check_dimensions(drawing(spark, sf, _STATED), drawing(spark, sf, t.CROSS_WALLS))


_PROFILES = "SELECT o_orderkey AS profile_id, CAST(o_orderkey % 5 + 8 AS DOUBLE) AS height_ft FROM orders"
_HOLES = "SELECT l_orderkey AS profile_id, CAST(l_suppkey % 4 AS DOUBLE) AS sill_ft, CAST(l_partkey % 6 AS DOUBLE) / 2 AS height_ft FROM lineitem"


@query(f"""WITH p AS ({_PROFILES}), o AS ({_HOLES}),
l AS (SELECT profile_id, CAST(0 AS DOUBLE) AS v FROM p UNION SELECT profile_id, height_ft FROM p UNION SELECT profile_id, sill_ft FROM o UNION SELECT profile_id, sill_ft + height_ft FROM o),
s AS (SELECT profile_id, v AS lower_ft, lead(v) OVER (PARTITION BY profile_id ORDER BY v) AS upper_ft FROM l)
SELECT s.profile_id, lower_ft, upper_ft, count(o.profile_id) AS n_open FROM s LEFT JOIN o ON o.profile_id = s.profile_id AND sill_ft < (lower_ft + upper_ft) / 2 AND (lower_ft + upper_ft) / 2 < sill_ft + height_ft WHERE upper_ft IS NOT NULL GROUP BY 1, 2, 3""")
def profile_slabs(spark, sf):
    return repair.height_slabs(drawing(spark, sf, _PROFILES), drawing(spark, sf, _HOLES))


@query(f"""SELECT sheet_id, layer, x0, y0, x1, y1, round((x1 - x0) / s + 0.0, 9) AS dx, round((y1 - y0) / s + 0.0, 9) AS dy, round((y0 * (x1 - x0) - x0 * (y1 - y0)) / s, 6) AS off
FROM (SELECT DISTINCT sheet_id, layer, x0, y0, x1, y1, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS s FROM ({t.LINES})) WHERE s > 0""")
def unit_directions(spark, sf):
    d = drawing(spark, sf, t.LINES).filter("x0 != x1 or y0 != y1").select("sheet_id", "layer", "x0", "y0", "x1", "y1").distinct()
    d = d.withColumn("u", geometry.direction(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    return d.select("sheet_id", "layer", "x0", "y0", "x1", "y1", F.round("u.x", 9).alias("dx"), F.round("u.y", 9).alias("dy"), F.round(F.col("y0") * F.col("u.x") - F.col("x0") * F.col("u.y"), 6).alias("off"))


_FIRST = f"SELECT sheet_id, element_id, source_id FROM ({t.CLAIMS}) WHERE kind = 'wall'"
_LATER = f"SELECT sheet_id, element_id, source_id FROM ({t.CLAIMS}) WHERE kind = 'window' AND verdict = 'correct'"


@query(f"""WITH a AS ({_FIRST}), b AS ({_LATER}) SELECT * FROM b UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM a x JOIN b ON b.sheet_id = x.sheet_id AND b.source_id = x.source_id WHERE x.sheet_id = a.sheet_id AND x.element_id = a.element_id)""")
def hypothesis_union(spark, sf):
    return sets.override_union(drawing(spark, sf, _FIRST), drawing(spark, sf, _LATER))
