"""Registered queries about openings and their walls, edges of regions, tiles, labels with sizes, and buildings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.operators import hosting, validate
from sheetwise.plans.catalog import query
from sheetwise.sources import driver_tables as t
from sheetwise.sources.driver_tables import drawing

_TWINS = f"SELECT sheet_id, wall_id, x0, y0, x1, y1, wall_id % 50 AS src FROM ({t.CROSS_WALLS}) UNION ALL SELECT sheet_id, wall_id + 10000000, x0, y0, x1, y1, CASE WHEN wall_id % 8 = 0 THEN wall_id % 50 ELSE 777 END FROM ({t.CROSS_WALLS}) WHERE wall_id % 4 = 0"
_CUTS = f"""SELECT sheet_id, wall_id AS opening_id, CASE WHEN y0 = y1 THEN x0 + 1 ELSE x0 END AS x0, CASE WHEN y0 = y1 THEN y0 + CASE WHEN wall_id % 7 = 0 THEN 0.5 ELSE 0.0 END ELSE y0 + 1 END AS y0,
  CASE WHEN y0 = y1 THEN x0 + 4 ELSE x0 END AS x1, CASE WHEN y0 = y1 THEN y0 + CASE WHEN wall_id % 7 = 0 THEN 0.5 ELSE 0.0 END ELSE y0 + 4 END AS y1, CASE WHEN wall_id % 3 > 0 THEN wall_id % 50 END AS src FROM ({t.CROSS_WALLS})"""


@query(f"""WITH w AS ({_TWINS}), o AS ({_CUTS}),
c AS (SELECT o.sheet_id, opening_id, wall_id, CASE WHEN o.src = w.src THEN 0 ELSE 1 END AS kind FROM o JOIN w ON w.sheet_id = o.sheet_id AND o.x0 >= w.x0 - 0.00001 AND o.x1 <= w.x1 + 0.00001 AND o.y0 >= w.y0 - 0.00001 AND o.y1 <= w.y1 + 0.00001),
b AS (SELECT opening_id, min(kind) AS kind FROM c GROUP BY 1)
SELECT sheet_id, c.opening_id, min(wall_id) AS wall_id FROM c JOIN b ON b.opening_id = c.opening_id AND b.kind = c.kind GROUP BY 1, 2 HAVING count(*) = 1""")
def remapped_openings(spark, sf):
    ids = F.when(F.col("src").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("src"))
    openings, walls = (drawing(spark, sf, s).withColumn("source_ids", ids).drop("src") for s in (_CUTS, _TWINS))
    return hosting.remap_openings(openings, walls)


_KINDS = f"SELECT sheet_id, wall_id AS opening_id, CASE wall_id % 3 WHEN 0 THEN 'door' WHEN 1 THEN 'window' ELSE 'gap' END AS kind, x0, y0, x1, y1, wall_id % 5 = 0 AS reviewed FROM ({t.CROSS_WALLS})"
_NOTES = f"SELECT sheet_id, point_id AS note_id, CASE point_id % 4 WHEN 0 THEN 'Sill lvl 3''' WHEN 1 THEN 'ＳＩＬＬ 900' WHEN 2 THEN 'door' ELSE 'WINDOWSILL' END AS text, CAST(80 + point_id % 21 AS DOUBLE) / 100 AS confidence, y AS x, x AS y FROM ({t.POINTS})"


@query(f"""WITH o AS ({_KINDS}), n AS (SELECT * FROM ({_NOTES}) WHERE confidence >= 0.85 AND upper(translate(text, 'ＳＩＬ', 'SIL')) LIKE '%SILL%'),
m AS (SELECT o.opening_id, note_id, round(sqrt(least(abs(x1 - x0), 0) + greatest(0, x0 - n.x, n.x - x1) ** 2 + greatest(0, y0 - n.y, n.y - y1) ** 2), 9) AS away FROM o JOIN n ON n.sheet_id = o.sheet_id
      WHERE o.kind <> 'gap' AND CASE WHEN y0 = y1 THEN n.x BETWEEN x0 - 0.25 AND x1 + 0.25 AND abs(n.y - y0) <= 2 ELSE n.y BETWEEN y0 - 0.25 AND y1 + 0.25 AND abs(n.x - x0) <= 2 END),
g AS (SELECT opening_id, count(*) AS n_notes, arg_min(note_id, (away, note_id)) AS note_id, min(away) AS distance_ft FROM m GROUP BY 1)
SELECT sheet_id, o.opening_id, coalesce(n_notes, 0) AS n_notes, note_id, distance_ft, coalesce(kind = 'door' AND n_notes > 0 AND NOT reviewed, false) AS ambiguous FROM o LEFT JOIN g ON g.opening_id = o.opening_id""")
def sill_context(spark, sf):
    return hosting.sill_notes(drawing(spark, sf, _KINDS), drawing(spark, sf, _NOTES))


_THICK = f"SELECT sheet_id, wall_id, floor(x0 / 5) * 5 AS x0, floor(y0 / 5) * 5 AS y0, floor(x0 / 5) * 5 + (x1 - x0) AS x1, floor(y0 / 5) * 5 + (y1 - y0) AS y1, CAST(wall_id % 7 + 1 AS DOUBLE) / 16 AS thickness_ft FROM ({t.CROSS_WALLS})"
_RINGS = f"SELECT box_id, sheet_id, floor(x0 / 5) * 5 AS x0, floor(y0 / 5) * 5 AS y0, floor(x0 / 5) * 5 + (box_id % 30 + 5) AS x1, floor(y0 / 5) * 5 + (box_id % 20 + 5) AS y1 FROM ({t.BOXES})"
_EDGES = f"""SELECT sheet_id, x0 AS ax, y0 AS ay, x1 AS ox, y0 AS oy FROM ({_RINGS}) UNION ALL SELECT sheet_id, x1, y0, x1, y1 FROM ({_RINGS})
UNION ALL SELECT sheet_id, x1, y1, x0, y1 FROM ({_RINGS}) UNION ALL SELECT sheet_id, x0, y1, x0, y0 FROM ({_RINGS})"""


@query(f"""WITH w AS ({_THICK}), e AS (SELECT sheet_id, least(ax, ox) AS a, greatest(ax, ox) AS b, least(ay, oy) AS c, greatest(ay, oy) AS d FROM ({_EDGES})),
m AS (SELECT w.sheet_id, wall_id, thickness_ft, x1 - x0 + y1 - y0 AS size, b - a + d - c AS n, CASE WHEN y0 = y1 THEN least(x1, b) - greatest(x0, a) ELSE least(y1, d) - greatest(y0, c) END AS shared
      FROM w JOIN e ON e.sheet_id = w.sheet_id AND (y0 = y1) = (c = d) AND CASE WHEN y0 = y1 THEN abs(y0 - c) ELSE abs(x0 - a) END <= 0.15 + thickness_ft / 2)
SELECT DISTINCT sheet_id, wall_id, kind FROM (SELECT *, 'railing' AS kind FROM m WHERE thickness_ft <= 0.375 AND shared >= 0.6 * least(n, size) UNION ALL SELECT *, 'pool_edge' FROM m WHERE shared >= 0.6 * least(n, size) AND shared >= 0.8 * size)""")
def edge_walls(spark, sf):
    walls, edges = drawing(spark, sf, _THICK), drawing(spark, sf, _EDGES)
    pools = hosting.walls_along(walls, edges, None, hosting.POOL_SHARE)
    return hosting.walls_along(walls, edges).withColumn("kind", F.lit("railing")).unionByName(pools.withColumn("kind", F.lit("pool_edge")))


_SPACES = "SELECT CAST(c_nationkey AS BIGINT) AS sheet_id, c_custkey AS space_id, CAST(c_custkey * 37 % 1000 AS DOUBLE) / 10 AS x0, CAST(c_custkey * 91 % 1000 AS DOUBLE) / 10 AS y0, CAST(c_custkey * 37 % 1000 AS DOUBLE) / 10 + 6 AS x1, CAST(c_custkey * 91 % 1000 AS DOUBLE) / 10 + 4 AS y1 FROM customer"
_CLASSES = f"SELECT *, CASE box_id % 4 WHEN 0 THEN 'void' WHEN 1 THEN 'pool' WHEN 2 THEN 'room' END AS class FROM ({t.BOXES})"


@query(f"""WITH s AS ({_SPACES}), b AS ({_CLASSES}), f AS (SELECT space_id, min(box_id) AS box_id FROM s JOIN b ON b.sheet_id = s.sheet_id AND (s.x0 + s.x1) / 2 > b.x0 AND (s.x0 + s.x1) / 2 < b.x1 AND (s.y0 + s.y1) / 2 > b.y0 AND (s.y0 + s.y1) / 2 < b.y1 GROUP BY 1)
SELECT s.sheet_id, s.space_id, coalesce(class, '') AS class FROM s LEFT JOIN f ON f.space_id = s.space_id LEFT JOIN b ON b.box_id = f.box_id""")
def carried_classes(spark, sf):
    return hosting.carry_classes(drawing(spark, sf, _SPACES), drawing(spark, sf, _CLASSES))


_HOSTS = "SELECT o_orderkey AS wall_id, CAST(o_orderkey % 7 + 6 AS DOUBLE) AS length_ft, o_custkey AS src FROM orders"
_SPANS = "SELECT l_orderkey AS wall_id, CASE l_linenumber % 3 WHEN 0 THEN 'door' WHEN 1 THEN 'opening' ELSE 'window' END AS kind, CAST(l_suppkey % 2 AS DOUBLE) AS sill_ft, CAST(l_partkey % 5 AS DOUBLE) AS lo, CAST(l_partkey % 5 + l_partkey % 4 AS DOUBLE) AS hi, l_partkey AS src FROM lineitem"


@query(f"""WITH w AS ({_HOSTS}), o AS (SELECT s.wall_id, lo, least(hi, length_ft) AS hi, s.src FROM ({_SPANS}) s JOIN ({_HOSTS}) h ON h.wall_id = s.wall_id WHERE kind <> 'window' AND sill_ft = 0 AND hi > lo),
c AS (SELECT wall_id, CAST(0 AS DOUBLE) AS lo FROM w UNION SELECT wall_id, length_ft FROM w UNION SELECT wall_id, lo FROM o UNION SELECT wall_id, hi FROM o),
p AS (SELECT wall_id, lo, lead(lo) OVER (PARTITION BY wall_id ORDER BY lo) AS hi FROM c),
u AS (SELECT p.wall_id, p.lo, p.hi, w.src, NULL AS more FROM p JOIN w ON w.wall_id = p.wall_id WHERE p.hi IS NOT NULL UNION ALL SELECT p.wall_id, p.lo, p.hi, o.src, 1 FROM p JOIN o ON o.wall_id = p.wall_id AND (p.lo + p.hi) / 2 BETWEEN o.lo AND o.hi WHERE p.hi IS NOT NULL)
SELECT wall_id, lo, hi, count(more) > 0 AS virtual, string_agg(DISTINCT src, ',' ORDER BY src) AS sources FROM u GROUP BY 1, 2, 3""")
def virtual_openings(spark, sf):
    walls, openings = (drawing(spark, sf, s).withColumn("source_ids", F.array("src")).drop("src") for s in (_HOSTS, _SPANS))
    return hosting.virtual_pieces(walls, openings).select("wall_id", "lo", "hi", "virtual", F.array_join("source_ids", ",").alias("sources"))


_ITEMS = f"SELECT sheet_id, point_id AS item_id, x, y FROM ({t.POINTS})"
_BOUNDS = f"SELECT sheet_id, min(x0) AS x0, min(y0) AS y0, max(x1) + sheet_id * 9 AS x1, max(y1) AS y1 FROM ({t.BOXES}) GROUP BY sheet_id"


@query(f"""WITH b AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM ({_BOUNDS})), z AS (SELECT b.*, 40 * pow(1.25, k) AS size FROM b, range(0, 60) r(k)),
n AS (SELECT *, CASE WHEN w <= size THEN 1 ELSE ceil((w - size) / (size * 0.85)) + 1 END AS nx, CASE WHEN h <= size THEN 1 ELSE ceil((h - size) / (size * 0.85)) + 1 END AS ny FROM z),
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY size) AS i FROM n WHERE nx * ny <= 8) WHERE i = 1),
k AS (SELECT q.*, k, k % CAST(nx AS BIGINT) AS ix, k // CAST(nx AS BIGINT) AS iy FROM q, range(0, 8) r(k) WHERE k < nx * ny),
a AS (SELECT sheet_id, k, CASE WHEN nx > 1 THEN x0 + ix * (w - size) / (nx - 1) ELSE x0 END AS a, CASE WHEN ny > 1 THEN y0 + iy * (h - size) / (ny - 1) ELSE y0 END AS b, least(w, size) AS tw, least(h, size) AS th FROM k),
d AS (SELECT p.sheet_id, item_id, k, x BETWEEN a AND a + tw AND y BETWEEN b AND b + th AS holds, round(sqrt((x - a - tw / 2) ** 2 + (y - b - th / 2) ** 2), 9) AS away FROM ({_ITEMS}) p JOIN a ON a.sheet_id = p.sheet_id)
SELECT sheet_id, item_id, coalesce(min(k) FILTER (holds), arg_min(k, (away, k))) AS tile FROM d GROUP BY 1, 2""")
def tile_assignment(spark, sf):
    return hosting.tile_of(drawing(spark, sf, _ITEMS), drawing(spark, sf, _BOUNDS))


_SIZED = f"SELECT sheet_id, box_id AS label_id, floor(x0) + 0.5 AS x, floor(y0) / 2 + 0.25 AS y, CAST(box_id % 9 + 4 AS DOUBLE) AS width, CAST(box_id % 5 + 3 AS DOUBLE) AS height FROM ({t.BOXES})"
_UPRIGHT = "SELECT DISTINCT l_orderkey % 25 AS sheet_id, CAST(l_partkey % 200 AS DOUBLE) AS pos, CAST(l_suppkey % 50 AS DOUBLE) AS lo, CAST(l_suppkey % 50 + 5 AS DOUBLE) + l_linenumber AS hi FROM lineitem WHERE l_linenumber > 3"
_LEVEL = "SELECT DISTINCT l_orderkey % 25 AS sheet_id, CAST(l_suppkey % 60 AS DOUBLE) AS pos, CAST(l_partkey % 200 AS DOUBLE) AS lo, CAST(l_partkey % 200 + 5 AS DOUBLE) + l_linenumber AS hi FROM lineitem WHERE l_linenumber <= 3"


@query(f"""WITH s AS ({_SIZED}), v AS (SELECT DISTINCT label_id, pos, pos > x AS up, abs(pos - x) AS away FROM s JOIN ({_UPRIGHT}) l ON l.sheet_id = s.sheet_id AND y BETWEEN lo AND hi),
h AS (SELECT DISTINCT label_id, pos, pos > y AS up, abs(pos - y) AS away FROM s JOIN ({_LEVEL}) l ON l.sheet_id = s.sheet_id AND x BETWEEN lo AND hi),
a AS (SELECT *, row_number() OVER (PARTITION BY label_id, up ORDER BY away) AS i FROM v), b AS (SELECT *, row_number() OVER (PARTITION BY label_id, up ORDER BY away) AS i FROM h),
c AS (SELECT s.sheet_id, s.label_id, l.pos AS x0, d.pos AS y0, r.pos AS x1, u.pos AS y1, l.i AS li, r.i AS ri, d.i AS di, u.i AS ui, round(least(abs(r.pos - l.pos - width) + abs(u.pos - d.pos - height), abs(r.pos - l.pos - height) + abs(u.pos - d.pos - width)), 6) AS error
  FROM s JOIN a l ON l.label_id = s.label_id AND NOT l.up AND l.i <= 5 JOIN a r ON r.label_id = s.label_id AND r.up AND r.i <= 5 JOIN b d ON d.label_id = s.label_id AND NOT d.up AND d.i <= 5 JOIN b u ON u.label_id = s.label_id AND u.up AND u.i <= 5)
SELECT sheet_id, label_id, error, x0, y0, x1, y1 FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY error, li, ri, di, ui) AS k FROM c) WHERE k = 1""")
def sized_label_regions(spark, sf):
    return hosting.sized_regions(drawing(spark, sf, _SIZED), drawing(spark, sf, _UPRIGHT), drawing(spark, sf, _LEVEL))


_FLOORS = "SELECT s_suppkey % 9 AS building_id, s_suppkey AS floor_id, CASE s_suppkey % 5 WHEN 0 THEN false WHEN 1 THEN true END AS approved FROM supplier"
_MODELS = "SELECT s_suppkey AS floor_id, CASE WHEN s_suppkey % 9 = 4 THEN CAST(9 + s_suppkey % 2 AS DOUBLE) ELSE 10.0 END AS wall_height_ft FROM supplier WHERE s_suppkey % 9 <> 2 AND s_suppkey % 4 > 0"


@query(f"""SELECT building_id, count(m.floor_id) AS n_assembled, coalesce(string_agg(f.floor_id, ',' ORDER BY f.floor_id) FILTER (m.floor_id IS NULL), '') AS missing, CASE WHEN min(wall_height_ft) = max(wall_height_ft) THEN min(wall_height_ft) END AS wall_height_ft,
  CASE WHEN count(m.floor_id) = 0 THEN 'nothing' WHEN count(DISTINCT wall_height_ft) > 1 THEN 'heights' ELSE 'built' END AS verdict FROM ({_FLOORS}) f LEFT JOIN ({_MODELS}) m ON m.floor_id = f.floor_id WHERE approved IS NULL OR approved GROUP BY 1""")
def assembled_buildings(spark, sf):
    return hosting.assemble_buildings(drawing(spark, sf, _FLOORS), drawing(spark, sf, _MODELS)).withColumn("missing", F.array_join("missing", ","))


_CHECKS = """SELECT p_partkey AS dim_id, CAST(p_size - 2 AS DOUBLE) AS expected_ft, CASE WHEN p_partkey % 9 > 0 THEN CAST(p_size - 2 AS DOUBLE) + CAST(p_partkey % 4 AS DOUBLE) / 8 END AS actual_ft,
  CAST(p_partkey % 4 AS DOUBLE) * 1.5 + CASE WHEN p_partkey % 11 = 0 THEN 0.25 ELSE 0.0 END AS error_in, CASE WHEN p_partkey % 5 > 0 THEN 'verified' ELSE 'failed' END AS status, CASE p_partkey % 3 WHEN 0 THEN 'Wall faces' WHEN 1 THEN 'source ends' ELSE 'the MODEL' END AS basis FROM part"""


@query(f"""WITH c AS (SELECT *, abs(actual_ft - expected_ft) * 12 AS e FROM ({_CHECKS})), i AS (SELECT dim_id, 'invalid_dimension' AS code FROM c WHERE actual_ft IS NOT NULL AND (expected_ft <= 0 OR actual_ft <= 0)
UNION ALL SELECT dim_id, 'dimension_residual_inconsistent' FROM c WHERE abs(e - error_in) > 0.00001 UNION ALL SELECT dim_id, 'model_dimension_gate_failed' FROM c WHERE e > 2.00000001
UNION ALL SELECT dim_id, 'dimension_unverified' FROM c WHERE actual_ft IS NULL OR status <> 'verified' OR basis = 'source ends')
SELECT 'error' AS severity, concat('dimension-', dim_id) AS entity, code FROM i""")
def dimension_issues(spark, sf):
    return validate.dimension_issues(drawing(spark, sf, _CHECKS))


_WHOLE = """SELECT s_suppkey AS sheet_id, CAST(s_suppkey % 6 AS DOUBLE) AS units_per_foot, CAST(s_suppkey % 5 AS DOUBLE) AS max_residual_in, s_suppkey % 3 = 0 AS scale_verified, CAST(s_suppkey % 4 AS DOUBLE) * 3 AS wall_height_ft,
  CASE WHEN s_suppkey % 7 > 0 THEN 1.5 END AS elevation_ft, s_suppkey % 2 = 0 AS footprint_verified, s_suppkey % 8 AS n_walls, s_suppkey % 3 AS n_profiles, s_suppkey % 5 AS n_spaces, s_suppkey % 4 AS n_footprints, s_suppkey % 6 AS n_checks, s_suppkey % 2 AS n_height_notes FROM supplier"""


@query(f"""WITH m AS ({_WHOLE}), i AS (SELECT sheet_id, 'error' AS severity, 'scale' AS part, 'invalid_scale' AS code FROM m WHERE units_per_foot <= 0 UNION ALL SELECT sheet_id, 'error', 'scale', 'scale_unverified' FROM m WHERE NOT scale_verified
UNION ALL SELECT sheet_id, 'error', 'scale', 'scale_gate_failed' FROM m WHERE max_residual_in > 2 UNION ALL SELECT sheet_id, 'error', 'model', 'empty_wall_model' FROM m WHERE n_walls + n_profiles = 0
UNION ALL SELECT sheet_id, 'error', 'model', 'invalid_wall_height' FROM m WHERE wall_height_ft <= 0 UNION ALL SELECT sheet_id, 'warn', 'model', 'wall_height_evidence_missing' FROM m WHERE n_height_notes = 0
UNION ALL SELECT sheet_id, CASE WHEN n_footprints > 0 THEN 'warn' ELSE 'error' END, 'model', 'no_spaces_detected' FROM m WHERE n_walls > 0 AND n_spaces = 0
UNION ALL SELECT sheet_id, 'error', 'model', 'footprint_unverified' FROM m WHERE n_footprints > 0 AND NOT footprint_verified UNION ALL SELECT sheet_id, 'error', 'model', 'missing_footprint' FROM m WHERE n_footprints = 0
UNION ALL SELECT sheet_id, 'error', 'dimensions', 'model_dimensions_unverified' FROM m WHERE n_checks = 0 UNION ALL SELECT sheet_id, 'warn', 'storey', 'assumed_elevation' FROM m WHERE elevation_ft IS NULL
UNION ALL SELECT sheet_id, 'warn', 'floors', 'assumed_slab_thickness' FROM m WHERE n_footprints > 0)
SELECT severity, concat('sheet-', sheet_id, '/', part) AS entity, code FROM i""")
def model_issues(spark, sf):
    return validate.model_issues(drawing(spark, sf, _WHOLE))


_JOINED = f"SELECT sheet_id, wall_id, x0, y0, x1, y1 FROM ({t.CROSS_WALLS}) UNION ALL SELECT sheet_id, wall_id + 10000000, x1, y1, x1, y1 + 3 FROM ({t.CROSS_WALLS})"
_JOINTS = f"SELECT sheet_id, wall_id AS junction_id, x1 + CASE WHEN wall_id % 6 = 0 THEN 1.0 ELSE 0.0 END AS x, y1 AS y, wall_id AS a, CASE wall_id % 5 WHEN 0 THEN wall_id WHEN 1 THEN 99999999 WHEN 2 THEN NULL ELSE wall_id + 10000000 END AS b FROM ({t.CROSS_WALLS})"


@query(f"""WITH w AS ({_JOINED}), j AS ({_JOINTS}), r AS (SELECT *, a AS id FROM j UNION ALL SELECT *, b FROM j WHERE b IS NOT NULL),
m AS (SELECT junction_id, a, b, count(*) - count(w.wall_id) AS missing, count(*) FILTER (x < x0 - 0.001 OR x > w.x1 + 0.001 OR y < y0 - 0.001 OR y > w.y1 + 0.001) AS off FROM r LEFT JOIN w ON w.sheet_id = r.sheet_id AND w.wall_id = r.id GROUP BY 1, 2, 3),
n AS (SELECT junction_id, CASE WHEN missing > 0 THEN 'invalid_junction_index' ELSE 'invalid_junction' END AS code, CASE WHEN missing > 0 THEN 1 WHEN b IS NULL OR a = b THEN 1 + off ELSE off END AS times FROM m)
SELECT 'error' AS severity, concat('junction-', junction_id) AS entity, code FROM n, range(0, 4) g(k) WHERE k < times""")
def junction_issues(spark, sf):
    ids = F.when(F.col("b").isNull(), F.array("a")).otherwise(F.array("a", "b"))
    return validate.junction_issues(drawing(spark, sf, _JOINTS).withColumn("wall_ids", ids), drawing(spark, sf, _JOINED))
