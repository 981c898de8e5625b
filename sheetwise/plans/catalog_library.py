"""Registered queries about library templates at any scale. Which instances are there follows from how the shapes are made."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.operators import library
from sheetwise.plans.catalog import query
from sheetwise.sources.driver_tables import drawing

#: Designs with their larger side, allowed angles and mirroring; parts by number, source (0 or 1), category and points.
_DESIGNS = {
    0: (3.5, range(0, 360, 45), True, [(0, 0, "path", [(0, 0), (2, 0), (2, 1)]), (1, 0, "path", [(0, 0), (0, 1.5)]), (2, 1, "closed", [(3, 0.5), (3.5, 0.5), (3.5, 1), (3, 1), (3, 0.5)])]),
    1: (3.0, range(0, 360, 90), True, [(0, 0, "path", [(0, 0), (3, 0), (3, 0.5)]), (1, 0, "path", [(1, 1), (2.25, 1)]), (2, 1, "path", [(1, 1), (2.25, 1)])]),
    2: (5.0, range(0, 360, 45), False, [(0, 0, "curve", [(0, 0), (1, 0.5), (2, 2), (2, 3)]), (1, 0, "closed", [(4, 0), (5, 0), (4, 2), (4, 0)]), (2, 1, "path", [(0, -1), (2, -1.5)])]),
    3: (2.0, range(0, 360, 45), True, [(0, 0, "path", [(0, 0), (2, 0), (1, 0.5), (1, 1.5)])]),
}
_LOW, _HIGH = 2.26, 5.74
#: Instances at sites 20 ft apart, 2 to 6 ft large, turned by k % 8 steps. Flaws by k: mirrored, a part missing, stretched,
#: a part off by less or by more than the tolerance, a source with a part of its own.
_SITES = """SELECT k, sheet_id, x, y, design, CAST(2 + CAST(k % 9 AS DOUBLE) / 2 AS DOUBLE) AS sc, k % 8 AS turn, k % 7 = 3 AS mirrored, k % 13 = 7 AS lacks, CASE WHEN k % 19 = 4 THEN 1.3 ELSE 1.0 END AS wide,
  CASE WHEN k % 17 = 3 THEN 0.05 WHEN k % 5 = 1 THEN 0.01 ELSE 0.0 END AS off, k % 11 = 5 AS more
FROM (SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS sheet_id, CAST(c_custkey % 50 * 20 AS DOUBLE) AS x, CAST(floor(c_custkey / 50) * 20 AS DOUBLE) AS y, c_custkey % 3 AS design FROM customer) s"""
#: One stroke everywhere: all of a sheet's customers on sheets divisible by five, else one in four.
_STROKES = """SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS sheet_id, CAST(c_custkey % 50 * 20 AS DOUBLE) AS x, CAST(floor(c_custkey / 50) * 20 AS DOUBLE) AS y, 3 AS design,
  CAST(2 + CAST(c_custkey % 9 AS DOUBLE) / 2 AS DOUBLE) AS sc, floor(c_custkey / 4) % 8 AS turn, c_custkey % 7 = 3 AS mirrored, 1.0 AS wide, 0.0 AS off, c_custkey % 13 = 7 AS lacks, c_custkey % 11 = 5 AS more
FROM customer WHERE c_nationkey % 5 = 0 OR c_custkey % 4 = 1"""


def _shape(points, size=1.0, x="0.0") -> str:
    return "array(" + ", ".join(f"struct(CAST({px / size} + {x} AS DOUBLE) AS x, CAST({py / size} AS DOUBLE) AS y)" for px, py in points) + ")"


def _parts(designs, sites) -> str:
    own = [f"SELECT *, {n} AS no, k * 10 + {source} AS source_id, '{category}' AS category, {_shape(points, _DESIGNS[d][0], 'off' if n == 2 else '0.0')} AS plan FROM ({sites}) WHERE design = {d} AND NOT (lacks AND {n} = 1)" for d in designs for n, source, category, points in _DESIGNS[d][3]]
    return " UNION ALL ".join([*own, f"SELECT *, 8, k * 10, 'more', {_shape([(0, 2), (0.5, 2)])} FROM ({sites}) WHERE more"])


def _templates(spark, sf, designs):
    chosen = " UNION ALL ".join(f"SELECT CAST(r_regionkey AS BIGINT) AS template_id, 'fixture' AS kind, {_LOW} AS size_min, {_HIGH} AS size_max, array({', '.join(str(a) for a in _DESIGNS[d][1])}) AS angles, {_DESIGNS[d][2]} AS mirror FROM region WHERE r_regionkey = {d}" for d in designs)
    paths = " UNION ALL ".join(f"SELECT CAST(r_regionkey AS BIGINT) AS template_id, {n} AS path_no, '{category}' AS category, {_shape(points, _DESIGNS[d][0])} AS points FROM region WHERE r_regionkey = {d}" for d in designs for n, _, category, points in _DESIGNS[d][3])
    return drawing(spark, sf, chosen), drawing(spark, sf, paths)


def _matched(spark, sf, designs, sites, budget):
    turned = F.transform("plan", lambda p: F.struct((p["x"] * F.col("wide") * F.col("sc") * F.when(F.col("mirrored"), -1).otherwise(1)).alias("x"), (p["y"] * F.col("sc")).alias("y")))
    c, s = F.cos(F.radians(F.col("turn") * 45)), F.sin(F.radians(F.col("turn") * 45))
    placed = F.transform("flat", lambda p: F.struct((F.col("x") + p["x"] * c - p["y"] * s).alias("x"), (F.col("y") + p["x"] * s + p["y"] * c).alias("y")))
    parts = drawing(spark, sf, _parts(designs, sites)).withColumn("flat", turned).withColumn("points", placed)
    parts = parts.select("sheet_id", (F.col("k") * 10 + F.col("no")).alias("part_id"), "source_id", F.lit("SYM").alias("layer"), "category", "points")
    found = library.match_library(parts, *_templates(spark, sf, designs), budget)
    return found.withColumns({"sources": F.array_join("sources", ","), "scale": F.round("scale", 6)})


def _length(points) -> float:
    return sum(((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5 for (ax, ay), (bx, by) in zip(points, points[1:]))


def _stretched(points, size) -> str:
    """The length of a part at scale sc, stretched by ``wide`` along x."""
    return "sc * (" + " + ".join(f"sqrt(pow({(bx - ax) / size} * wide, 2) + pow({(by - ay) / size}, 2))" for (ax, ay), (bx, by) in zip(points, points[1:])) + ")"


def _outside(designs, sites) -> str:
    """Shapes of the anchor's kind that imply a size out of range, by sheet and template: the anchor is the rarest kind there,
    the longest of equals."""
    shapes = " UNION ALL ".join(f"SELECT sheet_id, '{category}' AS category, {len(points) - 1} AS n, {_stretched(points, _DESIGNS[d][0])} AS length FROM ({sites}) WHERE design = {d} AND NOT (lacks AND {no} = 1)" for d in designs for no, _, category, points in _DESIGNS[d][3])
    paths = " UNION ALL ".join(f"SELECT {d} AS template_id, {len(_DESIGNS[d][3])} AS n_parts, {no} AS path_no, '{category}' AS category, {len(points) - 1} AS n, {_length(points) / _DESIGNS[d][0]} AS unit" for d in designs for no, _, category, points in _DESIGNS[d][3])
    return f"""WITH shapes AS ({shapes}), paths AS ({paths}), counts AS (SELECT sheet_id, category, n, count(*) AS rivals FROM shapes GROUP BY ALL),
there AS (SELECT *, count(*) OVER (PARTITION BY sheet_id, template_id) AS n_here, row_number() OVER (PARTITION BY sheet_id, template_id ORDER BY rivals, unit DESC, path_no) AS r FROM paths JOIN counts USING (category, n)),
spot AS (SELECT t.sheet_id, t.template_id, s.length / t.unit AS scale FROM there t JOIN shapes s ON s.sheet_id = t.sheet_id AND s.category = t.category AND s.n = t.n WHERE r = 1 AND n_here = n_parts)"""


@query(f"""{_outside((0, 1, 2), _SITES)}
SELECT sheet_id, CAST(design AS BIGINT) AS template_id, 'fixture' AS kind, sc AS scale, CAST(turn * 45 AS DOUBLE) AS angle, mirrored, concat(k * 10, ',', k * 10 + 1) AS sources, CAST(3 AS BIGINT) AS n, 'found' AS verdict
FROM ({_SITES}) i WHERE NOT lacks AND wide = 1 AND off < 0.02 AND NOT more AND sc BETWEEN {_LOW} AND {_HIGH} AND (design <> 1 OR turn % 2 = 0) AND NOT (design = 2 AND mirrored)
  AND EXISTS (SELECT 1 FROM spot WHERE spot.sheet_id = i.sheet_id AND spot.template_id = i.design)
UNION ALL SELECT sheet_id, CAST(template_id AS BIGINT), 'fixture', NULL, NULL, NULL, NULL, count(*), 'out_of_range' FROM spot WHERE NOT scale BETWEEN {_LOW} AND {_HIGH} GROUP BY ALL""")
def library_instances(spark, sf):
    return _matched(spark, sf, (0, 1, 2), _SITES, None)


#: Within 40 trials on a sheet: all 16 orientations, else 10, 8, 5, 2 or 1 of them, else none.
_TRIALS = f"""spots AS (SELECT sheet_id, count(*) AS n FROM ({_STROKES}) s WHERE sc BETWEEN {_LOW} AND {_HIGH} GROUP BY ALL),
fit AS (SELECT sheet_id, n, CASE WHEN n * 16 <= 40 THEN 16 WHEN n * 10 <= 40 THEN 10 WHEN n * 8 <= 40 THEN 8 WHEN n * 5 <= 40 THEN 5 WHEN n * 2 <= 40 THEN 2 WHEN n <= 40 THEN 1 ELSE 0 END AS trials FROM spots)"""


@query(f"""{_outside((3,), _STROKES)}, {_TRIALS}
SELECT i.sheet_id, CAST(3 AS BIGINT) AS template_id, 'fixture' AS kind, sc AS scale, CAST(turn * 45 AS DOUBLE) AS angle, mirrored, concat(k * 10, '') AS sources, CAST(1 AS BIGINT) AS n, 'found' AS verdict
FROM ({_STROKES}) i JOIN fit ON fit.sheet_id = i.sheet_id WHERE sc BETWEEN {_LOW} AND {_HIGH} AND NOT more AND (NOT mirrored OR trials IN (16, 10, 2))
  AND (trials IN (16, 8) OR trials IN (10, 5) AND turn IN (0, 1, 2, 4, 6) OR trials IN (2, 1) AND turn = 0)
UNION ALL SELECT sheet_id, 3, 'fixture', NULL, NULL, NULL, NULL, count(*), 'out_of_range' FROM spot WHERE NOT scale BETWEEN {_LOW} AND {_HIGH} GROUP BY ALL
UNION ALL SELECT sheet_id, 3, 'fixture', NULL, NULL, NULL, NULL, CASE WHEN trials = 0 THEN n ELSE trials END, CASE WHEN trials = 0 THEN 'skipped' ELSE 'reduced' END FROM fit WHERE trials < 16""")
def library_budgets(spark, sf):
    return _matched(spark, sf, (3,), _STROKES, 40)
