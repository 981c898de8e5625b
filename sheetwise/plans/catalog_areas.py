"""Registered queries about clear areas and footprints, on rooms that are turned by right and by slanted angles. The SQL
reckons in each room's own frame, where all shapes are boxes: it adds up the boxes between all their edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.operators import areas
from sheetwise.plans.catalog import query
from sheetwise.sources.driver_tables import drawing

#: Rooms of w by h: their place, the turn (c, s), two stubs of walls inside, and a void.
_ROOMS = """SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS sheet_id, CAST(c_custkey % 40 * 50 AS DOUBLE) AS ox, CAST(floor(c_custkey / 40) * 50 AS DOUBLE) AS oy,
  CAST(CASE c_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.6 END AS DOUBLE) AS c, CAST(CASE c_custkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.6 ELSE 0.8 END AS DOUBLE) AS s, CAST(3 + c_custkey % 13 AS DOUBLE) AS w, CAST(2 + c_custkey % 17 AS DOUBLE) AS h,
  CAST(c_custkey % 4 + 2 AS DOUBLE) / 7 AS t, CAST(3 + c_custkey % 13 AS DOUBLE) / 2 AS a, CAST(2 + c_custkey % 17 AS DOUBLE) * (c_custkey % 5) / 4 AS b, CAST(2 + c_custkey % 17 AS DOUBLE) / 4 AS d, CAST(3 + c_custkey % 13 AS DOUBLE) / 4 AS e FROM customer"""
#: Centre lines in the room's frame: four sides, an upright stub on the lower side, a level one that may cross it, and one outside.
_LINES = f"""SELECT k, sheet_id, ox, oy, c, s, t, n, u0, v0, u1, v1 FROM (
  SELECT *, 0 AS n, 0.0 AS u0, 0.0 AS v0, w AS u1, 0.0 AS v1 FROM ({_ROOMS}) UNION ALL SELECT *, 1, w, 0.0, w, h FROM ({_ROOMS}) UNION ALL SELECT *, 2, w, h, 0.0, h FROM ({_ROOMS}) UNION ALL SELECT *, 3, 0.0, h, 0.0, 0.0 FROM ({_ROOMS})
  UNION ALL SELECT *, 4, a, 0.0, a, b FROM ({_ROOMS}) WHERE b > 0 UNION ALL SELECT *, 5, e, d, w - e / 2, d FROM ({_ROOMS}) WHERE k % 2 = 0 UNION ALL SELECT *, 6, w + 3, 1.0, w + 6, 1.0 FROM ({_ROOMS}) WHERE k % 4 = 0) x"""
_WALLS = f"SELECT sheet_id, k * 10 + n AS wall_id, ox + u0 * c - v0 * s AS x0, oy + u0 * s + v0 * c AS y0, ox + u1 * c - v1 * s AS x1, oy + u1 * s + v1 * c AS y1, t AS thickness_ft FROM ({_LINES})"
_CORNERS = ", ".join(f"ox + {u} * c - {v} * s AS x{n}, oy + {u} * s + {v} * c AS y{n}" for n, (u, v) in enumerate((("u0", "v0"), ("u1", "v0"), ("u1", "v1"), ("u0", "v1"))))
_CELLS = f"SELECT sheet_id, k AS cell_id, {_CORNERS} FROM (SELECT *, 0.0 AS u0, 0.0 AS v0, w AS u1, h AS v1 FROM ({_ROOMS})) x"
_HOLE = "w / 8 AS u0, h / 8 AS v0, w / 8 + 1 AS u1, h / 8 + 1.5 AS v1"
_VOIDS = f"SELECT sheet_id, {_CORNERS} FROM (SELECT *, {_HOLE} FROM ({_ROOMS}) WHERE k % 3 < 2) x"
#: All shapes as boxes of the room's frame; ends of sides reach round the corner by half a thickness.
_BOXES = f"""SELECT k, 'cell' AS kind, 0.0 AS a0, 0.0 AS b0, w AS a1, h AS b1 FROM ({_ROOMS}) UNION ALL SELECT k, 'hole', u0, v0, u1, v1 FROM (SELECT *, {_HOLE} FROM ({_ROOMS}) WHERE k % 3 < 2)
UNION ALL SELECT k, CASE WHEN n = 6 THEN 'loose' ELSE 'body' END, least(u0, u1) - CASE WHEN n < 4 OR u0 = u1 THEN t / 2 ELSE 0 END, least(v0, v1) - CASE WHEN n < 4 OR v0 = v1 THEN t / 2 ELSE 0 END,
  greatest(u0, u1) + CASE WHEN n < 4 OR u0 = u1 THEN t / 2 ELSE 0 END, greatest(v0, v1) + CASE WHEN n < 4 OR v0 = v1 THEN t / 2 ELSE 0 END FROM ({_LINES})"""
_GRID = f"""WITH b AS MATERIALIZED ({_BOXES}), xs AS (SELECT k, a0 AS x FROM b UNION SELECT k, a1 FROM b), ys AS (SELECT k, b0 AS y FROM b UNION SELECT k, b1 FROM b),
x AS (SELECT k, x AS x0, lead(x) OVER (PARTITION BY k ORDER BY x) AS x1 FROM xs), y AS (SELECT k, y AS y0, lead(y) OVER (PARTITION BY k ORDER BY y) AS y1 FROM ys),
g AS (SELECT x.k, x0, x1, y0, y1, bool_or(kind = 'cell') AS cell, bool_or(kind = 'body') AS body, bool_or(kind = 'hole') AS hole FROM x JOIN y ON y.k = x.k JOIN b ON b.k = x.k AND (x0 + x1) / 2 BETWEEN a0 AND a1 AND (y0 + y1) / 2 BETWEEN b0 AND b1 GROUP BY ALL),
r AS (SELECT k, CAST(c_nationkey AS BIGINT) AS sheet_id FROM (SELECT c_custkey AS k, c_nationkey FROM customer))"""


def _rings(spark, sf, sql, *columns):
    corners = F.array(*[F.struct(F.col(f"x{n}").alias("x"), F.col(f"y{n}").alias("y")) for n in range(4)])
    return drawing(spark, sf, sql).select(*columns, corners.alias("ring"))


@query(f"""{_GRID} SELECT sheet_id, g.k AS cell_id, round(sum((x1 - x0) * (y1 - y0)), 4) AS area FROM g JOIN r ON r.k = g.k WHERE cell AND NOT body AND NOT hole GROUP BY 1, 2 HAVING sum((x1 - x0) * (y1 - y0)) >= 10""")
def clear_room_areas(spark, sf):
    return areas.clear_areas(_rings(spark, sf, _CELLS, "sheet_id", "cell_id"), drawing(spark, sf, _WALLS), _rings(spark, sf, _VOIDS, "sheet_id"))


@query(f"""{_GRID} SELECT sheet_id, round(sum((x1 - x0) * (y1 - y0)), 4) AS area FROM g JOIN r ON r.k = g.k WHERE (cell OR body) AND NOT hole GROUP BY 1""")
def footprints(spark, sf):
    return areas.footprint_areas(_rings(spark, sf, _CELLS, "sheet_id", "cell_id"), drawing(spark, sf, _WALLS), _rings(spark, sf, _VOIDS, "sheet_id"))
