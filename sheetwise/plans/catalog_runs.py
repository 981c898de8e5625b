"""Registered queries about wall runs: chains of walls, joints, connections and trimmed outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.operators import runs
from sheetwise.plans.catalog import query
from sheetwise.sources.driver_tables import drawing

#: Pieces of walls on the lines of a lattice of 5 ft: level, upright and slanting; some differ in thickness, height or class.
_PIECES = """SELECT min(k) AS wall_id, sheet_id, CAST(i * 5 AS DOUBLE) AS x0, CAST(j * 5 AS DOUBLE) AS y0, CAST(i * 5 + CASE WHEN o = 1 THEN 0 ELSE 5 END AS DOUBLE) AS x1, CAST(j * 5 + CASE WHEN o = 0 THEN 0 ELSE 5 END AS DOUBLE) AS y1,
  CAST(CASE WHEN min(k) % 19 = 0 THEN 1.0 WHEN o = 0 AND j % 2 = 0 THEN 0.75 ELSE 0.5 END AS DOUBLE) AS thickness_ft, 'A' AS layer, CASE WHEN min(k) % 23 = 0 THEN CAST(3 AS DOUBLE) END AS height_ft, CASE WHEN min(k) % 29 = 0 THEN 'railing' END AS wall_class
FROM (SELECT o_orderkey AS k, CAST(floor(o_orderkey / 400) AS BIGINT) AS sheet_id, o_custkey % 20 AS i, CAST(floor(o_totalprice) AS BIGINT) % 20 AS j, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE o_orderkey % 2 END AS o FROM orders) p GROUP BY sheet_id, i, j, o"""
_RUNS = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS size, (x1 - x0) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS ux, (y1 - y0) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS uy, coalesce(wall_class, '') <> 'railing' AS able FROM ({_PIECES})),
e AS MATERIALIZED (SELECT sheet_id, wall_id, x0 AS x, y0 AS y, true AS starts, ux AS dx, uy AS dy, able FROM w UNION ALL SELECT sheet_id, wall_id, x1, y1, false, -ux, -uy, able FROM w),
p AS MATERIALIZED (SELECT a.sheet_id, a.x1 AS x, a.y1 AS y, a.wall_id AS before, b.wall_id AS after FROM w a JOIN w b ON a.sheet_id = b.sheet_id AND a.x1 = b.x0 AND a.y1 = b.y0 AND abs(a.ux * b.uy - a.uy * b.ux) < 1e-7 AND a.able AND b.able AND a.thickness_ft = b.thickness_ft AND a.height_ft IS NOT DISTINCT FROM b.height_ft),
j AS MATERIALIZED (SELECT n.*, CASE WHEN n <> able THEN 'mixed' WHEN able = 2 AND pairs > 0 THEN 'chain' WHEN able = 2 AND level THEN 'step' WHEN able = 2 THEN 'L' WHEN able = 3 AND pairs = 1 THEN 'T' WHEN able = 4 AND pairs = 2 THEN 'X' ELSE 'tangle' END AS kind
  FROM (SELECT e.sheet_id, e.x, e.y, count(*) AS n, count(*) FILTER (able) AS able, abs(min(dx) FILTER (able) * 0 + (list(dx) FILTER (able))[1] * (list(dy) FILTER (able))[2] - (list(dy) FILTER (able))[1] * (list(dx) FILTER (able))[2]) < 1e-7 AS level FROM e GROUP BY 1, 2, 3 HAVING count(*) > 1) n
  LEFT JOIN (SELECT sheet_id, x, y, count(*) AS pairs FROM p GROUP BY 1, 2, 3) q USING (sheet_id, x, y)),
l AS (SELECT wall_id, wall_id AS head FROM w WHERE wall_id NOT IN (SELECT after FROM p) UNION ALL SELECT p.after, l.head FROM l JOIN p ON p.before = l.wall_id),
k AS MATERIALIZED (SELECT l.wall_id, r.* FROM l JOIN (SELECT head, -max(thickness_ft) AS t, -sum(size) AS s, min((x0, y0)) AS a, max((x1, y1)) AS b FROM l JOIN w USING (wall_id) GROUP BY 1) r ON r.head = l.head),
g AS MATERIALIZED (SELECT * FROM (SELECT p.*, kind, row_number() OVER (PARTITION BY p.sheet_id, p.x, p.y ORDER BY round(t, 6), round(s, 6), a, b) AS i FROM p JOIN j USING (sheet_id, x, y) JOIN k ON k.wall_id = p.before WHERE kind IN ('chain', 'T', 'X')) WHERE i = 1),
c AS (SELECT wall_id, wall_id AS head, 0 AS place FROM w WHERE wall_id NOT IN (SELECT after FROM g) UNION ALL SELECT g.after, c.head, c.place + 1 FROM c JOIN g ON g.before = c.wall_id),
m AS MATERIALIZED (SELECT w.sheet_id, c.wall_id, run_id, place, n_walls, ax, ay, bx, b_y, t FROM c JOIN w USING (wall_id) JOIN (SELECT head, min(wall_id) AS run_id, count(*) AS n_walls, (min((x0, y0)))[1] AS ax, (min((x0, y0)))[2] AS ay, (max((x1, y1)))[1] AS bx, (max((x1, y1)))[2] AS b_y, max(thickness_ft) AS t FROM c JOIN w USING (wall_id) GROUP BY 1) r ON r.head = c.head),
f AS MATERIALIZED (SELECT e.sheet_id, e.x, e.y, e.wall_id, e.dx, e.dy, run_id, ax, ay, bx, b_y, m.t, row_number() OVER (PARTITION BY e.sheet_id, e.x, e.y ORDER BY round(k.t, 6), round(k.s, 6), k.a, k.b, run_id) AS i, kind FROM e JOIN j USING (sheet_id, x, y) JOIN m ON m.wall_id = e.wall_id JOIN k ON k.wall_id = e.wall_id WHERE e.able),
z AS (SELECT g.*, b.run_id AS rb, b.ax AS bax, b.ay AS bay, b.bx AS bbx, b.b_y AS bby, b.t AS bt, b.dx AS bdx, b.dy AS bdy FROM f g JOIN f b ON b.sheet_id = g.sheet_id AND b.x = g.x AND b.y = g.y WHERE g.kind = 'L' AND g.i = 2 AND b.i = 1
  UNION ALL SELECT g.*, b.run_id, b.ax, b.ay, b.bx, b.b_y, b.t, b.dx, b.dy FROM f g JOIN g t ON t.sheet_id = g.sheet_id AND t.x = g.x AND t.y = g.y AND t.kind <> 'chain' JOIN f b ON b.sheet_id = g.sheet_id AND b.x = g.x AND b.y = g.y AND b.wall_id = t.before WHERE g.wall_id <> t.before AND g.wall_id <> t.after),
y AS MATERIALIZED (SELECT sheet_id, x, y, run_id AS relating, rb AS related, CASE WHEN x = ax AND y = ay THEN 'start' WHEN x = bx AND y = b_y THEN 'end' ELSE 'path' END AS relating_type, CASE WHEN x = bax AND y = bay THEN 'start' WHEN x = bbx AND y = bby THEN 'end' ELSE 'path' END AS related_type, abs(dx * bdy - dy * bdx) >= 0.025 AS joined FROM z)"""


@query(f"{_RUNS} SELECT sheet_id, wall_id, run_id, place, n_walls, ax, ay, bx, b_y AS by, t AS thickness_ft FROM m")
def wall_runs(spark, sf):
    return runs.build_runs(drawing(spark, sf, _PIECES))[0]


@query(f"{_RUNS} SELECT sheet_id, x, y, kind, relating, related, relating_type, related_type, joined FROM (SELECT sheet_id, x, y, kind FROM j) LEFT JOIN y USING (sheet_id, x, y)")
def run_joints(spark, sf):
    _, joints, connections = runs.build_runs(drawing(spark, sf, _PIECES))
    return joints.join(connections, ["sheet_id", "x", "y"], "left")


# each end of a run has one cut at most: corners slide along the run's faces to where they meet the cut; a run that stops isn't
# lengthened first, so a corner that the cut passes stays, and the cut crosses the end between both
_PLANES = """v AS (SELECT sheet_id, relating AS run_id, relating_type AS how, true AS stops, x + nx * side * t / 2 AS px, y + ny * side * t / 2 AS p_y, nx * side AS dx, ny * side AS d_y FROM
    (SELECT y.*, -(b.uy) AS nx, b.ux AS ny, b.t, CASE WHEN ((CASE WHEN relating_type = 'start' THEN g.bx ELSE g.ax END) - x) * -(b.uy) + ((CASE WHEN relating_type = 'start' THEN g.b_y ELSE g.ay END) - y) * b.ux >= 0 THEN 1 ELSE -1 END AS side
     FROM y JOIN r g ON g.run_id = relating JOIN r b ON b.run_id = related WHERE joined)
  UNION ALL SELECT sheet_id, related, related_type, false, x - nx * side * t / 2, y - ny * side * t / 2, nx * side, ny * side FROM
    (SELECT y.*, -(g.uy) AS nx, g.ux AS ny, g.t, CASE WHEN ((CASE WHEN related_type = 'start' THEN b.bx ELSE b.ax END) - x) * -(g.uy) + ((CASE WHEN related_type = 'start' THEN b.b_y ELSE b.ay END) - y) * g.ux >= 0 THEN 1 ELSE -1 END AS side
     FROM y JOIN r g ON g.run_id = relating JOIN r b ON b.run_id = related WHERE joined AND related_type <> 'path'))"""
_CORNER = "SELECT r.sheet_id, r.run_id, '{how}' AS how, {x} {s} uy * t / 2 AS cx, {y} {o} ux * t / 2 AS cy, ux, uy, stops, px, p_y, dx, d_y FROM r LEFT JOIN v ON v.run_id = r.run_id AND v.how = '{how}'"
_CORNERS = " UNION ALL ".join(_CORNER.format(x=x, y=y, s=s, o=o, how=how) for x, y, how in (("ax", "ay", "start"), ("bx", "b_y", "end")) for s, o in (("+", "-"), ("-", "+")))


@query(f"""{_RUNS}, r AS MATERIALIZED (SELECT DISTINCT sheet_id, run_id, ax, ay, bx, b_y, t, (bx - ax) / sqrt((bx - ax) ** 2 + (b_y - ay) ** 2) AS ux, (b_y - ay) / sqrt((bx - ax) ** 2 + (b_y - ay) ** 2) AS uy FROM m),
{_PLANES}, q AS (SELECT *, (cx - px) * dx + (cy - p_y) * d_y AS depth, -((cx - px) * dx + (cy - p_y) * d_y) / (ux * dx + uy * d_y) AS slide FROM ({_CORNERS})),
o AS (SELECT sheet_id, run_id, cx + CASE WHEN px IS NULL OR (stops AND depth >= 0) THEN 0 ELSE slide * ux END AS x, cy + CASE WHEN px IS NULL OR (stops AND depth >= 0) THEN 0 ELSE slide * uy END AS y FROM q
  UNION ALL SELECT a.sheet_id, a.run_id, a.cx + (b.cx - a.cx) * a.depth / (a.depth - b.depth), a.cy + (b.cy - a.cy) * a.depth / (a.depth - b.depth) FROM q a JOIN q b ON a.run_id = b.run_id AND a.how = b.how AND a.stops AND a.depth > 1e-12 AND b.depth < -1e-12)
SELECT sheet_id, run_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM o""")
def run_outlines(spark, sf):
    members, _, connections = runs.build_runs(drawing(spark, sf, _PIECES))
    at = lambda c: (F.round(F.col(f"p.{c}"), 6) + 0.0).alias(c)
    return runs.run_outlines(members, connections).select("sheet_id", "run_id", F.explode("ring").alias("p")).select("sheet_id", "run_id", at("x"), at("y"))
