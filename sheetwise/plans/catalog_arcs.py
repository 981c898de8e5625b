"""Registered queries about chains of lines, the circles they fit, and swing doors."""

from __future__ import annotations

from sheetwise.operators import arcs
from sheetwise.plans.catalog import query
from sheetwise.sources.driver_tables import drawing

#: Polygons of n lines on a circle of radius r about sites 30 ft apart, from angle a over sweep w. Some have a point off the
#: circle, a branch at a node, no end (whole circles), or a sharp corner; leaves go from the centre to one end or both.
_SITES = """SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS sheet_id, CAST(c_custkey % 60 * 30 AS DOUBLE) AS x, CAST(floor(c_custkey / 60) * 30 AS DOUBLE) AS y, CAST(2 + c_custkey % 10 AS DOUBLE) / 2 AS r, CAST(c_custkey % 12 AS DOUBLE) / 2 AS a,
  CASE WHEN c_custkey % 11 = 4 THEN 6.283185307179586 ELSE CAST(CASE c_custkey % 5 WHEN 0 THEN 60 WHEN 1 THEN 120 WHEN 2 THEN 70 WHEN 3 THEN -90 ELSE 100 END AS DOUBLE) * 0.017453292519943295 END AS w, CASE WHEN c_custkey % 11 = 4 THEN 12 ELSE CAST(5 + c_custkey % 6 AS INT) END AS n,
  CASE WHEN c_custkey % 13 = 5 THEN 0.06 WHEN c_custkey % 13 = 6 THEN 0.01 ELSE 0.0 END AS off FROM customer"""
_STEPS = " UNION ALL ".join(f"SELECT {i} AS i" for i in range(12))
_AT = "x + (r + CASE WHEN {i} = 2 THEN off ELSE 0.0 END) * cos(a + w * ({i}) / n) AS {n}x, y + (r + CASE WHEN {i} = 2 THEN off ELSE 0.0 END) * sin(a + w * ({i}) / n) AS {n}y"
_POINTS = f"SELECT k, sheet_id, i, x, y, {_AT.format(i='i', n='p')}, {_AT.format(i='CASE WHEN k % 11 = 4 AND i = 11 THEN 0 ELSE i + 1 END', n='q')} FROM ({_SITES}) s, ({_STEPS}) t WHERE i < n"
_EDGES = f"""SELECT sheet_id, k * 20 + i AS edge_id, CASE WHEN k % 3 = i % 3 THEN qx ELSE px END AS x0, CASE WHEN k % 3 = i % 3 THEN qy ELSE py END AS y0, CASE WHEN k % 3 = i % 3 THEN px ELSE qx END AS x1, CASE WHEN k % 3 = i % 3 THEN py ELSE qy END AS y1 FROM ({_POINTS})
UNION ALL SELECT sheet_id, k * 20 + 15, px, py, x + 9, y + 9 FROM ({_POINTS}) WHERE i = 3 AND k % 7 = 2"""
_LEAVES = f"""SELECT sheet_id, k * 2 AS leaf_id, CASE WHEN k % 2 = 0 THEN x ELSE px END AS x0, CASE WHEN k % 2 = 0 THEN y ELSE py END AS y0, CASE WHEN k % 2 = 0 THEN px ELSE x END AS x1, CASE WHEN k % 2 = 0 THEN py ELSE y END AS y1 FROM ({_POINTS}) WHERE i = 0
UNION ALL SELECT p.sheet_id, p.k * 2 + 1, p.x, p.y, qx, qy FROM ({_POINTS}) p JOIN ({_SITES}) s ON s.k = p.k WHERE i = n - 1 AND p.k % 9 = 8"""
_FITTED = f"""WITH RECURSIVE h AS MATERIALIZED (SELECT sheet_id, edge_id, edge_id * 2 AS id, round(x0, 9) AS ax, round(y0, 9) AS ay, round(x1, 9) AS bx, round(y1, 9) AS b_y FROM ({_EDGES}) UNION ALL SELECT sheet_id, edge_id, edge_id * 2 + 1, round(x1, 9), round(y1, 9), round(x0, 9), round(y0, 9) FROM ({_EDGES})),
d AS (SELECT sheet_id, ax AS x, ay AS y FROM h GROUP BY ALL HAVING count(*) = 2),
f AS MATERIALIZED (SELECT o.id, i.id AS prev FROM h i JOIN h o ON o.sheet_id = i.sheet_id AND o.ax = i.bx AND o.ay = i.b_y AND o.edge_id <> i.edge_id JOIN d ON d.sheet_id = o.sheet_id AND d.x = o.ax AND d.y = o.ay
  WHERE (i.bx - i.ax) * (o.bx - o.ax) + (i.b_y - i.ay) * (o.b_y - o.ay) >= cos(radians(35)) * sqrt(((i.bx - i.ax) ** 2 + (i.b_y - i.ay) ** 2) * ((o.bx - o.ax) ** 2 + (o.b_y - o.ay) ** 2))),
c AS (SELECT id, id AS head, 0 AS place FROM h WHERE id NOT IN (SELECT id FROM f) UNION ALL SELECT f.id, c.head, c.place + 1 FROM c JOIN f ON f.prev = c.id),
l AS (SELECT head, min(edge_id) AS chain_id FROM c JOIN h ON h.id = c.id GROUP BY 1), m AS (SELECT chain_id, min(head) AS head FROM l GROUP BY 1),
e AS MATERIALIZED (SELECT h.sheet_id, chain_id, place, ax, ay, bx, b_y FROM m JOIN c ON c.head = m.head JOIN h ON h.id = c.id),
p AS (SELECT sheet_id, chain_id, place + 1 AS i, bx AS x, b_y AS y FROM e UNION ALL SELECT sheet_id, chain_id, 0, ax, ay FROM e WHERE place = 0),
a AS (SELECT *, avg(x) OVER v AS mx, avg(y) OVER v AS m_y, count(*) OVER v AS n FROM p WINDOW v AS (PARTITION BY chain_id)),
s AS (SELECT sheet_id, chain_id, n, mx, m_y, sum((x - mx) ** 2) AS xx, sum((y - m_y) ** 2) AS yy, sum((x - mx) * (y - m_y)) AS xy, sum((x - mx) * ((x - mx) ** 2 + (y - m_y) ** 2)) / 2 AS xr, sum((y - m_y) * ((x - mx) ** 2 + (y - m_y) ** 2)) / 2 AS yr FROM a WHERE n >= 5 GROUP BY ALL),
o AS (SELECT *, (xr * yy - yr * xy) / (xx * yy - xy * xy) + mx AS cx, (yr * xx - xr * xy) / (xx * yy - xy * xy) + m_y AS cy FROM s WHERE xx * yy - xy * xy > 1e-8 * (xx + yy) ** 2),
q AS (SELECT o.sheet_id, o.chain_id, o.n, cx, cy, i, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS far, atan2(y - cy, x - cx) AS angle, x, y FROM o JOIN p ON p.chain_id = o.chain_id),
t AS (SELECT *, angle - lag(angle) OVER v AS step, avg(far) OVER (PARTITION BY chain_id) AS radius FROM q WINDOW v AS (PARTITION BY chain_id ORDER BY i)),
u AS (SELECT *, CASE WHEN step > pi() THEN step - 2 * pi() WHEN step < -pi() THEN step + 2 * pi() ELSE step END AS turn FROM t),
g AS MATERIALIZED (SELECT sheet_id, chain_id, n AS n_points, round(cx, 6) + 0.0 AS x, round(cy, 6) + 0.0 AS y, round(max(radius), 6) AS radius, round(degrees(sum(turn)), 6) + 0.0 AS sweep, round(max(abs(far - radius)), 6) AS off, round(sqrt(avg((far - radius) ** 2)), 6) AS rms,
  abs(degrees(sum(turn))) BETWEEN 65 AND 115 AND max(radius) BETWEEN 1.5 AND 5 AND max(abs(far - radius)) <= 0.025 AND sqrt(avg((far - radius) ** 2)) <= 0.012 AND (min(turn) > 0 OR max(turn) < 0) AND degrees(max(abs(turn))) <= 35 AS arc, arg_min(x, i) AS fx, arg_min(y, i) AS fy, arg_max(x, i) AS lx, arg_max(y, i) AS ly FROM u GROUP BY sheet_id, chain_id, n, cx, cy)"""


@query(f"{_FITTED} SELECT sheet_id, chain_id, n_points, x, y, radius, sweep, off, rms, arc FROM g")
def arc_chains(spark, sf):
    return arcs.fit_arcs(arcs.chains(drawing(spark, sf, _EDGES))).drop("first", "last")


@query(f"""{_FITTED}, v AS (SELECT sheet_id, leaf_id, x0 AS hx, y0 AS hy, x1 AS px, y1 AS p_y FROM ({_LEAVES}) UNION ALL SELECT sheet_id, leaf_id, x1, y1, x0, y0 FROM ({_LEAVES})),
w AS (SELECT g.*, leaf_id, px, p_y, sqrt((hx - x) ** 2 + (hy - y) ** 2) AS hinge, sqrt((px - fx) ** 2 + (p_y - fy) ** 2) AS one, sqrt((px - lx) ** 2 + (p_y - ly) ** 2) AS two, sqrt((px - hx) ** 2 + (p_y - hy) ** 2) AS size FROM g JOIN v ON v.sheet_id = g.sheet_id WHERE arc),
z AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY round(hinge + least(one, two), 6), leaf_id) AS i, max(px) OVER (PARTITION BY chain_id) - min(px) OVER (PARTITION BY chain_id) AS dx, max(p_y) OVER (PARTITION BY chain_id) - min(p_y) OVER (PARTITION BY chain_id) AS d_y
  FROM w WHERE hinge <= 0.08 AND abs(size - radius) <= 0.08 AND least(one, two) <= 0.08)
SELECT sheet_id, chain_id, leaf_id, x, y, round(CASE WHEN one <= two THEN lx ELSE fx END, 6) + 0.0 AS tx, round(CASE WHEN one <= two THEN ly ELSE fy END, 6) + 0.0 AS ty FROM z WHERE i = 1 AND dx <= 0.1 AND d_y <= 0.1""")
def swing_doors(spark, sf):
    return arcs.swing_doors(arcs.fit_arcs(arcs.chains(drawing(spark, sf, _EDGES))), drawing(spark, sf, _LEAVES))
