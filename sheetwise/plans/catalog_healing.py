"""Registered queries about residues and the sizes of instances."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.operators import healing
from sheetwise.plans.catalog import query
from sheetwise.sources.driver_tables import drawing

#: Chains of one to three residues at each site, arms at their nodes, some of them hosts, and arms that become one wall.
_SITES = "SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS sheet_id, CAST(c_custkey * 20 AS DOUBLE) AS x, CAST(c_custkey % 7 AS DOUBLE) AS y FROM customer"
_ARMS = (
    (0, "x", "y", "x + 0.00006", "y", "true", "false"), (1, "x + 0.00006", "y", "x + 0.00006", "y + 0.00005", "k % 3 > 0", "false"), (2, "x + 0.00006", "y + 0.00005", "x + 0.00013", "y + 0.00005", "k % 3 = 2", "false"),
    (3, "x - 5", "y", "x", "y", "true", "false"), (4, "x + 0.00006", "y", "x + 0.00006", "y - 6", "k % 2 = 0", "k % 5 = 0"), (5, "x + 0.00006", "y + 0.00005", "x + 8", "y + 0.00005", "k % 3 > 0", "false"),
    (6, "x + 0.00013", "y + 0.00005", "x + 0.00013", "y + 7", "k % 3 = 2", "k % 7 = 0"), (7, "x", "y", "x - 3", "y + 4", "k % 4 = 1", "false"), (8, "x", "y", "x + 2", "y + 9", "k % 4 = 0", "false"), (9, "x + 0.00006", "y", "x + 2", "y + 9", "k % 4 = 0", "false"),
)
_SPLINTERS = " UNION ALL ".join(
    f"SELECT k, sheet_id, k * 10 + {n} AS wall_id, {a} AS x0, {b} AS y0, {c} AS x1, {d} AS y1, CAST(0.5 AS DOUBLE) AS thickness_ft, CASE WHEN {n} % 2 = 0 THEN 'A' ELSE 'B' END AS layer, {host} AS host, k * 10 + {n} AS src FROM ({_SITES}) WHERE {when}"
    for n, a, b, c, d, when, host in _ARMS
)

_TURNED = "k, sheet_id, wall_id, CASE WHEN (x1, y1) < (x0, y0) THEN x1 ELSE x0 END AS x0, CASE WHEN (x1, y1) < (x0, y0) THEN y1 ELSE y0 END AS y0, CASE WHEN (x1, y1) < (x0, y0) THEN x0 ELSE x1 END AS x1, CASE WHEN (x1, y1) < (x0, y0) THEN y0 ELSE y1 END AS y1, thickness_ft, layer, host, sources"


@query(f"""WITH RECURSIVE s AS (SELECT 0 AS i, {_TURNED} FROM (SELECT *, [src] AS sources FROM ({_SPLINTERS}))
UNION ALL (WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY x0, y0, x1, y1, layer, sources) AS n FROM s WHERE sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) < 0.0001) WHERE n = 1),
  e AS (SELECT k, x, y, count(*) AS degree, bool_or(host) AS host FROM (SELECT k, x0 AS x, y0 AS y, host FROM s UNION ALL SELECT k, x1, y1, host FROM s) GROUP BY 1, 2, 3),
  c AS (SELECT f.k, f.wall_id, e.x, e.y, row_number() OVER (PARTITION BY f.k ORDER BY NOT e.host, -e.degree, e.x, e.y) AS n FROM f JOIN e ON e.k = f.k AND ((e.x = f.x0 AND e.y = f.y0) OR (e.x = f.x1 AND e.y = f.y1))),
  v AS (SELECT a.k, a.wall_id, a.x AS tx, a.y AS ty, b.x AS fx, b.y AS fy FROM c a JOIN c b ON b.k = a.k AND b.n = 2 WHERE a.n = 1),
  m AS (SELECT i, s.k, sheet_id, s.wall_id, CASE WHEN x0 = fx AND y0 = fy THEN tx ELSE x0 END AS x0, CASE WHEN x0 = fx AND y0 = fy THEN ty ELSE y0 END AS y0, CASE WHEN x1 = fx AND y1 = fy THEN tx ELSE x1 END AS x1, CASE WHEN x1 = fx AND y1 = fy THEN ty ELSE y1 END AS y1, thickness_ft, layer, host, sources
        FROM s LEFT JOIN v ON v.k = s.k WHERE v.wall_id IS NULL OR v.wall_id <> s.wall_id)
  SELECT min(i) + 1, k, sheet_id, arg_min(wall_id, (layer, sources)), x0, y0, x1, y1, thickness_ft, arg_min(layer, (layer, sources)), arg_min(host, (layer, sources)), list_sort(list_distinct(flatten(list(sources))))
  FROM (SELECT i, {_TURNED} FROM m) WHERE EXISTS (SELECT 1 FROM f) AND sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) > 1e-9 GROUP BY k, sheet_id, x0, y0, x1, y1, thickness_ft))
SELECT sheet_id, wall_id, x0, y0, x1, y1, layer, host, array_to_string(sources, ',') AS sources FROM s WHERE i = (SELECT max(i) FROM s)""")
def contracted_walls(spark, sf):
    walls = drawing(spark, sf, _SPLINTERS).withColumn("source_ids", F.array("src"))
    return healing.contract_residue(walls)[0].select("sheet_id", "wall_id", "x0", "y0", "x1", "y1", "layer", "host", F.array_join("source_ids", ",").alias("sources"))


#: Instances of one to seven points, each line a part; some points lie on one line and some are equal.
_MEMBERS = """SELECT l_orderkey AS symbol_id, l_orderkey % 30 AS sheet_id, CASE l_orderkey % 7 WHEN 0 THEN 'door' WHEN 1 THEN 'column' WHEN 2 THEN 'beam' WHEN 3 THEN 'vehicle' WHEN 4 THEN 'stair' WHEN 5 THEN 'electrical' ELSE 'compass' END AS kind,
  CASE WHEN l_orderkey % 5 = 0 THEN CAST(l_partkey % 9 AS DOUBLE) / 4 ELSE CAST(l_partkey % 40 AS DOUBLE) / 4 END AS x, CASE WHEN l_orderkey % 5 = 0 THEN CAST(l_partkey % 9 AS DOUBLE) / 2 ELSE CAST(l_suppkey % 30 AS DOUBLE) / 4 END AS y FROM lineitem"""


@query(f"""WITH p AS (SELECT DISTINCT * FROM ({_MEMBERS})), u AS (SELECT DISTINCT a.symbol_id, (b.x - a.x) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS ux, (b.y - a.y) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS uy FROM p a JOIN p b ON a.symbol_id = b.symbol_id AND (a.x, a.y) < (b.x, b.y)),
s AS (SELECT p.symbol_id, ux, uy, min(x * ux + y * uy) AS l0, max(x * ux + y * uy) AS l1, min(y * ux - x * uy) AS a0, max(y * ux - x * uy) AS a1 FROM p JOIN u ON u.symbol_id = p.symbol_id GROUP BY 1, 2, 3),
r AS (SELECT *, round((l1 - l0) * (a1 - a0), 6) AS area, CASE WHEN l1 - l0 >= a1 - a0 THEN atan2(uy, ux) ELSE atan2(ux, -uy) END AS turn FROM s),
v AS (SELECT *, CASE WHEN round(turn - floor(turn / pi()) * pi(), 9) >= 3.141592653 THEN 0 ELSE round(turn - floor(turn / pi()) * pi(), 9) END AS way FROM r),
t AS (SELECT *, CASE WHEN abs(l1 - l0 - a1 + a0) < 1e-9 THEN round(way - floor(way / 1.570796326) * 1.570796326, 6) ELSE way END AS angle FROM v),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY area, angle, greatest(l1 - l0, a1 - a0)) AS n FROM t),
g AS (SELECT sheet_id, symbol_id, kind, min(x) AS px, min(y) AS py FROM p GROUP BY ALL),
d AS (SELECT g.sheet_id, g.symbol_id, g.kind, coalesce(round(greatest(l1 - l0, a1 - a0), 9), 0) AS width_ft, coalesce(round(least(l1 - l0, a1 - a0), 9), 0) AS depth_ft, coalesce(angle, 0) AS angle,
  round(coalesce(((l0 + l1) * ux - (a0 + a1) * uy) / 2, px), 6) + 0.0 AS x, round(coalesce(((l0 + l1) * uy + (a0 + a1) * ux) / 2, py), 6) + 0.0 AS y FROM g LEFT JOIN b ON b.symbol_id = g.symbol_id AND n = 1)
SELECT *, width_ft > 0 AND CASE kind WHEN 'door' THEN width_ft BETWEEN 0.8 AND 14 WHEN 'column' THEN width_ft BETWEEN 0.2 AND 8 AND depth_ft >= 0.15 AND width_ft <= 5 * greatest(depth_ft, 0.000001) WHEN 'beam' THEN width_ft BETWEEN 0.3 AND 100 AND depth_ft > 0
  WHEN 'vehicle' THEN width_ft BETWEEN 2 AND 35 WHEN 'stair' THEN width_ft BETWEEN 1 AND 50 WHEN 'electrical' THEN width_ft BETWEEN 0.05 AND 10 ELSE false END AS accepted FROM d""")
def instance_sizes(spark, sf):
    parts = drawing(spark, sf, _MEMBERS).withColumn("points", F.array(F.struct("x", "y")))
    return healing.measure_instances(parts)
