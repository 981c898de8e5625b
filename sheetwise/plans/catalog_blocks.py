"""Registered queries about what walls touch, and about levels. Sites have squares, stars, paths, and squares with a long wall between them; the
SQL knows the loops of each and measures them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.operators import blocks, faces
from sheetwise.plans.catalog import query
from sheetwise.sources import driver_tables as t
from sheetwise.sources.driver_tables import drawing

_SITES = "SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS sheet_id, CAST(c_custkey % 40 * 60 AS DOUBLE) AS x, CAST(floor(c_custkey / 40) * 60 AS DOUBLE) AS y, CAST(c_custkey % 5 + 5 AS DOUBLE) AS s, CAST(c_custkey % 3 + 3 AS DOUBLE) / 8 AS t FROM customer"
#: Walls of a site by its kind k % 4, and the loop (0 or 1, null for none) that each lies in; the long wall lies in both.
_PLAN = (
    *((0, n, f"{n % 2}", *c, "0", None) for n, c in enumerate((("0", "0", "s", "0"), ("s", "0", "s", "s"), ("s", "s", "0", "s"), ("0", "s", "0", "0")))), (0, 4, "5", "s", "0", "s + 3", "0", "0", None),
    *((1, n, f"{n}", "0", "0", *c, "0", None) for n, c in enumerate((("s / 2", "0"), ("0", "s / 2"), ("-s / 2", "-1.0")))), *((2, n, "7", *c, None, None) for n, c in enumerate((("0", "0", "s", "0"), ("s", "0", "s", "s"), ("s + 20", "0", "s + 24", "0")))),
    *((3, n, f"{n}", *c, "0", None) for n, c in enumerate((("0", "0", "3.0", "0"), ("3.0", "0", "3.0", "3.0"), ("3.0", "3.0", "0", "3.0"), ("0", "3.0", "0", "0")))), (3, 4, "9", "3.0", "0", "3.0 + s", "0", "0", "1"),
    *((3, 5 + n, f"{n}", *c, "1", None) for n, c in enumerate((("3.0 + s", "0", "6.0 + s", "0"), ("6.0 + s", "0", "6.0 + s", "3.0"), ("6.0 + s", "3.0", "3.0 + s", "3.0"), ("3.0 + s", "3.0", "3.0 + s", "0")))),
)
_WALLS = " UNION ALL ".join(f"SELECT sheet_id, k, k * 10 + {n} AS wall_id, x + {a} AS x0, y + {b} AS y0, x + {c} AS x1, y + {d} AS y1, t AS thickness_ft, CASE WHEN k % 6 = 3 THEN k ELSE k * 10 + {src} END AS src FROM ({_SITES}) WHERE k % 4 = {kind}" for kind, n, src, a, b, c, d, *_ in _PLAN)
_LOOPS = " UNION ALL ".join(f"SELECT k * 10 + {n} AS wall_id, k * 2 + {loop} AS loop FROM ({_SITES}) WHERE k % 4 = {kind}" for kind, n, *_, one, two in _PLAN for loop in (one, two) if loop)


@query(f"""WITH w AS MATERIALIZED ({_WALLS}), l AS ({_LOOPS}),
b AS (SELECT loop, greatest(max(greatest(x0, x1)) - min(least(x0, x1)), max(greatest(y0, y1)) - min(least(y0, y1))) AS extent FROM l JOIN w ON w.wall_id = l.wall_id GROUP BY 1),
c AS (SELECT wall_id, max(CASE WHEN extent >= 10 THEN 1 ELSE -1 END) AS closure FROM l JOIN b ON b.loop = l.loop GROUP BY 1),
e AS (SELECT k, wall_id, src, thickness_ft, 0 AS n, x0 AS x, y0 AS y FROM w UNION ALL SELECT k, wall_id, src, thickness_ft, 1, x1, y1 FROM w),
d AS (SELECT e.wall_id, e.n, sqrt((e.x - o.x0 - u * (o.x1 - o.x0)) ** 2 + (e.y - o.y0 - u * (o.y1 - o.y0)) ** 2) AS away, greatest(e.thickness_ft, o.thickness_ft) AS t, e.src <> o.src AS other FROM
  (SELECT e.*, o.wall_id AS oid, greatest(0, least(1, ((e.x - o.x0) * (o.x1 - o.x0) + (e.y - o.y0) * (o.y1 - o.y0)) / ((o.x1 - o.x0) ** 2 + (o.y1 - o.y0) ** 2))) AS u FROM e JOIN w o ON o.k = e.k AND o.wall_id <> e.wall_id) e JOIN w o ON o.wall_id = e.oid),
j AS (SELECT wall_id, count(DISTINCT n) AS ends FROM d WHERE away <= t + 1.0::DOUBLE / 12 + 1e-12 AND other GROUP BY 1)
SELECT w.sheet_id, w.wall_id, CASE coalesce(ends, 0) WHEN 0 THEN -1.0::DOUBLE WHEN 1 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS connectivity, CAST(coalesce(closure, 0) AS DOUBLE) AS closure, CASE WHEN abs(thickness_ft - 0.5) <= 0.01 THEN 1.0::DOUBLE ELSE -0.5::DOUBLE END AS thickness
FROM w LEFT JOIN j ON j.wall_id = w.wall_id LEFT JOIN c ON c.wall_id = w.wall_id""")
def wall_signals(spark, sf):
    walls = drawing(spark, sf, _WALLS).withColumn("source_ids", F.array("src")).drop("src", "k")
    return blocks.wall_signals(walls, (0.5,), 0.01)


#: A hierarchy with short cuts from regions to customers and from nations to orders, which must not shorten a level.
_SHORTCUTS = f"""SELECT parent AS upper, child AS lower FROM ({t.HIERARCHY}) UNION ALL SELECT concat('r', n_regionkey), concat('c', c_custkey) FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT DISTINCT concat('n', c_nationkey), concat('o', o_orderkey) FROM orders JOIN customer ON c_custkey = o_custkey"""


@query(f"""WITH RECURSIVE e AS MATERIALIZED ({_SHORTCUTS}), walk(node, level) AS (SELECT upper, 0 FROM e WHERE upper NOT IN (SELECT lower FROM e) UNION SELECT e.lower, walk.level + 1 FROM walk JOIN e ON e.upper = walk.node)
SELECT node, max(level) AS level FROM walk GROUP BY node""")
def longest_levels(spark, sf):
    return faces.joint_levels(drawing(spark, sf, _SHORTCUTS))
