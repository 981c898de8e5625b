"""Registered query about templates. Which instances are there follows from how the shapes are made, and the SQL says that."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.operators import templates
from sheetwise.plans.catalog import query
from sheetwise.sources.driver_tables import drawing

#: Instances at sites 20 ft apart: one of three designs, turned by k % 4 right angles. Flaws by k: mirrored, a part missing,
#: a part off by less or by more than the tolerance, a source with a part of its own, and a stray copy of one part.
_SITES = """SELECT k, sheet_id, x, y, design, k % 4 AS quarter, k % 7 = 3 AS mirrored, k % 13 = 7 AS lacks, CASE WHEN k % 17 = 3 THEN 0.02 WHEN k % 5 = 1 THEN 0.004 ELSE 0.0 END AS off, k % 11 = 5 AS more, k % 23 = 9 AS stray
FROM (SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS sheet_id, CAST(c_custkey % 50 * 20 AS DOUBLE) AS x, CAST(floor(c_custkey / 50) * 20 AS DOUBLE) AS y, c_custkey % 3 AS design FROM customer) s"""
#: Designs: parts by number, the source they belong to (0 or 1), category and points. The second has two parts in one place.
_DESIGNS = (
    (0, 0, 0, "path", [(0, 0), (2, 0), (2, 1)]), (0, 1, 0, "path", [(0, 0), (0, 1.5)]), (0, 2, 1, "closed", [(3, 0.5), (3.5, 0.5), (3.5, 1), (3, 1), (3, 0.5)]),
    (1, 0, 0, "path", [(0, 0), (3, 0), (3, 0.5)]), (1, 1, 0, "path", [(1, 1), (2.25, 1)]), (1, 2, 1, "path", [(1, 1), (2.25, 1)]),
    (2, 0, 0, "curve", [(0, 0), (1, 0.5), (2, 2), (2, 3)]), (2, 1, 0, "closed", [(4, 0), (5, 0), (4, 2), (4, 0)]), (2, 2, 1, "path", [(0, -1), (2, -1.5)]),
)
_EXTRA = ((8, 0, "more", "path", [(0, 6), (1, 6)]), (9, 2, "stray", "path", [(6, 0), (6, 1.5)]))


def _shape(points, off="0.0") -> str:
    return "array(" + ", ".join(f"struct(CAST({px} + {off} AS DOUBLE) AS x, CAST({py} AS DOUBLE) AS y)" for px, py in points) + ")"


_PARTS = " UNION ALL ".join(
    f"SELECT sheet_id, k, k * 10 + {n} AS part_id, k * 10 + {source} AS source_id, 'SYM' AS layer, '{category}' AS category, x, y, quarter, mirrored, {_shape(points, 'off' if n == 2 else '0.0')} AS plan FROM ({_SITES}) WHERE design = {design} AND NOT (lacks AND {n} = 1)"
    for design, n, source, category, points in _DESIGNS
) + "".join(f" UNION ALL SELECT sheet_id, k, k * 10 + {n}, k * 10 + {source}, 'SYM', '{category}', x, y, quarter, mirrored, {_shape(points)} FROM ({_SITES}) WHERE {flag}" for n, source, flag, category, points in _EXTRA)
_GOOD = f"SELECT *, design AS d FROM ({_SITES}) WHERE NOT mirrored AND NOT lacks AND NOT more AND off < 0.01"
_FIRST = f"SELECT sheet_id, design, min(k) AS seed FROM ({_GOOD}) WHERE off = 0 GROUP BY sheet_id, design"
_SEEDS = " UNION ALL ".join(f"SELECT sheet_id, design AS template_id, 'furniture' AS kind, seed * 10 + {n} AS part_id FROM ({_FIRST}) WHERE design = {design}" for design, n, *_ in _DESIGNS)


@query(f"""SELECT g.sheet_id, CAST(g.design AS BIGINT) AS template_id, 'furniture' AS kind, CAST((g.k % 4 - f.seed % 4 + 4) % 4 * 90 AS DOUBLE) AS angle, concat(g.k * 10, ',', g.k * 10 + 1) AS sources, CAST(3 AS BIGINT) AS n_parts, 'found' AS verdict
FROM ({_GOOD}) g JOIN ({_FIRST}) f ON f.sheet_id = g.sheet_id AND f.design = g.design""")
def template_instances(spark, sf):
    turn = F.transform("plan", lambda p: F.struct(p["x"].alias("x"), F.when(F.col("mirrored"), -p["y"]).otherwise(p["y"]).alias("y")))
    quarter = lambda p, v: F.when(F.col("quarter") == 0, v[0]).when(F.col("quarter") == 1, v[1]).when(F.col("quarter") == 2, v[2]).otherwise(v[3])
    placed = F.transform("flat", lambda p: F.struct((F.col("x") + quarter(p, (p["x"], -p["y"], -p["x"], p["y"]))).alias("x"), (F.col("y") + quarter(p, (p["y"], p["x"], -p["y"], -p["x"]))).alias("y")))
    parts = drawing(spark, sf, _PARTS).withColumn("flat", turn).withColumn("points", placed).select("sheet_id", "part_id", "source_id", "layer", "category", "points")
    found = templates.match_templates(parts, drawing(spark, sf, _SEEDS))
    return found.withColumns({"template_id": F.col("template_id").cast("long"), "sources": F.array_join("sources", ",")})
