"""Registered queries about symbols from blocks, from layers, and from arcs with leaves. The shapes are boxes and lines whose
sizes follow from their site's number, which is what the SQL reckons with."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.operators import healing, symbols
from sheetwise.plans.catalog import query
from sheetwise.sources.driver_tables import drawing

_SITES = """SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS sheet_id, CAST(c_custkey % 50 * 30 AS DOUBLE) AS x, CAST(floor(c_custkey / 50) * 30 AS DOUBLE) AS y, CAST(c_custkey % 17 + 1 AS DOUBLE) / 2 AS w, CAST(c_custkey % 5 + 1 AS DOUBLE) / 4 AS d,
  CAST(c_custkey % 12 + 1 AS DOUBLE) / 2 AS a, CAST(c_custkey % 7 + 1 AS DOUBLE) / 2 AS b, CAST(c_custkey % 10 + 1 AS DOUBLE) / 4 AS c, CASE c_custkey % 4 WHEN 0 THEN 'A-FURN' WHEN 1 THEN 'misc' WHEN 2 THEN 'A-DOOR' ELSE '0' END AS layer,
  CASE WHEN c_custkey % 10 = 3 THEN '' ELSE CASE c_custkey % 7 WHEN 0 THEN 'Door 900' WHEN 1 THEN 'WIN 12' WHEN 2 THEN 'chair loose' WHEN 3 THEN 'COL C1' WHEN 4 THEN 'XREF' WHEN 5 THEN 'wc-1' ELSE 'car' END END AS block_name,
  CASE WHEN c_custkey % 10 = 3 THEN 'beam B2' END AS attributes FROM customer"""
#: Layers whose role a reviewer is sure of on every second sheet.
_ROLES = "SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS sheet_id, 'misc' AS layer, 'stair' AS role, CASE WHEN n_nationkey % 2 = 0 THEN 0.8 ELSE 0.5 END AS confidence FROM nation"
#: Blocks of three lines that span w by d, some with a block of their own inside, some partial.
_ENTITIES = f"""SELECT sheet_id, k * 100 AS entity_id, CAST(NULL AS BIGINT) AS parent_id, 'INSERT' AS kind, layer, block_name, attributes, k % 19 = 0 AS partial, x AS x0, y AS y0, x AS x1, y AS y1 FROM ({_SITES})
UNION ALL SELECT sheet_id, k * 100 + 1, k * 100, 'LINE', layer, NULL, NULL, false, x, y, x + w, y FROM ({_SITES}) UNION ALL SELECT sheet_id, k * 100 + 2, k * 100, 'LINE', layer, NULL, NULL, k % 13 = 0, x + w, y, x + w, y + d FROM ({_SITES})
UNION ALL SELECT sheet_id, k * 100 + 3, k * 100, 'LINE', layer, NULL, NULL, false, x, y + d, x, y FROM ({_SITES}) UNION ALL SELECT sheet_id, k * 100 + 10, k * 100, 'INSERT', '0', 'sink', NULL, false, x, y, x, y FROM ({_SITES}) WHERE k % 4 = 0
UNION ALL SELECT sheet_id, k * 100 + 11, k * 100 + 10, 'LINE', '0', NULL, NULL, false, x + 0.05, y + 0.05, x + 0.45, y + 0.2 FROM ({_SITES}) WHERE k % 4 = 0"""
_LAYER_KIND = "CASE layer WHEN 'A-FURN' THEN 'furniture' WHEN 'A-DOOR' THEN 'door' WHEN 'misc' THEN CASE WHEN sheet_id % 2 = 0 THEN 'stair' END END"
_NAME_KIND = "CASE WHEN k % 10 = 3 THEN 'beam' ELSE CASE k % 7 WHEN 0 THEN 'door' WHEN 1 THEN 'window' WHEN 2 THEN 'furniture' WHEN 3 THEN 'column' WHEN 5 THEN 'plumbing' WHEN 6 THEN 'vehicle' END END"
_FITS = (
    "(CASE kind "
    + " ".join(f"WHEN '{kind}' THEN width_ft BETWEEN {low} AND {high}" for kind, (low, high) in healing.WIDTHS_FT.items())
    + " ELSE false END AND CASE kind WHEN 'column' THEN depth_ft >= 0.15 AND width_ft <= 5 * depth_ft WHEN 'beam' THEN depth_ft > 0 ELSE true END)"
)


def _entities(spark, sf):
    ends = F.array(F.struct(F.col("x0").cast("double").alias("x"), F.col("y0").cast("double").alias("y")), F.struct(F.col("x1").cast("double").alias("x"), F.col("y1").cast("double").alias("y")))
    return drawing(spark, sf, _ENTITIES).withColumn("points", ends)


@query(f"""WITH o AS (SELECT k, sheet_id, coalesce({_NAME_KIND}, {_LAYER_KIND}) AS kind, greatest(w, d) AS width_ft, least(w, d) AS depth_ft FROM ({_SITES})),
t AS (SELECT * FROM o WHERE k % 19 > 0 AND k % 13 > 0 AND {_FITS})
SELECT sheet_id, k * 100 AS symbol_id, kind, width_ft, depth_ft, CAST(4 + CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_members FROM t
UNION ALL SELECT sheet_id, k * 100 + 10, 'plumbing', round(sqrt(0.16::DOUBLE + 0.0225::DOUBLE), 6), 0, 2 FROM o WHERE k % 4 = 0 AND k NOT IN (SELECT k FROM t)""")
def block_symbols(spark, sf):
    found, members = symbols.block_symbols(_entities(spark, sf), drawing(spark, sf, _ROLES))
    counts = members.groupBy("symbol_id").agg(F.count("*").alias("n_members"))
    at = lambda c: (F.round(c, 6) + 0.0).alias(c)  # noqa: E731  places of 1500 ft leave nine digits of a size in doubt
    return found.join(counts, "symbol_id").select("sheet_id", "symbol_id", "kind", at("width_ft"), at("depth_ft"), "n_members")


#: On layers: three lines round a box, .05 ft apart at their corners, and one line a little further off.
_LOOSE = f"""SELECT sheet_id, k * 100 + 21 AS shape_id, k * 10 AS source_id, layer, false AS partial, x AS x0, y + 10 AS y0, x + a AS x1, y + 10 AS y1 FROM ({_SITES}) UNION ALL SELECT sheet_id, k * 100 + 22, k * 10, layer, false, x + a + 0.05, y + 10, x + a + 0.05, y + 10 + b FROM ({_SITES}) WHERE k % 6 < 5
UNION ALL SELECT sheet_id, k * 100 + 23, k * 10 + 1, CASE WHEN k % 6 = 5 THEN 'A-FURN' ELSE layer END, false, x, y + 10 + b, x + a, y + 10 + b FROM ({_SITES}) UNION ALL SELECT sheet_id, k * 100 + 24, k * 10 + 2, layer, k % 16 = 0, x + a + 0.3, y + 10, x + a + 0.3 + c, y + 10 FROM ({_SITES})"""
_TAKEN = f"SELECT k * 10 + 2 AS entity_id FROM ({_SITES}) WHERE k % 9 = 0"


@query(f"""WITH s AS (SELECT *, {_LAYER_KIND} AS kind FROM ({_SITES})),
o AS (SELECT sheet_id, k * 100 + 21 AS symbol_id, kind, CASE WHEN k % 6 < 5 THEN greatest(a + 0.05, b) ELSE a END AS width_ft, CASE WHEN k % 6 < 5 THEN least(a + 0.05, b) ELSE 0 END AS depth_ft, CASE WHEN k % 6 < 5 THEN 2 ELSE 1 END AS n_sources FROM s
  UNION ALL SELECT sheet_id, k * 100 + 23, 'furniture', a, 0, 1 FROM s WHERE k % 6 = 5 UNION ALL SELECT sheet_id, k * 100 + 24, kind, c, 0, 1 FROM s WHERE k % 16 > 0 AND k % 9 > 0)
SELECT sheet_id, symbol_id, kind, CAST(width_ft AS DOUBLE) AS width_ft, CAST(depth_ft AS DOUBLE) AS depth_ft, CAST(n_sources AS BIGINT) AS n_sources FROM o WHERE {_FITS}""")
def layer_symbols(spark, sf):
    ends = F.array(F.struct(F.col("x0").cast("double").alias("x"), F.col("y0").cast("double").alias("y")), F.struct(F.col("x1").cast("double").alias("x"), F.col("y1").cast("double").alias("y")))
    shapes = drawing(spark, sf, _LOOSE).withColumn("points", ends)
    found, members = symbols.layer_symbols(shapes, drawing(spark, sf, _TAKEN), drawing(spark, sf, _ROLES))
    counts = members.groupBy("symbol_id").agg(F.count("*").alias("n_sources"))
    at = lambda c: (F.round(c, 6) + 0.0).alias(c)
    return found.join(counts, "symbol_id").select("sheet_id", "symbol_id", "kind", at("width_ft"), at("depth_ft"), "n_sources")


_ARCS = f"SELECT sheet_id, k AS arc_id, x + 15 AS x, y + 15 AS y, CAST(k % 10 + 2 AS DOUBLE) / 2 AS radius, CAST(k * 37 % 360 AS DOUBLE) AS start_deg, CAST((k * 37 + CASE k % 4 WHEN 0 THEN 90 WHEN 1 THEN 60 WHEN 2 THEN 110 ELSE 120 END) % 360 AS DOUBLE) AS end_deg FROM ({_SITES})"
_LEAF = f"SELECT sheet_id, arc_id, x, y, radius, start_deg, end_deg, radians(CASE arc_id % 3 WHEN 0 THEN start_deg WHEN 1 THEN end_deg + 2 ELSE start_deg + 30 END) AS turn, radius + CAST(arc_id % 5 AS DOUBLE) * 0.03 AS size, CASE WHEN arc_id % 11 = 7 THEN 0.09 ELSE 0.01 END AS off FROM ({_ARCS})"
_LEAVES = f"SELECT sheet_id, arc_id * 2 AS line_id, CASE WHEN arc_id % 2 = 0 THEN x + off ELSE x + size * cos(turn) END AS x0, CASE WHEN arc_id % 2 = 0 THEN y ELSE y + size * sin(turn) END AS y0, CASE WHEN arc_id % 2 = 0 THEN x + size * cos(turn) ELSE x + off END AS x1, CASE WHEN arc_id % 2 = 0 THEN y + size * sin(turn) ELSE y END AS y1 FROM ({_LEAF})"


@query(f"""WITH l AS (SELECT *, sqrt((size * cos(turn) - off) ** 2 + (size * sin(turn)) ** 2) AS long, CASE WHEN arc_id % 3 = 0 THEN end_deg ELSE start_deg END AS far FROM ({_LEAF}))
SELECT sheet_id, arc_id, arc_id * 2 AS line_id, x, y, round(x + radius * cos(radians(far)), 6) + 0.0 AS tx, round(y + radius * sin(radians(far)), 6) + 0.0 AS ty FROM l
WHERE arc_id % 4 IN (0, 2) AND radius BETWEEN 1.5 AND 5 AND off < 0.08 AND abs(long - radius) < 0.1 AND arc_id % 3 < 2""")
def arc_doors(spark, sf):
    return symbols.arc_doors(drawing(spark, sf, _ARCS), drawing(spark, sf, _LEAVES))
