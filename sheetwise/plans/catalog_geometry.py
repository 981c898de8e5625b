"""More registered queries: geometry, joints, symbols, streams run as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.functions import geometry
from sheetwise.operators import harvest, joints, sets, sweep
from sheetwise.plans.catalog import query
from sheetwise.runtime import read_table
from sheetwise.sources import driver_tables as t
from sheetwise.sources import snapshots
from sheetwise.sources.driver_tables import drawing
from sheetwise.streaming import inventory as streams

# --- joints -------------------------------------------------------------------------------------------------------

_CROSS_SQL = f"""WITH w AS ({t.CROSS_WALLS}),
x AS (SELECT h.sheet_id, h.wall_id AS h, v.wall_id AS v, (v.x0 - h.x0) / (h.x1 - h.x0) AS th, (h.y0 - v.y0) / (v.y1 - v.y0) AS tv, v.x0 AS x, h.y0 AS y
      FROM w h JOIN w v ON h.sheet_id = v.sheet_id AND h.wall_id % 2 = 0 AND v.wall_id % 2 = 1),
c AS (SELECT * FROM x WHERE th > 1e-9 AND th < 1 - 1e-9 AND tv > 1e-9 AND tv < 1 - 1e-9)
"""


@query(_CROSS_SQL + "SELECT sheet_id, least(h, v) AS a, greatest(h, v) AS b, round(CASE WHEN h < v THEN th ELSE tv END, 6) AS ta, round(CASE WHEN h < v THEN tv ELSE th END, 6) AS tb, round(x, 6) AS x, round(y, 6) AS y FROM c")
def wall_crossings(spark, sf):
    return joints.crossings(drawing(spark, sf, t.CROSS_WALLS))


@query(_CROSS_SQL + """, k AS (SELECT sheet_id, h AS wall_id, round(th, 6) AS t FROM c UNION SELECT sheet_id, v, round(tv, 6) FROM c),
p AS (SELECT sheet_id, wall_id, t FROM k UNION SELECT sheet_id, wall_id, 0.0 FROM w UNION SELECT sheet_id, wall_id, 1.0 FROM w),
o AS (SELECT *, lead(t) OVER q AS t1, row_number() OVER q - 1 AS piece FROM p WINDOW q AS (PARTITION BY sheet_id, wall_id ORDER BY t))
SELECT o.sheet_id, o.wall_id, CAST(piece AS INTEGER) AS piece, round(x0 + (x1 - x0) * t, 6) AS ax, round(y0 + (y1 - y0) * t, 6) AS ay, round(x0 + (x1 - x0) * t1, 6) AS bx, round(y0 + (y1 - y0) * t1, 6) AS by_
FROM o JOIN w ON w.sheet_id = o.sheet_id AND w.wall_id = o.wall_id WHERE t1 IS NOT NULL""")
def split_walls(spark, sf):
    walls = drawing(spark, sf, t.CROSS_WALLS)
    met = joints.crossings(walls)
    cuts = met.select("sheet_id", F.inline(F.array(F.struct(F.col("a").alias("wall_id"), F.col("ta").alias("t")), F.struct(F.col("b").alias("wall_id"), F.col("tb").alias("t")))))
    return joints.split_at(walls, cuts).withColumnRenamed("by", "by_")


@query(f"""
WITH w AS ({t.CROSS_WALLS}), p AS ({t.POINTS}),
d AS (SELECT w.sheet_id, wall_id, point_id AS node_id, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS t, x, y, x0, y0, x1, y1 FROM w JOIN p ON p.sheet_id = w.sheet_id)
SELECT sheet_id, wall_id, node_id, round(t, 6) AS t FROM d WHERE t > 1e-9 AND t < 1 - 1e-9 AND sqrt((x - x0 - (x1 - x0) * t) * (x - x0 - (x1 - x0) * t) + (y - y0 - (y1 - y0) * t) * (y - y0 - (y1 - y0) * t)) <= 0.25 + 1e-9""")
def nodes_on_walls(spark, sf):
    return joints.nodes_on_walls(drawing(spark, sf, t.CROSS_WALLS), drawing(spark, sf, t.POINTS).withColumnRenamed("point_id", "node_id"), 0.25)


_SPANS = f"SELECT sheet_id, layer, CAST(off * 4 AS BIGINT) AS host, row_number() OVER (PARTITION BY sheet_id, layer, CAST(off * 4 AS BIGINT) ORDER BY family, off, lo, hi) AS span_id, lo, hi FROM ({t.SEGMENTS})"


@query(f"""
SELECT sheet_id, layer, host, span_id, round(least(reach, hi) - lo, 6) AS overlap FROM (SELECT *, max(hi) OVER (PARTITION BY sheet_id, layer, host ORDER BY lo, hi, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({_SPANS})) WHERE reach > lo + 1e-9""")
def opening_overlaps(spark, sf):
    return joints.overlapping_spans(drawing(spark, sf, _SPANS), ["sheet_id", "layer", "host"])


_GAP_SQL = f"""WITH s AS ({t.SEGMENTS}), o AS (SELECT *, max(hi) OVER (PARTITION BY sheet_id, layer, family, off ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT DISTINCT sheet_id, layer, family, off, reach AS gap_lo, lo AS gap_hi FROM o WHERE lo > reach + 1e-9 AND lo - reach <= 6)
"""


@query(_GAP_SQL + "SELECT * FROM g")
def wall_gaps(spark, sf):
    return joints.gaps(drawing(spark, sf, t.SEGMENTS), [*sweep.FAMILY, "off"], 6.0)


@query(_GAP_SQL + """, e AS (SELECT DISTINCT sheet_id, layer, family, gap_lo, gap_hi FROM g)
SELECT e.sheet_id, e.layer, e.family, gap_lo, gap_hi, count(DISTINCT off) AS n_lines FROM e JOIN s ON s.sheet_id = e.sheet_id AND s.layer = e.layer AND s.family = e.family
WHERE least(hi, gap_hi) - greatest(lo, gap_lo) >= 0.7 * (gap_hi - gap_lo) GROUP BY ALL HAVING count(DISTINCT off) >= 2""")
def gap_windows(spark, sf):
    lines = drawing(spark, sf, t.SEGMENTS)
    found = joints.gaps(lines, [*sweep.FAMILY, "off"], 6.0).select(*sweep.FAMILY, "gap_lo", "gap_hi").distinct()
    return joints.lines_in_gaps(found, lines, sweep.FAMILY)


@query(f"""
WITH w AS ({t.CROSS_WALLS}), b AS ({t.BOXES}),
m AS (SELECT w.sheet_id, wall_id, box_id, (w.x0 + w.x1) / 2 BETWEEN b.x0 AND b.x1 AND (w.y0 + w.y1) / 2 BETWEEN b.y0 AND b.y1 AS holds FROM w JOIN b ON b.sheet_id = w.sheet_id AND w.x1 >= b.x0 AND w.x0 <= b.x1 AND w.y1 >= b.y0 AND w.y0 <= b.y1),
j AS (SELECT sheet_id, wall_id, min(box_id) FILTER (holds) AS centre, min(box_id) AS only_, count(*) AS k FROM m GROUP BY ALL)
SELECT w.sheet_id, w.wall_id, CASE WHEN centre IS NOT NULL THEN centre WHEN k = 1 THEN only_ END AS box_id, coalesce(k > 1 AND centre IS NULL, false) AS spanning FROM w LEFT JOIN j ON j.sheet_id = w.sheet_id AND j.wall_id = w.wall_id""")
def floor_cut(spark, sf):
    return joints.owner_by_box(drawing(spark, sf, t.CROSS_WALLS), drawing(spark, sf, t.BOXES))


# --- geometry functions -------------------------------------------------------------------------------------------

_RINGS = "SELECT c_custkey AS ring_id, CAST(c_custkey % 7 AS DOUBLE) AS a, CAST(c_custkey % 5 + 1 AS DOUBLE) AS b, CAST(c_custkey % 11 + 1 AS DOUBLE) AS c FROM customer"


def _ring():
    point = lambda x, y: F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"))
    return F.array(point("a", "0"), point("a + c", "0"), point("a + c", "b"), point("a", "b + c"))


@query(f"SELECT ring_id, round((b + b + c) / 2 * c, 6) AS area, concat(CASE WHEN a = 0 THEN '0.0' ELSE concat(a, '') END, ' ', '0.0') AS first_point, 4 AS n_segments FROM ({_RINGS})")
def ring_facts(spark, sf):
    d = drawing(spark, sf, _RINGS).withColumn("ring", _ring())
    first = geometry.canonical_ring(F.col("ring"))[0]
    return d.select("ring_id", F.round(geometry.ring_area(F.col("ring")), 6).alias("area"), F.concat_ws(" ", first["x"].cast("string"), first["y"].cast("string")).alias("first_point"), F.size(geometry.segments_of(F.col("ring"), F.lit(True))).alias("n_segments"))


@query(f"SELECT ring_id, k AS segment, CAST(CASE k WHEN 0 THEN c WHEN 1 THEN b WHEN 2 THEN sqrt(2 * c * c) ELSE b + c END AS DOUBLE) AS length FROM ({_RINGS}), (VALUES (0), (1), (2), (3)) v(k)".replace("CAST(CASE k", "round(CAST(CASE k").replace("END AS DOUBLE)", "END AS DOUBLE), 6)"))
def segment_explode(spark, sf):
    d = drawing(spark, sf, _RINGS).select("ring_id", F.posexplode(geometry.segments_of(_ring(), F.lit(True))).alias("segment", "s"))
    return d.select("ring_id", "segment", F.round(F.hypot(F.col("s.b.x") - F.col("s.a.x"), F.col("s.b.y") - F.col("s.a.y")), 6).alias("length"))


@query(f"SELECT ring_id, round(greatest(c, b + c), 6) AS side, round(-c / 2 / greatest(c, b + c), 6) AS first_x, round(-(b + c) / 2 / greatest(c, b + c), 6) AS first_y FROM ({_RINGS})")
def normalised_shapes(spark, sf):
    first = geometry.normalised(_ring())[0]
    return drawing(spark, sf, _RINGS).select("ring_id", F.round(F.greatest(F.col("c"), F.col("b") + F.col("c")), 6).alias("side"), F.round(first["x"], 6).alias("first_x"), F.round(first["y"], 6).alias("first_y"))


# --- symbols ------------------------------------------------------------------------------------------------------

_PARTS = "SELECT l_orderkey AS instance_id, 'block' AS kind, concat('p', l_linenumber) AS part, CAST(l_orderkey % 17 + 1 AS DOUBLE) AS size FROM lineitem"


@query(f"""
WITH f AS (SELECT instance_id, array_to_string(list_sort(list(part)), ',') AS family, max(size) AS size FROM ({_PARTS}) GROUP BY 1)
SELECT family, count(*) AS n, round(min(size) * 0.75, 6) AS smallest, round(max(size) * 1.25, 6) AS largest FROM f GROUP BY 1 HAVING count(*) >= 8""")
def harvest_families(spark, sf):
    return harvest.families(drawing(spark, sf, _PARTS))


_INSTANCES = "SELECT o_custkey % 60 AS template_id, CAST(o_orderkey % 13 AS DOUBLE) AS size, CAST(o_orderkey % 4 * 90 AS BIGINT) AS angle, o_orderkey % 5 = 0 AS mirrored FROM orders"
_TEMPLATES = "SELECT DISTINCT c_custkey % 80 AS template_id FROM customer"


@query(f"""
SELECT m.template_id, count(i.template_id) AS n, count(*) FILTER (mirrored) AS n_mirrored, min(size) AS min_size, median(size) AS median_size, max(size) AS max_size,
       count(*) FILTER (angle = 0) AS angle_0, count(*) FILTER (angle = 90) AS angle_90, count(*) FILTER (angle = 180) AS angle_180, count(*) FILTER (angle = 270) AS angle_270
FROM ({_TEMPLATES}) m LEFT JOIN ({_INSTANCES}) i ON i.template_id = m.template_id GROUP BY 1""")
def library_usage(spark, sf):
    return harvest.library_use(drawing(spark, sf, _TEMPLATES), drawing(spark, sf, _INSTANCES))


@query(f"SELECT element_id, sheet_id, kind, concat(CASE kind WHEN 'wall' THEN 'W' WHEN 'door' THEN 'D' ELSE 'N' END, row_number() OVER (PARTITION BY sheet_id, kind ORDER BY element_id)) AS label FROM (SELECT DISTINCT element_id, sheet_id, kind FROM ({t.CLAIMS}))")
def feedback_template(spark, sf):
    elements = drawing(spark, sf, t.CLAIMS).select("element_id", "sheet_id", "kind").distinct()
    return harvest.number_by_kind(elements, {"wall": "W", "door": "D", "window": "N"}, ["element_id"]).drop("verdict")


@query()
def greedy_claims(spark, sf):
    return harvest.greedy_disjoint(drawing(spark, sf, t.CLAIMS))


@query()
def bipartite_matching(spark, sf):
    c = drawing(spark, sf, t.CLAIMS)
    overlap = sets.set_overlap(c.filter("kind = 'wall'").select("sheet_id", "element_id", "source_id").distinct(), c.filter("kind = 'door'").select("sheet_id", "element_id", "source_id").distinct(), 0.2)
    return harvest.match(overlap.select("sheet_id", F.col("element_id").alias("ref_id"), F.col("other_id").alias("pred_id"), (F.col("common") / F.col("size")).alias("weight")))


# --- keys, unions, streams ----------------------------------------------------------------------------------------


@query("SELECT o_orderkey, sha256(concat(o_orderstatus, chr(31), o_orderpriority, chr(31), o_orderkey)) AS id FROM (SELECT DISTINCT o_orderkey, o_orderstatus, o_orderpriority FROM orders)")
def stable_identity(spark, sf):
    d = drawing(spark, sf, "SELECT DISTINCT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
    return d.select("o_orderkey", snapshots.stable_id("o_orderstatus", "o_orderpriority", "o_orderkey").alias("id"))


@query(f"""
SELECT coalesce(a.layer, b.layer) AS layer, n_walls, n_lines FROM (SELECT layer, count(*) AS n_walls FROM ({t.WALLS}) GROUP BY 1) a FULL JOIN (SELECT layer, count(*) AS n_lines FROM ({t.LINES}) GROUP BY 1) b ON a.layer = b.layer""")
def layer_table_union(spark, sf):
    of = lambda sql, name: drawing(spark, sf, sql).groupBy("layer").agg(F.count("*").alias(name))
    return joints.outer_union(of(t.WALLS, "n_walls"), of(t.LINES, "n_lines"), ["layer"])


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY ALL")
def windowed_inventory(spark, sf):
    return streams.windowed_counts(read_table(spark, sf, "events"))


@query("""
WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '5 minutes' THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf):
    return streams.sessions(read_table(spark, sf, "events"))


@query("SELECT CASE WHEN role IS NULL THEN NULL ELSE role END AS role, turn % 4 AS step, count(*) AS calls, sum(length(text)) AS characters FROM conversations GROUP BY ROLLUP (role, turn % 4)")
def usage_rollup(spark, sf):
    d = read_table(spark, sf, "conversations").withColumn("step", F.col("turn") % 4)
    return d.rollup("role", "step").agg(F.count("*").alias("calls"), F.sum(F.length("text")).alias("characters"))
