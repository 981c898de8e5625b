"""Every registered query of the drawing operators: its Spark form over the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.functions import text
from sheetwise.operators import decide, evaluate, floors, graph, inventory, scale, sets, spatial, sweep, validate
from sheetwise.sources import driver_tables as t
from sheetwise.sources.driver_tables import drawing

QUERIES: dict = {}
ORACLE_SQL: dict = {}
FLAGSHIP = "layer_inventory"
DECLARED, TOLERANCE = (0.25, 0.375), 0.01
_DECLARED_SQL = "(abs({x} - 0.25) <= 0.01 + 1e-9 OR abs({x} - 0.375) <= 0.01 + 1e-9)"


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) and its SQL under the function's name."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


# --- inventory and aggregates -------------------------------------------------------------------------------------


@query(f"""
WITH d AS (SELECT *, round(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 6) AS length FROM ({t.LINES})),
r AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, layer ORDER BY length) - 1 AS i, count(*) OVER (PARTITION BY sheet_id, layer) AS n FROM d)
SELECT sheet_id, layer, count(*) AS n_lines, round(avg(CASE WHEN abs(x1 - x0) < 0.02 OR abs(y1 - y0) < 0.02 THEN 1.0 ELSE 0.0 END), 9) AS axis_share,
       min(least(x0, x1)) AS min_x, min(least(y0, y1)) AS min_y, max(greatest(x0, x1)) AS max_x, max(greatest(y0, y1)) AS max_y,
       max(length) FILTER (i = least(n - 1, floor(n * 0.1))) AS p10, max(length) FILTER (i = least(n - 1, floor(n * 0.5))) AS p50, max(length) FILTER (i = least(n - 1, floor(n * 0.9))) AS p90
FROM r GROUP BY 1, 2""")
def layer_inventory(spark, sf):
    return inventory.layer_inventory(drawing(spark, sf, t.LINES)).withColumn("axis_share", F.round("axis_share", 9))


@query(f"""
SELECT sheet_id, layer, off, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, layer ORDER BY n DESC, off) AS rank
  FROM (SELECT sheet_id, layer, off, count(*) AS n FROM ({t.SEGMENTS}) GROUP BY ALL)) WHERE rank <= 4""")
def topk_frequency(spark, sf):
    return inventory.top_frequencies(drawing(spark, sf, t.SEGMENTS), ["sheet_id", "layer"], "off", 4)


@query(f"""
WITH g AS (SELECT sheet_id, layer, count(*) AS n, min(least(x0, x1)) AS ax, min(least(y0, y1)) AS ay, max(greatest(x0, x1)) AS bx, max(greatest(y0, y1)) AS b_y FROM ({t.LINES}) GROUP BY ALL),
s AS (SELECT sheet_id, sum(n) AS total, (max(bx) - min(ax)) * (max(b_y) - min(ay)) AS area FROM g GROUP BY 1)
SELECT g.sheet_id, layer, n, round(n / total, 9) AS entity_share, round(CASE WHEN area > 0 THEN least(1.0, (bx - ax) * (b_y - ay) / area) ELSE 0.0 END, 9) AS extent_share
FROM g JOIN s ON g.sheet_id = s.sheet_id""")
def entity_mix(spark, sf):
    d = inventory.entity_mix(drawing(spark, sf, t.LINES))
    return d.withColumns({c: F.round(c, 9) for c in ("entity_share", "extent_share")})


@query(f"""
WITH w AS (SELECT *, {_DECLARED_SQL.format(x='thickness_ft')} AS m FROM ({t.WALLS}))
SELECT sheet_id, layer, round(sum(length_ft), 6) AS paired_ft, round(coalesce(sum(length_ft) FILTER (m), 0), 6) AS matched_ft,
       round(coalesce(sum(length_ft) FILTER (m AND length_ft >= 4) / sum(length_ft) FILTER (m), 0), 9) AS long_share FROM w GROUP BY 1, 2""")
def thickness_evidence(spark, sf):
    d = inventory.thickness_evidence(drawing(spark, sf, t.WALLS), DECLARED, TOLERANCE)
    return d.withColumns({"paired_ft": F.round("paired_ft", 6), "matched_ft": F.round("matched_ft", 6), "long_share": F.round("long_share", 9)})


@query(f"""
WITH b AS (SELECT sheet_id, round_even(thickness_ft * 48, 0) / 48 AS thickness_ft, sum(length_ft) AS length_ft FROM ({t.WALLS}) WHERE confidence >= 0.7 GROUP BY 1, 2),
s AS (SELECT *, length_ft / sum(length_ft) OVER (PARTITION BY sheet_id) AS share FROM b)
SELECT sheet_id, round(thickness_ft, 9) AS thickness_ft, round(length_ft, 6) AS length_ft, round(share, 9) AS share FROM s WHERE share >= 0.1""")
def thickness_modes(spark, sf):
    d = inventory.thickness_modes(drawing(spark, sf, t.WALLS))
    return d.withColumns({"thickness_ft": F.round("thickness_ft", 9), "length_ft": F.round("length_ft", 6), "share": F.round("share", 9)})


_SCALED_WALLS = f"SELECT sheet_id, length_ft, CASE WHEN sheet_id % 3 = 0 THEN thickness_ft ELSE 0.25 * CASE sheet_id % 3 WHEN 1 THEN 12.0 ELSE 304.8 END END AS thickness_ft FROM ({t.WALLS})"


@query(f"""
WITH w AS ({_SCALED_WALLS}), f AS (SELECT * FROM (VALUES (1, 1 / 304.8), (2, 1 / 30.48), (3, 1 / 12.0), (4, 12.0), (5, 30.48), (6, 304.8)) v(k, f)),
o AS (SELECT sheet_id, coalesce(sum(length_ft) FILTER ({_DECLARED_SQL.format(x='thickness_ft')}), 0) / sum(length_ft) AS fits FROM w GROUP BY 1),
s AS (SELECT sheet_id, k, CAST(f AS DOUBLE) AS f, coalesce(sum(length_ft) FILTER ({_DECLARED_SQL.format(x='thickness_ft / f')}), 0) / sum(length_ft) AS share FROM w, f GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY share DESC, k) AS r FROM s)
SELECT o.sheet_id, round(fits, 9) AS fits, round(CASE WHEN fits < 0.6 AND share >= 0.6 THEN f END, 9) AS factor FROM o JOIN b ON o.sheet_id = b.sheet_id AND r = 1""")
def thickness_scale_check(spark, sf):
    d = inventory.thickness_scale_check(drawing(spark, sf, _SCALED_WALLS), DECLARED, TOLERANCE)
    return d.withColumns({"fits": F.round("fits", 9), "factor": F.round("factor", 9)})


# --- sweeps -------------------------------------------------------------------------------------------------------

@query(f"""
WITH RECURSIVE f AS (SELECT DISTINCT sheet_id, layer, family, lo, hi, off FROM ({t.SEGMENTS})),
c AS (SELECT DISTINCT sheet_id, layer, family, c0 FROM (SELECT sheet_id, layer, family, unnest([lo, hi]) AS c0 FROM f)),
s AS (SELECT *, lead(c0) OVER (PARTITION BY sheet_id, layer, family ORDER BY c0) AS c1 FROM c),
v AS (SELECT DISTINCT s.*, off FROM s JOIN f USING (sheet_id, layer, family) WHERE c1 IS NOT NULL AND lo <= c0 AND hi >= c1),
o AS (SELECT dense_rank() OVER (ORDER BY x.sheet_id, x.layer, x.family, x.c0) AS slab, row_number() OVER (PARTITION BY x.sheet_id, x.layer, x.family, x.c0 ORDER BY y.off - x.off, x.off, y.off) AS k,
             x.sheet_id, x.layer, x.family, x.c0, x.c1, x.off AS a, y.off AS b
      FROM v x JOIN v y ON y.sheet_id = x.sheet_id AND y.layer = x.layer AND y.family = x.family AND y.c0 = x.c0 AND y.off - x.off BETWEEN 0.25 - 1e-9 AND 1.0 + 1e-9),
g AS (SELECT slab, k, a, b, [a, b] AS used, true AS taken FROM o WHERE k = 1
      UNION ALL SELECT o.slab, o.k, o.a, o.b, CASE WHEN list_has_any(g.used, [o.a, o.b]) THEN g.used ELSE list_concat(g.used, [o.a, o.b]) END, NOT list_has_any(g.used, [o.a, o.b]) FROM g JOIN o ON o.slab = g.slab AND o.k = g.k + 1),
r AS (SELECT o.*, CASE WHEN c0 <= lag(c1) OVER w + 1e-8 THEN 0 ELSE 1 END AS fresh FROM o JOIN g ON g.slab = o.slab AND g.k = o.k AND g.taken WINDOW w AS (PARTITION BY o.sheet_id, o.layer, o.family, o.a, o.b ORDER BY c0)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY sheet_id, layer, family, a, b ORDER BY c0) AS run FROM r)
SELECT sheet_id, layer, family, a, b, min(c0) AS lo, max(c1) AS hi FROM i GROUP BY sheet_id, layer, family, a, b, run HAVING max(c1) - min(c0) + 1e-9 >= greatest(1.0, b - a)""")
def interval_pairs(spark, sf):
    return sweep.interval_pairs(drawing(spark, sf, t.SEGMENTS), 0.25, 1.0, 1.0)


@query(f"""
WITH o AS (SELECT *, max(hi) OVER (PARTITION BY sheet_id, layer, family, off ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({t.SEGMENTS})),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY sheet_id, layer, family, off ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT sheet_id, layer, family, off, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY sheet_id, layer, family, off, k""")
def island_merge(spark, sf):
    return sweep.merge_islands(drawing(spark, sf, t.SEGMENTS), [*sweep.FAMILY, "off"])


@query(f"""
WITH o AS (SELECT *, max(hi) OVER (PARTITION BY sheet_id, layer ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({t.SEGMENTS})),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY sheet_id, layer ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM o),
g AS (SELECT sheet_id, layer, k, max(hi) - min(lo) AS length FROM i GROUP BY ALL)
SELECT sheet_id, layer, round(sum(length), 6) AS covered, count(*) AS n_islands FROM g GROUP BY ALL""")
def coverage_length(spark, sf):
    return sweep.coverage_length(drawing(spark, sf, t.SEGMENTS), ["sheet_id", "layer"]).withColumn("covered", F.round("covered", 6))


_SHORT = f"SELECT DISTINCT sheet_id, layer, family, CAST(floor(lo / 40) * 40 AS DOUBLE) AS lo, CAST(floor(lo / 40) * 40 + 20 AS DOUBLE) AS hi, off FROM ({t.SEGMENTS})"


@query(f"""
WITH g AS (SELECT *, off - lag(off) OVER w AS gap FROM ({_SHORT}) WINDOW w AS (PARTITION BY sheet_id, layer, family, lo, hi ORDER BY off)),
j AS (SELECT *, sum(CASE WHEN gap > 0 AND gap <= 2.5 THEN 0 ELSE 1 END) OVER (PARTITION BY sheet_id, layer, family, lo, hi ORDER BY off ROWS UNBOUNDED PRECEDING) AS run FROM g),
r AS (SELECT sheet_id, layer, family, lo AS span_lo, hi AS span_hi, run, min(off) AS first_off, max(off) AS last_off, count(*) AS n,
             avg(gap) FILTER (gap > 0 AND gap <= 2.5) AS m, stddev_pop(gap) FILTER (gap > 0 AND gap <= 2.5) AS s FROM j GROUP BY ALL)
SELECT sheet_id, layer, family, span_lo, span_hi, first_off, last_off, n, coalesce(n >= 4 AND m > 0 AND s / m < 0.15, false) AS is_ladder FROM r""")
def ladder_runs(spark, sf):
    return sweep.ladder_runs(drawing(spark, sf, _SHORT))


@query(f"""
WITH d AS (SELECT *, off - lag(off) OVER (PARTITION BY sheet_id, layer, family ORDER BY off) AS gap FROM (SELECT DISTINCT sheet_id, layer, family, off FROM ({t.SEGMENTS})))
SELECT sheet_id, layer, family, CAST(sum(CASE WHEN gap IS NULL OR gap >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_distinct FROM d GROUP BY ALL""")
def distinct_offsets(spark, sf):
    return sweep.distinct_offsets(drawing(spark, sf, t.SEGMENTS), 0.5)


# --- spatial joins ------------------------------------------------------------------------------------------------

_APART = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@query(f"""
WITH p AS ({t.POINTS})
SELECT p.sheet_id, p.point_id, (SELECT count(*) FROM p b WHERE b.sheet_id = p.sheet_id AND b.point_id <> p.point_id AND sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)) <= 3 + 1e-9) AS touches FROM p""")
def eps_touch_counts(spark, sf):
    return spatial.eps_counts(drawing(spark, sf, t.POINTS), 3.0)


@query(f"""
WITH p AS ({t.POINTS}) SELECT a.sheet_id, a.point_id AS a, b.point_id AS b, round({_APART}, 6) AS distance
FROM p a JOIN p b ON a.sheet_id = b.sheet_id AND a.point_id < b.point_id AND {_APART} <= 3 + 1e-9""")
def eps_pairs(spark, sf):
    return spatial.eps_pairs(drawing(spark, sf, t.POINTS), 3.0)


@query(f"""
WITH p AS ({t.POINTS}), q AS ({t.BOXES}),
m AS (SELECT p.sheet_id, point_id, box_id, row_number() OVER (PARTITION BY p.sheet_id, point_id ORDER BY -round((x1 - x0) * (y1 - y0), 6), box_id) AS r
      FROM p JOIN q ON p.sheet_id = q.sheet_id AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)
SELECT p.sheet_id, p.point_id, box_id FROM p LEFT JOIN m ON m.sheet_id = p.sheet_id AND m.point_id = p.point_id AND r = 1""")
def pip_label(spark, sf):
    return spatial.containing_box(drawing(spark, sf, t.POINTS), drawing(spark, sf, t.BOXES))


@query(f"""
WITH p AS ({t.POINTS}),
m AS (SELECT a.sheet_id, a.point_id, b.point_id AS ahead_id, round({_APART}, 6) AS distance FROM p a JOIN p b ON a.sheet_id = b.sheet_id AND b.x > a.x AND abs(b.y - a.y) <= 0.7 * (b.x - a.x) + 1e-9 AND round({_APART}, 6) <= 8),
r AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, point_id ORDER BY distance, ahead_id) AS r FROM m)
SELECT sheet_id, point_id, ahead_id, distance FROM r WHERE r = 1""")
def cone_nearest(spark, sf):
    return spatial.nearest_ahead(drawing(spark, sf, t.POINTS), 8.0, 0.7)


@query(f"""
WITH l AS ({t.LINES}), v AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy FROM l),
c AS (SELECT *, greatest(0.0, CASE WHEN dx > 0 THEN (20 - x0) / dx END, CASE WHEN dx < 0 THEN (90 - x0) / dx END, CASE WHEN dy > 0 THEN (3 - y0) / dy END, CASE WHEN dy < 0 THEN (15 - y0) / dy END) AS t0,
             least(1.0, CASE WHEN dx > 0 THEN (90 - x0) / dx END, CASE WHEN dx < 0 THEN (20 - x0) / dx END, CASE WHEN dy > 0 THEN (15 - y0) / dy END, CASE WHEN dy < 0 THEN (3 - y0) / dy END) AS t1 FROM v
      WHERE (dx <> 0 OR x0 BETWEEN 20 AND 90) AND (dy <> 0 OR y0 BETWEEN 3 AND 15))
SELECT sheet_id, layer, entity_type, round(x0 + dx * t0, 6) AS x0, round(y0 + dy * t0, 6) AS y0, round(x0 + dx * t1, 6) AS x1, round(y0 + dy * t1, 6) AS y1, t0 > 0 OR t1 < 1 AS partial FROM c WHERE t0 <= t1""")
def region_clip(spark, sf):
    return spatial.clip_to_window(drawing(spark, sf, t.LINES), 20.0, 3.0, 90.0, 15.0)


# --- graphs -------------------------------------------------------------------------------------------------------


@query(f"""
WITH RECURSIVE e AS ({t.HIERARCHY}), c AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT c.node, e.parent, c.depth + 1 FROM c JOIN e ON c.ancestor = e.child)
SELECT * FROM c UNION ALL SELECT n, n, 0 FROM (SELECT child AS n FROM e UNION SELECT parent FROM e)""")
def hierarchy_closure(spark, sf):
    return graph.closure(drawing(spark, sf, t.HIERARCHY))


@query(f"""
WITH RECURSIVE e AS ({t.HIERARCHY}), x AS (SELECT concat('n', n_nationkey) AS n FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT e.child FROM x JOIN e ON e.parent = x.n)
SELECT o_orderkey AS order_id, concat('o', o_orderkey) AS source_id FROM (SELECT DISTINCT o_orderkey FROM orders) WHERE concat('o', o_orderkey) NOT IN (SELECT n FROM x)""")
def claim_exclusion(spark, sf):
    primitives = drawing(spark, sf, "SELECT DISTINCT o_orderkey AS order_id, concat('o', o_orderkey) AS source_id FROM orders")
    claimed = drawing(spark, sf, "SELECT concat('n', n_nationkey) AS id FROM nation WHERE n_nationkey % 3 = 0")
    return graph.exclude_claims(primitives, claimed, drawing(spark, sf, t.HIERARCHY))


@query(f"""
WITH RECURSIVE p AS ({t.POINTS}), e AS (SELECT a.point_id AS a, b.point_id AS b FROM p a JOIN p b ON a.sheet_id = b.sheet_id AND a.point_id <> b.point_id AND {_APART} <= 6 + 1e-9),
w AS (SELECT DISTINCT a AS id, a AS root FROM e UNION SELECT e.b, w.root FROM w JOIN e ON w.id = e.a)
SELECT id, min(root) AS component FROM w GROUP BY id""")
def connected_components(spark, sf):
    return graph.components(spatial.eps_links(drawing(spark, sf, t.POINTS), 6.0))


_ENDS = "SELECT c_nationkey AS sheet_id, c_custkey % 97 AS node, CASE c_custkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0.0 END AS dx, CASE c_custkey % 4 WHEN 2 THEN 1.0 WHEN 3 THEN -1.0 ELSE 0.0 END AS dy FROM customer"


@query(f"""
WITH d AS (SELECT sheet_id, node, count(*) AS degree, min(dx) AS ax, max(dx) AS bx, count(DISTINCT abs(dx)) AS axes FROM ({_ENDS}) GROUP BY ALL)
SELECT sheet_id, node, degree, CASE WHEN degree = 1 THEN 'end' WHEN degree = 2 AND axes = 1 THEN 'collinear' WHEN degree = 2 THEN 'L' WHEN degree = 3 THEN 'T' ELSE 'X' END AS kind FROM d""")
def degree_classify(spark, sf):
    ends = drawing(spark, sf, _ENDS)
    return graph.junction_kinds(ends.withColumns({c: F.col(c).cast("double") for c in ("dx", "dy")}), ["sheet_id", "node"])


# --- scale --------------------------------------------------------------------------------------------------------


@query(f"""
WITH d AS (SELECT *, units / feet AS ratio FROM ({t.DIMENSIONS})), m AS (SELECT sheet_id, median(ratio) AS m FROM d GROUP BY 1 HAVING count(*) >= 2)
SELECT d.sheet_id, round(median(ratio), 9) AS units_per_foot, count(*) AS support FROM d JOIN m ON d.sheet_id = m.sheet_id WHERE abs(units / m - feet) * 12 <= 2 GROUP BY 1 HAVING count(*) >= 2""")
def robust_median(spark, sf):
    return scale.robust_median(drawing(spark, sf, t.DIMENSIONS)).withColumn("units_per_foot", F.round("units_per_foot", 9))


@query(f"SELECT sheet_id, list_sort(list(round(units / feet, 9)))[1 + count(*) // 2] AS upper_median FROM ({t.DIMENSIONS}) GROUP BY 1")
def upper_median(spark, sf):
    d = drawing(spark, sf, t.DIMENSIONS).withColumn("ratio", F.round(F.col("units") / F.col("feet"), 9))
    return scale.upper_median(d, ["sheet_id"], "ratio")


_VALUES = "SELECT CAST(s_nationkey AS BIGINT) AS sheet_id, CAST(s_suppkey * 7 % 1000 AS DOUBLE) AS value FROM supplier"
_TARGETS = "SELECT CAST(c_nationkey AS BIGINT) AS sheet_id, c_custkey AS target_id, CAST(c_custkey * 13 % 1000 AS DOUBLE) AS target FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)"


@query(f"""
WITH m AS (SELECT g.sheet_id, target_id, value, abs(value - target) AS d FROM ({_TARGETS}) g JOIN ({_VALUES}) v ON v.sheet_id = g.sheet_id),
r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY d, value) AS r FROM m) SELECT sheet_id, target_id, value AS nearest, round(d, 6) AS distance FROM r WHERE r = 1""")
def asof_nearest(spark, sf):
    return scale.nearest_value(drawing(spark, sf, _VALUES), drawing(spark, sf, _TARGETS))


_CANDIDATES = "SELECT DISTINCT p_partkey % 50 AS sheet_id, CAST(12 + p_partkey % 50 + p_size % 5 - 2 AS DOUBLE) AS scale FROM part"


@query(f"""
WITH d AS ({t.DIMENSIONS}), c AS (SELECT sheet_id, scale FROM (SELECT *, lag(scale) OVER (PARTITION BY sheet_id ORDER BY scale) AS b FROM ({_CANDIDATES})) WHERE b IS NULL OR scale - b > scale * 1e-4),
v AS (SELECT d.sheet_id, scale, count(DISTINCT dim_id) AS support, round(max(abs(units / scale - feet) * 12), 6) AS worst_in FROM d JOIN c ON c.sheet_id = d.sheet_id WHERE abs(units / scale - feet) * 12 <= 2 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY support DESC, worst_in, scale) AS r FROM v), n AS (SELECT sheet_id, greatest(3, ceil(count(DISTINCT dim_id) * 0.25)) AS need FROM d GROUP BY 1)
SELECT b.sheet_id, scale, support, worst_in FROM b JOIN n ON n.sheet_id = b.sheet_id WHERE r = 1 AND support >= need""")
def scale_consensus(spark, sf):
    return scale.scale_vote(drawing(spark, sf, t.DIMENSIONS), drawing(spark, sf, _CANDIDATES))


@query(f"""
WITH p AS ({t.POINTS}), e AS (SELECT a.sheet_id, a.point_id AS a, b.point_id AS b, round({_APART}, 6) AS distance FROM p a JOIN p b ON a.sheet_id = b.sheet_id AND a.point_id < b.point_id AND {_APART} <= 4 + 1e-9)
SELECT sheet_id, a, b, distance FROM (SELECT *, count(*) OVER (PARTITION BY sheet_id, a) AS ka, count(*) OVER (PARTITION BY sheet_id, b) AS kb FROM e) WHERE ka = 1 AND kb = 1""")
def dimension_mutual_match(spark, sf):
    return scale.mutual_matches(spatial.lone_pairs(drawing(spark, sf, t.POINTS), 4.0), "a", "b")


@query(f"""SELECT dim_id, round(coalesce(CASE WHEN asserted > 0 THEN asserted END, CASE WHEN extracted > 0 THEN extracted END, CASE WHEN header > 0 THEN header END), 9) AS units_per_foot
FROM (SELECT dim_id, CASE WHEN dim_id % 5 = 0 THEN feet - 20 END AS asserted, CASE WHEN dim_id % 3 = 0 THEN units / feet END AS extracted, CASE WHEN dim_id % 2 = 0 THEN 12.0 END AS header FROM ({t.DIMENSIONS}))""")
def scale_ladder(spark, sf):
    d = drawing(spark, sf, f"SELECT dim_id, CASE WHEN dim_id % 5 = 0 THEN feet - 20 END AS asserted, CASE WHEN dim_id % 3 = 0 THEN units / feet END AS extracted, CAST(CASE WHEN dim_id % 2 = 0 THEN 12.0 END AS DOUBLE) AS header FROM ({t.DIMENSIONS})")
    return d.select("dim_id", F.round(scale.first_rung(F.col("asserted"), F.col("extracted"), F.col("header")), 9).alias("units_per_foot"))


# --- text ---------------------------------------------------------------------------------------------------------

#: What the texts of forms 0 to 2 state, from how they are made: feet and inches of each dimension.
_STATED = """
WITH p AS (SELECT p_partkey AS text_id, CAST(p_size AS DOUBLE) AS size, p_partkey AS k FROM part),
d AS (SELECT text_id, true AS whole, size AS f, CAST(k % 14 AS DOUBLE) AS i FROM p WHERE k % 6 = 0
      UNION ALL SELECT text_id, true, size, k % 11 + CASE WHEN k % 4 > 0 THEN CAST(k % 5 AS DOUBLE) / (k % 4) END FROM p WHERE k % 6 = 1
      UNION ALL SELECT text_id, false, size, CAST(k % 12 AS DOUBLE) FROM p WHERE k % 6 = 2
      UNION ALL SELECT text_id, false, CAST(k % 30 AS DOUBLE), 3.0 FROM p WHERE k % 6 = 2),
z AS (SELECT text_id, whole, f + i / 12 AS feet FROM d WHERE i < 12 AND f + i / 12 BETWEEN 0.5 AND 500)
"""


@query(_STATED + "SELECT p.text_id, round(feet, 9) AS feet FROM p LEFT JOIN z ON z.text_id = p.text_id AND whole")
def feet_inch_parse(spark, sf):
    return drawing(spark, sf, t.TEXTS).select("text_id", F.round(text.parse_feet(F.col("text")), 9).alias("feet"))


@query(_STATED + "SELECT text_id, count(*) AS n, round(sum(feet), 6) AS total_ft FROM z GROUP BY 1")
def dimension_pairs(spark, sf):
    d = drawing(spark, sf, t.TEXTS).select("text_id", F.explode(text.parse_feet_group(F.col("text"))).alias("feet"))
    return d.groupBy("text_id").agg(F.count("*").alias("n"), F.round(F.sum("feet"), 6).alias("total_ft"))


@query(f"""
WITH c AS (SELECT text_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\\\[PpNn]', ' ', 'g'), '\\\\[A-Za-z][^;\\\\]*;', '', 'g'), '[{{}}]', '', 'g'), '\\s+', ' ', 'g')) AS label FROM ({t.TEXTS})),
m AS (SELECT *, regexp_extract(label, '(?i)\\bLVL\\.?\\s*([+-])\\s*([0-9]+(?:\\.[0-9]+)?)\\s*''\\s*(?:-?\\s*([0-9]+(?:\\.[0-9]+)?))?', ['s', 'f', 'i']) AS v,
             regexp_extract(label, '(?i)\\bCLEAR\\s*H(?:T|EIGHT)\\.?\\s*[-:=]?\\s*([0-9]+(?:\\.[0-9]+)?)\\s*''\\s*(?:-?\\s*([0-9]+(?:\\.[0-9]+)?))?', ['f', 'i']) AS h FROM c)
SELECT text_id, label, round(CASE WHEN v.s = '-' THEN -1.0 ELSE 1.0 END * (TRY_CAST(v.f AS DOUBLE) + coalesce(TRY_CAST(v.i AS DOUBLE), 0) / 12), 9) AS level_offset_ft,
       round(TRY_CAST(h.f AS DOUBLE) + coalesce(TRY_CAST(h.i AS DOUBLE), 0) / 12, 9) AS clear_height_ft,
       regexp_matches(label, '(?i)\\bDOUBLE\\s*H[A-Z]*T\\b|\\bOPEN\\s+TO\\s+ABOVE\\b') AS double_height, regexp_matches(label, '(?i)\\bBELOW\\b|\\bOPEN\\s+TO\\s+SKY\\b') AS below, regexp_matches(label, '(?i)\\bPOOL\\b') AS pool FROM m""")
def label_attributes(spark, sf):
    return drawing(spark, sf, t.TEXTS).select("text_id", *[v.alias(k) for k, v in text.label_attributes(F.col("text")).items()])


@query(
    f"WITH n AS (SELECT layer_id, name, regexp_extract_all(lower(name), '[a-z]+') AS w FROM ({t.LAYERS})) SELECT layer_id, name, CASE "
    + " ".join("WHEN list_has_any(w, [" + ", ".join(f"'{x}'" for x in tokens) + f"]) THEN '{role}'" for role, tokens in text.ROLE_TOKENS)
    + " ELSE 'ignore' END AS role, trim(name) = '' OR lower(trim(name)) = 'defpoints' OR regexp_matches(trim(name), '^[0-9]+$') OR length(trim(name)) = 1 AS uninformative FROM n"
)
def token_roles(spark, sf):
    return drawing(spark, sf, t.LAYERS).select("layer_id", "name", text.token_role(F.col("name")).alias("role"), text.is_uninformative(F.col("name")).alias("uninformative"))


# --- decisions ----------------------------------------------------------------------------------------------------

_SIGNALS = {"layer_role": "candidate_id % 3 - 1", "length": "score * 2 - 1", "connectivity": "flags - 1", "closure": "sheet_id % 3 - 1", "thickness": "1 - score", "instancing": "CASE WHEN candidate_id % 11 = 0 THEN -1 ELSE 0 END", "glyph": "CASE WHEN candidate_id % 13 = 0 THEN -1 ELSE 0 END", "nested_outline": "CASE WHEN candidate_id % 17 = 0 THEN -1 ELSE 0 END"}


@query(
    f"WITH c AS ({t.SCORED}), s AS (SELECT candidate_id, round((("
    + " + ".join(f"({e}) * CAST({decide.WEIGHTS[k]} AS DOUBLE)" for k, e in _SIGNALS.items())
    + ") / 12 + 1) / 2, 6) AS score FROM c) SELECT candidate_id, score, CASE WHEN score >= 0.65 THEN 'accept' WHEN score <= 0.35 THEN 'reject' ELSE 'ambiguous' END AS band FROM s"
)
def candidate_scores(spark, sf):
    d = drawing(spark, sf, t.SCORED)
    score = decide.combined_score({k: F.expr(e).cast("double") for k, e in _SIGNALS.items()})
    return d.select("candidate_id", score.alias("score")).withColumn("band", decide.band(F.col("score")))


_VERDICTS = f"SELECT candidate_id, CASE WHEN flags = 0 THEN 'wall' ELSE 'not_wall' END AS verdict, CAST(candidate_id % 40 + 60 AS DOUBLE) / 100 AS confidence FROM ({t.SCORED}) WHERE candidate_id % 2 = 0"


@query(f"""
WITH c AS ({t.SCORED}), v AS ({_VERDICTS}), d AS (SELECT c.candidate_id, score, event_type IN ('click', 'view') AS on_wall_layer, verdict, coalesce(confidence >= 0.7, false) AS said,
  CASE WHEN score >= 0.65 THEN 'accept' WHEN score <= 0.35 THEN 'reject' ELSE 'ambiguous' END AS band FROM c LEFT JOIN v ON v.candidate_id = c.candidate_id)
SELECT candidate_id, score, band, CASE WHEN band <> 'ambiguous' THEN band WHEN said THEN CASE WHEN verdict = 'wall' THEN 'accept' ELSE 'reject' END WHEN on_wall_layer THEN 'accept' ELSE 'reject' END AS outcome,
       CASE WHEN band <> 'ambiguous' THEN 'deterministic' WHEN said THEN 'adjudicated' ELSE 'ambiguous-default' END AS source FROM d""")
def decision_table(spark, sf):
    candidates = drawing(spark, sf, t.SCORED).select("candidate_id", "score", F.col("event_type").isin("click", "view").alias("on_wall_layer"))
    return decide.decide(candidates, drawing(spark, sf, _VERDICTS))


@query(f"""
WITH l AS (SELECT *, role LIKE 'wall%' AND confidence < 0.75 AND matched_ft >= 40 AND CASE WHEN paired_ft > 0 THEN matched_ft / paired_ft ELSE 0 END >= 0.6 AND long_share >= 0.5 AS raised FROM ({t.LAYERS}))
SELECT layer_id, role, raised, CASE WHEN raised THEN 0.75 ELSE confidence END AS confidence FROM l""")
def corroborate_roles(spark, sf):
    return decide.corroborate(drawing(spark, sf, t.LAYERS)).select("layer_id", "role", "raised", "confidence")


@query(f"SELECT layer_id, name, role, confidence FROM ({t.LAYERS}) WHERE NOT (role IN ('dimension', 'text_label', 'title_block', 'grid') AND confidence >= 0.7)")
def candidate_layers(spark, sf):
    return decide.candidate_layers(drawing(spark, sf, t.LAYERS)).select("layer_id", "name", "role", "confidence")


@query(f"""
WITH l AS (SELECT *, CASE WHEN confidence < 0.7 THEN 'low_confidence' WHEN entity_share >= 0.05 AND role NOT IN ('wall_structural', 'column') THEN 'large_non_wall_layer'
  WHEN trim(name) = '' OR lower(trim(name)) = 'defpoints' OR regexp_matches(trim(name), '^[0-9]+$') OR length(trim(name)) = 1 THEN 'uninformative_name' END AS reason FROM ({t.LAYERS})),
r AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY entity_share DESC, name, layer_id) AS rank FROM l WHERE reason IS NOT NULL)
SELECT sheet_id, layer_id, name, reason, rank, rank > 2 AS dropped FROM r""")
def escalation_topn(spark, sf):
    return decide.escalate(drawing(spark, sf, t.LAYERS), 2)


@query(f"SELECT wall_id, sheet_id, row_number() OVER (PARTITION BY sheet_id ORDER BY length_ft DESC, wall_id) AS number, (row_number() OVER (PARTITION BY sheet_id ORDER BY length_ft DESC, wall_id) - 1) // 4 AS batch FROM ({t.WALLS})")
def adjudication_batches(spark, sf):
    return decide.batches(drawing(spark, sf, t.WALLS), ["sheet_id"], [F.desc("length_ft"), "wall_id"], 4).select("wall_id", "sheet_id", "number", "batch")


# --- sets ---------------------------------------------------------------------------------------------------------


@query(f"""
WITH c AS ({t.CLAIMS}), k AS (SELECT sheet_id, source_id, count(DISTINCT element_id) AS k FROM c GROUP BY ALL)
SELECT c.sheet_id, element_id, count(DISTINCT c.source_id) AS n_ids FROM c JOIN k ON k.sheet_id = c.sheet_id AND k.source_id = c.source_id GROUP BY ALL HAVING bool_and(k = 1)""")
def unique_claims(spark, sf):
    return sets.unique_claims(drawing(spark, sf, t.CLAIMS), t.parts(spark, sf))


@query(f"""
WITH c AS (SELECT sheet_id, element_id, source_id, kind FROM ({t.CLAIMS})), f AS (SELECT * FROM c WHERE kind <> 'door'), l AS (SELECT * FROM c WHERE kind = 'door'),
x AS (SELECT DISTINCT f.sheet_id, f.element_id FROM f JOIN l ON l.sheet_id = f.sheet_id AND l.source_id = f.source_id)
SELECT f.* FROM f LEFT JOIN x ON x.sheet_id = f.sheet_id AND x.element_id = f.element_id WHERE x.element_id IS NULL UNION ALL SELECT * FROM l""")
def override_union(spark, sf):
    c = drawing(spark, sf, t.CLAIMS).select("sheet_id", "element_id", "source_id", "kind")
    return sets.override_union(c.filter("kind <> 'door'"), c.filter("kind = 'door'"), t.parts(spark, sf))


@query(f"SELECT sheet_id, source_id, element_id FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, source_id ORDER BY element_id DESC) AS r FROM ({t.CLAIMS})) WHERE r = 1")
def keyed_override(spark, sf):
    claims = drawing(spark, sf, t.CLAIMS).select("sheet_id", "source_id", "element_id")
    return sets.keyed_override(claims, ["sheet_id", "source_id"], F.desc("element_id"), t.parts(spark, sf))


@query(f"""
WITH c AS ({t.CLAIMS}), e AS (SELECT DISTINCT sheet_id, element_id, source_id FROM c WHERE kind = 'wall'), j AS (SELECT DISTINCT sheet_id, element_id, source_id FROM c WHERE kind = 'door'),
s AS (SELECT sheet_id, element_id, count(*) AS size FROM e GROUP BY ALL), m AS (SELECT e.sheet_id, e.element_id, j.element_id AS other_id, count(*) AS common FROM e JOIN j ON j.sheet_id = e.sheet_id AND j.source_id = e.source_id GROUP BY ALL)
SELECT m.sheet_id, m.element_id, other_id, common, size FROM m JOIN s ON s.sheet_id = m.sheet_id AND s.element_id = m.element_id WHERE common >= size * 0.5""")
def set_overlap_match(spark, sf):
    c = drawing(spark, sf, t.CLAIMS)
    of = lambda kind: c.filter(F.col("kind") == kind).select("sheet_id", "element_id", "source_id").distinct()
    return sets.set_overlap(of("wall"), of("door"))


@query(f"SELECT element_id, count(DISTINCT source_id) AS n_ids, sha256(string_agg(DISTINCT CAST(source_id AS VARCHAR), ',' ORDER BY source_id)) AS digest FROM ({t.CLAIMS}) GROUP BY 1".replace("string_agg(DISTINCT CAST(source_id AS VARCHAR), ',' ORDER BY source_id)", "array_to_string(list_transform(list_sort(list_distinct(list(source_id))), lambda x: CAST(x AS VARCHAR)), ',')"))
def provenance_merge(spark, sf):
    return sets.provenance(drawing(spark, sf, t.CLAIMS), ["element_id"])


# --- evaluation ---------------------------------------------------------------------------------------------------


@query(f"""
WITH d AS (SELECT sheet_id, score >= 0.6 AS p, is_wall AS a FROM ({t.SCORED})), c AS (SELECT sheet_id, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn FROM d GROUP BY 1)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def prf_scores(spark, sf):
    return evaluate.prf(drawing(spark, sf, t.SCORED).select("sheet_id", (F.col("score") >= 0.6).alias("predicted"), F.col("is_wall").alias("actual")), ["sheet_id"])


_FEEDBACK = f"SELECT DISTINCT element_id, kind, CASE WHEN element_id % 4 = 0 THEN NULL ELSE verdict END AS verdict FROM ({t.CLAIMS})"
_MISSING = "SELECT CASE c_custkey % 4 WHEN 0 THEN 'wall' WHEN 1 THEN 'door' ELSE 'column' END AS kind FROM customer"


@query(f"""
WITH j AS (SELECT kind, count(verdict) AS reviewed, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'wrong') AS wrong, count(*) FILTER (verdict = 'unsure') AS unsure, count(*) FILTER (verdict IS NULL) AS unreviewed FROM ({_FEEDBACK}) GROUP BY 1),
m AS (SELECT kind, count(*) AS missing FROM ({_MISSING}) GROUP BY 1),
d AS (SELECT coalesce(j.kind, m.kind) AS kind, coalesce(reviewed, 0) AS reviewed, coalesce(correct, 0) AS correct, coalesce(wrong, 0) AS wrong, coalesce(unsure, 0) AS unsure, coalesce(unreviewed, 0) AS unreviewed, coalesce(missing, 0) AS missing FROM j FULL JOIN m ON m.kind = j.kind)
SELECT *, round(correct / nullif(correct + wrong, 0), 3) AS precision, round(correct / nullif(correct + missing, 0), 3) AS recall_estimate FROM d""")
def feedback_summary(spark, sf):
    return evaluate.feedback_summary(drawing(spark, sf, _FEEDBACK), drawing(spark, sf, _MISSING))


@query(f"""
WITH s AS ({t.SCORED}), g AS (SELECT CAST(k * 5 AS DOUBLE) / 100 AS g FROM range(1, 20) r(k)),
a AS (SELECT g AS floor, count(*) FILTER (is_wall) AS above, count(*) AS n FROM g JOIN s ON score >= g GROUP BY 1 HAVING count(*) FILTER (is_wall) >= count(*) * 0.95),
b AS (SELECT g AS ceiling, count(*) FILTER (score <= g AND NOT is_wall) AS below FROM g, s GROUP BY 1 HAVING count(*) FILTER (score <= g AND NOT is_wall) >= count(*) FILTER (score <= g) * 0.95)
SELECT ceiling, floor, above + below AS settled FROM a JOIN b ON ceiling <= floor WHERE (SELECT count(*) >= 50 AND count(DISTINCT sheet_id) >= 5 FROM s) ORDER BY above + below DESC, floor DESC, ceiling LIMIT 1""")
def fit_bands(spark, sf):
    return evaluate.fit_bands(drawing(spark, sf, t.SCORED))


# --- floors and validation ----------------------------------------------------------------------------------------

_LEVELS = "SELECT CAST(s_nationkey AS BIGINT) AS sheet_id, CASE WHEN s_nationkey % 2 = 0 THEN CAST(s_suppkey % 4 AS DOUBLE) * 10 ELSE CAST(s_suppkey % 5 * (s_suppkey % 5) AS DOUBLE) END AS level FROM supplier"


@query(f"""
WITH d AS (SELECT sheet_id, round(level - lag(level) OVER (PARTITION BY sheet_id ORDER BY level), 6) AS step FROM (SELECT DISTINCT * FROM ({_LEVELS}))),
m AS (SELECT sheet_id, list_sort(list(step))[1 + count(*) // 2] AS m, count(*) AS n_steps FROM d WHERE step IS NOT NULL GROUP BY 1), w AS (SELECT d.sheet_id, max(abs(step - m)) AS worst FROM d JOIN m ON m.sheet_id = d.sheet_id GROUP BY 1)
SELECT m.sheet_id, n_steps, CASE WHEN m BETWEEN 1 AND 50 AND worst <= 0.35 + 1e-9 THEN round(m, 3) END AS spacing FROM m JOIN w ON w.sheet_id = m.sheet_id""")
def floor_level_spacing(spark, sf):
    return floors.level_spacing(drawing(spark, sf, _LEVELS))


_FLOORS = "SELECT CAST(c_nationkey AS BIGINT) AS sheet_id, c_custkey AS floor_ix, CASE WHEN c_custkey % 6 = 0 THEN CAST(c_custkey AS DOUBLE) / 10 END AS marker, CASE c_custkey % 3 WHEN 0 THEN 'Ground floor' WHEN 1 THEN 'First floor' ELSE 'Terrace' END AS name FROM customer"


@query(f"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY floor_ix) AS n FROM ({_FLOORS})),
k AS (SELECT *, max(CASE WHEN marker IS NOT NULL OR n = 1 THEN n END) OVER (PARTITION BY sheet_id ORDER BY n) AS b FROM o)
SELECT k.sheet_id, k.floor_ix, round(coalesce(o.marker, 0) + (k.n - k.b) * 10, 6) AS elevation, CASE WHEN k.marker IS NOT NULL THEN 'level-marker' ELSE 'assumed' END AS source FROM k JOIN o ON o.sheet_id = k.sheet_id AND o.n = k.b""")
def running_elevation(spark, sf):
    return floors.running_elevation(drawing(spark, sf, _FLOORS), 10.0)


@query(f"SELECT sheet_id, floor_ix, CASE WHEN r = 1 THEN name ELSE concat(name, ' (', r, ')') END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, name ORDER BY floor_ix) AS r FROM ({_FLOORS}))")
def distinct_names(spark, sf):
    return floors.distinct_names(drawing(spark, sf, _FLOORS), ["sheet_id"], "name", ["floor_ix"]).select("sheet_id", "floor_ix", "unique_name")


@query(f"""
SELECT sheet_id, floor_ix, above_ix, round(above - elevation, 6) AS rise FROM (SELECT sheet_id, floor_ix, elevation, lead(floor_ix) OVER w AS above_ix, lead(elevation) OVER w AS above
  FROM (SELECT sheet_id, floor_ix, coalesce(marker, floor_ix % 17) AS elevation FROM ({_FLOORS})) WINDOW w AS (PARTITION BY sheet_id ORDER BY elevation, floor_ix)) WHERE above_ix IS NOT NULL""")
def storey_neighbours(spark, sf):
    return floors.neighbours(drawing(spark, sf, _FLOORS).select("sheet_id", "floor_ix", F.coalesce("marker", (F.col("floor_ix") % 17).cast("double")).alias("elevation")))


_BAD_WALLS = f"SELECT wall_id, CASE WHEN wall_id % 50 = 0 THEN 0.0 WHEN wall_id % 51 = 0 THEN NULL ELSE length_ft / 4 END AS length_ft, CASE WHEN wall_id % 70 = 0 THEN 0.0 ELSE thickness_ft END AS thickness_ft FROM ({t.WALLS})"
_ISSUES_SQL = f"""WITH w AS ({_BAD_WALLS}), i AS (
SELECT 'error' AS severity, wall_id, 'nonfinite_geometry' AS code FROM w WHERE length_ft IS NULL OR thickness_ft IS NULL
UNION ALL SELECT 'error', wall_id, 'zero_length_wall' FROM w WHERE length_ft <= 1e-9 UNION ALL SELECT 'error', wall_id, 'invalid_wall_thickness' FROM w WHERE thickness_ft <= 0
UNION ALL SELECT 'warn', wall_id, 'thick_wall' FROM w WHERE thickness_ft > 0.4 UNION ALL SELECT 'info', wall_id, 'short_wall' FROM w WHERE length_ft < thickness_ft)"""


@query(_ISSUES_SQL + "SELECT severity, concat('wall-', wall_id) AS entity, code FROM i")
def validation_issues(spark, sf):
    return validate.wall_issues(drawing(spark, sf, _BAD_WALLS).withColumns({c: F.col(c).cast("double") for c in ("length_ft", "thickness_ft")}))


@query(_ISSUES_SQL + "SELECT severity, code, count(*) AS n FROM i GROUP BY ROLLUP (severity, code)")
def issue_rollup(spark, sf):
    return validate.counts_by_severity(validation_issues(spark, sf))
