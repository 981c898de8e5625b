"""More registered queries: captions, readings, storeys and small set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sheetwise.functions import text
from sheetwise.operators import captions
from sheetwise.plans.catalog import query
from sheetwise.sources import driver_tables as t
from sheetwise.sources.driver_tables import drawing

_CAPTIONS = """
SELECT c_custkey AS text_id, CAST(c_nationkey AS BIGINT) AS sheet_id, concat(CASE c_custkey % 9 WHEN 0 THEN 'GROUND FLOOR PLAN' WHEN 1 THEN 'First floor' WHEN 2 THEN 'terrace level' WHEN 3 THEN 'SECOND FLOOR PLAN' WHEN 4 THEN 'section at first floor'
         WHEN 5 THEN 'roof' WHEN 6 THEN 'Stilt parking plan' WHEN 7 THEN 'up to third floor level' ELSE 'basement plan' END, ' ', c_custkey % 4) AS text,
       CAST(c_custkey % 5 + 1 AS DOUBLE) AS height, CAST(c_custkey * 37 % 1000 AS DOUBLE) / 10 AS x, CAST(c_custkey * 91 % 1000 AS DOUBLE) / 10 AS y
FROM customer"""
_SAID = "concat(' ', array_to_string(regexp_extract_all(lower(text), '[a-z0-9_]+'), ' '), ' ')"
_HAS = lambda words: "(" + " OR ".join(f"contains({_SAID}, ' {w} ')" for w in words) + ")"
_WORD_SQL = f"CASE WHEN NOT {_HAS(text.FLOOR_NOTE_WORDS)} AND {_HAS(text.FLOOR_KIND_WORDS)} THEN nullif(regexp_extract(lower(text), '\\b(" + "|".join(text.FLOOR_WORDS) + ")\\b', 1), '') END"


@query(f"SELECT text_id, {_WORD_SQL} AS word FROM ({_CAPTIONS})")
def floor_words(spark, sf):
    return drawing(spark, sf, _CAPTIONS).select("text_id", text.floor_word(F.col("text")).alias("word"))


@query(f"""
WITH c AS (SELECT *, {_WORD_SQL} AS word FROM ({_CAPTIONS})), b AS ({t.BOXES}),
m AS (SELECT c.sheet_id, text_id, word, height, box_id, CASE WHEN x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 THEN 1 WHEN x BETWEEN x0 - 2 AND x1 + 2 AND y < y0 AND y0 - y <= 6 THEN 0 WHEN x BETWEEN x0 - 2 AND x1 + 2 AND y > y1 AND y - y1 <= 6 THEN 2
        WHEN y BETWEEN y0 AND y1 AND CASE WHEN x < x0 THEN x0 - x ELSE x - x1 END > 0 AND CASE WHEN x < x0 THEN x0 - x ELSE x - x1 END <= 6 THEN 3 END AS class, x, y, x0, y0, x1, y1
      FROM c JOIN b ON b.sheet_id = c.sheet_id WHERE word IS NOT NULL),
d AS (SELECT *, round(CASE class WHEN 0 THEN y0 - y WHEN 1 THEN 0 WHEN 2 THEN y - y1 ELSE CASE WHEN x < x0 THEN x0 - x ELSE x - x1 END END, 9) AS distance FROM m WHERE class IS NOT NULL),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, text_id ORDER BY class, distance, box_id) AS k FROM d) WHERE k = 1),
p AS (SELECT * FROM (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY sheet_id, box_id ORDER BY class, height DESC, distance, text_id, box_id) AS k FROM o) WHERE k = 1),
w AS (SELECT * FROM (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY sheet_id, word ORDER BY class, height DESC, distance, text_id, box_id) AS k FROM p) WHERE k = 1)
SELECT sheet_id, box_id, text_id, word, class, distance FROM w""")
def caption_plans(spark, sf):
    c = drawing(spark, sf, _CAPTIONS).withColumn("word", text.floor_word(F.col("text"))).filter("word is not null")
    return captions.caption_plans(c, drawing(spark, sf, t.BOXES), 6.0)


_READINGS = f"SELECT point_id AS reading_id, sheet_id, concat('T', point_id % 3) AS text, CAST(point_id % 7 AS DOUBLE) / 10 AS confidence, floor(x / 10) AS x, floor(y / 10) AS y, 6.0 AS w, 6.0 AS h FROM ({t.POINTS})"


@query()
def merged_readings(spark, sf):
    d = drawing(spark, sf, _READINGS)
    return captions.merge_readings(d.withColumns({c: F.col(c).cast("double") for c in ("x", "y", "w", "h")}))


@query(f"SELECT point_id, sheet_id, round(x * 0.5 - y * 0.25 + 3, 9) AS x, round(x * 0.25 + y * 0.5 - 1, 9) AS y FROM ({t.POINTS})")
def image_to_drawing(spark, sf):
    return captions.map_points(drawing(spark, sf, t.POINTS), (0.5, -0.25, 3.0, 0.25, 0.5, -1.0))


_UNITS = "SELECT p_partkey % 50 AS sheet_id, CASE WHEN p_partkey % 50 < 25 THEN 'mm' WHEN p_size < 25 THEN 'in' ELSE 'ft' END AS unit FROM part"


@query(f"SELECT sheet_id, CASE WHEN count(DISTINCT unit) = 1 THEN min(unit) END AS unit, count(*) AS n_votes FROM ({_UNITS}) GROUP BY 1")
def dimstyle_vote(spark, sf):
    return captions.agreed_unit(drawing(spark, sf, _UNITS))


@query(f"""SELECT s.sheet_id, coalesce(min(least(x0, x1)), 0) AS min_x, coalesce(min(least(y0, y1)), 0) AS min_y, coalesce(max(greatest(x0, x1)), 0) AS max_x, coalesce(max(greatest(y0, y1)), 0) AS max_y
FROM (SELECT DISTINCT o_orderkey % 70 AS sheet_id FROM orders) s LEFT JOIN ({t.LINES}) l ON l.sheet_id = s.sheet_id GROUP BY 1""")
def sheet_extents(spark, sf):
    return captions.extents(drawing(spark, sf, t.LINES), drawing(spark, sf, "SELECT DISTINCT o_orderkey % 70 AS sheet_id FROM orders"))


@query(f"""
WITH d AS (SELECT sheet_id, box_id, x1 - x0 AS w, y1 - y0 AS h, lead(box_id) OVER o AS above_id, lead(x1 - x0) OVER o AS w2, lead(y1 - y0) OVER o AS h2 FROM ({t.BOXES}) WINDOW o AS (PARTITION BY sheet_id ORDER BY box_id))
SELECT sheet_id, box_id, above_id, round(least(w, w2) * least(h, h2) / least(w * h, w2 * h2), 6) AS coverage, least(w, w2) * least(h, h2) / least(w * h, w2 * h2) >= 0.5 AS stacked FROM d WHERE above_id IS NOT NULL""")
def stacked_storeys(spark, sf):
    return captions.stacked(drawing(spark, sf, t.BOXES))


_LENGTHS = "SELECT p_partkey AS text_id, concat(CAST(p_size AS DOUBLE), CASE p_partkey % 6 WHEN 0 THEN ' mm' WHEN 1 THEN 'CM' WHEN 2 THEN ' m ' WHEN 3 THEN 'ft' WHEN 4 THEN ' in' ELSE ' yd' END) AS text, CAST(p_size AS DOUBLE) AS size FROM part"


@query(f"SELECT text_id, round(size * CASE text_id % 6 WHEN 0 THEN 1 / 304.8 WHEN 1 THEN 1 / 30.48 WHEN 2 THEN 1 / 0.3048 WHEN 3 THEN 1.0 WHEN 4 THEN 1 / 12.0 END, 9) AS feet FROM ({_LENGTHS})")
def explicit_lengths(spark, sf):
    return drawing(spark, sf, _LENGTHS).select("text_id", F.round(text.explicit_length(F.col("text")), 9).alias("feet"))


_REASONS = "SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN 'this is a RAILING by the pool' WHEN 1 THEN 'goes -Z' WHEN 2 THEN 'Compound wall' WHEN 3 THEN 'site wall' WHEN 4 THEN 'a parapet' WHEN 5 THEN NULL ELSE 'wrong' END AS reason FROM supplier"


@query(f"""SELECT s_suppkey, CASE WHEN lower(reason) LIKE '%railing%' THEN 'railing' WHEN lower(reason) LIKE '%pool%' OR lower(reason) LIKE '%-z%' THEN 'pool_edge'
  WHEN regexp_matches(lower(reason), 'boundary|compound|site wall') THEN 'site_wall' WHEN lower(reason) LIKE '%parapet%' THEN 'parapet' ELSE '' END AS wall_class FROM ({_REASONS})""")
def reason_classes(spark, sf):
    return drawing(spark, sf, _REASONS).select("s_suppkey", text.reason_class(F.col("reason")).alias("wall_class"))


_RATIOS = "SELECT p_partkey, CAST(CASE p_partkey % 6 WHEN 0 THEN 25.4 WHEN 1 THEN 12.0 WHEN 2 THEN 304.8 WHEN 3 THEN 30.48 WHEN 4 THEN 2.54 ELSE 1.0 END AS DOUBLE) * (1 + CAST(p_size - 25 AS DOUBLE) / 2000) AS ratio FROM part"


@query(f"SELECT p_partkey, CASE " + " ".join(f"WHEN abs(ratio - {f}) / {f} <= 0.01 THEN '{said}'" for f, said in text.UNIT_RATIOS) + f" END AS hint FROM ({_RATIOS})")
def unit_hints(spark, sf):
    return drawing(spark, sf, _RATIOS).select("p_partkey", text.unit_hint(F.col("ratio")).alias("hint"))


@query(f"SELECT wall_id, dense_rank() OVER (PARTITION BY sheet_id ORDER BY thickness_ft DESC, length_ft DESC) AS rank FROM ({t.WALLS})")
def junction_run_order(spark, sf):
    order = Window.partitionBy("sheet_id").orderBy(F.desc("thickness_ft"), F.desc("length_ft"))
    return drawing(spark, sf, t.WALLS).select("wall_id", F.dense_rank().over(order).alias("rank"))


_CACHE = "SELECT o_custkey AS key, max(o_orderkey) AS answer FROM orders WHERE o_orderkey % 7 <> 1 GROUP BY o_custkey"
_FRESH = "SELECT o_custkey AS key, min(o_orderkey) AS answer FROM orders WHERE o_orderkey % 7 = 1 GROUP BY o_custkey"


@query(f"SELECT coalesce(f.key, c.key) AS key, CASE WHEN f.key IS NOT NULL THEN f.answer ELSE c.answer END AS answer FROM ({_CACHE}) c FULL JOIN ({_FRESH}) f ON f.key = c.key")
def cache_upsert(spark, sf):
    return captions.upsert(drawing(spark, sf, _CACHE), drawing(spark, sf, _FRESH), ["key"])


@query(f"SELECT sheet_id, source_id FROM ({t.CLAIMS}) WHERE kind = 'wall' EXCEPT SELECT sheet_id, source_id FROM ({t.CLAIMS}) WHERE kind = 'door'")
def unused_ids(spark, sf):
    c = drawing(spark, sf, t.CLAIMS)
    ids = lambda kind: c.filter(F.col("kind") == kind).select("sheet_id", "source_id").distinct()
    return ids("wall").join(ids("door"), ["sheet_id", "source_id"], "left_anti")
