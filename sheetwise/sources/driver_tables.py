"""Drawing tables made from the test data's star schema. Each is SQL text that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from sheetwise.runtime import read_table

#: Lines of drawings in parallel families of each sheet and layer.
SEGMENTS = """
SELECT DISTINCT l_orderkey % 64 AS sheet_id, concat(l_returnflag, l_linestatus) AS layer, CAST(l_linenumber % 2 AS BIGINT) AS family,
       CAST(l_partkey % 200 AS DOUBLE) AS lo, CAST(l_partkey % 200 + 1 + CAST(floor(l_quantity) AS BIGINT) % 20 AS DOUBLE) AS hi,
       CAST(l_suppkey % 100 AS DOUBLE) / 4 AS off
FROM lineitem"""
#: Free segments with end points, some of them slanted.
LINES = """
SELECT DISTINCT l_orderkey % 64 AS sheet_id, concat(l_returnflag, l_linestatus) AS layer, concat('T', l_linenumber) AS entity_type,
       CAST(l_partkey % 200 AS DOUBLE) AS x0, CAST(l_suppkey % 100 AS DOUBLE) / 4 AS y0,
       CAST(l_partkey % 200 + CAST(floor(l_quantity) AS BIGINT) % 20 AS DOUBLE) AS x1,
       CAST(l_suppkey % 100 AS DOUBLE) / 4 + CASE WHEN l_linenumber % 3 = 0 THEN 1.5 ELSE 0.0 END AS y1
FROM lineitem"""
#: Walls with a thickness and a length in feet.
WALLS = """
SELECT DISTINCT o_orderkey AS wall_id, o_custkey % 40 AS sheet_id, o_orderpriority AS layer, CAST(o_orderkey % 37 + 1 AS DOUBLE) / 2 AS length_ft,
       CAST(o_custkey % 9 + 3 AS DOUBLE) / 24 AS thickness_ft, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS confidence
FROM orders"""
#: Positions on sheets.
POINTS = """
SELECT c_custkey AS point_id, CAST(c_nationkey AS BIGINT) AS sheet_id, CAST(c_custkey * 37 % 1000 AS DOUBLE) / 10 AS x, CAST(c_custkey * 91 % 1000 AS DOUBLE) / 10 AS y
FROM customer"""
#: Axis-parallel boxes on sheets, as spaces or plans.
BOXES = """
SELECT s_suppkey AS box_id, CAST(s_nationkey AS BIGINT) AS sheet_id, CAST(s_suppkey * 53 % 900 AS DOUBLE) / 10 AS x0, CAST(s_suppkey * 17 % 900 AS DOUBLE) / 10 AS y0,
       CAST(s_suppkey * 53 % 900 AS DOUBLE) / 10 + 5 + s_suppkey % 30 AS x1, CAST(s_suppkey * 17 % 900 AS DOUBLE) / 10 + 5 + s_suppkey % 20 AS y1
FROM supplier"""
#: A hierarchy of four levels: orders below customers below nations below regions.
HIERARCHY = """
SELECT concat('n', n_nationkey) AS child, concat('r', n_regionkey) AS parent FROM nation
UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey) FROM customer
UNION ALL SELECT DISTINCT concat('o', o_orderkey), concat('c', o_custkey) FROM orders"""
#: Printed dimensions: source units measured, and the feet they state.
DIMENSIONS = """
SELECT p_partkey AS dim_id, p_partkey % 50 AS sheet_id, CAST(p_size + 4 AS DOUBLE) AS feet,
       CAST(p_size + 4 AS DOUBLE) * (12 + p_partkey % 50) + CASE WHEN p_partkey % 7 = 0 THEN 400.0 ELSE CAST(p_partkey % 5 AS DOUBLE) / 10 END AS units
FROM part"""
#: Dimension and label texts.
TEXTS = """
SELECT p_partkey AS text_id, p_partkey % 50 AS sheet_id,
       CASE p_partkey % 6
         WHEN 0 THEN concat(p_size, chr(39), '-', p_partkey % 14, chr(34))
         WHEN 1 THEN concat(p_size, chr(39), '-', p_partkey % 11, ' ', p_partkey % 5, '/', p_partkey % 4, chr(34))
         WHEN 2 THEN concat(p_size, chr(39), '-', p_partkey % 12, chr(34), 'x', p_partkey % 30, chr(39), '-3', chr(34))
         WHEN 3 THEN concat('LIVING Clear Ht. - ', p_size, chr(39), ' LVL + ', p_partkey % 9, chr(39), '-6', chr(34))
         WHEN 4 THEN concat(chr(123), chr(92), 'fArial;DOUBLE HEIGHT', chr(125), chr(92), 'POPEN TO BELOW ', p_size)
         ELSE concat(p_name, ' pool lvl. - ', p_size, chr(39)) END AS text
FROM part"""
#: Layers with a role and the evidence about it.
LAYERS = """
SELECT s_suppkey AS layer_id, CAST(s_nationkey AS BIGINT) AS sheet_id,
       concat(CASE s_suppkey % 8 WHEN 0 THEN 'A-WALL-' WHEN 1 THEN 'Door_' WHEN 2 THEN 'furn loose ' WHEN 3 THEN 'DEFPOINTS' WHEN 4 THEN '0' WHEN 5 THEN 'WIN-GLAZ ' WHEN 6 THEN 'col grid ' ELSE 'xref-' END,
              CASE WHEN s_suppkey % 8 = 3 THEN '' ELSE concat(s_suppkey % 13, '') END) AS name,
       CASE s_suppkey % 5 WHEN 0 THEN 'wall_structural' WHEN 1 THEN 'door' WHEN 2 THEN 'dimension' WHEN 3 THEN 'column' ELSE 'furniture' END AS role,
       CAST(s_suppkey % 101 AS DOUBLE) / 100 AS confidence, CAST(s_suppkey * 7 % 100 AS DOUBLE) / 100 AS entity_share,
       CAST(s_suppkey * 13 % 300 AS DOUBLE) AS paired_ft, CAST(s_suppkey * 13 % 300 AS DOUBLE) * (s_suppkey % 11) / 10 AS matched_ft, CAST(s_suppkey % 9 AS DOUBLE) / 8 AS long_share
FROM supplier"""
#: Elements with the ids they claim and what a reviewer said.
CLAIMS = """
SELECT DISTINCT o_orderkey AS element_id, o_custkey % 20 AS sheet_id, CASE o_orderkey % 3 WHEN 0 THEN 'wall' WHEN 1 THEN 'door' ELSE 'window' END AS kind,
       l_partkey AS source_id, CASE o_orderstatus WHEN 'F' THEN 'correct' WHEN 'O' THEN 'wrong' ELSE 'unsure' END AS verdict
FROM orders JOIN lineitem ON l_orderkey = o_orderkey"""
#: Scored candidates with the truth about them.
SCORED = """
SELECT event_id AS candidate_id, user_id % 25 AS sheet_id, CAST(CAST(floor(value * 100) AS BIGINT) % 100 AS DOUBLE) / 100 AS score,
       CASE WHEN event_id % 97 = 0 THEN CAST(floor(value * 100) AS BIGINT) % 100 < 62 ELSE CAST(floor(value * 100) AS BIGINT) % 100 >= 62 END AS is_wall,
       event_type, CAST(floor(value) AS BIGINT) % 3 AS flags
FROM events"""
#: Walls as segments along either axis.
CROSS_WALLS = """
SELECT c_custkey AS wall_id, CAST(c_nationkey AS BIGINT) AS sheet_id, CAST(c_custkey * 37 % 1000 AS DOUBLE) / 10 AS x0, CAST(c_custkey * 91 % 1000 AS DOUBLE) / 10 AS y0,
       CAST(c_custkey * 37 % 1000 AS DOUBLE) / 10 + CASE WHEN c_custkey % 2 = 0 THEN CAST(5 + c_custkey % 23 AS DOUBLE) ELSE 0.0 END AS x1,
       CAST(c_custkey * 91 % 1000 AS DOUBLE) / 10 + CASE WHEN c_custkey % 2 = 0 THEN 0.0 ELSE CAST(5 + c_custkey % 19 AS DOUBLE) END AS y1
FROM customer"""
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations", "embeddings")


#: Rows of a large table that one task joins, sorts or compares.
ROWS_A_TASK = 300_000


def parts(spark: SparkSession, sf_dir: str, table: str = "lineitem") -> int:
    """Over how many partitions rows of ``table`` are dealt: in number with the rows, which Parquet files state."""
    return max(spark.sparkContext.defaultParallelism, read_table(spark, sf_dir, table).count() // ROWS_A_TASK + 1)


def drawing(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the texts above over the tables of ``sf_dir``. Where claims are asked for, orders meet their items in stated
    partitions by order, in which they are also told apart: Spark would join small files into partitions of many rows."""
    pattern = r"\b(FROM|JOIN) (" + "|".join(TABLES) + r")\b"
    used = {t: read_table(spark, sf_dir, t) for t in {m[1] for m in re.findall(pattern, sql)}}
    if CLAIMS in sql:
        n = parts(spark, sf_dir)
        used |= {t: used[t].repartition(n, key) for t, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"))}
    return spark.sql(re.sub(pattern, r"\1 {\2}", sql), **used)
