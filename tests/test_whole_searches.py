"""Searches are whole unless a budget is given, at sizes where the former default budgets cut them."""

from pyspark.sql import functions as F

from sheetwise.operators import library, templates


def bars(spark, n):
    point = lambda x: F.struct(x.cast("double").alias("x"), F.lit(0.0).alias("y"))
    return spark.range(n).select(F.lit(1).cast("long").alias("sheet_id"), F.col("id").alias("part_id"), F.col("id").alias("source_id"), F.lit("F").alias("layer"), F.lit("path").alias("category"), F.array(point(F.col("id") * 9), point(F.col("id") * 9 + 3)).alias("points"))


def test_library_tries_all_poses(spark):
    templates = spark.createDataFrame([(1, "bar", 1.0, 6.0, [float(a) for a in range(0, 360, 45)], True)], "template_id long, kind string, size_min double, size_max double, angles array<double>, mirror boolean")
    paths = spark.createDataFrame([(1, 0, "path", [(0.0, 0.0), (1.0, 0.0)])], "template_id long, path_no int, category string, points array<struct<x:double,y:double>>")
    verdicts = library.match_library(bars(spark, 400), templates, paths).groupBy("verdict").count().collect()  # 6400 trials
    assert [tuple(r) for r in verdicts] == [("found", 400)]


def test_templates_try_all_poses(spark):
    seeds = spark.createDataFrame([(1, 1, "bar", 5)], "sheet_id long, template_id long, kind string, part_id long")
    verdicts = templates.match_templates(bars(spark, 1300), seeds).groupBy("verdict").count().collect()  # 5200 poses
    assert [tuple(r) for r in verdicts] == [("found", 1300)]
