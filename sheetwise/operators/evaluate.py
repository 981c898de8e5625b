"""Evaluation and feedback: rates per kind, review summaries and fitted bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def _ratio(a: Column, b: Column, digits: int = 6) -> Column:
    return F.when(b != 0, F.round(a / b, digits))


def prf(rows: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of (keys, predicted, actual); null where undefined."""
    p, a = F.col("predicted"), F.col("actual")
    d = rows.groupBy(*keys).agg(_count(p & a).alias("tp"), _count(p & ~a).alias("fp"), _count(~p & a).alias("fn"))
    return d.select("*", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def feedback_summary(elements: DataFrame, missing: DataFrame) -> DataFrame:
    """Per kind of (kind, verdict): reviewed, correct, wrong, unsure, precision, missing, recall estimate, unreviewed."""
    v = F.col("verdict")
    judged = elements.groupBy("kind").agg(_count(v.isNotNull()).alias("reviewed"), _count(v == "correct").alias("correct"), _count(v == "wrong").alias("wrong"), _count(v == "unsure").alias("unsure"), _count(v.isNull()).alias("unreviewed"))
    lost = missing.groupBy("kind").agg(F.count("*").alias("missing"))
    d = judged.join(lost, "kind", "full").na.fill(0)
    return d.select("*", _ratio(F.col("correct"), F.col("correct") + F.col("wrong"), 3).alias("precision"), _ratio(F.col("correct"), F.col("correct") + F.col("missing"), 3).alias("recall_estimate"))


def fit_bands(labelled: DataFrame, least: int = 50, sheets: int = 5, right: float = 0.95) -> DataFrame:
    """The (ceiling, floor) on a grid of 0.05 that settles most candidates (score, is_wall, sheet_id) with both sides at
    least ``right`` right; ties go to the higher floor, then the lower ceiling. Empty with too little feedback. Scores are
    counted by value before they meet the grid."""
    spark = labelled.sparkSession
    grid = spark.range(1, 20).select((F.col("id") * 5 / 100).alias("g"))
    enough = labelled.agg(F.count("*").alias("n"), F.count_distinct("sheet_id").alias("k")).filter(f"n >= {least} and k >= {sheets}")
    counted = labelled.groupBy("score").agg(F.count("*").alias("n"), _count(F.col("is_wall")).alias("walls"))
    side = lambda low: counted.join(F.broadcast(grid), (F.col("score") <= F.col("g")) if low else (F.col("score") >= F.col("g"))).groupBy("g").agg(F.sum("n").alias("n"), (F.sum(F.col("n") - F.col("walls")) if low else F.sum("walls")).cast("long").alias("good")).filter(F.col("good") >= F.col("n") * right)
    floors = side(False).select(F.col("g").alias("floor"), F.col("good").alias("above"))
    below = side(True).select(F.col("g").alias("ceiling"), F.col("good").alias("below"))
    empty = grid.join(counted.agg(F.min("score").alias("least")), F.col("g") < F.col("least")).select(F.col("g").alias("ceiling"), F.lit(0).cast("long").alias("below"))
    both = floors.join(F.broadcast(below.unionByName(empty)), F.col("ceiling") <= F.col("floor")).crossJoin(F.broadcast(enough.select("n")))  # of 19 rows each
    best = both.agg(F.max(F.struct((F.col("above") + F.col("below")).alias("correct"), "floor", (-F.col("ceiling")).alias("c"))).alias("best"))
    return best.filter("best is not null").select((-F.col("best.c")).alias("ceiling"), F.col("best.floor").alias("floor"), F.col("best.correct").alias("settled"))
