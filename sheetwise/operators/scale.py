"""Scale evidence: medians, votes, nearest runs and mutual matches. Tables are keyed by sheet_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.operators.inventory import ranked_percentiles


def robust_median(dims: DataFrame, tolerance_in: float = 2.0) -> DataFrame:
    """Units per foot by a median taken twice: the second over dimensions (feet, units) that the first explains within the
    tolerance. Sheets on which fewer than two agree have none."""
    d = dims.withColumn("ratio", F.col("units") / F.col("feet"))
    first = d.groupBy("sheet_id").agg(F.median("ratio").alias("m"), F.count("*").alias("n")).filter("n >= 2 and m > 0")
    agreeing = d.join(first, "sheet_id").filter(F.abs(F.col("units") / F.col("m") - F.col("feet")) * 12 <= tolerance_in)
    return agreeing.groupBy("sheet_id").agg(F.median("ratio").alias("units_per_foot"), F.count("*").alias("support")).filter("support >= 2")


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The sorted value at index n // 2 of each group, which averages nothing."""
    return ranked_percentiles(df, keys, value, (0.5,)).withColumnRenamed("p50", "upper_median")


def nearest_value(values: DataFrame, targets: DataFrame) -> DataFrame:
    """For each (sheet_id, target_id, target) the nearest (sheet_id, value), the lower in a tie: an as-of look in both
    directions over one sort."""
    both = values.select("sheet_id", F.col("value").alias("v"), F.lit(None).cast("long").alias("target_id")).distinct().unionByName(targets.select("sheet_id", F.col("target").alias("v"), "target_id"))
    given = F.when(F.col("target_id").isNull(), F.col("v"))
    up = Window.partitionBy("sheet_id").orderBy("v", F.col("target_id").asc_nulls_first())
    down = Window.partitionBy("sheet_id").orderBy(F.desc("v"), F.col("target_id").asc_nulls_first())
    d = both.withColumns({"below": F.last(given, True).over(up), "above": F.last(given, True).over(down)}).filter("target_id is not null")
    lower = F.col("above").isNull() | (F.col("v") - F.col("below") <= F.col("above") - F.col("v"))
    nearest = F.when(F.col("below").isNotNull() & lower, F.col("below")).otherwise(F.col("above"))
    return d.select("sheet_id", "target_id", nearest.alias("nearest"), F.round(F.abs(F.col("v") - nearest), 6).alias("distance"))


def scale_vote(dims: DataFrame, candidates: DataFrame, tolerance_in: float = 2.0, share: float = 0.25, least: int = 3) -> DataFrame:
    """Per sheet the candidate scale (sheet_id, scale) that explains most dimensions within the tolerance, then the one of
    the smaller worst residual, then the smaller; only with support from ``least`` and a ``share`` of the dimensions.
    Candidates within 0.01 % of a smaller one, step by step, count once."""
    order = Window.partitionBy("sheet_id").orderBy("scale")
    bands = candidates.select("sheet_id", "scale").distinct().withColumn("_before", F.lag("scale").over(order))
    bands = bands.filter(F.col("_before").isNull() | (F.col("scale") - F.col("_before") > F.col("scale") * 1e-4)).drop("_before")
    residual = F.abs(F.col("units") / F.col("scale") - F.col("feet")) * 12
    votes = dims.join(bands, "sheet_id").filter(residual <= tolerance_in).groupBy("sheet_id", "scale").agg(F.countDistinct("dim_id").alias("support"), F.round(F.max(residual), 6).alias("worst"))
    best = votes.groupBy("sheet_id").agg(F.max(F.struct("support", (-F.col("worst")).alias("w"), (-F.col("scale")).alias("s"))).alias("best"))
    need = dims.groupBy("sheet_id").agg(F.greatest(F.lit(least), F.ceil(F.countDistinct("dim_id") * share)).alias("need"))
    return best.join(need, "sheet_id").filter("best.support >= need").select("sheet_id", (-F.col("best.s")).alias("scale"), F.col("best.support").alias("support"), (-F.col("best.w")).alias("worst_in"))


def mutual_matches(pairs: DataFrame, one: str, other: str) -> DataFrame:
    """Pairs whose two sides have no other partner."""
    count = lambda c: F.count("*").over(Window.partitionBy("sheet_id", c))
    return pairs.withColumns({"_a": count(one), "_b": count(other)}).filter("_a = 1 and _b = 1").drop("_a", "_b")


def first_rung(*rungs: Column) -> Column:
    """The scale ladder: the first rung with a positive finite value."""
    return F.coalesce(*[F.when((r > 0) & (r < float("inf")) & ~F.isnan(r), r) for r in rungs])
