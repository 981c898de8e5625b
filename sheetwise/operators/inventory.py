"""Layer statistics: inventory, frequencies, entity mix and thickness evidence.

Percentiles are nearest-rank by index floor(n * q), found over the distinct values and their counts, so that a layer's
values are summed before they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXIS_TOLERANCE = 0.02
QUANTILES = (0.1, 0.5, 0.9)


def ranked_percentiles(df: DataFrame, keys: list[str], value: str, quantiles=QUANTILES) -> DataFrame:
    """A column p10, p50, ... per quantile: the value at index min(n - 1, floor(n * q)) of each group's sorted values."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("_k"))
    order = Window.partitionBy(*keys).orderBy(value)
    placed = counted.withColumns({"_last": F.sum("_k").over(order), "_n": F.sum("_k").over(Window.partitionBy(*keys))})
    hit = lambda q: (F.col("_last") > F.least(F.col("_n") - 1, F.floor(F.col("_n") * q))) & (F.col("_last") - F.col("_k") <= F.least(F.col("_n") - 1, F.floor(F.col("_n") * q)))
    return placed.groupBy(*keys).agg(*[F.max(F.when(hit(q), F.col(value))).alias(f"p{round(q * 100)}") for q in quantiles])


def axis_aligned() -> Column:
    return (F.abs(F.col("x1") - F.col("x0")) < AXIS_TOLERANCE) | (F.abs(F.col("y1") - F.col("y0")) < AXIS_TOLERANCE)


def layer_inventory(lines: DataFrame) -> DataFrame:
    """Per sheet and layer: lines, share of axis-aligned ones, bounding box and length percentiles."""
    d = lines.withColumn("length", F.round(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), 6))
    keys = ["sheet_id", "layer"]
    sums = d.groupBy(*keys).agg(
        F.count("*").alias("n_lines"),
        (F.sum(axis_aligned().cast("long")) / F.count("*")).alias("axis_share"),
        F.min(F.least("x0", "x1")).alias("min_x"), F.min(F.least("y0", "y1")).alias("min_y"),
        F.max(F.greatest("x0", "x1")).alias("max_x"), F.max(F.greatest("y0", "y1")).alias("max_y"),
    )
    return sums.join(ranked_percentiles(d, keys, "length"), keys)


def top_frequencies(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """The ``k`` most frequent values of each group with their rank; ties by value."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))).filter(F.col("rank") <= k)


def entity_mix(lines: DataFrame) -> DataFrame:
    """Per sheet and layer: share of the sheet's lines, and its box's share of the sheet's box, at most 1."""
    box = [F.min(F.least("x0", "x1")).alias("ax"), F.min(F.least("y0", "y1")).alias("ay"), F.max(F.greatest("x0", "x1")).alias("bx"), F.max(F.greatest("y0", "y1")).alias("by")]
    layers = lines.groupBy("sheet_id", "layer").agg(F.count("*").alias("n"), *box)
    sheet = Window.partitionBy("sheet_id")
    area = (F.max("bx").over(sheet) - F.min("ax").over(sheet)) * (F.max("by").over(sheet) - F.min("ay").over(sheet))
    own = (F.col("bx") - F.col("ax")) * (F.col("by") - F.col("ay"))
    return layers.select("sheet_id", "layer", "n", (F.col("n") / F.sum("n").over(sheet)).alias("entity_share"), F.when(area > 0, F.least(F.lit(1.0), own / area)).otherwise(0.0).alias("extent_share"))


def _matches(thickness: Column, declared: tuple[float, ...], tolerance: float) -> Column:
    out = F.lit(False)
    for d in declared:
        out = out | (F.abs(thickness - d) <= tolerance + 1e-9)
    return out


def thickness_evidence(walls: DataFrame, declared: tuple[float, ...], tolerance: float, long_ft: float = 4.0) -> DataFrame:
    """Per layer: paired feet, feet of a declared thickness, and the share of these in long runs."""
    length, match = F.col("length_ft"), _matches(F.col("thickness_ft"), declared, tolerance)
    sums = walls.groupBy("sheet_id", "layer").agg(F.sum(length).alias("paired_ft"), F.sum(F.when(match, length).otherwise(0.0)).alias("matched_ft"), F.sum(F.when(match & (length >= long_ft), length).otherwise(0.0)).alias("long_ft"))
    return sums.select("sheet_id", "layer", "paired_ft", "matched_ft", F.when(F.col("matched_ft") > 0, F.col("long_ft") / F.col("matched_ft")).otherwise(0.0).alias("long_share"))


def thickness_modes(walls: DataFrame, floor: float = 0.7, share: float = 0.1) -> DataFrame:
    """Thicknesses, to a quarter inch, with at least ``share`` of a sheet's confident length."""
    binned = walls.filter(F.col("confidence") >= floor).groupBy("sheet_id", (F.bround(F.col("thickness_ft") * 48, 0) / 48).alias("thickness_ft")).agg(F.sum("length_ft").alias("length_ft"))
    part = F.col("length_ft") / F.sum("length_ft").over(Window.partitionBy("sheet_id"))
    return binned.withColumn("share", part).filter(F.col("share") >= share)


SCALE_FACTORS = (1 / 304.8, 1 / 30.48, 1 / 12, 12.0, 30.48, 304.8)


def thickness_scale_check(walls: DataFrame, declared: tuple[float, ...], tolerance: float, least: float = 0.6) -> DataFrame:
    """Per sheet the factor that aligns observed thicknesses with the declared ones; null where they fit already or no
    factor explains most of the length. Of equal shares the first factor counts."""
    share = lambda f: F.sum(F.when(_matches(F.col("thickness_ft") / f, declared, tolerance), F.col("length_ft")).otherwise(0.0)) / F.sum("length_ft")
    sums = walls.groupBy("sheet_id").agg(share(1.0).alias("fits"), *[share(f).alias(f"s{k}") for k, f in enumerate(SCALE_FACTORS)])
    best = F.greatest(*[F.col(f"s{k}") for k in range(len(SCALE_FACTORS))])
    first = F.coalesce(*[F.when(F.col(f"s{k}") == best, F.lit(f)) for k, f in enumerate(SCALE_FACTORS)])
    return sums.select("sheet_id", "fits", F.when((F.col("fits") < least) & (best >= least), first).alias("factor"))
