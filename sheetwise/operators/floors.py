"""Storeys: levels, names and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.operators.scale import upper_median


def level_spacing(levels: DataFrame, tolerance: float = 0.35) -> DataFrame:
    """Per sheet the spacing its levels (sheet_id, level) agree on: the upper median step, if all steps are within the
    tolerance of it and it is 1 to 50 ft; else null."""
    step = F.col("level") - F.lag("level").over(Window.partitionBy("sheet_id").orderBy("level"))
    steps = levels.select("sheet_id", "level").distinct().withColumn("step", F.round(step, 6)).filter("step is not null")
    middle = upper_median(steps, ["sheet_id"], "step")
    d = steps.join(middle, "sheet_id").groupBy("sheet_id", "upper_median").agg(F.max(F.abs(F.col("step") - F.col("upper_median"))).alias("worst"), F.count("*").alias("n_steps"))
    agreed = F.col("upper_median").between(1.0, 50.0) & (F.col("worst") <= tolerance + 1e-9)
    return d.select("sheet_id", "n_steps", F.when(agreed, F.round("upper_median", 3)).alias("spacing"))


def running_elevation(floors: DataFrame, height: float) -> DataFrame:
    """(sheet_id, floor_ix, marker) with its elevation: the marker's, else the last marker's plus a height for each floor
    since; the first floor is 0."""
    order = Window.partitionBy("sheet_id").orderBy("floor_ix")
    d = floors.withColumns({"_n": F.row_number().over(order), "_given": F.col("marker").isNotNull()})
    known = F.when(F.col("_given") | (F.col("_n") == 1), F.struct("_n", F.coalesce("marker", F.lit(0.0)).alias("e")))
    last = F.last(known, True).over(order)
    return d.select("sheet_id", "floor_ix", F.round(last["e"] + (F.col("_n") - last["_n"]) * height, 6).alias("elevation"), F.when(F.col("_given"), "level-marker").otherwise("assumed").alias("source"))


def distinct_names(rows: DataFrame, keys: list[str], name: str, order: list[str]) -> DataFrame:
    """Repeated names of a group become "name (2)", "name (3)" and so on."""
    k = F.row_number().over(Window.partitionBy(*keys, name).orderBy(*order))
    return rows.withColumn("_k", k).withColumn("unique_name", F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), F.col("_k").cast("string"), F.lit(")")))).drop("_k")


def neighbours(floors: DataFrame) -> DataFrame:
    """Each floor with the next above it: (sheet_id, floor_ix, above_ix, rise)."""
    order = Window.partitionBy("sheet_id").orderBy("elevation", "floor_ix")
    return floors.withColumns({"above_ix": F.lead("floor_ix").over(order), "rise": F.round(F.lead("elevation").over(order) - F.col("elevation"), 6)}).filter("above_ix is not null").select("sheet_id", "floor_ix", "above_ix", "rise")
