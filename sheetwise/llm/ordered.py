"""Running totals over a total order that no single task could hold.

Rows are dealt by ranges of the order, written once, and summed by range; a row's total is that of the ranges before its
own plus that of the rows before it within its range. Only sums of ranges meet in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.runtime import materialize


def running_totals(df: DataFrame, by: list[str], order: list[Column], values: dict[str, str], groups: DataFrame | None = None) -> DataFrame:
    """``df`` with a column for each of ``values`` (new name: summed column): the sum over the rows before it, of its own
    group ``by`` (columns without nulls), in ``order``. Rows that are equal in ``order`` come in any order. A group may
    hold any share of the rows, as a range is a part of it. The columns of ``groups`` (one row for each group) are added on
    the way, where they meet ranges of groups instead of rows."""
    ranged = materialize(df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("_range", *by).agg(*[F.sum(c).alias(f"_of_{k}") for k, c in values.items()])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    before = sums.select("_range", *by, *[F.coalesce(F.sum(f"_of_{k}").over(earlier), F.lit(0)).alias(f"_before_{k}") for k in values])
    before = before if groups is None else before.join(groups, by)
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = ranged.join(before, ["_range", *by])
    d = d.withColumns({k: F.col(f"_before_{k}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in values.items()})
    return d.drop("_range", *[f"_before_{k}" for k in values])
