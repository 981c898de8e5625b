"""Boxes that meet, of any sizes: cells come in levels, so that a box is in four cells of a level at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALLEST_FT = 2.0**-4


def _levelled(d: DataFrame, p: str) -> DataFrame:
    extent = F.greatest(F.col(f"{p}x1") - F.col(f"{p}x0"), F.col(f"{p}y1") - F.col(f"{p}y0"), F.lit(SMALLEST_FT))
    return d.withColumn(f"{p}level", F.ceil(F.log2(extent)).cast("int"))


def meeting_boxes(one: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs of rows of a sheet whose boxes overlap or touch, each once, with the columns of both.

    Boxes are the columns ax0, ay0, ax1, ay1 of ``one`` and bx0, by0, bx1, by1 of ``other``; only sheet_id is in both. A box
    belongs to the level of its own size and meets others in the larger of two levels, in the cell where their overlap
    begins. Boxes with a null or a bound that isn't finite meet nothing."""
    finite = lambda d, p: d.filter(" AND ".join(f"abs({p}{c}) < 1e15" for c in ("x0", "y0", "x1", "y1")))
    one, other = _levelled(finite(one, "a"), "a"), _levelled(finite(other, "b"), "b")
    levels = one.select("sheet_id", F.col("alevel").alias("level")).union(other.select("sheet_id", "blevel")).distinct()  # one for each power of two
    cell = F.pow(F.lit(2.0), F.col("level"))

    def celled(d: DataFrame, p: str) -> DataFrame:
        span = lambda c: F.sequence(F.floor(F.col(f"{p}{c}0") / cell).cast("long"), F.floor(F.col(f"{p}{c}1") / cell).cast("long"))
        d = d.join(levels, "sheet_id").filter(F.col("level") >= F.col(f"{p}level"))
        return d.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))

    first = lambda c: F.floor(F.greatest(F.col(f"a{c}0"), F.col(f"b{c}0")) / cell).cast("long")
    overlap: Column = (F.col("ax0") <= F.col("bx1")) & (F.col("bx0") <= F.col("ax1")) & (F.col("ay0") <= F.col("by1")) & (F.col("by0") <= F.col("ay1"))
    pairs = celled(one, "a").join(celled(other, "b"), ["sheet_id", "level", "cx", "cy"])
    pairs = pairs.filter(overlap & (F.col("level") == F.greatest("alevel", "blevel")) & (F.col("cx") == first("x")) & (F.col("cy") == first("y")))
    return pairs.drop("level", "cx", "cy", "alevel", "blevel")
