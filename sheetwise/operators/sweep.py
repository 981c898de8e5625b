"""Interval sweeps over parallel lines: pairing faces, merging runs, ladders and coverage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.runtime import dealt, ship_package

FAMILY = ["sheet_id", "layer", "family"]


def _taken(offs: np.ndarray, thinnest: float, thickest: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs a < b of distinct offsets that are taken when the thinnest go first and each offset is used once."""
    o = np.sort(offs[~np.isnan(offs)])
    first = np.arange(len(o))
    n = np.maximum(np.searchsorted(o, o + thickest + 1e-6, "right") - first - 1, 0)  # those behind each that may be near enough
    i = np.repeat(first, n)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    t = o[j] - o[i]
    fits = (t >= thinnest - 1e-9) & (t <= thickest + 1e-9) & (t > 0)
    i, j, t = i[fits], j[fits], t[fits]
    order = np.lexsort((j, i, t))
    used, taken = bytearray(len(o)), []
    for k, x, y in zip(order.tolist(), i[order].tolist(), j[order].tolist(), strict=True):
        if not (used[x] or used[y]):
            used[x] = used[y] = 1
            taken.append(k)
    return o[i[taken]], o[j[taken]]


def interval_pairs(faces: DataFrame, thinnest: float, thickest: float, shortest: float) -> DataFrame:
    """Walls between parallel faces (FAMILY, lo, hi, off): in each slab between neighbouring ends the thinnest pairs go
    first and each face is used once; neighbouring slabs of one pair join. Returns FAMILY, a, b (offsets), lo, hi."""
    order = Window.partitionBy(*FAMILY).orderBy("c0")
    cuts = faces.select(*FAMILY, F.explode(F.array("lo", "hi")).alias("c0")).distinct()
    cuts = cuts.withColumns({"c1": F.lead("c0").over(order), "slab": F.row_number().over(order)})
    at = lambda end: cuts.select(*FAMILY, F.col("c0").alias(end), F.col("slab").alias(f"{end}_slab"))
    # each face meets the slabs between its ends by their numbers, so that no slab is tested against faces it hasn't
    spread = faces.filter("lo < hi").join(at("lo"), [*FAMILY, "lo"]).join(at("hi"), [*FAMILY, "hi"])
    spread = spread.select(*FAMILY, "off", F.explode(F.sequence("lo_slab", F.col("hi_slab") - 1)).alias("slab")).distinct()
    slabs = dealt(spread, *FAMILY, "slab").groupBy(*FAMILY, "slab").agg(F.collect_list("off").alias("offs"))  # work grows with pairs, not with bytes
    ship_package(faces.sparkSession)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, offs = batch.columns
            ends = np.concatenate([[0], np.cumsum(offs.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
            flat = offs.flatten().to_numpy(zero_copy_only=False)
            pairs = [_taken(flat[m:n], thinnest, thickest) for m, n in zip(ends[:-1], ends[1:])]
            row = pa.array(np.repeat(np.arange(len(pairs)), [len(a) for a, _ in pairs]))
            yield pa.RecordBatch.from_arrays([*[k.take(row) for k in keys], *[pa.array(np.concatenate([p[c] for p in pairs] or [np.zeros(0)])) for c in (0, 1)]], [*batch.schema.names[:-1], "a", "b"])

    types = {f.name: f.dataType.simpleString() for f in slabs.schema}
    schema = ", ".join([*[f"{c} {types[c]}" for c in (*FAMILY, "slab")], "a double", "b double"])
    runs = slabs.withColumn("offs", F.col("offs").cast("array<double>")).mapInArrow(take, schema).join(cuts, [*FAMILY, "slab"]).select(*FAMILY, "c0", "c1", "a", "b")
    return merge_islands(runs.withColumnsRenamed({"c0": "lo", "c1": "hi"}), [*FAMILY, "a", "b"], 1e-8).filter(F.col("hi") - F.col("lo") + 1e-9 >= F.greatest(F.lit(shortest), F.col("b") - F.col("a")))


def merge_islands(intervals: DataFrame, keys: list[str], slack: float = 1e-9) -> DataFrame:
    """Intervals (keys, lo, hi) that touch or overlap, joined; a gap is never bridged."""
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("lo") > reach + slack), 1).otherwise(0)
    islands = intervals.withColumn("_new", begins).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def coverage_length(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Length of the union of each group's intervals."""
    return merge_islands(intervals, keys).groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo")).alias("covered"), F.count("*").alias("n_islands"))


def ladder_runs(faces: DataFrame, widest: float = 2.5, least: int = 4, evenness: float = 0.15) -> DataFrame:
    """Runs of evenly spaced lines of one span (to a foot): FAMILY, span_lo, span_hi, first and last offset, n and whether
    the run is a ladder (stairs, hatching)."""
    keys = [*FAMILY, "span_lo", "span_hi"]
    d = faces.select(*FAMILY, F.bround("lo", 0).alias("span_lo"), F.bround("hi", 0).alias("span_hi"), "off")
    order = Window.partitionBy(*keys).orderBy("off")
    gap = F.col("off") - F.lag("off").over(order)
    d = d.withColumn("gap", gap).withColumn("_joins", F.coalesce((F.col("gap") > 0) & (F.col("gap") <= widest), F.lit(False)))
    d = d.withColumn("run", F.sum(F.when(F.col("_joins"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inner = F.when(F.col("_joins"), F.col("gap"))
    runs = d.groupBy(*keys, "run").agg(F.min("off").alias("first_off"), F.max("off").alias("last_off"), F.count("*").alias("n"), F.avg(inner).alias("mean"), F.stddev_pop(inner).alias("deviation"))
    return runs.select(*keys, "first_off", "last_off", "n", F.coalesce((F.col("n") >= least) & (F.col("mean") > 0) & (F.col("deviation") / F.col("mean") < evenness), F.lit(False)).alias("is_ladder"))


def distinct_offsets(faces: DataFrame, apart: float = 0.02) -> DataFrame:
    """Per family, offsets that differ by ``apart`` or more from the one before."""
    order = Window.partitionBy(*FAMILY).orderBy("off")
    d = faces.select(*FAMILY, "off").distinct().withColumn("before", F.lag("off").over(order))
    return d.groupBy(*FAMILY).agg(F.sum(F.when(F.col("before").isNull() | (F.col("off") - F.col("before") >= apart), 1).otherwise(0)).cast("long").alias("n_distinct"))
