"""Repair of walls' ends: residues of floating point contracted into one node, and the sizes of recognised instances.

Walls are (sheet_id, wall_id, x0, y0, x1, y1, thickness_ft, layer, host, source_ids); ends that are the same point meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.geometry import computed, convex_hull
from sheetwise.functions.rectangles import FEW, FIELDS, measured_batches
from sheetwise.operators.graph import components
from sheetwise.runtime import dealt, discard, materialize, ship_package

#: Walls below the first length are residue, walls below the second are none at all.
RESIDUE_FT, NO_LENGTH_FT = 1e-4, 1e-9
#: The least and the greatest width of an instance by its kind, in feet.
WIDTHS_FT = {
    "door": (0.8, 14), "window": (0.3, 40), "column": (0.2, 8), "beam": (0.3, 100), "stair": (1, 50), "furniture": (0.3, 35), "electrical": (0.05, 10), "plumbing": (0.15, 15), "vehicle": (2, 35),
}
#: The least depth of a column and its greatest width by depth.
COLUMN_DEPTH_FT, COLUMN_RATIO = 0.15, 5


def _key() -> Column:
    return F.struct("x0", "y0", "x1", "y1", "thickness_ft", "layer", "source_ids")


def merge_duplicates(walls: DataFrame) -> DataFrame:
    """Walls from their lesser end, those without length left out, and those of the same ends and thickness made one: the
    first by layer and sources, with all their sources."""
    swap = F.struct("x1", "y1") < F.struct("x0", "y0")
    turned = {f"_{c}": F.when(swap, F.col(o)).otherwise(F.col(c)) + 0.0 for c, o in (("x0", "x1"), ("y0", "y1"), ("x1", "x0"), ("y1", "y0"))}
    d = walls.withColumns(turned).withColumns({c: F.col(f"_{c}") for c in ("x0", "y0", "x1", "y1")}).drop(*turned)
    d = d.filter(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) > NO_LENGTH_FT)
    d = d.groupBy("sheet_id", "x0", "y0", "x1", "y1", F.round("thickness_ft", 9).alias("_t")).agg(
        F.min_by(F.struct("wall_id", "thickness_ft", "layer", "host", "source_ids"), F.struct("thickness_ft", "layer", "source_ids", "wall_id")).alias("w"),
        F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_ids")))).alias("merged"),
    )
    return d.select("sheet_id", "w.wall_id", "x0", "y0", "x1", "y1", "w.thickness_ft", "w.layer", "w.host", F.when(F.col("n") > 1, F.col("merged")).otherwise(F.col("w.source_ids")).alias("source_ids"))


def contract_residue(walls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(walls, adjustments) with each wall shorter than ``RESIDUE_FT`` contracted into one node. The point that stays is an
    opening host's end where there is one, else the one of more walls, else the lesser. Adjustments: sheet_id, wall_id,
    source_ids, from (fx, fy) to (tx, ty) and the distance of each end moved.

    Residues that touch each other are contracted one after the other in the order of the walls, as each changes how many
    walls meet at a point; all groups of touching residues work at the same time, a written round for each residue of the
    longest group. Rows repeating an id are walls of their own."""
    now = materialize(merge_duplicates(walls), "walls")
    moved = []
    node = lambda x, y: F.xxhash64("sheet_id", x, y)
    while True:
        short = now.filter(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) < RESIDUE_FT)
        if short.isEmpty():
            break
        groups = components(short.select(node("x0", "y0").alias("a"), node("x1", "y1").alias("b")))
        known = short.withColumn("id", node("x0", "y0")).join(groups, "id")
        first = materialize(known.groupBy("component").agg(F.min_by(F.struct("sheet_id", "wall_id", "x0", "y0", "x1", "y1"), _key()).alias("w")).select("w.*"), "first")
        both = first.select("sheet_id", "wall_id", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("p")).select("sheet_id", "wall_id", "p.x", "p.y")
        ends = now.select("sheet_id", "host", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("p")).select("sheet_id", "host", "p.x", "p.y")
        met = ends.join(both.select("sheet_id", "x", "y"), ["sheet_id", "x", "y"], "left_semi").groupBy("sheet_id", "x", "y").agg(F.count("*").alias("degree"), F.max("host").alias("host"))
        order = F.struct(~F.col("host"), -F.col("degree"), "x", "y")
        chosen = both.join(met, ["sheet_id", "x", "y"]).groupBy("sheet_id", "wall_id").agg(F.min(order).alias("keep"), F.max(order).alias("drop"))
        moves = chosen.select("sheet_id", F.col("drop.x").alias("fx"), F.col("drop.y").alias("fy"), F.col("keep.x").alias("tx"), F.col("keep.y").alias("ty"))
        moves = materialize(moves, "moves")
        left = now.join(first.select("sheet_id", "wall_id", "x0", "y0", "x1", "y1"), ["sheet_id", "wall_id", "x0", "y0", "x1", "y1"], "left_anti")
        for k in "01":
            to = moves.select("sheet_id", F.col("fx").alias(f"x{k}"), F.col("fy").alias(f"y{k}"), F.col("tx").alias(f"tx{k}"), F.col("ty").alias(f"ty{k}"))
            left = left.join(to, ["sheet_id", f"x{k}", f"y{k}"], "left")
        left = materialize(left, "moving")
        gone = lambda k: left.filter(F.col(f"tx{k}").isNotNull()).select("sheet_id", "wall_id", "source_ids", F.col(f"x{k}").alias("fx"), F.col(f"y{k}").alias("fy"), F.col(f"tx{k}").alias("tx"), F.col(f"ty{k}").alias("ty"))
        moved.append(materialize(gone("0").unionByName(gone("1")), "adjustments"))
        placed = left.withColumns({f"{c}{k}": F.coalesce(f"t{c}{k}", f"{c}{k}") for c in "xy" for k in "01"}).drop("tx0", "ty0", "tx1", "ty1")
        before, now = now, materialize(merge_duplicates(placed), "walls")
        discard(before, groups, first, moves, left)
    spark = walls.sparkSession
    schema = "sheet_id long, wall_id long, source_ids array<long>, fx double, fy double, tx double, ty double"
    adjusted = spark.read.schema(moved[0].schema).parquet(*[m.written_to for m in moved]) if moved else spark.createDataFrame([], schema)
    return now, adjusted.withColumn("distance_ft", F.hypot(F.col("tx") - F.col("fx"), F.col("ty") - F.col("fy")))


def measure_instances(parts: DataFrame) -> DataFrame:
    """Sizes of recognised instances from their parts (sheet_id, symbol_id, kind, points: array of x, y): the rectangle of
    least area (width_ft, depth_ft, angle, x, y), and ``accepted`` if the kind allows it: its width in range, a column no
    sliver, a beam with a depth. A kind that isn't known, or an instance without points or width, isn't accepted. Parts of
    many points are reduced to their hulls first, so only corners meet by instance; rectangles are found for whole batches."""
    few = F.when(F.size("_points") > FEW, convex_hull(F.col("_points"))).otherwise(F.col("_points"))
    hulls = computed(parts.withColumnRenamed("points", "_points"), points=F.coalesce(few, F.array().cast("array<struct<x:double,y:double>>")))
    keys = ["sheet_id", "symbol_id", "kind"]
    whole = dealt(hulls, *keys).groupBy(*keys).agg(F.flatten(F.collect_list("points")).alias("points"))
    known = F.filter("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull())  # of an instance without such points the first stays
    of = lambda c: F.transform(known, lambda p: p[c]).alias(f"{c}s")
    ship_package(parts.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in whole.schema}
    schema = ", ".join([*[f"{c} {types[c]}" for c in keys], "first struct<x:double,y:double>", *[f"{c} double" for c in FIELDS]])
    d = whole.select(*keys, F.array_min("points").alias("first"), of("x"), of("y")).mapInArrow(measured_batches, schema)
    none = lambda c: F.coalesce(c, F.when(F.col("first").isNotNull(), 0.0))
    place = lambda c: F.coalesce(c, F.round(F.col(f"first.{c}"), 6) + 0.0).alias(c)
    d = d.select(*keys, *[none(c).alias(c) for c in FIELDS[:3]], *[place(c) for c in FIELDS[3:]])
    width, depth = F.col("width"), F.col("depth")
    fits = F.lit(False)
    for kind, (low, high) in WIDTHS_FT.items():
        fits = F.when(F.col("kind") == kind, width.between(low, high)).otherwise(fits)
    shaped = F.when(F.col("kind") == "column", (depth >= COLUMN_DEPTH_FT) & (width <= COLUMN_RATIO * F.greatest(depth, F.lit(1e-6)))).when(F.col("kind") == "beam", depth > 0).otherwise(True)
    accepted = F.coalesce(fits & shaped & (width > 0), F.lit(False))
    return d.select("sheet_id", "symbol_id", "kind", width.alias("width_ft"), depth.alias("depth_ft"), "angle", "x", "y", accepted.alias("accepted"))
