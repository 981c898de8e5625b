"""Walls carried on to each other, dimensions held against walls, and a wall's heights. Feet throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions.geometry import computed, cross_param, distance_to_segment, param_on
from sheetwise.operators.joints import INSIDE, _celled
from sheetwise.operators.sweep import merge_islands
from sheetwise.runtime import dealt

ENDS = ("x0", "y0", "x1", "y1")
#: Fixed value: how much farther than its reach a wall is looked at, as points are rounded to nine digits.
LOOSE_FT = 1e-6


def _lines(walls: DataFrame) -> DataFrame:
    """The places that walls cover (sheet_id and ends), without ids: walls along an axis that overlap or touch on one line are
    one, as a point's distance from them is that from the nearest; others are there once each."""
    upright, level = F.col("x0") == F.col("x1"), F.col("y0") == F.col("y1")
    along = lambda f: F.when(upright, f("y0", "y1")).otherwise(f("x0", "x1"))
    axial = walls.filter(upright != level).select("sheet_id", upright.alias("upright"), F.when(upright, F.col("x0")).otherwise(F.col("y0")).alias("pos"), along(F.least).alias("lo"), along(F.greatest).alias("hi"))
    at = lambda one, other: F.when(F.col("upright"), F.col(one)).otherwise(F.col(other))
    merged = merge_islands(axial, ["sheet_id", "upright", "pos"], 0.0)
    merged = merged.select("sheet_id", at("pos", "lo").alias("x0"), at("lo", "pos").alias("y0"), at("pos", "hi").alias("x1"), at("hi", "pos").alias("y1"))
    return merged.unionByName(walls.filter(upright == level).select("sheet_id", *ENDS).distinct())


def extend_ends(walls: DataFrame, extend_in: float = 6.0, cell: float = 10.0) -> DataFrame:
    """Walls (sheet_id, wall_id, x0, y0, x1, y1) with each end moved to the nearest point, ``extend_in`` inches away at
    most, where its line meets the line of a wall that reaches that near. Ties go to the lesser point. A wall that would
    turn round or vanish stays. An end meets walls in its own cell only: such a wall is within twice the reach of it. It
    never meets its own, which is parallel to it."""
    reach = extend_in / 12 + 1e-9
    end = lambda k, o: F.struct(F.lit(k).alias("end"), F.col(f"x{k}").alias("px"), F.col(f"y{k}").alias("py"), F.col(f"x{o}").alias("qx"), F.col(f"y{o}").alias("qy"))
    ends = walls.select("sheet_id", "wall_id", F.inline(F.array(end(0, 1), end(1, 0)))).withColumns({"cx": F.floor(F.col("px") / cell), "cy": F.floor(F.col("py") / cell), "size": F.hypot(F.col("qx") - F.col("px"), F.col("qy") - F.col("py"))})
    others, where = _celled(_lines(walls), cell, 2 * reach), ["sheet_id", "cx", "cy"]
    p, q, wall = [F.col("px"), F.col("py")], [F.col("qx"), F.col("qy")], [F.col(c) for c in ENDS]
    # what is plainly too far goes by its box and the way to the hit, before anything is rounded
    near = lambda c: F.col(f"p{c}").between(F.least(f"{c}0", f"{c}1") - 2 * reach - LOOSE_FT, F.greatest(f"{c}0", f"{c}1") + 2 * reach + LOOSE_FT)
    d = dealt(ends, *where).join(dealt(others, *where), where).filter(near("x") & near("y")).withColumn("t", cross_param(*p, *q, *wall))
    d = d.filter(F.abs("t") * F.col("size") <= reach + LOOSE_FT)
    d = computed(d, hx=F.round(p[0] + (q[0] - p[0]) * F.col("t"), 9) + 0.0, hy=F.round(p[1] + (q[1] - p[1]) * F.col("t"), 9) + 0.0)
    d = computed(d, away=F.hypot(F.col("hx") - p[0], F.col("hy") - p[1]), beside=distance_to_segment(F.col("hx"), F.col("hy"), *wall))
    met = d.filter((F.col("away") <= reach) & (F.hypot(F.col("hx") - q[0], F.col("hy") - q[1]) > 1e-9) & (F.col("beside") <= reach)).withColumn("away", F.round("away", 9))
    best = met.groupBy("sheet_id", "wall_id").agg(*[F.min(F.when(F.col("end") == k, F.struct("away", "hx", "hy"))).alias(f"hit{k}") for k in (0, 1)])
    d = walls.join(best, ["sheet_id", "wall_id"], "left")
    new = {f"{c}{k}": F.coalesce(F.col(f"hit{k}.h{c}"), F.col(f"{c}{k}")) for k in (0, 1) for c in "xy"}
    forward = param_on(new["x1"], new["y1"], *wall) > param_on(new["x0"], new["y0"], *wall)
    return d.withColumns({f"_{c}": F.when(forward, v).otherwise(F.col(c)) for c, v in new.items()}).withColumns({c: F.col(f"_{c}") for c in ENDS}).drop("hit0", "hit1", *[f"_{c}" for c in ENDS])


def check_dimensions(dimensions: DataFrame, walls: DataFrame, tolerance_in: float = 2.0, cell: float = 10.0) -> DataFrame:
    """Dimensions (sheet_id, dim_id, x0, y0, x1, y1, expected_ft, source) against the centre lines of walls (sheet_id,
    wall_id and ends): each end goes to the nearest point of a wall within the tolerance. status is unverified where
    nothing is stated, an end finds no wall or the text was read from an image; else verified, or failed where the span
    between the found points, or the drawn one, is off by more than the tolerance."""
    reach = tolerance_in / 12
    ends = dimensions.select("sheet_id", "dim_id", F.inline(F.array(*[F.struct(F.lit(k).alias("end"), F.col(f"x{k}").alias("px"), F.col(f"y{k}").alias("py")) for k in (0, 1)])))
    ends = ends.withColumns({"cx": F.floor(F.col("px") / cell), "cy": F.floor(F.col("py") / cell)})
    wall = [F.col(c) for c in ENDS]
    where = ["sheet_id", "cx", "cy"]
    d = dealt(ends, *where).join(dealt(_celled(_lines(walls), cell, reach + INSIDE), *where), where)
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), param_on(F.col("px"), F.col("py"), *wall)))
    d = d.withColumns({"fx": F.round(F.col("x0") + (F.col("x1") - F.col("x0")) * t, 9), "fy": F.round(F.col("y0") + (F.col("y1") - F.col("y0")) * t, 9)})
    d = d.withColumn("away", F.round(F.hypot(F.col("px") - F.col("fx"), F.col("py") - F.col("fy")), 9)).filter(F.col("away") <= reach + INSIDE)
    found = d.groupBy("sheet_id", "dim_id").agg(*[F.min(F.when(F.col("end") == k, F.struct("away", "fx", "fy"))).alias(f"foot{k}") for k in (0, 1)])
    d = dimensions.join(found, ["sheet_id", "dim_id"], "left")
    judged = F.col("expected_ft").isNotNull() & F.col("foot0").isNotNull() & F.col("foot1").isNotNull()
    actual = F.when(judged, F.round(F.hypot(F.col("foot1.fx") - F.col("foot0.fx"), F.col("foot1.fy") - F.col("foot0.fy")), 9))
    drawn = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    off = lambda v: F.abs(v - F.col("expected_ft")) * 12
    holds = (F.col("actual_ft") > 0) & (F.greatest(off(F.col("actual_ft")), off(drawn)) <= tolerance_in + INSIDE)
    status = F.when(F.col("actual_ft").isNull(), "unverified").when(~holds, "failed").when(F.col("source") == "ocr-associated", "unverified").otherwise("verified")
    return d.withColumn("actual_ft", actual).select("sheet_id", "dim_id", "expected_ft", "actual_ft", F.round(off(F.col("actual_ft")), 6).alias("error_in"), status.alias("status"))


def height_slabs(profiles: DataFrame, openings: DataFrame) -> DataFrame:
    """Wall profiles (profile_id, height_ft) cut at the sills and tops of their openings (profile_id, sill_ft, height_ft):
    lower_ft, upper_ft and how many openings are open there, by a running sum over the levels. Openings without height
    change nothing but the levels."""
    level = lambda at, step: F.struct(F.round(at, 9).alias("lower_ft"), F.lit(step).alias("step"))
    own = profiles.select("profile_id", F.inline(F.array(level(F.lit(0.0), 0), level(F.col("height_ft"), 0))))
    step = F.when(F.col("height_ft") > 0, 1).otherwise(0)
    cut = lambda at, s: F.struct(F.round(at, 9).alias("lower_ft"), s.alias("step"))
    cuts = openings.join(profiles.select("profile_id"), "profile_id", "left_semi").select("profile_id", F.inline(F.array(cut(F.col("sill_ft"), step), cut(F.col("sill_ft") + F.col("height_ft"), -step))))
    levels = own.unionByName(cuts).groupBy("profile_id", "lower_ft").agg(F.sum("step").alias("step"))
    order = Window.partitionBy("profile_id").orderBy("lower_ft")
    d = levels.withColumns({"upper_ft": F.lead("lower_ft").over(order), "n_open": F.sum("step").over(order)})
    return d.filter("upper_ft is not null").select("profile_id", "lower_ft", "upper_ft", "n_open")
