"""Chains of short lines that bend smoothly, the circles they fit, and swing doors among them. Feet throughout.

Edges are (sheet_id, edge_id, x0, y0, x1, y1), their ids unique over all sheets; ends meet where they are the same point
to nine digits (the caller snaps looser drawings first).
"""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions.geometry import computed
from sheetwise.operators.graph import list_places

#: The greatest bend of a chain, the sweep and radius of a door's arc, how far off the circle its points may be
#: at most and in the mean of squares, how flat they may lie, and the fewest points.
BEND, LEAST_SWEEP, MOST_SWEEP, LEAST_RADIUS_FT, MOST_RADIUS_FT, OFF_FT, RMS_FT, FLAT, LEAST_POINTS = 35.0, 65.0, 115.0, 1.5, 5.0, 0.025, 0.012, 1e-8, 5
#: How far a leaf's hinge, length and tip may be off, and how far apart two tips are two leaves.
LEAF_FT, TIPS_FT = 0.08, 0.1


def _rounded(v: Column, digits: int) -> Column:
    """``v`` to so many digits by the rule of SQL engines, which round the multiple: ``round`` judges halves by the shortest decimal
    text, which far from the origin, or near a half, gives another last digit."""
    return F.round(v * 10.0**digits) / 10.0**digits + 0.0


def chains(edges: DataFrame) -> DataFrame:
    """sheet_id, chain_id (its least edge), place and ax, ay, bx, by: the edges of each chain in order and direction.

    Two edges follow each other where no third one meets them and the bend is at most ``BEND``. Each edge is walked both
    ways, so that what follows is known at each node by itself; lists are ranked by pointer doubling, and of the two
    lists of a chain the one with the lesser first edge stays. Smooth rings without an end are left out, as edges without
    length are."""
    d = edges.withColumns({c: _rounded(F.col(c), 9) for c in ("x0", "y0", "x1", "y1")}).filter("x0 <> x1 or y0 <> y1")
    way = lambda back, a, b: F.struct((F.col("edge_id") * 2 + back).alias("id"), F.col(f"x{a}").alias("ax"), F.col(f"y{a}").alias("ay"), F.col(f"x{b}").alias("bx"), F.col(f"y{b}").alias("by"))
    half = d.select("sheet_id", "edge_id", F.explode(F.array(way(0, 0, 1), way(1, 1, 0))).alias("h")).select("sheet_id", "edge_id", "h.*")
    nodes = half.groupBy("sheet_id", F.col("ax").alias("x"), F.col("ay").alias("y")).agg(F.count("*").alias("n")).filter("n = 2").drop("n")
    into = half.select("sheet_id", F.col("bx").alias("x"), F.col("by").alias("y"), F.col("id").alias("prev"), F.col("edge_id").alias("e"), (F.col("bx") - F.col("ax")).alias("ux"), (F.col("by") - F.col("ay")).alias("uy"))
    out = half.select("sheet_id", F.col("ax").alias("x"), F.col("ay").alias("y"), "id", "edge_id", (F.col("bx") - F.col("ax")).alias("vx"), (F.col("by") - F.col("ay")).alias("vy"))
    smooth = F.col("ux") * F.col("vx") + F.col("uy") * F.col("vy") >= cos(radians(BEND)) * F.hypot("ux", "uy") * F.hypot("vx", "vy")
    follows = into.join(nodes, ["sheet_id", "x", "y"], "left_semi").join(out, ["sheet_id", "x", "y"]).filter((F.col("e") != F.col("edge_id")) & smooth).select("id", "prev")
    places = list_places(half.select("id").join(follows, "id", "left"), cycles=True)
    ranked = half.join(places, "id")
    lists = ranked.groupBy("head").agg(F.min("edge_id").alias("chain_id"))
    one = lists.groupBy("chain_id").agg(F.min("head").alias("head"))
    return ranked.join(one, "head").select("sheet_id", "chain_id", "place", "ax", "ay", "bx", "by")


def fit_arcs(pieces: DataFrame) -> DataFrame:
    """The circle of each chain by least squares: sheet_id, chain_id, n_points, x, y, radius, sweep (degrees, signed), off and
    rms (of its points from the circle), the first and last point, and ``arc`` if it is a door's quarter circle: sweep, radius
    and residuals in bounds and all turns in one direction and small. Chains of too few points or in a line have no circle.
    All sums go along the chain, in windows over one sort: in another order they end elsewhere in the last digits, which decides where
    a radius is a bound itself."""
    key = ["sheet_id", "chain_id"]
    at = lambda i, p: F.struct(i.cast("int").alias("i"), F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y"))
    ends = F.when(F.col("place") == 0, F.array(at(F.lit(0), "a"), at(F.lit(1), "b"))).otherwise(F.array(at(F.col("place") + 1, "b")))
    along = Window.partitionBy(*key).orderBy("i")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = pieces.select(*key, F.inline(ends))
    d = d.withColumns({"n_points": F.count("*").over(whole), "mx": F.avg("x").over(whole), "my": F.avg("y").over(whole), "lx": F.last("x").over(whole), "ly": F.last("y").over(whole)}).filter(F.col("n_points") >= LEAST_POINTS)
    d = computed(d, px=F.col("x") - F.col("mx"), py=F.col("y") - F.col("my"))
    x, y = F.col("px"), F.col("py")
    square = x * x + y * y
    d = d.withColumns({c: F.sum(v).over(whole) for c, v in (("xx", x * x), ("yy", y * y), ("xy", x * y), ("xr", x * square), ("yr", y * square))}).withColumns({c: F.col(c) / 2 for c in ("xr", "yr")})
    d = computed(d, det=F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")).filter(F.col("det") > FLAT * (F.col("xx") + F.col("yy")) * (F.col("xx") + F.col("yy")))
    d = computed(d, cx=(F.col("xr") * F.col("yy") - F.col("yr") * F.col("xy")) / F.col("det") + F.col("mx"), cy=(F.col("yr") * F.col("xx") - F.col("xr") * F.col("xy")) / F.col("det") + F.col("my"))
    d = computed(d.select(*key, "n_points", "i", "x", "y", "lx", "ly", "cx", "cy"), dx=F.col("x") - F.col("cx"), dy=F.col("y") - F.col("cy"))
    d = computed(d, far=F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), angle=F.atan2("dy", "dx"))
    d = d.withColumns({"step": F.col("angle") - F.lag("angle").over(along), "radius": F.avg("far").over(whole)})
    pi, step = 3.141592653589793, F.col("step")
    d = computed(d, turn=F.when(step > pi, step - 2 * pi).when(step < -pi, step + 2 * pi).otherwise(step), miss=F.abs(F.col("far") - F.col("radius")))
    d = d.withColumns({"off": F.max("miss").over(whole), "rms": F.sqrt(F.avg(F.col("miss") * F.col("miss")).over(whole)), **{c: F.degrees(f("turn").over(whole)) for c, f in (("sweep", F.sum), ("low", F.min), ("high", F.max))}})
    one_way = (F.col("low") * F.col("sweep") > 0) & (F.col("high") * F.col("sweep") > 0) & (F.greatest(F.abs("low"), F.abs("high")) <= BEND)
    arc = F.abs("sweep").between(LEAST_SWEEP, MOST_SWEEP) & F.col("radius").between(LEAST_RADIUS_FT, MOST_RADIUS_FT) & (F.col("off") <= OFF_FT) & (F.col("rms") <= RMS_FT) & one_way
    first, last = F.struct(F.col("x").alias("ax"), F.col("y").alias("ay")), F.struct(F.col("lx").alias("bx"), F.col("ly").alias("by"))
    shown = {"x": "cx", "y": "cy", "radius": "radius", "sweep": "sweep", "off": "off", "rms": "rms"}
    return d.filter("i = 0").select(*key, "n_points", *[_rounded(F.col(v), 6).alias(k) for k, v in shown.items()], first.alias("first"), last.alias("last"), arc.alias("arc"))


def swing_doors(arcs: DataFrame, leaves: DataFrame, cell: float = 1.0) -> DataFrame:
    """sheet_id, chain_id, leaf_id, x, y (hinge) and tx, ty (the arc's end that the open leaf doesn't touch) of arcs with a leaf
    (sheet_id, leaf_id, x0, y0, x1, y1): a line from the centre to one end of the arc. Leaves to both ends are no door."""
    ends = F.array(F.struct(F.col("x0").alias("hx"), F.col("y0").alias("hy"), F.col("x1").alias("px"), F.col("y1").alias("py")), F.struct(F.col("x1").alias("hx"), F.col("y1").alias("hy"), F.col("x0").alias("px"), F.col("y0").alias("py")))
    hinges = leaves.select("sheet_id", "leaf_id", F.explode(ends).alias("e")).select("sheet_id", "leaf_id", "e.*").withColumns({"cx": F.floor(F.col("hx") / cell).cast("long"), "cy": F.floor(F.col("hy") / cell).cast("long")})
    around = lambda c: F.sequence(F.floor((F.col(c) - LEAF_FT) / cell).cast("long"), F.floor((F.col(c) + LEAF_FT) / cell).cast("long"))
    asked = arcs.filter("arc").withColumn("cx", F.explode(around("x"))).withColumn("cy", F.explode(around("y")))
    d = asked.join(hinges, ["sheet_id", "cx", "cy"])
    to = lambda end, c: F.hypot(F.col("px") - F.col(end)[f"{c}x"], F.col("py") - F.col(end)[f"{c}y"])
    d = computed(d, hinge=F.hypot(F.col("hx") - F.col("x"), F.col("hy") - F.col("y")), size=F.hypot(F.col("px") - F.col("hx"), F.col("py") - F.col("hy")), one=to("first", "a"), two=to("last", "b"))
    d = d.filter((F.col("hinge") <= LEAF_FT) & (F.abs(F.col("size") - F.col("radius")) <= LEAF_FT) & (F.least("one", "two") <= LEAF_FT))
    order = F.struct(_rounded(F.col("hinge") + F.least("one", "two"), 6).alias("miss"), "leaf_id")
    picked = d.groupBy("sheet_id", "chain_id").agg(F.min_by(F.struct("leaf_id", "x", "y", "first", "last", "one", "two"), order).alias("b"), F.min("px").alias("l"), F.max("px").alias("r"), F.min("py").alias("d"), F.max("py").alias("u"))
    picked = picked.filter((F.col("r") - F.col("l") <= TIPS_FT) & (F.col("u") - F.col("d") <= TIPS_FT))
    free: Column = F.when(F.col("b.one") <= F.col("b.two"), F.struct(F.col("b.last.bx").alias("x"), F.col("b.last.by").alias("y"))).otherwise(F.struct(F.col("b.first.ax").alias("x"), F.col("b.first.ay").alias("y")))
    return picked.select("sheet_id", "chain_id", "b.leaf_id", "b.x", "b.y", _rounded(free["x"], 6).alias("tx"), _rounded(free["y"], 6).alias("ty"))
