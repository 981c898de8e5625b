"""Wall runs: walls that continue each other through their joints, how runs end at a joint, and their trimmed outlines.

Walls are (sheet_id, wall_id, x0, y0, x1, y1, thickness_ft, layer, height_ft, wall_class) with exact nodes; wall ids are
unique over all sheets. Feet throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions.geometry import clip_convex
from sheetwise.operators.graph import list_places
from sheetwise.runtime import dealt, discard, materialize

#: Sine of directions that count as one, and walls that take no part in a joint.
PARALLEL, APART = 1e-7, "railing"
#: Fixed value: beyond so many thicknesses a joint reaches too far to be made; half a thickness over the sine is the reach.
MOST_REACH = 20.0
#: Walls are dealt by their turn in steps of so many radians; those of one line sway less than ``SWAY``.
TURN, SWAY = 1e-5, 2e-7


def _walls(walls: DataFrame) -> DataFrame:
    """Each wall from its lesser end (sx, sy) to the greater (ex, ey), with its direction, turn and what makes walls alike."""
    points = {c: F.round(c, 9) + 0.0 for c in ("x0", "y0", "x1", "y1")}
    d = walls.withColumns(points)
    swap = F.struct("x1", "y1") < F.struct("x0", "y0")
    d = d.withColumns({c: F.when(swap, F.col(o)).otherwise(F.col(k)) for c, k, o in (("sx", "x0", "x1"), ("sy", "y0", "y1"), ("ex", "x1", "x0"), ("ey", "y1", "y0"))})
    size = F.hypot(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy"))
    d = d.withColumn("length_ft", size).filter(F.col("length_ft") > 1e-9).withColumns({"ux": (F.col("ex") - F.col("sx")) / F.col("length_ft"), "uy": (F.col("ey") - F.col("sy")) / F.col("length_ft")})
    kind = ["layer", F.round("thickness_ft", 9).alias("thickness_ft"), F.coalesce(F.col("height_ft"), F.lit(-1.0)).alias("height"), F.coalesce("wall_class", F.lit("")).alias("wall_class")]
    turn = lambda sway: F.floor(F.pmod(F.atan2("uy", "ux") + sway, F.lit(3.141592653589793)) / TURN).cast("long")
    usable = F.coalesce(F.col("wall_class") != APART, F.lit(True)).alias("usable")
    near = F.array_distinct(F.array(turn(-SWAY), turn(SWAY))).alias("near")  # a turn on the edge of two
    return d.select("sheet_id", "wall_id", "length_ft", *kind, turn(0.0).alias("turn"), near, usable, "sx", "sy", "ex", "ey", "ux", "uy")


def _ends(walls: DataFrame) -> DataFrame:
    """Each wall's two ends: its place and the unit direction away from it."""
    end = lambda x, y, sign: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), (F.col("ux") * sign + 0.0).alias("dx"), (F.col("uy") * sign + 0.0).alias("dy"))
    both = F.explode(F.array(end("sx", "sy", 1), end("ex", "ey", -1))).alias("e")
    return walls.select("sheet_id", "wall_id", "usable", both).select("sheet_id", "wall_id", "usable", "e.*")


def _partners(walls: DataFrame) -> DataFrame:
    """Pairs of usable walls that go straight on through a node: sheet_id, x, y, before (which ends there) and after."""
    keys = ["sheet_id", "x", "y", "layer", "thickness_ft", "height", "wall_class", "turn"]
    able = walls.filter("usable")
    a = able.withColumnsRenamed({"ex": "x", "ey": "y"}).select(*keys, F.col("wall_id").alias("before"), (-F.col("ux") + 0.0).alias("before_dx"), (-F.col("uy") + 0.0).alias("before_dy"))
    b = able.withColumnsRenamed({"sx": "x", "sy": "y"}).withColumn("turn", F.explode("near")).select(*keys, F.col("wall_id").alias("after"), (F.col("ux") + 0.0).alias("after_dx"), (F.col("uy") + 0.0).alias("after_dy"))
    straight = (F.abs(F.col("before_dx") * F.col("after_dy") - F.col("before_dy") * F.col("after_dx")) < PARALLEL) & (F.col("before_dx") * F.col("after_dx") + F.col("before_dy") * F.col("after_dy") < 0)
    return a.join(b, keys).filter(straight).select("sheet_id", "x", "y", "before", "after")  # one turn of a wall is that of the other


def _joints(ends: DataFrame, partners: DataFrame) -> DataFrame:
    """sheet_id, x, y and kind of every node of two ends or more. ``chain``, ``L``, ``T`` and ``X`` are joints; ``mixed`` (a
    railing meets it), ``step`` (in line, but not alike) and ``tangle`` (anything else) stay as they are."""
    way = F.struct("dx", "dy")
    node = ends.groupBy("sheet_id", "x", "y").agg(F.count("*").alias("n"), F.count_if("usable").alias("able"), F.min(F.when(F.col("usable"), way)).alias("one"), F.max(F.when(F.col("usable"), way)).alias("two"))
    d = node.filter("n > 1").join(partners.groupBy("sheet_id", "x", "y").agg(F.count("*").alias("pairs")), ["sheet_id", "x", "y"], "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))
    level = F.abs(F.col("one.dx") * F.col("two.dy") - F.col("one.dy") * F.col("two.dx")) < PARALLEL
    able, pairs = F.col("able"), F.col("pairs")
    kind = (
        F.when(F.col("n") != able, "mixed").when((able == 2) & (pairs > 0), "chain").when((able == 2) & level, "step").when(able == 2, "L")
        .when((able == 3) & (pairs == 1), "T").when((able == 4) & (pairs == 2), "X").otherwise("tangle")
    )
    return d.select("sheet_id", "x", "y", kind.alias("kind"))


def _lines(walls: DataFrame, pairs: DataFrame) -> DataFrame:
    """Walls with the head of the list that ``pairs`` (before, after) link, their place in it and its rank: thicker first, then
    longer, then by its ends. Walls in no pair are lines of their own and take no part in the search for heads."""
    behind = pairs.select(F.col("after").alias("id"), F.col("before").alias("prev"))
    first = pairs.select(F.col("before").alias("id")).join(behind.select("id"), "id", "left_anti")
    places = list_places(behind.unionByName(first, allowMissingColumns=True)).withColumnRenamed("id", "wall_id")
    d = walls.select("sheet_id", "wall_id", "length_ft", "thickness_ft", "sx", "sy", "ex", "ey").join(places, "wall_id", "left")
    d = d.withColumns({"head": F.coalesce("head", "wall_id"), "place": F.coalesce("place", F.lit(0))})
    line = Window.partitionBy("head")
    low, high = F.min(F.struct(F.col("sx").alias("x"), F.col("sy").alias("y"))), F.max(F.struct(F.col("ex").alias("x"), F.col("ey").alias("y")))
    rank = {"t": -F.max("thickness_ft").over(line), "l": -F.round(F.sum("length_ft").over(line), 6), "a": low.over(line), "b": high.over(line)}
    return d.withColumn("rank", F.struct(*[v.alias(k) for k, v in rank.items()]))


def build_runs(walls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, joints, connections).

    Members: sheet_id, wall_id, its run_id (the least wall of the run), its place along the run, and the run's own n_walls,
    ax, ay, bx, by, thickness_ft. Joints: sheet_id, x, y, kind of every node of two ends or more. Connections: at L, T and X
    joints the run that stops (relating) and the one that owns the joint (related), how each meets it (start, end, path),
    and whether the joint can be made. At an X the thicker, else longer line goes through; at an L it owns the corner.
    Where an end has two walls that could go on, the drawing is at fault and ValueError is raised.
    """
    walls = materialize(_walls(walls), "run-walls")
    ends = _ends(walls)
    partners = materialize(_partners(walls), "partners")
    if not partners.groupBy("sheet_id", "x", "y", "after").count().unionByName(partners.groupBy("sheet_id", "x", "y", F.col("before").alias("after")).count()).filter("count > 1").isEmpty():
        raise ValueError("a wall goes on into two others through one end")
    joints = materialize(_joints(ends, partners), "joints")
    node = ["sheet_id", "x", "y"]
    lines = materialize(_lines(walls, partners), "lines")
    going = partners.join(joints.filter(F.col("kind").isin("chain", "T", "X")), node)
    # of the two lines at an X one goes through; elsewhere there is one
    crossed = going.filter("kind = 'X'").join(lines.select(F.col("wall_id").alias("before"), "rank"), "before")
    crossed = crossed.groupBy(*node, "kind").agg(F.min_by(F.struct("before", "after"), "rank").alias("p")).select(*node, "kind", "p.before", "p.after")
    through = materialize(going.filter("kind <> 'X'").select(*node, "kind", "before", "after").unionByName(crossed), "through")
    # a run is the part of a line from a wall that nothing goes through to up to the next such wall
    onward = lines.join(through.select(F.col("after").alias("wall_id"), F.lit(True).alias("on")), "wall_id", "left")
    first = F.max(F.when(F.col("on").isNull(), F.col("place"))).over(Window.partitionBy("head").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    run = Window.partitionBy("head", "first")
    whole = {
        "run_id": F.min("wall_id").over(run), "n_walls": F.count("*").over(run), "a": F.min(F.struct(F.col("sx").alias("x"), F.col("sy").alias("y"))).over(run),
        "b": F.max(F.struct(F.col("ex").alias("x"), F.col("ey").alias("y"))).over(run), "thick": F.max("thickness_ft").over(run),
    }
    placed = onward.withColumn("first", first).withColumns(whole)
    placed = placed.select("sheet_id", "wall_id", "run_id", (F.col("place") - F.col("first")).alias("place"), "n_walls", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"), F.col("thick").alias("thickness_ft"), "rank")
    placed = materialize(placed, "members")
    discard(lines, partners)
    members = placed.drop("rank")

    how = lambda p: F.when((F.col("x") == F.col(f"{p}.ax")) & (F.col("y") == F.col(f"{p}.ay")), "start").when((F.col("x") == F.col(f"{p}.bx")) & (F.col("y") == F.col(f"{p}.by")), "end").otherwise("path")
    at = ends.filter("usable").join(joints.filter(F.col("kind").isin("L", "T", "X")), node).join(through.select(*node, "before", "after"), node, "left")
    at = at.join(placed.drop("sheet_id", "place", "n_walls", "thickness_ft"), "wall_id").withColumn("g", F.struct("run_id", "dx", "dy", "ax", "ay", "bx", "by"))
    # the wall that owns the joint comes first: the one that goes through, or the first by rank at an L
    owner = Window.partitionBy(*node).orderBy(F.coalesce(F.col("wall_id") != F.col("before"), F.lit(False)), "rank", "run_id")
    met = at.withColumns({"i": F.row_number().over(owner), "b": F.first("g").over(owner)})
    joined = met.filter((F.col("i") > 1) & F.coalesce(F.col("wall_id") != F.col("after"), F.lit(True)))
    sine = F.abs(F.col("g.dx") * F.col("b.dy") - F.col("g.dy") * F.col("b.dx"))
    connections = joined.select(*node, F.col("g.run_id").alias("relating"), F.col("b.run_id").alias("related"), how("g").alias("relating_type"), how("b").alias("related_type"), ((sine >= PARALLEL) & (sine >= 1 / (2 * MOST_REACH))).alias("joined"))
    return members, joints, connections


def run_outlines(members: DataFrame, connections: DataFrame) -> DataFrame:
    """The outline of each run as an array of (x, y), trimmed at its joints: a run that stops is cut by the near face of the
    one it meets, and one that owns a corner reaches the far face of the one that stops there. Each cut keeps a half-plane
    (a point of its border and the direction kept), and a run's half-planes clip its rectangle one after the other."""
    runs = members.filter("wall_id = run_id").select("sheet_id", "run_id", "ax", "ay", "bx", "by", "thickness_ft")
    side = lambda p, key: runs.select("sheet_id", F.col("run_id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in ("ax", "ay", "bx", "by", "thickness_ft")])
    d = connections.filter("joined").join(side("g", "relating"), ["sheet_id", "relating"]).join(side("b", "related"), ["sheet_id", "related"])

    def axis(p: str) -> tuple[Column, Column]:
        size = F.hypot(F.col(f"{p}_bx") - F.col(f"{p}_ax"), F.col(f"{p}_by") - F.col(f"{p}_ay"))
        return (F.col(f"{p}_bx") - F.col(f"{p}_ax")) / size, (F.col(f"{p}_by") - F.col(f"{p}_ay")) / size

    def far(p: str, how: str) -> tuple[Column, Column]:
        starts = F.col(how) == "start"
        return F.when(starts, F.col(f"{p}_bx")).otherwise(F.col(f"{p}_ax")), F.when(starts, F.col(f"{p}_by")).otherwise(F.col(f"{p}_ay"))

    def plane(wall: str, other: str, how: str, near: bool) -> Column:
        """What ``wall`` keeps: its side of the near face of ``other``, or of the far one."""
        ux, uy = axis(other)
        fx, fy = far(wall, how)
        side_of = F.when((fx - F.col("x")) * -uy + (fy - F.col("y")) * ux >= 0, 1.0).otherwise(-1.0)
        off = F.col(f"{other}_thickness_ft") / 2 * (1 if near else -1)
        return F.struct((F.col("x") - uy * side_of * off).alias("x"), (F.col("y") + ux * side_of * off).alias("y"), (-uy * side_of).alias("dx"), (ux * side_of).alias("dy"))

    reach = 2 * MOST_REACH * (F.col("g_thickness_ft") + F.col("b_thickness_ft")) + 1
    zero = F.lit(0.0)
    stops = F.struct(F.col("relating").alias("run_id"), plane("g", "b", "relating_type", True).alias("keep"), zero.alias("at_start"), zero.alias("at_end"))
    longer = lambda how: F.when(F.col("related_type") == how, reach).otherwise(0.0)
    owns = F.struct(F.col("related").alias("run_id"), plane("b", "g", "related_type", False).alias("keep"), longer("start").alias("at_start"), longer("end").alias("at_end"))
    each = d.select("sheet_id", F.explode(F.array(stops, F.when(F.col("related_type") != "path", owns))).alias("c")).filter("c is not null").select("sheet_id", "c.*")
    # clipping takes long for its bytes, so that a stated number of partitions deals it
    cuts = dealt(each, "sheet_id", "run_id").groupBy("sheet_id", "run_id").agg(F.array_sort(F.collect_list("keep")).alias("keeps"), F.max("at_start").alias("at_start"), F.max("at_end").alias("at_end"))  # two ends, a cut each
    d = runs.join(cuts, ["sheet_id", "run_id"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("at_start", "at_end")})
    size = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    ux, uy, half = (F.col("bx") - F.col("ax")) / size, (F.col("by") - F.col("ay")) / size, F.col("thickness_ft") / 2
    corner = lambda x, y, back, s: F.struct((F.col(x) + ux * back - uy * half * s).alias("x"), (F.col(y) + uy * back + ux * half * s).alias("y"))
    box = F.array(corner("ax", "ay", -F.col("at_start"), -1), corner("bx", "by", F.col("at_end"), -1), corner("bx", "by", F.col("at_end"), 1), corner("ax", "ay", -F.col("at_start"), 1))
    ring = F.aggregate(F.coalesce("keeps", F.array().cast("array<struct<x:double,y:double,dx:double,dy:double>>")), box, clip_convex)
    return d.select("sheet_id", "run_id", ring.alias("ring"))
