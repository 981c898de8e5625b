"""Walls that lie partly on accepted profiles, split at the profiles' edges, and what becomes of their openings.

Walls are (sheet_id, wall_id, x0, y0, x1, y1, thickness_ft), profiles (sheet_id, profile_id, rings: array of rings, each an
array of x, y; inner rings are holes), openings (sheet_id, opening_id, x0, y0, x1, y1). In a wall's own frame u runs along its
axis from its start and v across. There the corners of profiles cut the wall into slabs, and each slab into stretches of v on
a profile and off all of them; stretches that go on alike in the next slab are one rectangle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions.geometry import computed
from sheetwise.operators.boxes import meeting_boxes
from sheetwise.runtime import materialize

#: Fixed values in feet: what counts as touching, the least length and thickness of a piece, how far an opening's ends may be
#: off a wall that carries it and off the axis of one that has it; and the shares of a thickness and of an opening that count.
TOUCH_FT, PIECE_FT, STRIP_FT, REACH_FT, ON_AXIS_FT, HOSTED_SHARE, OPENING_SHARE = 2e-4, 0.25, 1 / 12, 0.05, 1e-5, 0.5, 0.5
#: Corners that differ by less are in line.
LEVEL_FT = 1e-6
_WALL = ("sheet_id", "wall_id")


def _framed(walls: DataFrame) -> DataFrame:
    """``walls`` with a length and a thickness, with their frame (ox, oy, ux, uy, long, half) and box."""
    d = walls.select(*_WALL, F.col("x0").alias("ox"), F.col("y0").alias("oy"), "x1", "y1", (F.col("thickness_ft") / 2).alias("half"))
    d = d.withColumn("long", F.hypot(F.col("x1") - F.col("ox"), F.col("y1") - F.col("oy"))).filter("long > 0 AND half > 0")
    d = d.withColumns({"ux": (F.col("x1") - F.col("ox")) / F.col("long"), "uy": (F.col("y1") - F.col("oy")) / F.col("long")})
    wide = lambda c, low: (F.least if low else F.greatest)(F.col(f"o{c}"), F.col(f"{c}1")) + (-1 if low else 1) * (F.col("half") + REACH_FT)
    return d.withColumns({f"a{c}{n}": wide(c, n == 0) for c in "xy" for n in (0, 1)}).drop("x1", "y1")


def _local(p: Column) -> Column:
    dx, dy = p["x"] - F.col("ox"), p["y"] - F.col("oy")
    return F.struct((dx * F.col("ux") + dy * F.col("uy")).alias("u"), (dy * F.col("ux") - dx * F.col("uy")).alias("v"))


def _edges(ring: Column) -> Column:
    return F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _rectangles(walls: DataFrame, edges: DataFrame) -> DataFrame:
    """Rectangles of walls: their columns with profile_id (null: on none), ua, ub, va, vb. ``edges`` are pairs of a wall and
    an edge of a profile near it, in the wall's frame: a and b with u and v."""
    level = edges.filter(F.abs(F.col("b.v") - F.col("a.v")) <= LEVEL_FT).select(*_WALL, "profile_id", F.col("a.v").alias("v"), F.least("a.u", "b.u").alias("eu0"), F.greatest("a.u", "b.u").alias("eu1"))
    ends = F.array(F.lit(0.0), F.col("long"))
    inner = edges.join(walls.select(*_WALL, "long"), list(_WALL)).filter("a.u > 0 AND a.u < long").select(*_WALL, F.round("a.u", 9).alias("ua"))
    cuts = walls.select(*_WALL, F.explode(ends).alias("ua")).union(inner).distinct()
    slabs = cuts.withColumn("ub", F.lead("ua").over(Window.partitionBy(*_WALL).orderBy("ua"))).filter("ub - ua >= 1e-9")
    under = slabs.join(level, list(_WALL)).filter((F.col("eu0") < (F.col("ua") + F.col("ub")) / 2) & (F.col("eu1") > (F.col("ua") + F.col("ub")) / 2))
    upward = Window.partitionBy(*_WALL, "ua", "profile_id").orderBy("v")
    spans = under.withColumns({"odd": F.row_number().over(upward) % 2 == 1, "top": F.lead("v").over(upward)}).filter("odd").join(walls.select(*_WALL, "half"), list(_WALL))
    spans = spans.select(*_WALL, "ua", "ub", "profile_id", F.greatest(F.col("v"), -F.col("half")).alias("va"), F.least("top", "half").alias("vb"))
    # the next profile begins where those below it have ended
    below = Window.partitionBy(*_WALL, "ua").orderBy("va", "vb", "profile_id").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reached", F.max("vb").over(below)).withColumn("va", F.greatest("va", "reached")).filter("vb - va > 1e-9").drop("reached")
    borders = spans.select(*_WALL, "ua", "ub", F.col("vb").alias("va"), F.col("va").alias("until"))
    bottom = slabs.join(walls.select(*_WALL, "half"), list(_WALL)).select(*_WALL, "ua", "ub", (-F.col("half")).alias("va"), F.lit(None).cast("double").alias("until"))
    rising = Window.partitionBy(*_WALL, "ua").orderBy("va", F.col("until").asc_nulls_first())
    gaps = bottom.unionByName(borders).withColumn("next", F.lead("until").over(rising)).join(walls.select(*_WALL, "half"), list(_WALL))
    gaps = gaps.select(*_WALL, "ua", "ub", F.lit(None).cast(spans.schema["profile_id"].dataType).alias("profile_id"), "va", F.coalesce("next", "half").alias("vb")).filter("vb - va > 1e-9")
    alike = [*_WALL, "profile_id", F.round("va", 6), F.round("vb", 6)]
    along = Window.partitionBy(*alike).orderBy("ua")
    run = spans.unionByName(gaps).withColumn("fresh", (F.abs(F.col("ua") - F.lag("ub").over(along)) < 1e-9).cast("int"))
    run = run.withColumn("run", F.sum(1 - F.coalesce("fresh", F.lit(0))).over(along)).withColumns({"ra": F.round("va", 6), "rb": F.round("vb", 6)})
    return run.groupBy(*_WALL, "profile_id", "ra", "rb", "run").agg(F.min("ua").alias("ua"), F.max("ub").alias("ub"), F.min("va").alias("va"), F.min("vb").alias("vb")).drop("ra", "rb", "run")


def fit_to_profiles(walls: DataFrame, profiles: DataFrame, openings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces of ``walls`` and the fate of ``openings``.

    Pieces: sheet_id, wall_id, profile_id, x0, y0, x1, y1, thickness_ft, verdict. A wall that only touches profiles is
    ``clear``, one wholly on a single profile ``on``, both whole. Others fall into ``free`` pieces (at least ``PIECE_FT`` long
    and ``STRIP_FT``, or the wall's thickness, thick), ``hosted`` ones on a profile (as long, with ``HOSTED_SHARE`` of the
    thickness, or with an opening) and ``dropped`` rests, which are no walls. Where a slanted edge crosses a wall, it is
    ``ragged`` and stays whole. Walls without a length, or with nulls, are ``clear``. Where profiles overlap, the one that
    begins lower across the wall comes first. Lengths are compared to nine digits, so that exact halves count.

    Openings: sheet_id, opening_id, wall_id, x0, y0, x1, y1, verdict, a row for each split wall whose axis has it: ``kept``
    where a piece's axis has it whole, else ``narrowed`` to the piece that holds most of it, if that is ``OPENING_SHARE`` of
    it and ``PIECE_FT``, else ``lost``. An opening on no split wall is ``kept`` with no wall."""
    framed = _framed(walls)
    points = F.flatten("rings")
    bound = lambda f, c: f(F.transform(points, lambda p: p[c]))
    boxed = profiles.filter(F.size(points) > 2).select("sheet_id", "profile_id", "rings", *[bound(f, c).alias(f"b{c}{n}") for c in "xy" for n, f in ((0, F.array_min), (1, F.array_max))])
    near = meeting_boxes(framed, boxed).withColumn("ring", F.explode("rings"))
    edges = near.select(*_WALL, "profile_id", "long", "half", F.explode(_edges(F.transform("ring", _local))).alias("e")).select(*_WALL, "profile_id", "long", "half", "e.a", "e.b")
    inside = lambda c, low, high: (F.least(f"a.{c}", f"b.{c}") < high - TOUCH_FT) & (F.greatest(f"a.{c}", f"b.{c}") > low + TOUCH_FT)
    slanted = (F.abs(F.col("a.u") - F.col("b.u")) > LEVEL_FT) & (F.abs(F.col("a.v") - F.col("b.v")) > LEVEL_FT)
    edges = materialize(edges.withColumn("slanted", slanted & inside("u", F.lit(0.0), F.col("long")) & inside("v", -F.col("half"), F.col("half"))), "edges")  # read for cuts, level edges and verdicts
    seen = edges.groupBy(*_WALL).agg(F.max("slanted").alias("ragged"))
    at = framed.drop("ax0", "ax1", "ay0", "ay1")
    straight = at.join(seen.filter("NOT ragged").select(*_WALL), list(_WALL))
    tiles = _rectangles(straight, edges.drop("long", "half", "slanted").join(seen.filter("NOT ragged").select(*_WALL), list(_WALL)))
    tiles = materialize(tiles.join(at, list(_WALL)), "tiles")  # read for verdicts, pieces and openings
    touch = F.least(F.col("ub") - F.col("ua"), F.col("vb") - F.col("va")) <= TOUCH_FT
    lies = F.col("profile_id").isNotNull() & ~touch
    facts = tiles.groupBy(*_WALL).agg(F.max(lies).alias("lies"), F.max(F.col("profile_id").isNull() & ~touch).alias("stands"), F.count_distinct(F.when(lies, F.col("profile_id"))).alias("n_profiles"), F.min(F.when(lies, F.col("profile_id"))).alias("only"))
    whole = F.when(F.col("ragged"), "ragged").when(~F.coalesce("lies", F.lit(False)), "clear").when(~F.col("stands") & (F.col("n_profiles") == 1), "on")
    judged = seen.join(facts, list(_WALL), "left").select(*_WALL, whole.alias("whole"), F.when(whole == "on", F.col("only")).alias("only"))
    split = tiles.join(judged.filter("whole IS NULL").select(*_WALL), list(_WALL))

    spot = openings.select("sheet_id", "opening_id", "x0", "y0", "x1", "y1", *[f(f"{c}0", f"{c}1").alias(f"b{c}{n}") for c in "xy" for n, f in ((0, F.least), (1, F.greatest))])
    cut = framed.join(judged.filter("whole IS NULL").select(*_WALL), list(_WALL))
    local = lambda n: _local(F.struct(F.col(f"x{n}").alias("x"), F.col(f"y{n}").alias("y")))
    carried = meeting_boxes(cut, spot).select(*_WALL, "opening_id", "half", "long", local(0).alias("p"), local(1).alias("q"))
    carried = carried.withColumns({"off": F.greatest(F.abs("p.v"), F.abs("q.v")), "lo": F.least("p.u", "q.u"), "hi": F.greatest("p.u", "q.u")}).filter(F.col("off") <= F.col("half") + REACH_FT)
    carried = materialize(carried, "carried")
    tile = [*_WALL, "ua", "va", "ub", "vb"]
    holds = split.filter("profile_id IS NOT NULL").join(carried.select(*_WALL, "lo", "hi"), list(_WALL)).filter((F.col("lo") >= F.col("ua") - ON_AXIS_FT) & (F.col("hi") <= F.col("ub") + ON_AXIS_FT))
    split = split.join(holds.select(*tile).distinct().withColumn("holds", F.lit(True)), tile, "left")
    length, thick = F.round(F.col("ub") - F.col("ua"), 9), F.round(F.col("vb") - F.col("va"), 9)
    free = (length >= PIECE_FT) & (thick >= F.round(F.least(F.lit(STRIP_FT), 2 * F.col("half")), 9))
    big = (length >= PIECE_FT) & (thick >= F.round(HOSTED_SHARE * 2 * F.col("half"), 9))
    verdict = F.when(F.col("profile_id").isNull(), F.when(free, "free").otherwise("dropped")).otherwise(F.when(F.col("holds") | big, "hosted").otherwise("dropped"))
    split = materialize(computed(split, middle=(F.col("va") + F.col("vb")) / 2, verdict=verdict), "pieces")
    place = lambda u, v, n: {f"x{n}": F.col("ox") + u * F.col("ux") - v * F.col("uy"), f"y{n}": F.col("oy") + u * F.col("uy") + v * F.col("ux")}
    placed = split.withColumns(place(F.col("ua"), F.col("middle"), 0) | place(F.col("ub"), F.col("middle"), 1))
    shape = ["x0", "y0", "x1", "y1", "thickness_ft", "verdict"]
    placed = placed.select(*_WALL, "profile_id", "x0", "y0", "x1", "y1", thick.alias("thickness_ft"), "verdict")
    entire = walls.join(judged.withColumn("met", F.lit(True)), list(_WALL), "left").filter("met IS NULL OR whole IS NOT NULL")
    pieces = placed.unionByName(entire.select(*_WALL, F.col("only").alias("profile_id"), *shape[:5], F.coalesce("whole", F.lit("clear")).alias("verdict")))

    axis = carried.filter((F.col("off") <= ON_AXIS_FT) & (F.col("lo") >= -ON_AXIS_FT) & (F.col("hi") <= F.col("long") + ON_AXIS_FT)).drop("half", "long")
    on = axis.join(split.filter("verdict <> 'dropped'"), list(_WALL), "left")
    fits = (F.greatest(F.abs(F.col("p.v") - F.col("middle")), F.abs(F.col("q.v") - F.col("middle"))) <= ON_AXIS_FT) & (F.col("lo") >= F.col("ua") - ON_AXIS_FT) & (F.col("hi") <= F.col("ub") + ON_AXIS_FT)
    left = F.greatest(F.col("lo"), F.col("ua")), F.least(F.col("hi"), F.col("ub"))
    on = on.withColumns({"fits": F.coalesce(fits, F.lit(False)), "from": left[0], "to": left[1]})
    best = F.max_by(F.struct("from", "to", "middle", "ox", "oy", "ux", "uy"), F.struct(F.round(F.col("to") - F.col("from"), 9).alias("width"), (-F.col("ua")).alias("u"), (-F.col("va")).alias("v")))
    on = on.groupBy(*_WALL, "opening_id", "p", "q").agg(F.max("fits").alias("fits"), best.alias("b")).select("*", "b.*")
    width, remains = F.hypot(F.col("q.u") - F.col("p.u"), F.col("q.v") - F.col("p.v")), F.round(F.coalesce(F.col("to") - F.col("from"), F.lit(0.0)), 9)
    fate = F.when(F.col("fits"), "kept").when((remains >= F.round(OPENING_SHARE * width, 9)) & (remains >= PIECE_FT), "narrowed").otherwise("lost")
    forward = F.col("p.u") <= F.col("q.u")
    start, end = F.when(forward, F.col("from")).otherwise(F.col("to")), F.when(forward, F.col("to")).otherwise(F.col("from"))
    on = on.withColumn("fate", fate).withColumns(place(start, F.col("middle"), 0) | place(end, F.col("middle"), 1)).select(*_WALL, "opening_id", "fate", *[F.col(c).alias(f"n_{c}") for c in shape[:4]])
    told = openings.join(on, ["sheet_id", "opening_id"], "left")
    moved = [F.when(F.col("fate") == "narrowed", F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in shape[:4]]
    return pieces, told.select("sheet_id", "opening_id", "wall_id", *moved, F.coalesce("fate", F.lit("kept")).alias("verdict"))
