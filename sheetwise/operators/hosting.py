"""Openings and the walls that hold them, edges of regions, tiles, and storeys of a building. Feet throughout.

Walls are (sheet_id, wall_id, x0, y0, x1, y1) and more. Rows meet in grid cells, never all of a sheet with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions.geometry import distance_to_segment, param_on
from sheetwise.functions.text import nfkc
from sheetwise.operators.joints import _celled
from sheetwise.operators.spatial import unlike_boxes
from sheetwise.operators.sweep import merge_islands
from sheetwise.runtime import dealt

#: How far from a wall's axis an opening may lie, and lengths that count as none.
ON_AXIS_FT, NO_LENGTH_FT, FLOOR_SILL_FT = 1e-5, 1e-9, 1e-7
#: Fixed values of walls along a region's edge: sine between them, reach, shared part, and of railings the thickness.
EDGE_SINE, EDGE_REACH_FT, EDGE_SHARE, RAILING_FT, POOL_SHARE = 0.03, 0.15, 0.6, 4.5 / 12, 0.8
#: Fixed values of notes about sills: least confidence, reach along and across the opening.
NOTE_CONFIDENCE, NOTE_ALONG_FT, NOTE_ACROSS_FT = 0.85, 0.25, 2.0
#: Fixed values of tiles: first size, overlap, growth and how many there may be. GROWTHS bounds the sizes tried.
TILE_FT, TILE_OVERLAP, TILE_GROWTH, MOST_TILES, GROWTHS = 40.0, 0.15, 1.25, 8, 200
#: Fixed values of sized labels: lines each side, and how far the found sides may be off.
LINES_A_SIDE = 5


def _axis() -> list[Column]:
    return [F.col(c) for c in ("x0", "y0", "x1", "y1")]


def remap_openings(openings: DataFrame, walls: DataFrame, cell: float = 10.0) -> DataFrame:
    """The wall of each opening (sheet_id, opening_id, x0..y1, source_ids): one whose axis covers it. A wall that holds all
    its sources goes before others; where two of the better kind cover it, or none does, the opening has no wall and goes."""
    asked = openings.select("sheet_id", "opening_id", F.col("source_ids").alias("asked"), *[c.alias(n) for c, n in zip(_axis(), ("ax", "ay", "bx", "by"), strict=True)])
    placed = asked.withColumns({"cx": F.floor(F.col("ax") / cell), "cy": F.floor(F.col("ay") / cell)})
    met = placed.join(_celled(walls, cell, ON_AXIS_FT), ["sheet_id", "cx", "cy"])
    near = lambda p: distance_to_segment(F.col(f"{p}x"), F.col(f"{p}y"), *_axis()) <= ON_AXIS_FT
    linked = F.coalesce((F.size("asked") > 0) & (F.size(F.array_except("asked", "source_ids")) == 0), F.lit(False))
    found = met.filter(near("a") & near("b")).withColumn("linked", linked).groupBy("sheet_id", "opening_id").agg(
        F.count("*").alias("n"), F.count_if("linked").alias("n_linked"), F.min("wall_id").alias("any_id"), F.min(F.when(F.col("linked"), F.col("wall_id"))).alias("linked_id")
    )
    wall = F.when(F.col("n_linked") == 1, F.col("linked_id")).when((F.col("n_linked") == 0) & (F.col("n") == 1), F.col("any_id"))
    return found.select("sheet_id", "opening_id", wall.alias("wall_id")).filter("wall_id is not null")


def sill_notes(openings: DataFrame, notes: DataFrame, cell: float = 10.0) -> DataFrame:
    """Doors and windows (sheet_id, opening_id, kind, x0..y1, reviewed) with the sure notes (sheet_id, note_id, text,
    confidence, x, y) beside them that speak of a sill: how many, the nearest (least distance, then id), and whether a door
    nobody reviewed is in doubt. Openings without a length have no notes."""
    sure = notes.filter(F.col("confidence").between(NOTE_CONFIDENCE, 1.0) & F.upper(nfkc(F.col("text"))).contains("SILL"))
    sure = sure.select("sheet_id", "note_id", "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    judged = openings.filter(F.col("kind").isin("door", "window")).withColumn("size", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).filter("size > 1e-6")
    met = _celled(judged, cell, NOTE_ACROSS_FT + NOTE_ALONG_FT).join(sure, ["sheet_id", "cx", "cy"])
    along = param_on(F.col("x"), F.col("y"), *_axis()) * F.col("size")
    across = F.abs((F.col("x") - F.col("x0")) * (F.col("y1") - F.col("y0")) - (F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0"))) / F.col("size")
    met = met.withColumns({"along": along, "across": across}).filter((F.col("along") >= -NOTE_ALONG_FT) & (F.col("along") <= F.col("size") + NOTE_ALONG_FT) & (F.col("across") <= NOTE_ACROSS_FT))
    away = F.round(F.hypot(F.col("across"), F.greatest(F.lit(0.0), -F.col("along"), F.col("along") - F.col("size"))), 9)
    found = met.groupBy("sheet_id", "opening_id").agg(F.count("*").alias("n_notes"), F.min(F.struct(away.alias("away"), F.col("note_id"))).alias("nearest"))
    d = openings.join(found, ["sheet_id", "opening_id"], "left")
    doubt = F.coalesce((F.col("kind") == "door") & (F.col("n_notes") > 0) & ~F.coalesce("reviewed", F.lit(False)), F.lit(False))
    return d.select("sheet_id", "opening_id", F.coalesce("n_notes", F.lit(0)).alias("n_notes"), F.col("nearest.note_id").alias("note_id"), F.col("nearest.away").alias("distance_ft"), doubt.alias("ambiguous"))


def walls_along(walls: DataFrame, edges: DataFrame, thickest: float | None = RAILING_FT, wall_share: float = 0.0, cell: float = 10.0) -> DataFrame:
    """Walls (and thickness_ft) that run along an edge (sheet_id, ax, ay, ox, oy) of a region, as railings of a void do
    (thin ones) or the edge of a pool (any thickness, ``POOL_SHARE`` of the wall): sheet_id, wall_id, once each."""
    # summed for walls along an axis, so that noise in the last digit of an end doesn't decide where shares are met exactly
    axial = (F.col("x0") == F.col("x1")) | (F.col("y0") == F.col("y1"))
    size = F.when(axial, F.abs(F.col("x1") - F.col("x0") + F.col("y1") - F.col("y0"))).otherwise(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    reach = EDGE_REACH_FT + F.col("thickness_ft") / 2
    own = walls.withColumns({"size": size, "reach": reach}).filter(F.col("size") > NO_LENGTH_FT)
    own = own if thickest is None else own.filter(F.col("thickness_ft") <= thickest)
    span = lambda a, b, more: F.sequence(F.floor((F.least(a, b) - more) / cell).cast("long"), F.floor((F.greatest(a, b) + more) / cell).cast("long"))
    drift = F.col("reach") + EDGE_SINE * F.col("size")
    own = own.withColumn("cx", F.explode(span("x0", "x1", drift))).withColumn("cy", F.explode(span("y0", "y1", drift)))
    n = F.hypot(F.col("ox") - F.col("ax"), F.col("oy") - F.col("ay"))
    sides = edges.select("sheet_id", "ax", "ay", ((F.col("ox") - F.col("ax")) / n).alias("ux"), ((F.col("oy") - F.col("ay")) / n).alias("uy"), n.alias("n"), "ox", "oy").filter(F.col("n") > NO_LENGTH_FT)
    sides = sides.withColumn("cx", F.explode(span("ax", "ox", 0.0))).withColumn("cy", F.explode(span("ay", "oy", 0.0)))
    at = lambda k: (F.col(f"x{k}") - F.col("ax")) * F.col("ux") + (F.col(f"y{k}") - F.col("ay")) * F.col("uy")
    turn = F.abs((F.col("x1") - F.col("x0")) * F.col("uy") - (F.col("y1") - F.col("y0")) * F.col("ux")) / F.col("size")
    off = F.abs((F.col("y0") - F.col("ay")) * F.col("ux") - (F.col("x0") - F.col("ax")) * F.col("uy"))
    shared = F.least(F.greatest(at(0), at(1)), F.col("n")) - F.greatest(F.least(at(0), at(1)), F.lit(0.0))
    holds = (turn <= EDGE_SINE) & (off <= F.col("reach")) & (shared >= EDGE_SHARE * F.least("n", "size")) & (shared >= wall_share * F.col("size"))
    return own.join(sides, ["sheet_id", "cx", "cy"]).filter(holds).select("sheet_id", "wall_id").distinct()


def carry_classes(spaces: DataFrame, classed: DataFrame, cell: float = 10.0) -> DataFrame:
    """Boxes (sheet_id, space_id, x0..y1) with the class of the first classed box (sheet_id, box_id, x0..y1, class) that
    holds their centre inside; '' where there is none or it has no class. Equal boxes are met once, and so are equal centres."""
    middle = spaces.select("sheet_id", "space_id", ((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("y0") + F.col("y1")) / 2).alias("my"))
    centres = middle.select("sheet_id", "mx", "my").distinct().withColumns({"cx": F.floor(F.col("mx") / cell), "cy": F.floor(F.col("my") / cell)})
    unlike = unlike_boxes(classed, F.min("box_id").alias("box_id"), F.min_by("class", "box_id").alias("class"))
    inside = (F.col("mx") > F.col("x0")) & (F.col("mx") < F.col("x1")) & (F.col("my") > F.col("y0")) & (F.col("my") < F.col("y1"))
    where, at = ["sheet_id", "cx", "cy"], ["sheet_id", "mx", "my"]
    first = dealt(centres, *where).join(dealt(_celled(unlike, cell), *where), where).filter(inside).groupBy(*at).agg(F.min_by("class", "box_id").alias("class"))
    return middle.join(first, at, "left").select("sheet_id", "space_id", F.coalesce("class", F.lit("")).alias("class"))


def virtual_pieces(walls: DataFrame, openings: DataFrame) -> DataFrame:
    """Walls (wall_id, length_ft, source_ids) cut at the doors and openings at floor level (wall_id, kind, sill_ft, lo, hi,
    source_ids): the pieces lo to hi, whether an opening makes a piece virtual, and the sources of both. Windows, raised
    sills and openings without width cut nothing; walls without an opening stay whole."""
    low = openings.filter(F.col("kind").isin("door", "opening") & F.col("sill_ft").between(0, FLOOR_SILL_FT))
    known = low.join(walls.select("wall_id", "length_ft"), "wall_id")
    ends = {c: F.round(F.least(F.greatest(F.col(c), F.lit(0.0)), F.col("length_ft")), 9) for c in ("lo", "hi")}
    spans = known.select("wall_id", *[v.alias(f"_{c}") for c, v in ends.items()], F.col("source_ids").alias("more")).filter(F.col("_hi") - F.col("_lo") > NO_LENGTH_FT)
    whole = walls.select("wall_id", F.explode(F.array(F.lit(0.0), F.round("length_ft", 9))).alias("lo"))
    cuts = whole.unionByName(spans.select("wall_id", F.explode(F.array("_lo", "_hi")).alias("lo"))).distinct()
    pieces = cuts.withColumn("hi", F.lead("lo").over(Window.partitionBy("wall_id").orderBy("lo"))).filter(F.col("hi") - F.col("lo") > NO_LENGTH_FT)
    middle = (F.col("lo") + F.col("hi")) / 2
    covered = pieces.join(spans, "wall_id").filter(middle.between(F.col("_lo"), F.col("_hi")))
    ids = covered.select("wall_id", "lo", F.explode_outer("more").alias("id")).groupBy("wall_id", "lo").agg(F.collect_set("id").alias("more"))
    d = pieces.join(ids, ["wall_id", "lo"], "left").join(walls.select("wall_id", "source_ids"), "wall_id")
    sources = F.when(F.col("more").isNull(), F.col("source_ids")).otherwise(F.array_sort(F.array_union("source_ids", "more")))
    return d.select("wall_id", "lo", "hi", F.col("more").isNotNull().alias("virtual"), sources.alias("source_ids"))


def _steps(span: Column, size: Column) -> Column:
    return F.when(span <= size, 1).otherwise(F.ceil((span - size) / (size * (1 - TILE_OVERLAP))) + 1)


def tile_of(items: DataFrame, bounds: DataFrame) -> DataFrame:
    """The tile of each item (sheet_id, item_id, x, y) over its sheet's bounds (sheet_id, x0, y0, x1, y1): the first that
    holds it, else that of the nearest centre. Tiles overlap and grow until few enough cover the sheet; rows run first in x."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    sizes = F.transform(F.sequence(F.lit(0), F.lit(GROWTHS)), lambda k: F.lit(TILE_FT) * F.pow(F.lit(TILE_GROWTH), k))
    d = bounds.withColumn("size", F.array_min(F.filter(sizes, lambda s: _steps(w, s) * _steps(h, s) <= MOST_TILES)))
    d = d.withColumns({"nx": _steps(w, F.col("size")), "ny": _steps(h, F.col("size"))})
    at = lambda lo, span, n, k: lo + F.when(n > 1, k * (span - F.col("size")) / (n - 1)).otherwise(0.0)

    def tile(k: Column) -> Column:
        a, b = at(F.col("x0"), w, F.col("nx"), k % F.col("nx")), at(F.col("y0"), h, F.col("ny"), F.floor(k / F.col("nx")))
        return F.struct(k.alias("k"), a.alias("a"), b.alias("b"), (a + F.least(w, F.col("size"))).alias("c"), (b + F.least(h, F.col("size"))).alias("d"))

    tiles = d.select("sheet_id", F.transform(F.sequence(F.lit(0).cast("long"), F.col("nx") * F.col("ny") - 1), tile).alias("tiles"))
    holds = lambda t: F.col("x").between(t["a"], t["c"]) & F.col("y").between(t["b"], t["d"])
    away = lambda t: F.struct(F.round(F.hypot(F.col("x") - (t["a"] + t["c"]) / 2, F.col("y") - (t["b"] + t["d"]) / 2), 9).alias("away"), t["k"].alias("k"))
    first = F.try_element_at(F.filter("tiles", holds), F.lit(1))["k"]
    return items.join(tiles, "sheet_id").select("sheet_id", "item_id", F.coalesce(first, F.array_min(F.transform("tiles", away))["k"]).alias("tile"))


def sized_regions(labels: DataFrame, uprights: DataFrame, levels: DataFrame, band: float = 10.0) -> DataFrame:
    """The rectangle round each label (sheet_id, label_id, x, y, width, height) whose sides best agree with its stated size,
    either way round, among the nearest five lines to each side that pass it: uprights and levels (sheet_id, pos, lo, hi).
    Ties go to nearer lines, left, right, down and up in turn; labels that lack a side are left out."""

    def sides(lines: DataFrame, across: str, own: str, low: str, high: str) -> DataFrame:
        # lines of one position count as their union, and each distinct place across them is met once, whoever stands there
        whole = merge_islands(lines.select("sheet_id", F.round("pos", 3).alias("pos"), "lo", "hi").filter("lo <= hi").distinct(), ["sheet_id", "pos"], 0.0)
        bands = F.sequence(F.floor(F.col("lo") / band).cast("long"), F.floor(F.col("hi") / band).cast("long"))
        spread = whole.withColumn("band", F.explode(bands))
        places = labels.select("sheet_id", F.col(across).alias("across")).distinct().withColumn("band", F.floor(F.col("across") / band))
        passing = dealt(places, "sheet_id", "across").join(spread, ["sheet_id", "band"]).filter(F.col("across").between(F.col("lo"), F.col("hi"))).select("sheet_id", "across", "pos")
        asked = labels.select("sheet_id", F.col(own).alias("own"), F.col(across).alias("across")).distinct()
        met = asked.join(passing, ["sheet_id", "across"]).filter(F.col("pos") != F.col("own"))
        met = met.select("sheet_id", "own", "across", "pos", (F.col("pos") > F.col("own")).alias("above"), F.abs(F.col("pos") - F.col("own")).alias("away"))
        rank = F.row_number().over(Window.partitionBy("sheet_id", "own", "across", "above").orderBy("away"))
        near = met.withColumn("rank", rank).filter(F.col("rank") <= LINES_A_SIDE)
        of = lambda above: F.array_sort(F.collect_list(F.when(F.col("above") == above, F.struct("rank", "pos"))))
        return near.groupBy("sheet_id", F.col("own").alias(own), F.col("across").alias(across)).agg(of(False).alias(low), of(True).alias(high))

    stated = ["sheet_id", "x", "y", "width", "height"]
    d = labels.select(*stated).distinct().join(sides(uprights, "y", "x", "l", "r"), ["sheet_id", "x", "y"]).join(sides(levels, "x", "y", "d", "u"), ["sheet_id", "x", "y"])
    d = dealt(d, *stated)  # each makes up to LINES_A_SIDE ** 4 rows
    for c in "lrdu":
        d = d.withColumn(c, F.explode(c))
    w, h = F.col("r.pos") - F.col("l.pos"), F.col("u.pos") - F.col("d.pos")
    off = lambda a, b: F.abs(w - F.col(a)) + F.abs(h - F.col(b))
    error = F.round(F.least(off("width", "height"), off("height", "width")), 6)
    order = F.struct(error.alias("error"), *[F.col(f"{c}.rank").alias(f"{c}_rank") for c in "lrdu"], *[F.col(f"{c}.pos").alias(f"{c}_at") for c in "lrdu"])
    best = d.groupBy(*stated).agg(F.min(order).alias("best")).alias("b")
    alike = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in stated]
    best = labels.alias("a").join(best, alike).select("a.sheet_id", "a.label_id", "b.best")
    return best.select("sheet_id", "label_id", "best.error", *[F.col(f"best.{c}_at").alias(n) for c, n in zip("ldru", ("x0", "y0", "x1", "y1"), strict=True)])


def assemble_buildings(floors: DataFrame, models: DataFrame) -> DataFrame:
    """Buildings from listed floors (building_id, floor_id, approved) and finished models (floor_id, wall_height_ft): floors
    assembled, floors missing, the wall height, and a verdict: ``nothing`` finished, ``heights`` that differ, else ``built``.
    Floors that were refused take no part; a floor of unknown approval does."""
    asked = floors.filter(F.coalesce("approved", F.lit(True))).join(models.select("floor_id", "wall_height_ft", F.lit(True).alias("done")), "floor_id", "left")
    done, n = F.col("done"), F.col("n_assembled")
    d = asked.groupBy("building_id").agg(
        F.count("done").alias("n_assembled"), F.array_sort(F.collect_list(F.when(done.isNull(), F.col("floor_id")))).alias("missing"),
        F.min("wall_height_ft").alias("low"), F.max("wall_height_ft").alias("high"),
    )
    verdict = F.when(n == 0, "nothing").when(F.col("low") != F.col("high"), "heights").otherwise("built")
    return d.select("building_id", "n_assembled", "missing", F.when(F.col("low") == F.col("high"), F.col("low")).alias("wall_height_ft"), verdict.alias("verdict"))
