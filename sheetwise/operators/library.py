"""Instances of library templates among a sheet's shapes, at any even scale, turned by steps of 45 degrees, also mirrored.

A library template has no size of its own: its larger side is 1. Its rarest part on a sheet is the anchor, and each shape of
that kind votes for a pose: the ratio of lengths is the scale, and each allowed angle and mirroring is tried with it. Poses
are then verified part by part. Scales differ, so cells come in levels: a pose looks into cells of about its own size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions.geometry import computed, convex_hull
from sheetwise.operators.templates import hausdorff, measured_parts, settled
from sheetwise.runtime import materialize

#: Tolerance as a share of the larger side, how far forms may differ, how many other parts are looked for
#: before a pose is tried, and the angles that remain when all are too many.
TOLERANCE, FORM_TOLERANCE, NEIGHBOURS, AXES = 0.03, 0.12, 5, (0.0, 45.0, 90.0, 180.0, 270.0)


def form(points: Column, length: Column) -> Column:
    """Length over longest chord, which scale, turns and mirroring don't change; null where all points are one."""
    hulls = F.transform(F.array(convex_hull(points)), lambda h: F.array_max(F.transform(h, lambda p: F.array_max(F.transform(h, lambda q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))))))
    return F.when(hulls[0] > 0, length / hulls[0])


def orientations(angles: Column, mirror: Column, spots: Column, budget: int | None) -> Column:
    """The most trials within ``budget``: struct<trials, angles, mirrors>, null where one for each spot is too many; all of
    them without a budget.

    Fewer than all are the angles among ``AXES`` or a single one (0 where it is allowed), with mirroring or without."""
    single = F.when(F.array_contains(angles, 0.0), F.array(F.lit(0.0))).otherwise(F.slice(angles, 1, 1))
    sets = F.filter(F.array(angles, F.filter(angles, lambda a: a.isin(*AXES)), single), lambda s: F.size(s) > 0)

    def combination(s: Column, m: tuple[bool, ...]) -> Column:
        return F.struct((F.size(s) * len(m)).alias("trials"), F.size(s).alias("n_angles"), s.alias("angles"), F.array(*map(F.lit, m)).alias("mirrors"))

    plain = F.transform(sets, lambda s: combination(s, (False,)))
    both = F.when(mirror, F.transform(sets, lambda s: combination(s, (False, True)))).otherwise(F.slice(plain, 1, 0))
    every = F.concat(plain, both)
    return F.array_max(every if budget is None else F.filter(every, lambda c: c["trials"] * spots <= budget))


def _levels(d: DataFrame, x: Column, y: Column, reach: Column, share: float) -> DataFrame:
    """``d`` once for each cell within ``reach`` of (x, y), cells being ``share`` of the power of two above the scale."""
    d = d.withColumn("level", F.ceil(F.log2("scale")).cast("int"))
    cell = F.pow(F.lit(2.0), F.col("level")) * share
    cells = lambda c: F.sequence(F.floor((c - reach) / cell).cast("long"), F.floor((c + reach) / cell).cast("long"))
    return d.withColumn("cx", F.explode(cells(x))).withColumn("cy", F.explode(cells(y)))


def _placed(pool: DataFrame, asked: DataFrame, share: float) -> DataFrame:
    """The shapes in the cells of each level that is asked for on their sheet, for their kind."""
    levels = asked.select("sheet_id", "category", "n", "level").distinct()  # a few for each kind: sizes have a range
    cell = F.pow(F.lit(2.0), F.col("level")) * share
    return pool.join(levels, ["sheet_id", "category", "n"]).withColumns({"cx": F.floor(F.col("o_mx") / cell).cast("long"), "cy": F.floor(F.col("o_my") / cell).cast("long")})


def match_library(parts: DataFrame, templates: DataFrame, paths: DataFrame, budget: int | None = None) -> DataFrame:
    """Instances of ``templates``: sheet_id, template_id, kind, scale (ft), angle (degrees), mirrored, sources (sorted), n, verdict.

    ``parts`` are as in ``templates.py``. ``templates`` has template_id, kind, size_min, size_max (ft), angles (array) and
    mirror; ``paths`` a row for each part of a template: template_id, path_no, category, points. A template is sought on
    sheets that have shapes of the kinds of all its parts. A shape may be the anchor if the size that it implies is in range,
    its form is the anchor's, and the template's rarest other parts (at most ``NEIGHBOURS``) are at their distances from it.

    An instance takes whole sources only, each set of sources once, by the first template, anchor, mirroring and angle that
    fit; n is its number of parts. ``found`` instances share no source with another, others are ``shared``. A template has
    further rows for a sheet: ``out_of_range`` with n shapes whose size isn't in range, ``reduced`` with n orientations where
    all would take more than ``budget`` trials, and ``skipped`` with n possible anchors where one orientation would, with no
    instances then; without a budget, as it is unless one is given, all poses are tried. Rows with nulls in geometry or key have no shape and match nothing; comparisons aren't limited."""
    key, kinds = ["sheet_id", "template_id"], ["category", "n"]
    shapes = materialize(measured_parts(parts).select("sheet_id", "part_id", "source_id", *kinds, "length", "mx", "my", "points"), "shapes")  # read for counts, anchors and poses
    pool = shapes.select("sheet_id", *kinds, *[F.col(c).alias(f"o_{c}") for c in ("part_id", "source_id", "length", "mx", "my", "points")])
    allowed = F.array_sort(F.array_distinct(F.transform("angles", lambda a: F.pmod(a.cast("double"), F.lit(360.0)))))
    wanted = templates.select("template_id", "kind", "size_min", "size_max", allowed.alias("angles"), F.coalesce("mirror", F.lit(False)).alias("mirror"))
    drawn = measured_parts(paths).select("template_id", "path_no", *kinds, "length", "mx", "my", "points")
    sizes = paths.groupBy("template_id").agg(F.count("*").alias("n_seeds"))
    counts = shapes.groupBy("sheet_id", *kinds).agg(F.count("*").alias("rivals"))
    there = drawn.join(counts, kinds).join(sizes, "template_id")
    every = Window.partitionBy(*key)
    there = there.withColumn("n_here", F.count("*").over(every)).filter("n_here = n_seeds")
    rarest = every.orderBy("rivals", F.desc("length"), "points", "path_no")
    others = every.orderBy(F.when(F.col("anchor"), -1).otherwise(F.col("rivals")), "path_no")
    ranked = there.withColumn("anchor", F.row_number().over(rarest) == 1).withColumn("turn", F.row_number().over(others) - 1)
    ranked = ranked.withColumn("place", F.row_number().over(every.orderBy(F.desc("anchor"), "path_no")))
    anchors = ranked.filter("anchor").join(wanted, "template_id")
    at = anchors.join(pool, ["sheet_id", *kinds]).withColumn("scale", F.col("o_length") / F.col("length"))
    inside = F.col("scale").between(F.col("size_min"), F.col("size_max"))
    outside = at.filter(~inside).groupBy(*key, "kind").agg(F.count("*").alias("n"))
    close = F.abs(F.col("o_form") - F.col("form")) > FORM_TOLERANCE * F.col("form")
    at = computed(at.filter(inside), form=form(F.col("points"), F.col("length")), o_form=form(F.col("o_points"), F.col("o_length"))).filter((F.col("category") == "fill") | ~F.coalesce(close, F.lit(False)))
    spot = [*key, "at_part"]
    spots = at.select(*key, "kind", "angles", "mirror", "n_seeds", F.col("mx").alias("ax"), F.col("my").alias("ay"), F.col("o_part_id").alias("at_part"), F.col("o_source_id").alias("at_source"), F.col("o_mx").alias("tx"), F.col("o_my").alias("ty"), "scale")
    spots = materialize(spots, "spots")  # read for neighbours, budgets and poses

    sought = spots.join(ranked.filter(F.col("turn").between(1, NEIGHBOURS)).select(*key, "turn", *kinds, "mx", "my"), key)
    sought = sought.withColumn("far", F.hypot(F.col("mx") - F.col("ax"), F.col("my") - F.col("ay")) * F.col("scale")).withColumn("slack", 3 * TOLERANCE * F.col("scale"))
    sought = _levels(sought, F.col("tx"), F.col("ty"), F.col("far") + F.col("slack"), 1.0)
    seen = sought.join(_placed(pool, sought, 1.0), ["sheet_id", *kinds, "level", "cx", "cy"]).filter(F.col("o_part_id") != F.col("at_part"))
    seen = seen.filter(F.abs(F.hypot(F.col("o_mx") - F.col("tx"), F.col("o_my") - F.col("ty")) - F.col("far")) <= F.col("slack"))
    met = seen.groupBy(*spot, "turn").agg(F.lit(1).alias("one")).groupBy(*spot).agg(F.count("*").alias("n_seen"))
    possible = spots.join(met, spot, "left").filter(F.coalesce("n_seen", F.lit(0)) == F.least(F.col("n_seeds") - 1, F.lit(NEIGHBOURS)))

    trials = possible.groupBy(*key).agg(F.min("kind").alias("kind"), F.min("angles").alias("angles"), F.max("mirror").alias("mirror"), F.count("*").alias("n_spots"))
    trials = materialize(computed(trials, fit=orientations(F.col("angles"), F.col("mirror"), F.col("n_spots"), budget)), "trials")
    whole = F.size("angles") * F.when(F.col("mirror"), 2).otherwise(1)
    poses = possible.drop("angles", "mirror", "n_seen").join(trials.filter("fit IS NOT NULL").select(*key, "fit"), key)
    poses = poses.withColumn("mirrored", F.explode("fit.mirrors")).withColumn("angle", F.explode("fit.angles")).drop("fit")
    poses = poses.withColumns({"c": F.cos(F.radians("angle")) * F.col("scale"), "s": F.sin(F.radians("angle")) * F.col("scale"), "side": F.when(F.col("mirrored"), -1.0).otherwise(1.0)})

    def moved(p: Column) -> Column:
        dx, dy = (p["x"] - F.col("ax")) * F.col("side"), p["y"] - F.col("ay")
        return F.struct((F.col("tx") + dx * F.col("c") - dy * F.col("s")).alias("x"), (F.col("ty") + dx * F.col("s") + dy * F.col("c")).alias("y"))

    expected = poses.join(ranked.select(*key, "place", *kinds, "mx", "my", "points"), key)
    expected = computed(expected, line=F.transform("points", moved), middle=moved(F.struct(F.col("mx").alias("x"), F.col("my").alias("y")))).drop("points")
    reach = 2 * TOLERANCE * F.col("scale")
    expected = _levels(expected, F.col("middle.x"), F.col("middle.y"), reach, 0.25)
    near = expected.join(_placed(pool, expected, 0.25), ["sheet_id", *kinds, "level", "cx", "cy"])
    near = near.filter(F.when(F.col("place") == 1, F.col("o_part_id") == F.col("at_part")).otherwise(F.hypot(F.col("o_mx") - F.col("middle.x"), F.col("o_my") - F.col("middle.y")) <= reach))
    fitting = computed(near, away=hausdorff(F.col("line"), F.col("o_points"))).filter(F.col("away") <= TOLERANCE * F.col("scale"))
    found = settled(fitting, parts, ["mirrored", "angle", "scale"]).join(templates.select("template_id", "kind"), "template_id")
    out = found.select(*key, "kind", "scale", "angle", "mirrored", "sources", F.col("n_parts").alias("n"), "verdict")

    def notes(d: DataFrame, n: Column, verdict: str) -> DataFrame:
        empty = {f.name: F.lit(None).cast(f.dataType) for f in out.schema if f.name in ("scale", "angle", "mirrored", "sources")}
        return d.select(*key, "kind", n.cast("long").alias("n"), F.lit(verdict).alias("verdict")).withColumns(empty)

    out = out.unionByName(notes(outside, F.col("n"), "out_of_range")).unionByName(notes(trials.filter("fit IS NULL"), F.col("n_spots"), "skipped"))
    return out.unionByName(notes(trials.filter(F.col("fit.trials") < whole), F.col("fit.trials"), "reduced"))
