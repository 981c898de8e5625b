"""Instances of reviewed templates among a sheet's shapes: exact in size, turned by given angles, never mirrored.

Parts are (sheet_id, part_id, source_id, layer, category, points: array of x, y in feet, a closed one repeating its first
point); part ids are unique on a sheet. A template is a set of a sheet's parts. Its rarest part is the anchor: each shape
that could be the anchor gives, with each angle, a pose, and in each pose every part of the template must be met by a
shape of its own. Poses meet shapes by signature and grid cell, so shapes are compared only where a part is expected.
"""

from __future__ import annotations

from math import cos, radians, sin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions.geometry import computed, distance_to_segment
from sheetwise.runtime import materialize

#: Tolerance in inches, angles in degrees, and the most parts of a template.
TOLERANCE_IN, ANGLES, MOST_PARTS = 0.1, (0, 90, 180, 270), 64
CELL_FT = 0.5


def _pairs(points: Column) -> Column:
    return F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def hausdorff(one: Column, other: Column) -> Column:
    """The two-sided Hausdorff distance of two lines: the farthest that a corner of either is from the other."""
    farthest = lambda points, sides: F.array_max(F.transform(points, lambda p: F.array_min(F.transform(sides, lambda s: distance_to_segment(p["x"], p["y"], s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))))
    return F.greatest(farthest(one, _pairs(other)), farthest(other, _pairs(one)))


def measured_parts(parts: DataFrame) -> DataFrame:
    """``parts`` of two points or more with n (sides), length and the middle (mx, my) of their line; others have no shape."""
    d = parts.filter(F.size(F.coalesce("points", F.array().cast("array<struct<x:double,y:double>>"))) > 1).withColumn("points", F.col("points").cast("array<struct<x:double,y:double>>"))
    sides = F.transform(_pairs(F.col("points")), lambda s: F.struct(F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]).alias("l"), ((s["a"]["x"] + s["b"]["x"]) / 2).alias("x"), ((s["a"]["y"] + s["b"]["y"]) / 2).alias("y")))
    d = computed(d, sides=sides)
    total = lambda f: F.aggregate("sides", F.lit(0.0), lambda t, s: t + f(s))
    d = computed(d, length=total(lambda s: s["l"]), wx=total(lambda s: s["l"] * s["x"]), wy=total(lambda s: s["l"] * s["y"])).filter("length > 0")
    return d.withColumns({"n": F.size("sides"), "mx": F.col("wx") / F.col("length"), "my": F.col("wy") / F.col("length")}).drop("sides", "wx", "wy")


def _moved(p: Column) -> Column:
    """A point of the template in a pose: turned about the anchor's middle, which goes to the shape's."""
    dx, dy = p["x"] - F.col("ax"), p["y"] - F.col("ay")
    return F.struct((F.col("tx") + dx * F.col("c") - dy * F.col("s")).alias("x"), (F.col("ty") + dx * F.col("s") + dy * F.col("c")).alias("y"))


def settled(met: DataFrame, parts: DataFrame, turn: list[str]) -> DataFrame:
    """The instances among poses: sheet_id, template_id, ``turn``, n_parts, sources and verdict (found or shared).

    ``met`` has a row for each shape that a part (``place``, the anchor's being 1) of a template meets in a pose, which is a
    template at an anchor (at_part, at_source) with the columns ``turn``, in the order that decides which pose counts."""
    pose = ["sheet_id", "template_id", "at_part", *turn]
    choice = F.struct(F.round("away", 9).alias("away"), F.col("o_source_id").alias("source_id"), F.col("o_part_id").alias("part_id"))
    each = met.groupBy(*pose, "at_source", "n_seeds", "place").agg(F.array_sort(F.collect_list(choice)).alias("options"))  # shapes within the tolerance of one place
    whole = each.groupBy(*pose, "at_source", "n_seeds").agg(F.count("*").alias("n_met"), F.array_sort(F.collect_list(F.struct("place", "options"))).alias("asked")).filter("n_met = n_seeds")

    def take(taken: Column, asked: Column) -> Column:
        left = F.filter(asked["options"], lambda o: ~F.exists(taken, lambda t: t["part_id"] == o["part_id"]))
        return F.concat(taken, F.slice(left, 1, 1))  # in the order of the template's parts, the nearest shape that is left

    first = F.col("asked")[0]["options"]
    chosen = computed(whole, chosen=F.aggregate("asked", F.slice(first, 1, 0), take)).filter(F.size("chosen") == F.col("n_seeds"))
    members = chosen.select(*pose, "at_source", F.explode("chosen").alias("m")).groupBy(*pose, "at_source", F.col("m.source_id").alias("source_id")).agg(F.count("*").alias("k"))
    totals = parts.groupBy("sheet_id", "source_id").agg(F.count("*").alias("total"))
    judged = members.join(totals, ["sheet_id", "source_id"]).groupBy(*pose, "at_source").agg(F.array_sort(F.collect_list("source_id")).alias("sources"), F.sum("k").alias("n_parts"), F.min(F.col("k") == F.col("total")).alias("complete"))
    best = F.min_by(F.struct("template_id", *turn, "n_parts"), F.struct("template_id", "at_source", "at_part", *turn))
    once = judged.filter("complete").groupBy("sheet_id", "sources").agg(best.alias("b")).select("sheet_id", "sources", "b.*")
    claims = once.select("sheet_id", "sources", F.explode("sources").alias("source_id"))
    doubled = claims.groupBy("sheet_id", "source_id").agg(F.count("*").alias("k")).filter("k > 1").select("sheet_id", "source_id")
    shared = claims.join(doubled, ["sheet_id", "source_id"], "left_semi").select("sheet_id", "sources").distinct().withColumn("shared", F.lit(True))
    return once.join(shared, ["sheet_id", "sources"], "left").withColumn("verdict", F.when(F.col("shared"), "shared").otherwise("found")).drop("shared")


def match_templates(parts: DataFrame, seeds: DataFrame, tolerance_in: float = TOLERANCE_IN, angles: tuple[float, ...] = ANGLES, budget: int | None = None) -> DataFrame:
    """Instances of templates: sheet_id, template_id, kind, angle (degrees), sources (sorted), n_parts and verdict.

    ``seeds`` has a row for each part of a template: sheet_id, template_id, kind, part_id. Shapes on the layers of the
    template's own parts are looked through. An instance takes whole sources only: one with a part that no template part
    meets is refused. Each set of sources counts once, at the least angle of the first template. ``found`` instances share no
    source with another; those that do are ``shared``. A template with more than ``budget`` poses, if a budget is given, isn't searched and has
    one row ``over_budget``; one of more than ``MOST_PARTS`` parts, or with parts that aren't there, one row ``unfit``."""
    tolerance = tolerance_in / 12
    shapes = materialize(measured_parts(parts), "shapes")  # read for counts, anchors and poses
    key = ["sheet_id", "template_id"]
    of = seeds.join(shapes.withColumn("layer", F.lower("layer")), ["sheet_id", "part_id"], "left")
    counts = of.groupBy(*key).agg(F.min("kind").alias("kind"), F.count("*").alias("n_seeds"), F.count("points").alias("n_known"), F.collect_set("layer").alias("layers"))  # layers of at most MOST_PARTS parts
    fit = (F.col("n_seeds") == F.col("n_known")) & (F.col("n_seeds") <= MOST_PARTS)
    known = of.join(counts.filter(fit).select(*key, "n_seeds", "layers"), key).select(*key, "kind", "n_seeds", "layers", "part_id", "source_id", "category", "n", "length", "mx", "my", "points")
    pool = shapes.select("sheet_id", "category", "n", F.lower("layer").alias("layer"), *[F.col(c).alias(f"o_{c}") for c in ("part_id", "source_id", "length", "mx", "my", "points")])
    alike = (F.abs(F.col("length") - F.col("o_length")) <= 2 * tolerance * F.greatest(F.col("n"), F.lit(1))) & F.array_contains("layers", F.col("layer"))
    rivals = known.join(pool, ["sheet_id", "category", "n"]).filter(alike).groupBy(*key, "part_id").agg(F.count("*").alias("rivals"))
    order = Window.partitionBy(*key).orderBy("rivals", F.desc("length"), "source_id", "part_id")
    ranked = known.join(rivals, [*key, "part_id"]).withColumn("place", F.row_number().over(order))
    anchors = ranked.filter("place = 1").withColumn("over", F.lit(False) if budget is None else F.col("rivals") * len(set(angles)) > budget)
    at = anchors.filter("not over").join(pool, ["sheet_id", "category", "n"]).filter(alike)
    turns = F.array(*[F.struct(F.lit(float(a)).alias("angle"), F.lit(cos(radians(a))).alias("c"), F.lit(sin(radians(a))).alias("s")) for a in sorted({x % 360 for x in angles})])
    poses = at.select(*key, F.col("mx").alias("ax"), F.col("my").alias("ay"), F.col("o_part_id").alias("at_part"), F.col("o_source_id").alias("at_source"), F.col("o_mx").alias("tx"), F.col("o_my").alias("ty"), F.explode(turns).alias("t")).select("*", "t.*").drop("t")
    pose = [*key, "at_part", "angle"]
    expected = poses.join(ranked.select(*key, "n_seeds", "layers", "place", "category", "n", "mx", "my", "points"), key)
    middle = _moved(F.struct(F.col("mx").alias("x"), F.col("my").alias("y")))
    expected = computed(expected, line=F.transform("points", _moved), middle=middle).drop("points")
    reach = 2 * tolerance
    cells = lambda c: F.sequence(F.floor((F.col(f"middle.{c}") - reach) / CELL_FT).cast("long"), F.floor((F.col(f"middle.{c}") + reach) / CELL_FT).cast("long"))
    expected = expected.withColumn("cx", F.explode(cells("x"))).withColumn("cy", F.explode(cells("y")))
    placed = pool.withColumns({"cx": F.floor(F.col("o_mx") / CELL_FT).cast("long"), "cy": F.floor(F.col("o_my") / CELL_FT).cast("long")})
    near = expected.join(placed, ["sheet_id", "category", "n", "cx", "cy"]).filter(F.array_contains("layers", F.col("layer")) & ((F.col("place") > 1) | (F.col("o_part_id") == F.col("at_part"))))
    near = near.filter((F.col("place") == 1) | (F.hypot(F.col("o_mx") - F.col("middle.x"), F.col("o_my") - F.col("middle.y")) <= reach))
    met = computed(near, away=hausdorff(F.col("line"), F.col("o_points"))).filter(F.col("away") <= tolerance)
    found = settled(met, parts, ["angle"]).join(counts.select(*key, "kind"), key)
    out = found.select(*key, "kind", "angle", "sources", "n_parts", "verdict")
    source = out.schema["sources"].dataType.simpleString()
    rest = lambda d, verdict: d.select(*key, "kind", F.lit(None).cast("double").alias("angle"), F.lit(None).cast(source).alias("sources"), F.lit(None).cast("long").alias("n_parts"), F.lit(verdict).alias("verdict"))
    return out.unionByName(rest(anchors.filter("over"), "over_budget")).unionByName(rest(counts.filter(~fit), "unfit"))
