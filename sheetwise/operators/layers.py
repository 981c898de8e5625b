"""Filters, attributes and orders of layers, walls and entities. All are projections, or joins and windows by sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Heights in feet of wall classes that don't reach the ceiling.
CLASS_HEIGHTS = {"parapet": 3.5, "railing": 3.5, "site_wall": 6.0, "pool_edge": 5.0}
#: What the exported element and its type are called, by wall class, else by the last.
CLASS_TYPES = {"railing": ("IfcRailing", "GUARDRAIL"), "parapet": ("IfcWallStandardCase", "PARAPET")}
PLAIN_TYPE = "IfcWallStandardCase"
#: Wall classes that are openings, and the confidence they get.
OPENING_CLASSES, OPENING_CONFIDENCE = ("window", "door"), 0.7
#: Relative and absolute tolerance of a rectangle.
AREA_TOLERANCE, COORDINATE_NOISE_FT = 1e-9, 2e-8
RIVALS = "competing_wall_layers"


def by_layer(primitives: DataFrame, names: DataFrame) -> DataFrame:
    """Primitives whose layer is among ``names`` (layer), in any case."""
    wanted = names.select(F.lower("layer").alias("_name")).distinct()
    return primitives.join(wanted, F.lower("layer") == F.col("_name"), "left_semi")


def layer_names(primitives: DataFrame, texts: DataFrame) -> DataFrame:
    """The distinct layers of each sheet that hold a primitive or a text."""
    return primitives.select("sheet_id", "layer").unionByName(texts.select("sheet_id", "layer")).distinct()


def layers_for_roles(decisions: DataFrame, roles: list[str], floor: float = 0.0) -> DataFrame:
    """Layers with one of ``roles`` at a confidence of ``floor`` or more."""
    return decisions.filter(F.col("role").isin(roles) & (F.col("confidence") >= floor))


def to_feet(rows: DataFrame, scales: DataFrame, columns: list[str]) -> DataFrame:
    """Coordinates in feet: ``columns`` over the sheet's units_per_foot. Sheets without a positive scale are left out."""
    known = scales.filter("units_per_foot > 0").select("sheet_id", "units_per_foot")
    return rows.join(known, "sheet_id").withColumns({c: F.col(c) / F.col("units_per_foot") for c in columns}).drop("units_per_foot")


def class_height(wall_class: Column, storey_height: Column) -> Column:
    fixed = F.create_map(*[F.lit(v) for pair in CLASS_HEIGHTS.items() for v in pair])
    return F.coalesce(F.try_element_at(fixed, wall_class), storey_height)


def class_offset(wall_class: Column) -> Column:
    """Where a wall begins above its floor: a pool's edge goes down."""
    return F.when(wall_class == "pool_edge", -CLASS_HEIGHTS["pool_edge"]).otherwise(0.0)


def class_type(wall_class: Column) -> Column:
    """struct<entity, kind>."""
    out = F.struct(F.lit(PLAIN_TYPE).alias("entity"), F.lit(None).cast("string").alias("kind"))
    for name, (entity, kind) in CLASS_TYPES.items():
        out = F.when(wall_class == name, F.struct(F.lit(entity).alias("entity"), F.lit(kind).alias("kind"))).otherwise(out)
    return out


def split_openings(walls: DataFrame) -> DataFrame:
    """Walls (wall_class, length_ft and more), and after them an opening along the whole of each that is classed as one;
    such walls lose their class. Column ``opening`` is null for walls; walls without length hold no opening."""
    holds = F.col("wall_class").isin(*OPENING_CLASSES) & (F.col("length_ft") > 1e-6)
    kept = F.struct(F.lit(None).cast("string").alias("opening"), F.when(holds, "").otherwise(F.col("wall_class")).alias("wall_class"), F.lit(None).cast("double").alias("confidence"))
    opening = F.struct(F.col("wall_class").alias("opening"), F.lit("").alias("wall_class"), F.lit(OPENING_CONFIDENCE).alias("confidence"))
    rows = F.when(holds, F.array(kept, opening)).otherwise(F.array(kept))
    parts = {"opening": "opening", "wall_class": "wall_class", "opening_confidence": "confidence"}
    return walls.withColumn("_row", F.explode(rows)).withColumns({c: F.col(f"_row.{part}") for c, part in parts.items()}).drop("_row")


def crop(shapes: DataFrame, window: tuple[float, float, float, float], hidden_kinds: list[str]) -> DataFrame:
    """Shapes (kind, x0, y0, x1, y1) whose box touches the window, without kinds that are never drawn."""
    x0, y0, x1, y1 = window
    lo, hi = (lambda c: F.least(f"{c}0", f"{c}1")), (lambda c: F.greatest(f"{c}0", f"{c}1"))
    return shapes.filter(~F.col("kind").isin(hidden_kinds) & (hi("x") >= x0) & (lo("x") <= x1) & (hi("y") >= y0) & (lo("y") <= y1))


def attach_entities(primitives: DataFrame, entities: DataFrame) -> DataFrame:
    """Primitives with the entity (sheet_id, source_id and more) that they came from, where there is one."""
    return primitives.join(entities, ["sheet_id", "source_id"], "left")


def wall_order(walls: DataFrame) -> DataFrame:
    """Walls (sheet_id, wall_id, x0, y0, x1, y1, thickness_ft, layer) numbered on their sheet by lesser end, greater end,
    thickness, layer and id, whichever way they were drawn."""
    a, b = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    order = Window.partitionBy("sheet_id").orderBy(F.least(a, b), F.greatest(a, b), "thickness_ft", "layer", "wall_id")
    return walls.withColumn("place", F.row_number().over(order))


def longest_named(walls: DataFrame, k: int = 5) -> DataFrame:
    """Per sheet the count of walls (sheet_id, wall_id, layer, length_ft) and the ``k`` longest as text. Each sheet holds
    ``k`` rows at most when they are put together."""
    rank = F.row_number().over(Window.partitionBy("sheet_id").orderBy(F.desc("length_ft"), "wall_id"))
    top = walls.withColumn("_rank", rank).filter(F.col("_rank") <= k)
    said = F.format_string("'%s' %.1fft", "layer", "length_ft")
    named = top.groupBy("sheet_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", said.alias("said")))), lambda r: r["said"]), ", ").alias("longest"))
    return walls.groupBy("sheet_id").agg(F.count("*").alias("n")).join(named, "sheet_id")


def rival_batches(layers: DataFrame, size: int = 4) -> DataFrame:
    """Layers (sheet_id, layer_id, reason, rank) in batches of ``size`` by rank, rivals first and never among others."""
    rival = F.col("reason") == RIVALS
    k = F.row_number().over(Window.partitionBy("sheet_id", rival).orderBy("rank", "layer_id")) - 1
    before = F.sum(F.when(rival, 1).otherwise(0)).over(Window.partitionBy("sheet_id"))
    start = F.when(rival, 0).otherwise(F.ceil(before / size))
    return layers.withColumn("batch", (start + F.floor(k / size)).cast("long"))


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first of equal rows, with its place among those kept, by the order of first appearance in each sheet."""
    rest = F.struct(*[c for c in rows.columns if c not in ("sheet_id", *keys)])
    first = rows.groupBy("sheet_id", *keys).agg(F.min_by(rest, F.struct(*order)).alias("_row")).select("sheet_id", *keys, "_row.*")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("sheet_id").orderBy(*order)))


def hide_approved(shapes: DataFrame, approved: DataFrame) -> DataFrame:
    """Shapes (fingerprint and more) that no approved fingerprint names."""
    return shapes.join(approved.select("fingerprint").distinct(), "fingerprint", "left_anti")


def is_rectangular(area: Column, box_area: Column, perimeter: Column) -> Column:
    """Whether an outline fills its box, up to a part of its area and the noise of coordinates along its edge."""
    return F.abs(area - box_area) <= F.greatest(area, box_area) * AREA_TOLERANCE + perimeter * COORDINATE_NOISE_FT


def form_factor(points: Column, length: Column) -> Column:
    """Length over the longest chord between two points; null where all points are one."""
    chords = F.transform(points, lambda p: F.array_max(F.transform(points, lambda q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))))
    longest = F.array_max(chords)
    return F.when(longest > 0, length / longest)


def as_map(entries: Column) -> Column:
    """Entries array<struct<key, value>> as a map; of equal keys the last counts. No entries: an empty map."""
    later = lambda e, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: ~later(e, i)))


def opening_span(properties: Column) -> Column:
    """start_ft and end_ft of the opening that a JSON text of properties states, as struct; null where either is missing."""
    said = F.from_json(properties, "opening_start_ft double, opening_end_ft double")
    return F.when(said["opening_start_ft"].isNotNull() & said["opening_end_ft"].isNotNull(), F.struct(said["opening_start_ft"].alias("start_ft"), said["opening_end_ft"].alias("end_ft")))
