"""Recognition of symbols: blocks by their names, touching shapes on a layer of one role, and doors from arcs and leaves.

Entities are (sheet_id, entity_id, parent_id, kind, layer, block_name, attributes, partial, points: array of x, y in feet),
ids unique over all sheets. Nothing is claimed by a box: a symbol has the ids that it is made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.geometry import computed, segment_distance
from sheetwise.functions.text import token_role
from sheetwise.operators.graph import closure, components
from sheetwise.operators.healing import measure_instances
from sheetwise.operators.openings import line_cells
from sheetwise.runtime import materialize

#: Kinds by role, the least confidence of a layer's role, and how near shapes of one symbol lie.
KINDS = {
    "door": "door", "window": "window", "column": "column", "beam_overhead": "beam", "stair": "stair", "furniture": "furniture", "electrical": "electrical", "plumbing": "plumbing", "vehicle": "vehicle",
}
SURE, TOUCH_FT = 0.7, 0.08
#: Fixed values of a door's arc and leaf: sweep in degrees, radius, and by how much hinge, length and angle may be off.
LEAST_SWEEP, MOST_SWEEP, LEAST_RADIUS_FT, MOST_RADIUS_FT, HINGE_FT, LEAF_FT, LEAF_DEG = 65, 115, 1.5, 5.0, 0.08, 0.1, 5


def _kind(role: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), role)


def _with_layer_kind(d: DataFrame, roles: DataFrame) -> DataFrame:
    """``d`` with layer_kind: that of the layer's sure role, else of its name."""
    sure = roles.filter((F.col("confidence") >= SURE) & F.col("role").isin(*KINDS)).groupBy("sheet_id", "layer").agg(F.min("role").alias("_role"))
    named = computed(d.join(sure, ["sheet_id", "layer"], "left"), _named=token_role(F.coalesce("layer", F.lit(""))))
    return named.withColumn("layer_kind", _kind(F.coalesce("_role", "_named"))).drop("_role", "_named")


def block_symbols(entities: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, members) of blocks: an INSERT whose name, else whose layer, says a kind, with all entities below it, if their
    rectangle has a size of that kind. One with a partial entity isn't taken, nor one below a taken block of a lesser id.
    Symbols: sheet_id, symbol_id (the block's), kind, width_ft, depth_ft, angle, x, y; members: symbol_id, entity_id."""
    whole = ~F.coalesce("partial", F.lit(False))
    inserts = computed(_with_layer_kind(entities.filter((F.col("kind") == "INSERT") & whole), roles), _role=token_role(F.concat_ws(" ", "block_name", "attributes")))
    blocks = inserts.withColumn("symbol_kind", F.coalesce(_kind(F.col("_role")), "layer_kind")).filter("symbol_kind is not null")
    blocks = materialize(blocks.select("sheet_id", F.col("entity_id").alias("symbol_id"), "symbol_kind"), "blocks")
    paths = closure(entities.select(F.col("entity_id").alias("child"), F.col("parent_id").alias("parent")))
    below = paths.filter("depth > 0").select(F.col("ancestor").alias("symbol_id"), F.col("node").alias("entity_id"))
    members = blocks.join(below, "symbol_id").select("symbol_id", "entity_id").unionByName(blocks.select("symbol_id", F.col("symbol_id").alias("entity_id")))
    members = materialize(members, "members")
    each = members.join(entities.select("entity_id", F.col("kind").alias("entity_kind"), "partial", "points"), "entity_id")
    drawn = each.filter("entity_kind <> 'INSERT'")
    own = each.filter("entity_id = symbol_id").join(drawn.select("symbol_id").distinct(), "symbol_id", "left_anti")  # a block without shapes of its own is one itself
    shapes = drawn.unionByName(own)
    torn = shapes.filter("partial").select("symbol_id").distinct()
    measured = measure_instances(shapes.join(blocks, "symbol_id").join(torn, "symbol_id", "left_anti").select("sheet_id", "symbol_id", F.col("symbol_kind").alias("kind"), "points"))
    sized = materialize(measured.filter("accepted").drop("accepted"), "sized")
    above = members.filter("entity_id <> symbol_id").select(F.col("symbol_id").alias("upper"), F.col("entity_id").alias("symbol_id")).filter("upper < symbol_id")
    ids = sized.select("symbol_id")
    above = materialize(above.join(ids, "symbol_id", "left_semi").join(ids.withColumnRenamed("symbol_id", "upper"), "upper", "left_semi"), "above")
    # from the outside in: a block is decided when all blocks above it are
    out, left = None, ids
    while True:
        waiting = above.join(left.withColumnRenamed("symbol_id", "upper"), "upper", "left_semi").select("symbol_id")
        now = left.join(waiting, "symbol_id", "left_anti")
        free = now if out is None else now.join(above.join(out.withColumnRenamed("symbol_id", "upper"), "upper", "left_semi").select("symbol_id"), "symbol_id", "left_anti")
        taken = materialize(free if out is None else out.unionByName(free), "taken")
        rest = materialize(left.join(now, "symbol_id", "left_anti"), "undecided")
        out, left = taken, rest
        if rest.isEmpty():
            break
    symbols = sized.join(out, "symbol_id", "left_semi")
    return materialize(symbols, "symbols"), materialize(members.join(out, "symbol_id", "left_semi"), "symbol-members")


def layer_symbols(shapes: DataFrame, claimed: DataFrame, roles: DataFrame, cell: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """(symbols, members) of shapes (sheet_id, shape_id, source_id, layer, partial, points) on layers of a kind: those that
    come within ``TOUCH_FT`` of each other, on one layer, are one symbol, if its rectangle has a size of the kind. Sources in
    ``claimed`` (entity_id) take no part. Symbols as of blocks, symbol_id being the least shape; members: symbol_id, source_id."""
    free = shapes.filter(~F.coalesce("partial", F.lit(False)) & (F.size("points") > 1)).join(claimed.select(F.col("entity_id").alias("source_id")).distinct(), "source_id", "left_anti")
    kept = materialize(_with_layer_kind(free, roles).filter("layer_kind is not null").drop("partial"), "layer-shapes")
    n = F.size("points")
    lines = F.zip_with(F.slice("points", F.lit(1), n - 1), F.slice("points", F.lit(2), n - 1), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))
    each = kept.select("sheet_id", "layer", "layer_kind", "shape_id", F.explode(lines).alias("s")).select("sheet_id", "layer", "layer_kind", "shape_id", "s.*")
    cells = each.withColumn("c", F.explode(line_cells(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], F.lit(TOUCH_FT), cell))).select("*", "c.cx", "c.cy").drop("c")
    group = ["sheet_id", "layer", "layer_kind", "cx", "cy"]
    side = lambda p: cells.select(*group, *[F.col(c).alias(f"{p}_{c}") for c in ("shape_id", "x0", "y0", "x1", "y1")])
    met = side("a").join(side("b"), group).filter("a_shape_id < b_shape_id")
    both = F.array(F.struct(*[F.col(f"{p}_{c}") for p in "ab" for c in ("x0", "y0", "x1", "y1")]))
    away = F.transform(both, lambda s: segment_distance(*[s[f"{p}_{c}"] for p in "ab" for c in ("x0", "y0", "x1", "y1")]))[0]  # binds the pair once
    pairs = computed(met, away=away).filter(F.col("away") <= TOUCH_FT + 1e-12).select(F.col("a_shape_id").alias("a"), F.col("b_shape_id").alias("b")).distinct()
    parts = components(pairs).withColumnsRenamed({"id": "shape_id", "component": "symbol_id"})
    grouped = kept.join(parts, "shape_id", "left").withColumn("symbol_id", F.coalesce("symbol_id", "shape_id"))
    measured = measure_instances(grouped.select("sheet_id", "symbol_id", F.col("layer_kind").alias("kind"), "points")).filter("accepted").drop("accepted")
    symbols = materialize(measured, "layer-symbols")
    members = grouped.select("symbol_id", "source_id").distinct().join(symbols.select("symbol_id"), "symbol_id", "left_semi")
    return symbols, members


def arc_doors(arcs: DataFrame, lines: DataFrame, cell: float = 4.0) -> DataFrame:
    """Swing doors from analytic arcs (sheet_id, arc_id, x, y, radius, start_deg, end_deg) and leaves (sheet_id, line_id, x0, y0,
    x1, y1) from the hinge along an end of the arc: sheet_id, arc_id, line_id (the least), and the closed opening from the
    hinge to the end of the arc that the leaf doesn't touch (tx, ty)."""
    sweep = F.pmod(F.col("end_deg") - F.col("start_deg"), F.lit(360))
    quarter = arcs.filter(sweep.between(LEAST_SWEEP, MOST_SWEEP) & F.col("radius").between(LEAST_RADIUS_FT, MOST_RADIUS_FT))
    around = lambda c: F.sequence(F.floor((F.col(c) - HINGE_FT) / cell).cast("long"), F.floor((F.col(c) + HINGE_FT) / cell).cast("long"))
    asked = quarter.withColumn("cx", F.explode(around("x"))).withColumn("cy", F.explode(around("y")))
    ways = F.array(F.struct(F.col("x0").alias("hx"), F.col("y0").alias("hy"), F.col("x1").alias("px"), F.col("y1").alias("py")), F.struct(F.col("x1").alias("hx"), F.col("y1").alias("hy"), F.col("x0").alias("px"), F.col("y0").alias("py")))
    ends = lines.select("sheet_id", "line_id", F.explode(ways).alias("e")).select("sheet_id", "line_id", "e.*").withColumns({"cx": F.floor(F.col("hx") / cell).cast("long"), "cy": F.floor(F.col("hy") / cell).cast("long")})
    d = computed(asked.join(ends, ["sheet_id", "cx", "cy"]), hinge=F.hypot(F.col("hx") - F.col("x"), F.col("hy") - F.col("y")), size=F.hypot(F.col("px") - F.col("hx"), F.col("py") - F.col("hy")), angle=F.degrees(F.atan2(F.col("py") - F.col("y"), F.col("px") - F.col("x"))))
    off = lambda c: F.abs(F.pmod(F.col("angle") - F.col(c) + 180, F.lit(360)) - 180)
    d = d.filter((F.col("hinge") < HINGE_FT) & (F.abs(F.col("size") - F.col("radius")) < LEAF_FT) & (F.least(off("start_deg"), off("end_deg")) <= LEAF_DEG))
    end = lambda f, c: F.round(F.col("x" if f is F.cos else "y") + F.col("radius") * f(F.radians(c)), 6) + 0.0
    far = F.when(off("start_deg") > off("end_deg"), F.col("start_deg")).otherwise(F.col("end_deg"))
    d = d.select("sheet_id", "arc_id", "line_id", "x", "y", end(F.cos, far).alias("tx"), end(F.sin, far).alias("ty"))
    return d.groupBy("sheet_id", "arc_id").agg(F.min_by(F.struct("line_id", "x", "y", "tx", "ty"), "line_id").alias("b")).select("sheet_id", "arc_id", "b.*")
