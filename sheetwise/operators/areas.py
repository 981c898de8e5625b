"""Areas of unions and differences of polygons, clear areas of rooms and footprints of floors, without a clipper.

Polygons are first cut by square tiles, so that everything after works within one tile of one region. There, vertical
lines through all corners and crossings make slabs in which sides don't cross; a running sum over the sides of a slab,
from below, says how often a point between two of them is covered, and the covered trapezoids are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.geometry import clip_convex, computed, ring_area
from sheetwise.runtime import dealt, ship_package

#: Places that differ by less are one line of a sweep.
DIGITS = 10
#: Lengths that count as none, a void's least area, and how far a mitred corner may reach beyond half a thickness.
NO_LENGTH_FT, MOST_MITRE = 1e-9, 5.0
#: Fixed value: rooms below this area are none.
LEAST_ROOM_SQFT = 10.0
_POINT = "struct<x:double,y:double>"
#: Pairs of sides, or of sides and slabs, that are in memory at a time.
AT_ONCE = 1_000_000


def in_tiles(shapes: DataFrame, tile: float) -> DataFrame:
    """``shapes`` with cx, cy and the part of each ring that lies in that tile. A ring that isn't convex may fold along the
    tile's border, where its sides cancel out."""
    of = lambda c: F.transform("ring", lambda p: p[c])
    low, high = ({c: f(of(c)) for c in "xy"} for f in (F.array_min, F.array_max))
    span = lambda c: F.sequence(F.floor(low[c] / tile).cast("long"), F.floor(high[c] / tile).cast("long"))
    d = shapes.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    keep = lambda x, y, dx, dy: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(float(dx)).alias("dx"), F.lit(float(dy)).alias("dy"))
    x, y = F.col("cx") * tile, F.col("cy") * tile
    sides = F.array(keep(x, y, 1, 0), keep(x, y, 0, 1), keep(x + tile, y + tile, -1, 0), keep(x + tile, y + tile, 0, -1))
    d = computed(d.withColumnRenamed("ring", "_whole"), ring=F.aggregate(sides, F.col("_whole").cast(f"array<{_POINT}>"), clip_convex))
    return d.drop("_whole").filter(F.size("ring") > 2)


def covered_area(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the area (to 4 digits) that rings (keys, cx, cy, cut, ring) cover and those with ``cut`` don't. A point is
    covered if a ring winds round it, in whatever sense; a hole is a ring with ``cut``. Rings are in tiles already."""
    group = [*keys, "cx", "cy"]
    d = computed(shapes.select(*group, "cut", "ring"), turn=F.when(ring_area(F.col("ring")) >= 0, 1).otherwise(-1))
    n = F.size("ring")
    side = F.transform("ring", lambda p, i: F.struct(p.alias("p"), F.element_at("ring", (i + 1) % n + 1).alias("q")))
    d = d.select(*group, "cut", "turn", F.explode(side).alias("s")).select(*group, "cut", "turn", "s.p", "s.q")
    d = d.filter(F.round("p.x", DIGITS) != F.round("q.x", DIGITS))
    ahead = F.col("p.x") < F.col("q.x")
    of = lambda a, b, c: F.when(ahead, F.col(f"{a}.{c}")).otherwise(F.col(f"{b}.{c}"))
    # alike sides count together: twins of one place would only repeat its crossings
    sides = d.select(*group, "cut", F.round(of("p", "q", "x"), DIGITS).alias("x0"), of("p", "q", "y").alias("y0"), F.round(of("q", "p", "x"), DIGITS).alias("x1"), of("q", "p", "y").alias("y1"), F.when(ahead, F.col("turn")).otherwise(-F.col("turn")).alias("step"))
    places = [F.col("x0"), F.round("y0", DIGITS).alias("y0"), F.col("x1"), F.round("y1", DIGITS).alias("y1")]
    alike = dealt(sides, *group).groupBy(*group, "cut", *places).agg(F.sum("step").alias("step"))
    tiles = alike.groupBy(*group).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1", F.col("cut").cast("int").alias("cut"), "step")).alias("sides"))  # of one tile, dealt already
    ship_package(shapes.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, lists = batch.columns
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
            flat = np.stack([lists.flatten().field(i).to_numpy(zero_copy_only=False).astype(float) for i in range(6)])
            yield pa.RecordBatch.from_arrays([*kept, pa.array([_swept(flat[:, m:n]) for m, n in zip(ends[:-1], ends[1:])], pa.float64())], [*batch.schema.names[:-1], "area"])

    types = {f.name: f.dataType.simpleString() for f in tiles.schema}
    return tiles.mapInArrow(measure, ", ".join([*[f"{c} {types[c]}" for c in group], "area double"])).groupBy(*keys).agg(F.round(F.sum("area"), 4).alias("area"))


def _rounded(v: np.ndarray) -> np.ndarray:
    return np.where(np.abs(v) < 2.0**53 / 10**DIGITS, np.floor(v * 10.0**DIGITS + 0.5) / 10.0**DIGITS, v)


def _swept(sides: np.ndarray) -> float:
    """The area that the sides of a tile (rows x0, y0, x1, y1, cut, step; x0 < x1) enclose. Crossings and slabs are taken in
    parts, so that memory grows with the sides and not with their square."""
    x0, y0, x1, y1, cut, step = sides[:, np.lexsort((sides[3], sides[2], sides[1], sides[0]))]
    n = len(x0)
    part = max(1, AT_ONCE // n)
    dx, dy, crossings = x1 - x0, y1 - y0, []
    for i in range(0, n, part):
        a = slice(i, i + part)
        px, py, ux, uy = (v[a, None] for v in (x0, y0, dx, dy))
        det = ux * dy - uy * dx
        with np.errstate(all="ignore"):
            s, t = ((x0 - px) * dy - (y0 - py) * dx) / det, ((px - x0) * uy - (py - y0) * ux) / -det
        met = (np.abs(det) > 1e-12) & (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1) & (np.arange(n) > np.arange(n)[a, None])
        crossings.append(np.unique(_rounded((px + s * ux)[met])))
    lines = np.unique(np.concatenate([x0, x1, *crossings]))
    area = 0.0
    for i in range(0, len(lines) - 1, part):
        low, high = lines[:-1][i : i + part], lines[1:][i : i + part]
        slab, side = np.nonzero((x0 <= low[:, None]) & (x1 >= high[:, None]))
        middle = _rounded(y0[side] + dy[side] * ((low + high)[slab] / 2 - x0[side]) / dx[side])
        order = np.lexsort((middle, slab))
        slab, side, middle = slab[order], side[order], middle[order]
        kept, taken = np.cumsum(np.where(cut[side] > 0, 0, step[side])), np.cumsum(np.where(cut[side] > 0, step[side], 0))
        begins = np.searchsorted(slab, slab)  # where each row's slab begins
        base = lambda v: np.where(begins > 0, v[begins - 1], 0.0)
        inside = (kept - base(kept) != 0) & (taken - base(taken) == 0)
        held = inside[:-1] & (slab[1:] == slab[:-1])
        area += float(np.sum(((high - low)[slab[:-1]] * (middle[1:] - middle[:-1]))[held]))
    return area


def _unit(walls: DataFrame) -> DataFrame:
    size = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    d = computed(walls, size=size).filter((F.col("size") > NO_LENGTH_FT) & (F.col("thickness_ft") > 0))
    return d.withColumns({"ux": (F.col("x1") - F.col("x0")) / F.col("size"), "uy": (F.col("y1") - F.col("y0")) / F.col("size"), "half": F.col("thickness_ft") / 2})


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def wall_bodies(walls: DataFrame) -> DataFrame:
    """sheet_id and rings of the bodies of noded walls (sheet_id, wall_id, x0, y0, x1, y1, thickness_ft): a rectangle with flat
    ends for each, and where two walls of one thickness alone meet at a node the corner between their outer faces, mitred
    up to ``MOST_MITRE`` half thicknesses and cut straight beyond. Walls without thickness or length have no body."""
    d = _unit(walls)
    nx, ny = -F.col("uy") * F.col("half"), F.col("ux") * F.col("half")
    box = F.array(_point(F.col("x0") - nx, F.col("y0") - ny), _point(F.col("x1") - nx, F.col("y1") - ny), _point(F.col("x1") + nx, F.col("y1") + ny), _point(F.col("x0") + nx, F.col("y0") + ny))
    leave = lambda x, y, s: F.struct((F.round(x, 9) + 0.0).alias("x"), (F.round(y, 9) + 0.0).alias("y"), (F.col("ux") * s).alias("dx"), (F.col("uy") * s).alias("dy"))
    ends = d.select("sheet_id", F.round("thickness_ft", 9).alias("t"), F.explode(F.array(leave("x0", "y0", 1), leave("x1", "y1", -1))).alias("e")).select("sheet_id", "t", "e.*")
    way = F.struct("dx", "dy")
    node = ends.groupBy("sheet_id", "t", "x", "y").agg(F.count("*").alias("n"), F.min(way).alias("a"), F.max(way).alias("b")).filter("n = 2")
    turn = F.col("a.dx") * F.col("b.dy") - F.col("a.dy") * F.col("b.dx")
    node = computed(node, turn=turn).filter(F.abs(F.col("turn")) > 1e-9)
    # the outer face of each wall lies away from the other; both faces leave the node at half a thickness
    s, half = F.signum("turn"), F.col("t") / 2
    ax, ay = F.col("x") + F.col("a.dy") * s * half, F.col("y") - F.col("a.dx") * s * half
    bx, by = F.col("x") - F.col("b.dy") * s * half, F.col("y") + F.col("b.dx") * s * half
    sx, sy = F.col("a.dx") + F.col("b.dx"), F.col("a.dy") + F.col("b.dy")
    cosine = F.col("a.dx") * F.col("b.dx") + F.col("a.dy") * F.col("b.dy")
    reach = half / F.sqrt((1 - cosine) / 2)  # over the sine of half the angle between the walls
    away = F.hypot(sx, sy)
    tip = _point(F.col("x") - sx / away * reach, F.col("y") - sy / away * reach)
    flat = F.array(_point(F.col("x"), F.col("y")), _point(ax, ay), _point(bx, by))
    corner = F.when(reach <= MOST_MITRE * half, F.concat(F.slice(flat, 1, 2), F.array(tip), F.slice(flat, 3, 1))).otherwise(flat)
    return d.select("sheet_id", box.alias("ring")).unionByName(node.select("sheet_id", corner.alias("ring")))


def clear_areas(cells: DataFrame, walls: DataFrame, voids: DataFrame, least: float = LEAST_ROOM_SQFT, tile: float = 16.0) -> DataFrame:
    """sheet_id, cell_id and the area between wall faces of closed cells (sheet_id, cell_id, ring): a cell without the bodies
    of walls and the voids (sheet_id, ring) of its sheet. Cells with less than ``least`` are left out."""
    own = in_tiles(cells.select("sheet_id", "cell_id", "ring"), tile)
    cuts = in_tiles(wall_bodies(walls).unionByName(voids.select("sheet_id", "ring")), tile)
    met = own.select("sheet_id", "cell_id", "cx", "cy").join(cuts, ["sheet_id", "cx", "cy"])
    shapes = own.withColumn("cut", F.lit(False)).unionByName(met.withColumn("cut", F.lit(True)))
    return covered_area(shapes, ["sheet_id", "cell_id"]).filter(F.col("area") >= least)


def footprint_areas(cells: DataFrame, walls: DataFrame, voids: DataFrame, tile: float = 16.0) -> DataFrame:
    """sheet_id and the area of each sheet's footprint: closed cells with the bodies of the walls on or in them, without the
    voids. A noded wall is on or in a cell if its middle is; dangling walls add nothing."""
    middle = walls.withColumns({"mx": (F.col("x0") + F.col("x1")) / 2, "my": (F.col("y0") + F.col("y1")) / 2})
    own = in_tiles(cells.select("sheet_id", "cell_id", "ring"), tile)
    near = [F.floor(F.col("mx") / tile), F.floor(F.col("my") / tile)]
    edge = [F.ceil(F.col("mx") / tile) - 1, F.ceil(F.col("my") / tile) - 1]  # a middle on a tile's border
    place = F.explode(F.array_distinct(F.array(*[F.struct(a.cast("long").alias("cx"), b.cast("long").alias("cy")) for a in (near[0], edge[0]) for b in (near[1], edge[1])]))).alias("c")
    asked = middle.select("sheet_id", "wall_id", "mx", "my", place).select("sheet_id", "wall_id", "mx", "my", "c.cx", "c.cy")
    n = F.size("ring")
    sides = F.transform("ring", lambda p, i: F.struct(p.alias("p"), F.element_at("ring", (i + 1) % n + 1).alias("q")))
    passes = lambda e: ((e["p"]["y"] > F.col("my")) != (e["q"]["y"] > F.col("my"))) & (F.col("mx") < e["p"]["x"] + (e["q"]["x"] - e["p"]["x"]) * (F.col("my") - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"]))
    within = F.size(F.filter(sides, passes)) % 2 == 1
    turn = lambda e: (e["q"]["x"] - e["p"]["x"]) * (F.col("my") - e["p"]["y"]) - (e["q"]["y"] - e["p"]["y"]) * (F.col("mx") - e["p"]["x"])
    between = lambda e, c, m: F.col(m).between(F.least(e["p"][c], e["q"][c]) - 1e-7, F.greatest(e["p"][c], e["q"][c]) + 1e-7)
    on = F.exists(sides, lambda e: between(e, "x", "mx") & between(e, "y", "my") & (F.abs(turn(e)) <= 1e-7 * F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"])))
    held = asked.join(own, ["sheet_id", "cx", "cy"]).filter(within | on).select("sheet_id", "wall_id").distinct()
    bodies = in_tiles(wall_bodies(walls.join(held, ["sheet_id", "wall_id"], "left_semi")), tile)
    kept = own.select("sheet_id", "cx", "cy", "ring").unionByName(bodies.select("sheet_id", "cx", "cy", "ring")).withColumn("cut", F.lit(False))
    cuts = in_tiles(voids.select("sheet_id", "ring"), tile).select("sheet_id", "cx", "cy", "ring").withColumn("cut", F.lit(True))
    return covered_area(kept.unionByName(cuts), ["sheet_id"])
