"""Plane geometry as column expressions; points are (x, y) columns, rings arrays of struct<x, y>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(d: DataFrame, /, **columns: Column) -> DataFrame:
    """``d`` with ``columns``, each computed once: a generator stands between them and what uses them, so that filters and
    later projections don't repeat long expressions."""
    return d.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def param_on(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where on the segment a-b (0 to 1, unclamped) a point's foot lies; 0 on a segment without length."""
    dx, dy = bx - ax, by - ay
    return F.when(dx * dx + dy * dy > 0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy)).otherwise(0.0)


def distance_to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), param_on(px, py, ax, ay, bx, by)))
    return F.hypot(px - (ax + (bx - ax) * t), py - (ay + (by - ay) * t))


def direction(dx: Column, dy: Column) -> Column:
    """The unit vector struct<x, y>, never with a negative zero; (0, 0) for no length."""
    size = F.hypot(dx, dy)
    part = lambda v: F.when(size < 1e-12, 0.0).otherwise(v / size + 0.0)
    return F.struct(part(dx).alias("x"), part(dy).alias("y"))


def cross_param(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Where on a-b the line through c-d meets it; null for parallel lines."""
    det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    return F.when(F.abs(det) > 1e-12, ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det)


def ring_area(ring: Column) -> Column:
    """Signed area by the shoelace formula; the ring needn't repeat its first point."""
    n = F.size(ring)
    terms = F.transform(ring, lambda p, i: p["x"] * F.element_at(ring, (i + 1) % n + 1)["y"] - F.element_at(ring, (i + 1) % n + 1)["x"] * p["y"])
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / 2


def canonical_ring(ring: Column) -> Column:
    """The least of all rotations of a ring and of its reverse, coordinates rounded to 9 digits."""
    exact = F.transform(ring, lambda p: F.struct((F.round(p["x"], 9) + 0.0).alias("x"), (F.round(p["y"], 9) + 0.0).alias("y")))
    rotations = lambda r: F.transform(r, lambda _, i: F.concat(F.slice(r, i + 1, F.size(r) - i), F.slice(r, 1, i)))
    return F.array_min(F.concat(rotations(exact), rotations(F.reverse(exact))))


def segments_of(points: Column, closed: Column) -> Column:
    """Neighbouring points in pairs struct<a, b>; a closed line also joins its last to its first where they differ."""
    n = F.size(points)
    pairs = F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    last = F.array(F.struct(F.try_element_at(points, F.lit(-1)).alias("a"), F.try_element_at(points, F.lit(1)).alias("b")))
    return F.when(n < 2, F.slice(pairs, 1, 0)).when(closed & (F.try_element_at(points, F.lit(-1)) != F.try_element_at(points, F.lit(1))), F.concat(pairs, last)).otherwise(pairs)


def normalised(points: Column) -> Column:
    """A shape centred on its box with the larger side 1; its orientation stays."""
    of = lambda f, c: f(F.transform(points, lambda p: p[c]))
    lo = {c: of(F.array_min, c) for c in "xy"}
    hi = {c: of(F.array_max, c) for c in "xy"}
    side = F.greatest(hi["x"] - lo["x"], hi["y"] - lo["y"])
    size = F.when(side > 0, side).otherwise(1.0)
    at = lambda p, c: F.round((p[c] - (lo[c] + hi[c]) / 2) / size, 9) + 0.0
    return F.transform(points, lambda p: F.struct(at(p, "x").alias("x"), at(p, "y").alias("y")))


def segment_distance(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Distance of the segments a-b and c-d; 0 where they cross or touch."""
    s, t = cross_param(ax, ay, bx, by, cx, cy, dx, dy), cross_param(cx, cy, dx, dy, ax, ay, bx, by)
    apart = F.least(
        distance_to_segment(ax, ay, cx, cy, dx, dy), distance_to_segment(bx, by, cx, cy, dx, dy), distance_to_segment(cx, cy, ax, ay, bx, by), distance_to_segment(dx, dy, ax, ay, bx, by)
    )
    return F.when(s.between(0, 1) & t.between(0, 1), 0.0).otherwise(apart)


def clip_convex(ring: Column, keep: Column) -> Column:
    """What of a convex ring lies on the kept side of a line: ``keep`` has a point of the line (x, y) and the direction kept
    (dx, dy). Each side gives its first point if that is kept, and the point where it crosses the line."""
    n = F.size(ring)
    depth = lambda p: (p["x"] - keep["x"]) * keep["dx"] + (p["y"] - keep["y"]) * keep["dy"]
    none = F.slice(ring, 1, 0)

    def side(p: Column, i: Column) -> Column:
        q = F.element_at(ring, (i + 1) % n + 1)
        a, b = depth(p), depth(q)
        t = a / (a - b)
        cut = F.struct((p["x"] + (q["x"] - p["x"]) * t).alias("x"), (p["y"] + (q["y"] - p["y"]) * t).alias("y"))
        return F.concat(F.when(a >= 0, F.array(p)).otherwise(none), F.when(((a > 0) & (b < 0)) | ((a < 0) & (b > 0)), F.array(cut)).otherwise(none))

    return F.flatten(F.transform(ring, side))


def convex_hull(points: Column) -> Column:
    """The corners of the convex hull of an array of struct<x, y>, counter-clockwise from the least point. Points on a line
    give its two ends, equal points one. A fold keeps the longest front of the hull that turns left to each new point."""
    sorted_points = F.array_sort(F.array_distinct(points))

    def half(of: Column) -> Column:
        def add(h: Column, p: Column) -> Column:
            def turns(m: Column) -> Column:
                a, b = F.element_at(h, F.greatest(m - 1, F.lit(1))), F.element_at(h, m)
                return (m == 1) | ((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]) > 0)

            longest = F.array_max(F.filter(F.sequence(F.lit(1), F.size(h)), turns))
            return F.when(F.size(h) == 0, F.array(p)).otherwise(F.concat(F.slice(h, F.lit(1), longest), F.array(p)))

        return F.aggregate(of, F.slice(of, 1, 0), add)

    # a transform over one element binds the sorted points once
    both = lambda s: F.concat(*[F.slice(h, F.lit(1), F.size(h) - 1) for h in (half(s), half(F.reverse(s)))])
    return F.element_at(F.transform(F.array(sorted_points), lambda s: F.when(F.size(s) < 2, s).otherwise(both(s))), 1)


def minimum_rectangle(hull: Column) -> Column:
    """The rectangle of least area round a convex hull, as struct<width, depth, angle, x, y>: the longer side, the other, the
    longer one's direction in radians (0 up to pi, of a square below pi/2) and the middle. Every side of the hull is tried as a direction; of equal
    areas the least angle counts. A line has depth 0, a point no width; null for no points."""
    n = F.size(hull)
    span = lambda ux, uy: (F.array_min(F.transform(hull, lambda p: p["x"] * ux + p["y"] * uy)), F.array_max(F.transform(hull, lambda p: p["x"] * ux + p["y"] * uy)))

    def measured(u: Column) -> Column:
        (l0, l1), (a0, a1) = span(u["x"], u["y"]), span(-u["y"], u["x"])
        return F.struct(u["x"].alias("ux"), u["y"].alias("uy"), l0.alias("l0"), l1.alias("l1"), a0.alias("a0"), a1.alias("a1"))

    def rectangle(m: Column) -> Column:
        along, across = m["l1"] - m["l0"], m["a1"] - m["a0"]
        long = along >= across
        angle = F.round(F.pmod(F.atan2(F.when(long, m["uy"]).otherwise(m["ux"]), F.when(long, m["ux"]).otherwise(-m["uy"])), F.lit(3.141592653589793)), 9)
        middle = lambda a, b: F.round(((m["l0"] + m["l1"]) * a + (m["a0"] + m["a1"]) * b) / 2, 6) + 0.0
        return F.struct(
            F.round(along * across, 6).alias("area"), F.when(angle >= 3.141592653, 0.0).otherwise(F.when(F.abs(along - across) < 1e-9, F.round(F.pmod(angle, F.lit(1.570796326)), 6)).otherwise(angle)).alias("angle"), F.round(F.greatest(along, across), 9).alias("width"),
            F.round(F.least(along, across), 9).alias("depth"), middle(m["ux"], -m["uy"]).alias("x"), middle(m["uy"], m["ux"]).alias("y"),
        )

    def side(p: Column, i: Column) -> Column:
        q = F.element_at(hull, (i + 1) % n + 1)
        return direction(q["x"] - p["x"], q["y"] - p["y"])

    best = F.array_min(F.transform(F.transform(F.transform(hull, side), measured), rectangle))
    alone = F.element_at(hull, 1)
    point = F.struct(F.lit(0.0).alias("width"), F.lit(0.0).alias("depth"), F.lit(0.0).alias("angle"), (F.round(alone["x"], 6) + 0.0).alias("x"), (F.round(alone["y"], 6) + 0.0).alias("y"))
    return F.when(n > 1, F.struct(best["width"].alias("width"), best["depth"].alias("depth"), best["angle"].alias("angle"), best["x"].alias("x"), best["y"].alias("y"))).when(n == 1, point)
