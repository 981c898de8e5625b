"""Walls on profiles, boxes that meet and library templates on small scenes."""

import math
import random

import pytest

from sheetwise.operators import boxes, library, profiles

WALL = "sheet_id long, wall_id long, x0 double, y0 double, x1 double, y1 double, thickness_ft double"
PROFILE = "sheet_id long, profile_id long, rings array<array<struct<x:double,y:double>>>"
OPENING = "sheet_id long, opening_id long, x0 double, y0 double, x1 double, y1 double"
PART = "sheet_id long, part_id long, source_id long, layer string, category string, points array<struct<x:double,y:double>>"
TEMPLATE = "template_id long, kind string, size_min double, size_max double, angles array<double>, mirror boolean"
PATH = "template_id long, path_no long, category string, points array<struct<x:double,y:double>>"


def box(u0, v0, u1, v1):
    return [(u0, v0), (u1, v0), (u1, v1), (u0, v1)]


def turned(x, y, a):
    return x * math.cos(a) - y * math.sin(a) + 7, x * math.sin(a) + y * math.cos(a) - 3


def test_boxes_meet_once_at_any_size(spark):
    rng = random.Random(5)

    def some(n):
        out = [(1 + i % 2, i, x, y, x + rng.choice([0, 0.01, 1, 30, 900]), y + rng.choice([0, 0.01, 1, 30, 900])) for i in range(n) for x, y in [(rng.uniform(-500, 500), rng.uniform(-500, 500))]]
        return [*out, (1, n, 0.0, 0.0, 16.0, 16.0), (1, n + 1, 16.0, 16.0, 32.0, 16.0)]

    one, other = some(120), some(120)
    columns = lambda p: f"sheet_id long, {p}id long, " + ", ".join(f"{p}{c} double" for c in ("x0", "y0", "x1", "y1"))
    extra = [(1, 900, None, 0.0, 1.0, 1.0), (1, 901, 0.0, 0.0, float("inf"), 1.0), (None, 902, 0.0, 0.0, 1.0, 1.0)]
    got = boxes.meeting_boxes(spark.createDataFrame([*one, *extra], columns("a")), spark.createDataFrame(other, columns("b"))).select("aid", "bid").collect()
    want = {(a[1], b[1]) for a in one for b in other if a[0] == b[0] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("angle", [0.0, math.atan2(3, 4), 2.5])
def test_walls_split_at_profiles(spark, angle):
    at = lambda ring: [turned(*p, angle) for p in ring]
    walls = [(1, i, *turned(0, 40 * i, angle), *turned(12, 40 * i, angle), 1.0) for i in range(6)]
    rings = {
        (0, 1): [box(4, -2, 8, 2)], (1, 2): [box(-1, 38, 13, 42), box(5, 39, 7, 41)], (2, 3): [box(3, 79.4, 9, 80.7)], (2, 4): [box(10, 80.5, 11, 83)],
        (3, 5): [box(6, 119.9, 10, 122)], (4, 6): [[(3, 158), (7, 160), (3, 162)]],
    }
    openings = [(1, 1, *turned(3.5, 0, angle), *turned(7, 0, angle)), (1, 2, *turned(11, 0, angle), *turned(9, 0, angle)), (1, 3, *turned(9, 120, angle), *turned(7, 120, angle)), (1, 4, *turned(2, 160, angle), *turned(4, 160, angle)), (1, 5, *turned(7.5, 0, angle), *turned(8.125, 0, angle))]
    pieces, fates = profiles.fit_to_profiles(
        spark.createDataFrame([*walls, (1, 90, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 91, None, 0.0, 1.0, 0.0, 1.0)], WALL),
        spark.createDataFrame([*[(1, p, [at(r) for r in rs]) for (_, p), rs in rings.items()], (1, 98, []), (1, 99, None)], PROFILE),
        spark.createDataFrame([*openings, (1, 9, None, None, None, None)], OPENING),
    )

    def local(r):
        out = []
        for x, y in ((r.x0, r.y0), (r.x1, r.y1)):
            x, y = x - 7, y + 3
            out += [round(x * math.cos(angle) + y * math.sin(angle), 6), round(y * math.cos(angle) - x * math.sin(angle), 6) + 0.0]
        return tuple(out)

    got = sorted((r.wall_id, r.verdict, r.profile_id or 0, *local(r), round(r.thickness_ft, 6)) for r in pieces.collect() if r.wall_id < 90)
    assert got == sorted([
        (0, "free", 0, 0, 0, 4, 0, 1), (0, "hosted", 1, 4, 0, 8, 0, 1), (0, "free", 0, 8, 0, 12, 0, 1),
        (1, "free", 0, 5, 40, 7, 40, 1), (1, "hosted", 2, 0, 40, 5, 40, 1), (1, "hosted", 2, 7, 40, 12, 40, 1),
        (2, "free", 0, 0, 80, 3, 80, 1), (2, "free", 0, 9, 80, 12, 80, 1), (2, "hosted", 3, 3, 80, 9, 80, 1),
        (3, "free", 0, 0, 120, 6, 120, 1), (3, "free", 0, 10, 120, 12, 120, 1), (3, "hosted", 5, 6, 120.2, 10, 120.2, 0.6), (3, "free", 0, 6, 119.7, 10, 119.7, 0.4),
        (4, "ragged", 0, 0, 160, 12, 160, 1), (5, "clear", 0, 0, 200, 12, 200, 1),
    ])
    assert {r.wall_id: r.verdict for r in pieces.collect() if r.wall_id >= 90} == {90: "clear", 91: "clear"}
    told = {r.opening_id: (r.wall_id, r.verdict, local(r) if r.x0 is not None else None) for r in fates.collect()}
    assert told == {1: (0, "narrowed", (4, 0, 7, 0)), 2: (0, "kept", (11, 0, 9, 0)), 3: (3, "narrowed", (9, 119.7, 7, 119.7)), 4: (None, "kept", (2, 160, 4, 160)), 5: (0, "narrowed", (7.5, 0, 8, 0)), 9: (None, "kept", None)}


def test_profiles_of_nothing(spark):
    none = [spark.createDataFrame([], s) for s in (WALL, PROFILE, OPENING)]
    pieces, fates = profiles.fit_to_profiles(*none)
    assert pieces.count() == 0 and fates.count() == 0
    pieces, fates = profiles.fit_to_profiles(spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0, 0.0, 0.5)], WALL), *none[1:])
    assert [(r.wall_id, r.verdict) for r in pieces.collect()] == [(1, "clear")]


L, BAR = [(0.0, 0.0), (1.0, 0.0), (1.0, 0.5)], [(0.0, 0.25), (0.0, 0.75)]


def scene(at, size, angle=0, mirrored=False, first=0, source=None, extra=()):
    """The parts of an L and a bar at a place."""
    place = lambda p: turned((-p[0] if mirrored else p[0]) * size, p[1] * size, math.radians(angle))
    moved = lambda line: [(x + at[0], y + at[1]) for x, y in map(place, line)]
    return [(1, first + n, source if source is not None else first, "F", "path", moved(line)) for n, line in enumerate([L, BAR, *extra])]


def match(spark, parts, mirror=True, angles=(0.0, 45.0, 90.0, 135.0), budget=5000, also=()):
    templates = spark.createDataFrame([(1, "sofa", 2.0, 6.0, list(angles), mirror), *also], TEMPLATE)
    paths = spark.createDataFrame([(1, 0, "path", L), (1, 1, "path", BAR), *[(t[0], n, "path", p) for t in also for n, p in enumerate([L, BAR])]], PATH)
    out = library.match_library(spark.createDataFrame(parts, PART), templates, paths, budget).collect()
    return sorted((r.template_id, r.verdict, tuple(r.sources or ()), r.angle, r.mirrored, r.scale and round(r.scale, 6), r.n) for r in out)


def test_library_at_scales(spark):
    good = [*scene((0, 0), 3, first=10), *scene((50, 0), 4.5, 45, True, 20), *scene((100, 0), 2.5, 90, False, 30)]
    bad = [*scene((0, 50), 3, 30, first=40), *scene((50, 50), 9, first=50), *scene((100, 50), 3, first=60, extra=[[(0, 1), (1, 1), (1, 2)]]), *scene((0, 100), 3, first=70)[:1], (1, 80, 80, "F", "path", None), (1, 81, 81, "F", None, [(0.0, 0.0), (1.0, 1.0)]), (1, 82, 82, "F", "path", [(5.0, 5.0), (5.0, 5.0)])]
    got = match(spark, [*good, *bad])
    assert [g for g in got if g[1] != "out_of_range"] == [(1, "found", (10,), 0.0, False, 3.0, 2), (1, "found", (20,), 45.0, True, 4.5, 2), (1, "found", (30,), 90.0, False, 2.5, 2)]
    assert [g[6] for g in got if g[1] == "out_of_range"] == [1]  # the bar is rarest, and one is too large


def test_library_budgets_and_claims(spark):
    parts = [*scene((0, 0), 3, first=10), *scene((50, 0), 4.5, 45, True, 20), *scene((100, 0), 2.5, 90, False, 30)]
    assert [g[1:5] for g in match(spark, parts, budget=8)] == [("found", (10,), 0.0, False), ("reduced", (), None, None)]
    assert match(spark, parts, budget=2) == [(1, "skipped", (), None, None, None, 3)]
    # bars far from any L aren't possible anchors, and so cost nothing
    strays = [(1, 500 + i, 500 + i, "F", "path", [(300.0 + 30 * i, 0.0), (301.5 + 30 * i, 0.0)]) for i in range(3)]
    assert [g[1] for g in match(spark, [*parts, *strays], budget=24)] == ["found"] * 3
    # the same strokes claimed by two templates count once, for the first; two Ls on one bar share it
    assert [g[:2] for g in match(spark, parts, also=[(2, "bed", 2.0, 6.0, [0.0], False)])] == [(1, "found")] * 3
    twin = (1, 15, 15, "F", "path", parts[0][5])
    split = [(s, p, p, *rest) for s, p, _, *rest in parts[:2]]
    assert match(spark, [*split, twin]) == [(1, "found", (10, 11), 0.0, False, 3.0, 2)]
    assert match(spark, []) == []
