"""Opening hosts, runs, residues, instance sizes and areas on small scenes, some of them turned."""

import math

import pytest
from pyspark.sql import functions as F

from sheetwise.functions.geometry import convex_hull, minimum_rectangle
from sheetwise.operators import areas, blocks, graph, healing, openings, runs

RING = "array<struct<x:double,y:double>>"
# two flanks with a gap and their twins a foot above; a square wall at the far end of a third flank; one long wall
WALLS = [(1, 0, 0, 4, 0), (2, 7, 0, 11, 0), (3, 20, 0, 24, 0), (4, 20, 1, 24, 1), (5, 27, 0, 31, 0), (6, 27, 1, 31, 1), (7, 40, 0, 44, 0), (8, 46.5, -3, 46.5, 3), (9, 60, 0, 80, 0), (10, 70, 0, 70, 5)]
MARKS = [
    (1, "door", True, [(4.25, 0.1), (6.75, 0.1)]), (2, "door", True, [(4.5, 0), (6.5, 0)]), (3, "door", False, [(24.25, 0.25), (26.75, 0.25), (26.75, 0.75), (24.25, 0.75)]), (4, "door", True, [(44.25, 0), (46.25, 0)]),
    (5, "window", False, [(62, -0.1), (65, -0.1), (65, 0.1), (62, 0.1)]), (6, "window", False, [(68, -0.1), (72, -0.1), (72, 0.1), (68, 0.1)]), (7, "door", False, [(75, -0.1), (78, -0.1), (78, 2), (75, 2)]),
    (8, "column", False, [(1, 1)]), (9, "door", False, None), (10, "window", False, []), (11, "door", True, [(100, 100), (103, 100)]),
]
VERDICTS = {1: ("open", None, True), 2: ("unhosted", None, False), 3: ("tie", None, False), 4: ("open", None, True), 5: ("open", 9, False), 6: ("unhosted", None, False), 7: ("unhosted", None, False), 11: ("unhosted", None, False)}


def turned(x, y, a):
    return x * math.cos(a) - y * math.sin(a) + 3, x * math.sin(a) + y * math.cos(a) - 2


@pytest.mark.parametrize("angle", [0.0, math.atan2(3, 4)])
def test_hosts_in_any_direction(spark, angle):
    walls = [(1, i, *turned(a, b, angle), *turned(c, d, angle), 0.5, "A") for i, a, b, c, d in WALLS]
    marks = [(1, i, kind, None if ring is None else [turned(*p, angle) for p in ring], local, i == 12) for i, kind, local, ring in [*MARKS, (12, *MARKS[0][1:])]]
    walls = spark.createDataFrame(walls, "sheet_id long, wall_id long, x0 double, y0 double, x1 double, y1 double, thickness_ft double, layer string")
    judged, hosts = openings.host_openings(walls, spark.createDataFrame(marks, f"sheet_id long, symbol_id long, kind string, ring {RING}, localized boolean, ambiguous boolean"), 9.0)
    got = {r.symbol_id: (r.verdict, r.wall_id, r.new_host) for r in judged.collect()}
    assert got == VERDICTS | {12: ("skipped", None, False)}
    ends = {r.host_id: ((r.x0, r.y0), (r.x1, r.y1)) for r in hosts.collect()}
    assert ends.keys() == {1, 4}
    for p, q in zip(ends[1], (turned(4, 0, angle), turned(7, 0, angle))):
        assert p == pytest.approx(q, abs=1e-6)


def test_hosts_of_nothing(spark):
    walls = spark.createDataFrame([], "sheet_id long, wall_id long, x0 double, y0 double, x1 double, y1 double, thickness_ft double, layer string")
    none = spark.createDataFrame([], f"sheet_id long, symbol_id long, kind string, ring {RING}, localized boolean, ambiguous boolean")
    judged, hosts = openings.host_openings(walls, none, 9.0)
    assert judged.count() == 0 and hosts.count() == 0
    with pytest.raises(ValueError):
        openings.host_openings(walls, none, 0)


def test_lines_walk_their_cells(spark):
    lines = [(0.0, 0.0, 100.0, 100.0), (5.0, 5.0, 5.0, 95.0), (-20.0, 3.0, 40.0, 3.0), (1.0, 99.0, 60.0, 2.0), (3.0, 3.0, 3.0, 3.0)]
    d = spark.createDataFrame(lines, "x0 double, y0 double, x1 double, y1 double")
    for r in d.withColumn("c", openings.line_cells(*[F.col(c) for c in d.columns], F.lit(0.0), 10.0)).collect():
        cells = [(c.cx, c.cy) for c in r.c]
        assert len(set(cells)) == len(cells) <= 25
        for k in range(1001):
            x, y = r.x0 + (r.x1 - r.x0) * k / 1000, r.y0 + (r.y1 - r.y0) * k / 1000
            assert (math.floor(x / 10), math.floor(y / 10)) in cells


def test_lists(spark):
    links = [(k, None if k % 100 == 0 else k - 1) for k in range(250)]
    got = {r.id: (r["head"], r.place) for r in graph.list_places(spark.createDataFrame(links, "id long, prev long")).collect()}
    assert got == {k: (k - k % 100, k % 100) for k in range(250)}
    for bad in ([(1, 2), (2, 3), (3, 1)], [(1, None), (2, 1), (3, 1)], [(1, None), (1, 2), (2, None)]):
        with pytest.raises(ValueError):
            graph.list_places(spark.createDataFrame(bad, "id long, prev long"))


PIECES = "sheet_id long, wall_id long, x0 double, y0 double, x1 double, y1 double, thickness_ft double, layer string, height_ft double, wall_class string"


def test_joints_in_a_turned_frame(spark):
    a = math.atan2(3, 4)
    plan = [(1, 0, 0, 5, 0, 0.5), (2, 10, 0, 5, 0, 0.5), (3, 5, 0, 5, 5, 0.5), (4, 10, 0, 10, 6, 0.5), (5, 10, 6, 15, 6, 0.5), (6, 10, 6, 10, 12, 0.5), (7, 5, 6, 10, 6, 0.75), (8, 10, 0, 10, 0, 0.5)]
    rows = [(1, i, *[round(v, 9) for v in (*turned(b, c, a), *turned(d, e, a))], t, "A", None, None) for i, b, c, d, e, t in plan]
    members, joints, connections = runs.build_runs(spark.createDataFrame(rows, PIECES))
    got = {r.wall_id: (r.run_id, r.place, r.n_walls) for r in members.collect()}
    assert {i: got[i][0] for i in got} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7} and {got[1][1], got[2][1]} == {0, 1}
    assert sorted(r.kind for r in joints.collect()) == ["L", "T", "tangle"]
    assert {(r.relating, r.related, r.related_type) for r in connections.collect()} == {(3, 1, "path"), (1, 4, "end")}  # the line of 4 and 6 is longer
    outline = {r.run_id: r.ring for r in runs.run_outlines(members, connections).collect()}
    area = lambda ring: abs(sum(p.x * q.y - q.x * p.y for p, q in zip(ring, ring[1:] + ring[:1]))) / 2
    assert area(outline[1]) == pytest.approx(9.75 * 0.5) and area(outline[3]) == pytest.approx(4.75 * 0.5) and area(outline[4]) == pytest.approx(6.25 * 0.5)


def test_a_wall_that_goes_on_twice(spark):
    rows = [(1, 1, 0.0, 0.0, 5.0, 0.0), (1, 2, 5.0, 0.0, 9.0, 0.0), (1, 3, 5.0, 0.0, 12.0, 0.0)]
    with pytest.raises(ValueError):
        runs.build_runs(spark.createDataFrame([(*r, 0.5, "A", None, None) for r in rows], PIECES))


def test_residue(spark):
    schema = "sheet_id long, wall_id long, x0 double, y0 double, x1 double, y1 double, thickness_ft double, layer string, host boolean, source_ids array<long>"
    rows = [(1, 1, 0.0, 0.0, 5e-5, 0.0), (1, 2, -4.0, 0.0, 0.0, 0.0), (1, 3, 0.0, 0.0, 0.0, 4.0), (1, 4, 5e-5, 0.0, 0.0, 4.0), (1, 5, 7.0, 7.0, 7.0, 7.0), (1, 6, 9.0, 9.0, 8.0, 9.0)]
    now, moved = healing.contract_residue(spark.createDataFrame([(*r, 0.5, "A", False, [r[1]]) for r in rows], schema))
    assert sorted((r.wall_id, r.x0, r.y0, r.x1, r.y1, r.source_ids) for r in now.collect()) == [(2, -4.0, 0.0, 0.0, 0.0, [2]), (3, 0.0, 0.0, 0.0, 4.0, [3, 4]), (6, 8.0, 9.0, 9.0, 9.0, [6])]
    assert [(r.wall_id, r.fx, r.tx) for r in moved.collect()] == [(4, 5e-5, 0.0)]
    now, moved = healing.contract_residue(now.limit(0))
    assert now.count() == moved.count() == 0


def test_hull_and_rectangle(spark):
    a = math.atan2(3, 4)
    sets = [[turned(x, y, a) for x, y in [(0, 0), (6, 0), (6, 2), (0, 2), (3, 1), (1, 1.5), (6, 0)]], [(1.0, 1.0)] * 3, [(0.0, 0.0), (2.0, 2.0), (1.0, 1.0)], []]
    d = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], f"k long, points {RING}").withColumn("hull", convex_hull(F.col("points")))
    got = {r.k: r for r in d.withColumn("r", minimum_rectangle(F.col("hull"))).collect()}
    assert [len(got[k].hull) for k in range(4)] == [4, 1, 2, 0]
    assert (got[0].r.width, got[0].r.depth) == pytest.approx((6, 2)) and got[0].r.angle == pytest.approx(a) and (got[0].r.x, got[0].r.y) == pytest.approx(turned(3, 1, a), abs=1e-6)
    assert got[1].r.width == 0 and (got[2].r.width, got[2].r.depth) == pytest.approx((math.sqrt(8), 0)) and got[2].r.angle == pytest.approx(math.pi / 4) and got[3].r is None


def test_areas_of_unions(spark):
    square = [(0.0, 0.0), (20.0, 0.0), (20.0, 20.0), (0.0, 20.0)]
    diamond = [(10 + 10 * math.sqrt(2) * math.cos(k * math.pi / 2), 10 + 10 * math.sqrt(2) * math.sin(k * math.pi / 2)) for k in range(4)]
    star = [((7 if k % 2 else 18) * math.cos(k * math.pi / 5) + 40, (7 if k % 2 else 18) * math.sin(k * math.pi / 5) - 40) for k in range(10)]
    hole = [(2.0, 2.0), (2.0, 5.5), (7.25, 5.5), (7.25, 2.0)]
    shapes = [(1, False, square), (1, False, diamond), (2, False, star[::-1]), (3, False, square), (3, True, hole), (3, False, square), (4, True, hole), (5, False, hole), (5, True, square)]
    d = areas.in_tiles(spark.createDataFrame(shapes, f"g long, cut boolean, ring {RING}"), 7.0)
    got = {r.g: r.area for r in areas.covered_area(d, ["g"]).collect()}
    octagon = 400 + 4 * (10 * math.sqrt(2) - 10) ** 2  # four tips of the diamond stand out
    assert got[1] == pytest.approx(octagon, abs=1e-3)
    assert got[2] == pytest.approx(abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(star, star[1:] + star[:1]))) / 2, abs=1e-3)
    assert got[3] == pytest.approx(400 - 3.5 * 5.25, abs=1e-3) and got[4] == 0 and got[5] == 0


def parts_of(edges):
    """Biconnected parts by brute force: two edges belong together if no node's removal parts them, closed over edges."""
    edges = sorted({(min(e), max(e)) for e in edges if e[0] != e[1]})

    def together(e, f):
        shared = set(e) & set(f)
        if len(shared) != 1:
            return False
        cut, (a,), (b,) = shared.copy(), set(e) - shared, set(f) - shared
        seen, todo = {a}, [a]
        while todo:
            at = todo.pop()
            for g in edges:
                if at in g and not cut & set(g):
                    for n in set(g) - seen:
                        seen.add(n)
                        todo.append(n)
        return b in seen

    left, out = set(edges), []
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            e = todo.pop()
            part.add(e)
            for f in [f for f in left if together(e, f)]:
                left.discard(f)
                todo.append(f)
        out.append(tuple(sorted({n for e in part for n in e})))
    return sorted(out)


def test_biconnected_parts(spark):
    import random

    rng = random.Random(5)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(44)] + [(100, 101), (101, 102), (102, 100), (102, 103), (103, 103), (101, 100)]
    found = {}
    for r in blocks.biconnected(spark.createDataFrame(edges, "a long, b long")).collect():
        found.setdefault(r.block, []).append(r.node)
    assert sorted(tuple(sorted(v)) for v in found.values()) == parts_of(edges)
