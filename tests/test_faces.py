import random

import pytest

from sheetwise.operators import faces

EDGES = "sheet_id long, edge_id long, ax double, ay double, bx double, by double"


def grid(columns, rows, width=10.0, height=8.0):
    """Unit edges of a grid of cells."""
    out = []
    for i in range(columns + 1):
        for j in range(rows + 1):
            x, y = i * width, j * height
            out += [(x, y, x + width, y)] if i < columns else []
            out += [(x, y, x, y + height)] if j < rows else []
    return out


def table(spark, *sheets):
    rows = [(s, s * 1000 + k, *map(float, e)) for s, edges in enumerate(sheets) for k, e in enumerate(edges)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, EDGES)


def test_faces_of_a_grid_with_a_diagonal_and_dangles(spark):
    first = [*grid(3, 2), (0, 0, 10, 8), (30, 16, 35, 16), (35, 16, 36, 17)]
    got = faces.polygonise(table(spark, first, grid(1, 1), [(0, 0, 5, 0)]))
    assert sorted((r.sheet_id, r.area) for r in got.collect()) == [(0, 40.0)] * 2 + [(0, 80.0)] * 5 + [(1, 80.0)]


def test_loops_and_closure(spark):
    triangle, tail = [(0, 0, 4, 0), (4, 0, 4, 3), (4, 3, 0, 0)], [(4, 0, 9, 0)]
    big = [(9, 0, 29, 0), (29, 0, 29, 12), (29, 12, 9, 12), (9, 12, 9, 0)]
    got = {r.edge_id: r.closure for r in faces.closure_signal(table(spark, triangle + tail + big)).collect()}
    assert got == {0: -1, 1: -1, 2: -1, 3: 0, 4: 1, 5: 1, 6: 1, 7: 1}


def test_ends_cluster_by_complete_link(spark):
    rows = [(0, k, k, 0.07 * k, 0.0) for k in range(4)] + [(0, 10, 10, 5.0, 5.0), (0, 11, 10, 5.01, 5.0)]
    got = {r.end_id: (r.cluster, r.cx) for r in faces.cluster_ends(spark.createDataFrame(rows, "sheet_id long, end_id long, wall_id long, x double, y double"), 1 / 12).collect()}
    assert got[0] == got[1] == (0, 0.035) and got[2] == got[3] == (2, 0.175)
    assert got[10][0] != got[11][0]  # ends of one wall


def test_levels(spark):
    d = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 3), (3, 5)], "upper long, lower long")
    assert {r.node: r.level for r in faces.joint_levels(d).collect()} == {1: 0, 4: 0, 2: 1, 3: 2, 5: 3}
    with pytest.raises(ValueError):
        faces.joint_levels(d.union(spark.createDataFrame([(5, 1)], "upper long, lower long")), 6)
