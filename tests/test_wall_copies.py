"""Walls and boxes of which many are alike or lie on one line."""

from pyspark.sql import functions as F

from sheetwise.operators import hosting, joints, repair

WALL = "sheet_id long, wall_id long, x0 double, y0 double, x1 double, y1 double"
BOX = "sheet_id long, box_id long, x0 double, y0 double, x1 double, y1 double"


# F7
def test_crossings_without_a_shuffle_of_pairs(spark):
    got = joints.crossings(spark.createDataFrame([(1, 1, -25.0, 3.0, 35.0, 3.0), (1, 2, 5.0, -25.0, 5.0, 31.0), (1, 3, -20.0, -20.0, 30.0, 30.0)], WALL))
    assert sorted((r.a, r.b, r.x, r.y) for r in got.collect()) == [(1, 2, 5.0, 3.0), (1, 3, 3.0, 3.0), (2, 3, 5.0, 5.0)]
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


# F6
def test_cuts_in_one_place_count_once(spark):
    walls = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 0.0)], WALL)
    cuts = spark.range(300).select(F.lit(1).cast("long").alias("sheet_id"), F.lit(1).cast("long").alias("wall_id"), (F.col("id") % 3 / 4).alias("t"))
    got = joints.split_at(walls, cuts)
    assert sorted((r.piece, r.ax, r.bx) for r in got.collect()) == [(0, 0.0, 2.5), (1, 2.5, 5.0), (2, 5.0, 10.0)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2  # places before sets


# F14
def test_equal_boxes_keep_their_number(spark):
    boxes = [(1, n, 0.0, 0.0, 10.0, 10.0) for n in (7, 5)] + [(1, 9, 30.0, 0.0, 40.0, 10.0)]
    walls = [(1, 1, 4.0, 4.0, 6.0, 4.0), (1, 2, 9.0, 4.0, 15.0, 4.0), (1, 3, 25.0, 4.0, 31.0, 4.0), (1, 4, 70.0, 0.0, 71.0, 0.0)]
    got = joints.owner_by_box(spark.createDataFrame(walls, WALL), spark.createDataFrame(boxes, BOX))
    assert sorted(tuple(r) for r in got.select("wall_id", F.coalesce("box_id", F.lit(0)), "spanning").collect()) == [(1, 5, False), (2, 0, True), (3, 9, False), (4, 0, False)]
    assert "dropDuplicates" not in str(got) and got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2  # boxes and verdicts


# F15
def test_classes_of_equal_boxes(spark):
    classed = [(1, 7, 0.0, 0.0, 10.0, 10.0, "pool"), (1, 5, 0.0, 0.0, 10.0, 10.0, None), (1, 6, 20.0, 0.0, 30.0, 10.0, "void"), (1, 8, 20.0, 0.0, 30.0, 10.0, "room")]
    spaces = [(1, 1, 4.0, 4.0, 6.0, 6.0), (1, 2, 24.0, 4.0, 26.0, 6.0), (1, 3, 23.0, 3.0, 27.0, 7.0), (1, 4, 90.0, 0.0, 91.0, 1.0)]
    got = hosting.carry_classes(spark.createDataFrame(spaces, BOX.replace("box_id", "space_id")), spark.createDataFrame(classed, BOX + ", class string"))
    assert {r.space_id: r["class"] for r in got.collect()} == {1: "", 2: "void", 3: "void", 4: ""}


# F3, F8
def test_walls_on_one_line_are_one(spark):
    walls = [(1, i, float(i % 40), 0.0, float(i % 40 + 3), 0.0) for i in range(200)] + [(1, 500, 60.0, 0.0, 61.0, 0.0), (1, 501, 5.0, 5.0, 9.0, 9.0), (1, 502, 5.0, 5.0, 9.0, 9.0), (1, 503, 7.0, 9.0, 7.0, 0.25)]
    df = spark.createDataFrame(walls, WALL)
    assert sorted(tuple(r)[1:] for r in repair._lines(df).collect()) == [(0.0, 0.0, 42.0, 0.0), (5.0, 5.0, 9.0, 9.0), (7.0, 0.25, 7.0, 9.0), (60.0, 0.0, 61.0, 0.0)]
    assert {r.wall_id: (r.x1, r.y1) for r in repair.extend_ends(df).collect()}[503] == (7.0, 0.0)
    stated = spark.createDataFrame([(1, 1, 1.0, 0.1, 41.5, 0.1, 40.5, "native")], "sheet_id long, dim_id long, x0 double, y0 double, x1 double, y1 double, expected_ft double, source string")
    assert [(r.actual_ft, r.status) for r in repair.check_dimensions(stated, df).collect()] == [(40.5, "verified")]
