"""Cases of the layer and repair operators that the registered queries' tables don't hold."""

from pyspark.sql import functions as F

from sheetwise.operators import layers, repair

WALL = "sheet_id long, wall_id long, x0 double, y0 double, x1 double, y1 double"


def test_the_last_of_equal_keys_counts(spark):
    d = spark.createDataFrame([(1, [("a", 1), ("b", 2), ("a", 3)]), (2, []), (3, None)], "id int, entries array<struct<key: string, value: int>>")
    got = {r.id: r.m for r in d.select("id", layers.as_map(F.col("entries")).alias("m")).collect()}
    assert got == {1: {"b": 2, "a": 3}, 2: {}, 3: None}


def test_ends_go_to_the_nearest_line_and_short_walls_stay(spark):
    rows = [(1, 1, 0.0, 0.0, 9.8, 0.0), (1, 2, 10.0, -5.0, 10.0, 5.0), (1, 3, 10.3, -5.0, 10.3, 5.0), (1, 4, 9.9, 3.0, 10.1, 3.0), (2, 5, 0.0, 0.0, 9.8, 0.0)]
    got = {r.wall_id: (r.x0, r.y0, r.x1, r.y1) for r in repair.extend_ends(spark.createDataFrame(rows, WALL)).collect()}
    assert got[1] == (0.0, 0.0, 10.0, 0.0)  # to the nearer of two
    assert got[4] == (9.9, 3.0, 10.1, 3.0)  # both ends want one point
    assert got[5] == (0.0, 0.0, 9.8, 0.0)  # other sheets don't count
    assert len(got) == 5


def test_dimensions_without_a_wall_or_a_statement_are_unverified(spark):
    walls = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 0.0)], WALL)
    rows = [(1, 1, 0.0, 0.1, 10.0, 0.1, 10.0, "native"), (1, 2, 0.0, 0.1, 10.0, 0.1, 9.0, "native"), (1, 3, 0.0, 0.5, 10.0, 0.5, 10.0, "native"), (1, 4, 0.0, 0.0, 10.0, 0.0, None, "native"), (1, 5, 0.0, 0.0, 10.0, 0.0, 10.0, "ocr-associated")]
    d = spark.createDataFrame(rows, "sheet_id long, dim_id long, x0 double, y0 double, x1 double, y1 double, expected_ft double, source string")
    got = {r.dim_id: r.status for r in repair.check_dimensions(d, walls).collect()}
    assert got == {1: "verified", 2: "failed", 3: "unverified", 4: "unverified", 5: "unverified"}


def test_first_of_each_keeps_other_columns(spark):
    d = spark.createDataFrame([(1, "b", 3, "x"), (1, "a", 1, "y"), (1, "a", 2, None), (1, None, 4, "z")], "sheet_id int, code string, k int, more string")
    got = sorted(layers.first_of_each(d, ["code"], ["k"]).select("place", "code", "k", "more").collect())
    assert [tuple(r) for r in got] == [(1, "a", 1, "y"), (2, "b", 3, "x"), (3, None, 4, "z")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], WALL)
    assert repair.extend_ends(none).count() == 0
    assert layers.longest_named(none.withColumns({"layer": F.lit("L"), "length_ft": F.lit(1.0)})).count() == 0
