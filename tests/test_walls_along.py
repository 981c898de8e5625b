from sheetwise.operators import hosting


def test_share_met_exactly_despite_noise(spark):
    walls = spark.createDataFrame([(1, 7, 15.0, 25.0, 30.000000000000004, 25.0, 0.25), (1, 8, 15.0, 25.0, 30.1, 25.0, 0.25)], "sheet_id long, wall_id long, x0 double, y0 double, x1 double, y1 double, thickness_ft double")
    edges = spark.createDataFrame([(1, 15.0, 25.0, 27.0, 25.0)], "sheet_id long, ax double, ay double, ox double, oy double")
    assert [r.wall_id for r in hosting.walls_along(walls, edges, None, hosting.POOL_SHARE).collect()] == [7]
