"""Odd rows of the validation rules."""

from sheetwise.operators import validate

CHECK = "dim_id long, expected_ft double, actual_ft double, error_in double, status string, basis string"


def test_odd_dimension_checks(spark):
    rows = [(1, 10.0, 10.0, 0.0, "verified", "Wall"), (2, float("nan"), 10.0, 0.0, "verified", "wall"), (3, 10.0, 10.0, None, None, None), (4, 10.0, 10.0, 0.0, None, None), (5, 10.0, 11.0, 12.0, "verified", "model"), (6, -1.0, -1.0, 0.0, "verified", "model")]
    got = sorted((r.entity, r.code) for r in validate.dimension_issues(spark.createDataFrame(rows, CHECK)).collect())
    assert got == [
        ("dimension-2", "nonfinite_geometry"), ("dimension-3", "dimension_unverified"), ("dimension-4", "dimension_unverified"),
        ("dimension-5", "model_dimension_gate_failed"), ("dimension-6", "invalid_dimension"),
    ]


def test_odd_junctions(spark):
    walls = spark.createDataFrame([(1, 1, 0.0, 0.0, 3.0, 4.0), (1, 2, 3.0, 4.0, 3.0, 9.0), (1, 3, 5.0, 5.0, 5.0, 5.0)], "sheet_id long, wall_id long, x0 double, y0 double, x1 double, y1 double")
    rows = [(1, 1, 3.0, 4.0, [1, 2]), (1, 2, 3.0, 4.0, [1, 1]), (1, 3, 3.0, 4.5, [1, 2]), (2, 4, 3.0, 4.0, [1, 2]), (1, 5, 0.0, 0.0, None), (1, 6, 0.0, 0.0, []), (1, 7, 3.0, 4.0, [1, None]), (1, 8, 3.0, 4.0, [1, 3])]
    d = validate.junction_issues(spark.createDataFrame(rows, "sheet_id long, junction_id long, x double, y double, wall_ids array<long>"), walls)
    got = sorted((r.entity, r.code) for r in d.collect())
    wrong, lost = "invalid_junction", "invalid_junction_index"
    assert got == [("junction-2", wrong), ("junction-3", wrong), ("junction-4", lost), ("junction-5", wrong), ("junction-6", wrong), ("junction-7", lost)]


def test_empty_tables(spark):
    assert validate.dimension_issues(spark.createDataFrame([], CHECK)).count() == 0
