"""Model validation: each rule is one branch of a union of issues (severity, entity, code)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: How far measured lengths may be off, how far their record, and a junction from its walls.
MAX_RESIDUAL_IN, RECORD_IN, JUNCTION_FT = 2.0, 1e-5, 1e-5
#: Words of a measurement's basis that speak of what was rebuilt.
REBUILT = ("model", "reconstructed", "wall")


def _found(entity: Column, rules: list[tuple[str, str, Column]]) -> list[Column]:
    return [F.when(broken, F.struct(F.lit(severity).alias("severity"), entity.alias("entity"), F.lit(code).alias("code"))) for severity, code, broken in rules]


def _bad(*names: str) -> Column:
    """Whether a number is missing, not a number or without bound."""
    return reduce(Column.__or__, [F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in names])


def issues_of(table: DataFrame, entity: Column, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(severity, entity, code) of every row that breaks a rule, in one pass over the table."""
    return table.select(F.inline(F.filter(F.array(*_found(entity, rules)), lambda x: x.isNotNull())))


def dimension_issues(checks: DataFrame) -> DataFrame:
    """Issues of dimensions held against the model (dim_id, expected_ft, actual_ft, error_in, status, basis). One without a
    measurement is unverified, one with a number that isn't finite only that; the rest may break several rules."""
    measured = F.col("actual_ft").isNotNull() & F.col("error_in").isNotNull()
    sound = measured & ~_bad("expected_ft", "actual_ft", "error_in")
    error = F.abs(F.col("actual_ft") - F.col("expected_ft")) * 12
    rebuilt = F.coalesce(F.lower("basis").rlike("|".join(REBUILT)), F.lit(False))
    rules = [
        ("error", "nonfinite_geometry", measured & ~sound),
        ("error", "invalid_dimension", sound & ((F.col("expected_ft") <= 0) | (F.col("actual_ft") <= 0))),
        ("error", "dimension_residual_inconsistent", sound & (F.abs(error - F.col("error_in")) > RECORD_IN)),
        ("error", "model_dimension_gate_failed", sound & (error > MAX_RESIDUAL_IN + 1e-8)),
        ("error", "dimension_unverified", ~measured | (sound & ~(F.col("status").eqNullSafe("verified") & rebuilt))),
    ]
    return issues_of(checks, F.concat(F.lit("dimension-"), F.col("dim_id").cast("string")), rules)


def model_issues(models: DataFrame) -> DataFrame:
    """Issues of whole models, in one pass: sheet_id, units_per_foot, max_residual_in, scale_verified, wall_height_ft,
    elevation_ft, footprint_verified and the counts n_walls, n_profiles, n_spaces, n_footprints, n_checks, n_height_notes."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    parts = {
        "scale": [
            ("error", "nonfinite_geometry", _bad("units_per_foot", "max_residual_in")),
            ("error", "invalid_scale", ~_bad("units_per_foot", "max_residual_in") & (F.col("units_per_foot") <= 0)),
            ("error", "scale_unverified", no("scale_verified")),
            ("error", "scale_gate_failed", F.col("max_residual_in") > MAX_RESIDUAL_IN),
        ],
        "model": [
            ("error", "empty_wall_model", none("n_walls") & none("n_profiles")),
            ("error", "invalid_wall_height", _bad("wall_height_ft") | (F.col("wall_height_ft") <= 0)),
            ("warn", "wall_height_evidence_missing", none("n_height_notes")),
            ("error", "no_spaces_detected", ~none("n_walls") & none("n_spaces") & none("n_footprints")),
            ("warn", "no_spaces_detected", ~none("n_walls") & none("n_spaces") & ~none("n_footprints")),
            ("error", "footprint_unverified", ~none("n_footprints") & no("footprint_verified")),
            ("error", "missing_footprint", none("n_footprints")),
        ],
        "dimensions": [("error", "model_dimensions_unverified", none("n_checks"))],
        "storey": [
            ("warn", "assumed_elevation", F.col("elevation_ft").isNull()),
            ("error", "nonfinite_geometry", F.col("elevation_ft").isNotNull() & _bad("elevation_ft")),
        ],
        "floors": [("warn", "assumed_slab_thickness", ~none("n_footprints"))],
    }
    found = [x for part, rules in parts.items() for x in _found(F.concat(F.lit("sheet-"), F.col("sheet_id").cast("string"), F.lit(f"/{part}")), rules)]
    return models.select(F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


def junction_issues(junctions: DataFrame, walls: DataFrame) -> DataFrame:
    """Issues of junctions (sheet_id, junction_id, x, y, wall_ids): one for a wall that its sheet lacks, and nothing else
    then; else one where fewer than two walls or one wall twice is joined, and one for each wall that the point is off."""
    asked = junctions.select("sheet_id", "junction_id", "x", "y", F.coalesce(F.size(F.array_distinct("wall_ids")), F.lit(0)).alias("k"), F.explode_outer("wall_ids").alias("wall_id"), F.greatest(F.size("wall_ids"), F.lit(0)).alias("n"))
    known = walls.select("sheet_id", "wall_id", "x0", "y0", "x1", "y1", F.lit(True).alias("known"))
    d = asked.join(known, ["sheet_id", "wall_id"], "left")
    size = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    along = ((F.col("x") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y") - F.col("y0")) * (F.col("y1") - F.col("y0"))) / size
    across = F.abs((F.col("x") - F.col("x0")) * (F.col("y1") - F.col("y0")) - (F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0"))) / size
    off = F.when(size > 0, (across > JUNCTION_FT) | (along < -JUNCTION_FT) | (along > size + JUNCTION_FT))
    seen = d.groupBy("sheet_id", "junction_id").agg(F.count_if((F.col("n") > 0) & F.col("known").isNull()).alias("missing"), F.min(F.when((F.col("n") < 2) | (F.col("k") < F.col("n")), 1).otherwise(0)).alias("wrong"), F.count_if(off).alias("off"))
    code = F.when(F.col("missing") > 0, "invalid_junction_index").otherwise("invalid_junction")
    times = F.when(F.col("missing") > 0, 1).otherwise(F.col("wrong") + F.col("off")).cast("int")
    issue = F.struct(F.lit("error").alias("severity"), F.concat(F.lit("junction-"), F.col("junction_id").cast("string")).alias("entity"), code.alias("code"))
    return seen.select(F.inline(F.array_repeat(issue, times)))


def wall_issues(walls: DataFrame) -> DataFrame:
    rules = [
        ("error", "nonfinite_geometry", _bad("length_ft", "thickness_ft")),
        ("error", "zero_length_wall", F.col("length_ft") <= 1e-9),
        ("error", "invalid_wall_thickness", F.col("thickness_ft") <= 0),
        ("warn", "thick_wall", F.col("thickness_ft") > 0.4),
        ("info", "short_wall", F.col("length_ft") < F.col("thickness_ft")),
    ]
    return issues_of(walls, F.concat(F.lit("wall-"), F.col("wall_id").cast("string")), rules)


def empty_models(sheets: DataFrame, walls: DataFrame) -> DataFrame:
    """An error for each sheet without walls."""
    return sheets.select("sheet_id").distinct().join(walls.select("sheet_id").distinct(), "sheet_id", "left_anti").select(F.lit("error").alias("severity"), F.concat(F.lit("sheet-"), F.col("sheet_id").cast("string")).alias("entity"), F.lit("empty_wall_model").alias("code"))


def counts_by_severity(*issues: DataFrame) -> DataFrame:
    """Issues by severity and code with totals of each severity and of all (null where summed over)."""
    return reduce(DataFrame.unionByName, issues).rollup("severity", "code").agg(F.count("*").alias("n"))
