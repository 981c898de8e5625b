"""Cases of openings, edges, tiles and buildings that the registered queries' tables don't hold."""

from sheetwise.functions.text import nfkc
from sheetwise.operators import hosting

AXIS = "x0 double, y0 double, x1 double, y1 double"
WALL = f"sheet_id long, wall_id long, {AXIS}, source_ids array<long>"


def test_openings_stay_with_slanted_walls_and_leave_bends(spark):
    walls = spark.createDataFrame([(1, 1, 0.0, 0.0, 30.0, 40.0, [1]), (1, 2, 30.0, 40.0, 60.0, 40.0, None)], WALL)
    openings = [(1, 1, 3.0, 4.0, 15.0, 20.0, []), (1, 2, 27.0, 36.0, 33.0, 40.0, [1]), (2, 3, 3.0, 4.0, 15.0, 20.0, [1]), (1, 4, 40.0, 40.0, 33.0, 40.0, [5, None])]
    found = hosting.remap_openings(spark.createDataFrame(openings, f"sheet_id long, opening_id long, {AXIS}, source_ids array<long>"), walls)
    assert sorted((r.opening_id, r.wall_id) for r in found.collect()) == [(1, 1), (4, 2)]


def test_two_walls_with_all_sources_leave_an_opening_without_one(spark):
    walls = spark.createDataFrame([(1, k, 0.0, 0.0, 10.0, 0.0, ids) for k, ids in ((1, [7, 8]), (2, [7]), (3, [7, 8]))], WALL)
    schema = f"sheet_id long, opening_id long, {AXIS}, source_ids array<long>"
    found = hosting.remap_openings(spark.createDataFrame([(1, 1, 1.0, 0.0, 3.0, 0.0, [7, 8])], schema), walls)
    assert found.count() == 0
    found = hosting.remap_openings(spark.createDataFrame([(1, 1, 1.0, 0.0, 3.0, 0.0, [7, 8])], schema), walls.filter("wall_id < 3"))
    assert [r.wall_id for r in found.collect()] == [1]


def test_notes_without_text_or_confidence_say_nothing(spark):
    openings = spark.createDataFrame([(1, 1, "door", 0.0, 0.0, 3.0, 4.0, None), (1, 2, "door", 50.0, 0.0, 50.0, 0.0, False)], f"sheet_id long, opening_id long, kind string, {AXIS}, reviewed boolean")
    notes = [(1, 1, None, 0.9, 1.0, 1.0), (1, 2, "SILL", None, 1.0, 1.0), (1, 3, "sill", float("nan"), 1.0, 1.0), (1, 4, "Ｓill", 0.85, 1.5, 2.0), (1, 5, "SILL", 1.0, 50.0, 0.0)]
    d = hosting.sill_notes(openings, spark.createDataFrame(notes, "sheet_id long, note_id long, text string, confidence double, x double, y double"))
    got = {r.opening_id: (r.n_notes, r.note_id, r.distance_ft, r.ambiguous) for r in d.collect()}
    assert got == {1: (1, 4, 0.0, True), 2: (0, None, None, False)}


def test_slanted_walls_along_an_edge(spark):
    walls = [(1, 1, 0.0, 0.0, 30.0, 40.0, 0.25), (1, 2, 0.0, 0.0, 30.0, 0.0, 0.25), (1, 3, 0.0, 0.0, 30.0, 40.0, 0.5), (1, 4, 5.0, 5.0, 5.0, 5.0, 0.1)]
    d = spark.createDataFrame(walls, f"sheet_id long, wall_id long, {AXIS}, thickness_ft double")
    edges = spark.createDataFrame([(1, 27.16, 35.88, 3.16, 3.88), (1, 9.0, 9.0, 9.0, 9.0)], "sheet_id long, ax double, ay double, ox double, oy double")
    assert [r.wall_id for r in hosting.walls_along(d, edges).collect()] == [1]
    assert sorted(r.wall_id for r in hosting.walls_along(d, edges, None, hosting.POOL_SHARE).collect()) == [1, 3]


def test_pieces_take_the_sources_of_every_opening_over_them(spark):
    walls = spark.createDataFrame([(1, 10.0, [9]), (2, 5.0, [1])], "wall_id long, length_ft double, source_ids array<long>")
    spans = [(1, "door", 0.0, 2.0, 6.0, [3]), (1, "opening", 0.0, 4.0, 12.0, None), (1, "door", 2.5, 0.0, 1.0, [4]), (1, "window", 0.0, 0.0, 1.0, [5]), (3, "door", 0.0, 0.0, 1.0, [6])]
    d = hosting.virtual_pieces(walls, spark.createDataFrame(spans, "wall_id long, kind string, sill_ft double, lo double, hi double, source_ids array<long>"))
    got = sorted((r.wall_id, r.lo, r.hi, r.virtual, r.source_ids) for r in d.collect())
    assert got == [(1, 0.0, 2.0, False, [9]), (1, 2.0, 4.0, True, [3, 9]), (1, 4.0, 6.0, True, [3, 9]), (1, 6.0, 10.0, True, [9]), (2, 0.0, 5.0, False, [1])]


def test_a_point_off_the_sheet_goes_to_the_nearest_tile(spark):
    bounds = spark.createDataFrame([(1, 0.0, 0.0, 74.0, 30.0), (2, 0.0, 0.0, 0.0, 0.0)], f"sheet_id long, {AXIS}")
    items = [(1, 1, 38.0, 10.0), (1, 2, 60.0, 10.0), (1, 3, 900.0, -5.0), (2, 4, 3.0, 3.0)]
    d = hosting.tile_of(spark.createDataFrame(items, "sheet_id long, item_id long, x double, y double"), bounds)
    assert sorted((r.item_id, r.tile) for r in d.collect()) == [(1, 0), (2, 1), (3, 1), (4, 0)]


def test_compatibility_forms(spark):
    d = spark.createDataFrame([("Ｓｉｌｌ ①",), ("plain",), (None,), ("",)], "t string")
    assert [r.t for r in d.select(nfkc(d.t).alias("t")).collect()] == ["Sill 1", "plain", None, ""]


def test_empty_tables(spark):
    none = spark.createDataFrame([], WALL)
    assert hosting.remap_openings(none.withColumnRenamed("wall_id", "opening_id"), none).count() == 0
    floors = spark.createDataFrame([], "building_id long, floor_id long, approved boolean")
    assert hosting.assemble_buildings(floors, spark.createDataFrame([], "floor_id long, wall_height_ft double")).count() == 0
