from sheetwise.operators import captions


def test_captions_meet_boxes_by_cells(spark):
    said = spark.createDataFrame([(1, 1, "ground", 2.0, 9.5, 29.0), (1, 2, "ground", 1.0, 5.0, 5.0), (1, 3, "first", 1.0, -5.0, 2.0), (1, 4, "roof", 1.0, 400.0, 0.0)], "sheet_id long, text_id long, word string, height double, x double, y double")
    boxes = spark.createDataFrame([(1, n, 0.0, 0.0, 8.0, 24.0) for n in (9, 4)], "sheet_id long, box_id long, x0 double, y0 double, x1 double, y1 double")
    got = captions.caption_plans(said, boxes, 6.0)
    assert [(r.box_id, r.text_id, r.word, r["class"]) for r in got.collect()] == [(4, 2, "ground", captions.INSIDE)]
    assert "cx#" in got._jdf.queryExecution().optimizedPlan().toString()  # never all boxes of a sheet
