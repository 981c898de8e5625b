"""Captions, readings and storeys: best matches between texts and boxes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.operators.joints import _celled
from sheetwise.operators.spatial import unlike_boxes
from sheetwise.runtime import dealt, ship_package


#: Codes of where a caption stands, best first.
UNDER, INSIDE, OVER, BESIDE = 0, 1, 2, 3


def placement(reach: float) -> Column:
    """Where a point (x, y) stands to a box (x0..y1): a struct of a code above as class and of the distance; null if it is
    further than ``reach``, or over or under the box and more than a third of that outside its sides."""
    aside = F.greatest(F.col("x0") - F.col("x"), F.col("x") - F.col("x1"), F.lit(0.0))  # how far outside, along either axis
    below, above = F.greatest(F.col("y0") - F.col("y"), F.lit(0.0)), F.greatest(F.col("y") - F.col("y1"), F.lit(0.0))
    apart = F.greatest(below, above)
    code = (
        F.when((aside == 0) & (apart == 0), INSIDE)
        .when((apart == 0) & (aside <= reach), BESIDE)
        .when((apart > 0) & (apart <= reach) & (aside <= reach / 3), F.when(below > 0, UNDER).otherwise(OVER))
    )
    return F.when(code.isNotNull(), F.struct(code.alias("class"), F.round(F.when(code == BESIDE, aside).otherwise(apart), 9).alias("distance")))


def caption_plans(captions: DataFrame, boxes: DataFrame, reach: float, cell: float = 10.0) -> DataFrame:
    """Captions (sheet_id, text_id, word, height, x, y) on plans (sheet_id, box_id, x0..y1): each caption takes its best plan,
    each plan its best caption, and each word its best plan. Captions meet the boxes whose reach enters their cell; of equal
    boxes the least id is all that can win."""
    where = ["sheet_id", "cx", "cy"]
    unlike = _celled(unlike_boxes(boxes, F.min("box_id").alias("box_id")), cell, reach)
    placed = captions.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    met = dealt(placed, *where).join(dealt(unlike, *where), where).withColumn("p", placement(reach)).filter("p is not null")
    first = lambda keys, *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rank = (F.col("p.class"), F.desc("height"), F.col("p.distance"), F.col("text_id"), F.col("box_id"))
    own = met.withColumn("k", first(["sheet_id", "text_id"], "p.class", "p.distance", "box_id")).filter("k = 1")
    plan = own.withColumn("k", first(["sheet_id", "box_id"], *rank)).filter("k = 1")
    word = plan.withColumn("k", first(["sheet_id", "word"], *rank)).filter("k = 1")
    return word.select("sheet_id", "box_id", "text_id", "word", F.col("p.class").alias("class"), F.col("p.distance").alias("distance"))


def merge_readings(readings: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Equal texts (sheet_id, reading_id, text, confidence, x, y, w, h) merge where every pair of boxes overlaps by the
    threshold (IoU), the more confident first. Readings of one text on one sheet are a group; its fold is sequential."""
    ship_package(readings.sparkSession)

    def iou(a, b) -> float:
        inner = max(0.0, min(a.x + a.w, b.x + b.w) - max(a.x, b.x)) * max(0.0, min(a.y + a.h, b.y + b.h) - max(a.y, b.y))
        outer = a.w * a.h + b.w * b.h - inner
        return inner / outer if outer > 0 else 0.0

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        groups: list[list] = []
        for r in group.sort_values(["confidence", "x", "y", "w", "h", "reading_id"], ascending=[False, True, True, True, True, True]).itertuples():
            for g in groups:
                if all(iou(m, r) >= threshold for m in g):
                    g.append(r)
                    break
            else:
                groups.append([r])
        return pd.DataFrame([(g[0].sheet_id, g[0].text, g[0].reading_id, len(g)) for g in groups], columns=["sheet_id", "text", "reading_id", "n_merged"])

    return readings.groupBy("sheet_id", "text").applyInPandas(fold, "sheet_id long, text string, reading_id long, n_merged long")


def map_points(points: DataFrame, affine: tuple[float, float, float, float, float, float]) -> DataFrame:
    """Points through a 2 x 3 affine map, from image to drawing."""
    a, b, c, d, e, f = affine
    return points.withColumns({"x": F.round(F.col("x") * a + F.col("y") * b + c, 9), "y": F.round(F.col("x") * d + F.col("y") * e + f, 9)})


def agreed_unit(votes: DataFrame) -> DataFrame:
    """Per sheet the unit of (sheet_id, unit) if all votes name the same; else null."""
    units = F.collect_set("unit")  # of a handful of names
    return votes.groupBy("sheet_id").agg(F.when(F.size(units) == 1, units[0]).alias("unit"), F.count("*").alias("n_votes"))


def extents(lines: DataFrame, sheets: DataFrame) -> DataFrame:
    """Each sheet's box; zeros for one without lines."""
    found = lines.groupBy("sheet_id").agg(F.min(F.least("x0", "x1")).alias("min_x"), F.min(F.least("y0", "y1")).alias("min_y"), F.max(F.greatest("x0", "x1")).alias("max_x"), F.max(F.greatest("y0", "y1")).alias("max_y"))
    return sheets.select("sheet_id").distinct().join(found, "sheet_id", "left").na.fill(0.0)


def stacked(boxes: DataFrame, share: float = 0.5) -> DataFrame:
    """Neighbouring storeys (sheet_id, box_id in order) whose boxes, moved to one corner, cover each other by a share of the
    smaller."""
    order = Window.partitionBy("sheet_id").orderBy("box_id")
    d = boxes.select("sheet_id", "box_id", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    d = d.withColumns({"above_id": F.lead("box_id").over(order), "w2": F.lead("w").over(order), "h2": F.lead("h").over(order)}).filter("above_id is not null")
    cover = F.least("w", "w2") * F.least("h", "h2") / F.least(F.col("w") * F.col("h"), F.col("w2") * F.col("h2"))
    return d.select("sheet_id", "box_id", "above_id", F.round(cover, 6).alias("coverage"), (cover >= share).alias("stacked"))


def upsert(cache: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """The cache with fresh rows in place of those of the same key."""
    return cache.join(fresh.select(*key), key, "left_anti").unionByName(fresh)
