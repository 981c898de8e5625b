"""Scores and decisions over candidates and layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions.text import is_uninformative

#: Weights of a candidate's signals.
WEIGHTS = {"layer_role": 1.0, "length": 1.0, "connectivity": 2.0, "closure": 2.0, "thickness": 0.5, "instancing": 1.5, "glyph": 1.5, "nested_outline": 2.5}
#: Floors, ceilings and shares that decide on candidates and layers.
ACCEPT_FLOOR, REJECT_CEILING = 0.65, 0.35
VERDICT_FLOOR, OVERRIDE_FLOOR = 0.70, 0.85
WALL_FLOOR, RAISED = 0.70, 0.75
WALL_LIKE_FT, WALL_LIKE_SHARE, WALL_LIKE_LONG = 40.0, 0.60, 0.50
NEVER_WALL = ("dimension", "text_label", "title_block", "grid")
CAP = 20


def combined_score(signals: dict[str, Column]) -> Column:
    """Signals of -1 to 1 as a weighted score of 0 to 1."""
    total = sum(WEIGHTS.values())
    return F.round((sum((signals[k] * w for k, w in WEIGHTS.items()), F.lit(0.0)) / total + 1) / 2, 6)


def band(score: Column, accept: float = ACCEPT_FLOOR, reject: float = REJECT_CEILING) -> Column:
    return F.when(score >= accept, "accept").when(score <= reject, "reject").otherwise("ambiguous")


def decide(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates (candidate_id, score, on_wall_layer) with outcome and source: clear bands decide, else a confident
    verdict (candidate_id, verdict, confidence), else the layer."""
    d = candidates.join(verdicts, "candidate_id", "left").withColumn("band", band(F.col("score")))
    said = F.coalesce(F.col("confidence") >= VERDICT_FLOOR, F.lit(False))
    outcome = F.when(F.col("band") != "ambiguous", F.col("band")).when(said, F.when(F.col("verdict") == "wall", "accept").otherwise("reject")).otherwise(F.when(F.col("on_wall_layer"), "accept").otherwise("reject"))
    source = F.when(F.col("band") != "ambiguous", "deterministic").when(said, "adjudicated").otherwise("ambiguous-default")
    return d.select("candidate_id", "score", "band", outcome.alias("outcome"), source.alias("source"))


def wall_like() -> Column:
    share = F.when(F.col("paired_ft") > 0, F.col("matched_ft") / F.col("paired_ft")).otherwise(0.0)
    return (F.col("matched_ft") >= WALL_LIKE_FT) & (share >= WALL_LIKE_SHARE) & (F.col("long_share") >= WALL_LIKE_LONG)


def corroborate(layers: DataFrame) -> DataFrame:
    """Wall roles that the thickness evidence supports are raised to the wall floor; nothing is lowered."""
    raised = F.col("role").startswith("wall") & (F.col("confidence") < RAISED) & wall_like()
    return layers.withColumns({"raised": raised, "confidence": F.when(raised, RAISED).otherwise(F.col("confidence"))})


def candidate_layers(layers: DataFrame) -> DataFrame:
    """All layers but those whose role is confidently none of a wall's."""
    return layers.filter(~(F.col("role").isin(*NEVER_WALL) & (F.col("confidence") >= WALL_FLOOR)))


def escalate(layers: DataFrame, cap: int = CAP) -> DataFrame:
    """Per sheet the layers to look at again, by falling entity share: rank, reason and whether the cap drops them."""
    doubtful = F.col("confidence") < WALL_FLOOR
    large = (F.col("entity_share") >= 0.05) & ~F.col("role").isin("wall_structural", "column")
    reason = F.when(doubtful, "low_confidence").when(large, "large_non_wall_layer").when(is_uninformative(F.col("name")), "uninformative_name")
    picked = layers.withColumn("reason", reason).filter("reason is not null")
    rank = F.row_number().over(Window.partitionBy("sheet_id").orderBy(F.desc("entity_share"), "name", "layer_id"))
    return picked.withColumn("rank", rank).select("sheet_id", "layer_id", "name", "reason", "rank", (F.col("rank") > cap).alias("dropped"))


def batches(df: DataFrame, keys: list[str], order: list, size: int) -> DataFrame:
    """Rows numbered within their group and dealt into batches of ``size``."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("number", number).withColumn("batch", F.floor((F.col("number") - 1) / size))
