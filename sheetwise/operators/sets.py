"""Set operations over claims: elements and the source ids they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` over ``parts`` partitions, which stay as stated; without a number Spark chooses as it sees bytes."""
    return rows.repartition(parts, *keys) if parts else rows


def unique_claims(claims: DataFrame, parts: int | None = None) -> DataFrame:
    """Elements whose every (sheet_id, source_id) nobody else claims."""
    claims = _dealt(claims.select("sheet_id", "element_id", "source_id").filter("sheet_id is not null and source_id is not null"), parts, "sheet_id", "source_id")
    owners = claims.groupBy("sheet_id", "source_id").agg(F.coalesce(F.min("element_id") == F.max("element_id"), F.lit(False)).alias("one"))
    judged = _dealt(claims.join(owners, ["sheet_id", "source_id"]), parts, "sheet_id", "element_id")
    judged = judged.groupBy("sheet_id", "element_id").agg(F.bool_and("one").alias("alone"), F.count_distinct("source_id").alias("n_ids"))
    return judged.filter("alone").drop("alone")


def override_union(first: DataFrame, later: DataFrame, parts: int | None = None) -> DataFrame:
    """The claims of ``later``, and those elements of ``first`` that share no id with them."""
    keys, ids = ("sheet_id", "element_id"), ("sheet_id", "source_id")
    taken = _dealt(first.select(*keys, "source_id"), parts, *ids).join(_dealt(later.select(*ids), parts, *ids), [*ids], "left_semi").select(*keys)
    return _dealt(first, parts, *keys).join(_dealt(taken, parts, *keys), [*keys], "left_anti").unionByName(later)


def keyed_override(rows: DataFrame, keys: list[str], priority: Column, parts: int | None = None) -> DataFrame:
    """One row for each key: the one of the highest priority."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(priority))
    return _dealt(rows, parts, *keys).withColumn("_k", first).filter("_k = 1").drop("_k")


def set_overlap(elements: DataFrame, judged: DataFrame, share: float = 0.5) -> DataFrame:
    """Pairs (element_id, other_id) on a sheet whose common ids are at least ``share`` of the element's. Ids meet by an
    equi-join; sets are never compared in pairs."""
    size = elements.groupBy("sheet_id", "element_id").agg(F.count("*").alias("size"))
    met = elements.join(judged.select("sheet_id", "source_id", F.col("element_id").alias("other_id")), ["sheet_id", "source_id"]).groupBy("sheet_id", "element_id", "other_id").agg(F.count("*").alias("common"))
    return met.join(size, ["sheet_id", "element_id"]).filter(F.col("common") >= F.col("size") * share).select("sheet_id", "element_id", "other_id", "common", "size")


def provenance(claims: DataFrame, keys: list[str]) -> DataFrame:
    """The union of each group's ids, sorted, with its digest."""
    ids = F.array_sort(F.collect_set("source_id"))
    return claims.groupBy(*keys).agg(F.size(ids).cast("long").alias("n_ids"), F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("digest"))
