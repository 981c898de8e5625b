"""Bounded samples of labelled rows for the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def chosen(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, text: str = "text") -> DataFrame:
    """k, doc_id, text (null: empty) and label of at most ``rows`` documents of each label where ``learn`` holds, the first by
    a hash k of the id. Only ids of ``docs`` are chosen; rows that repeat one all come, the highest of its labels holding."""
    known = labels.filter(learn & F.col(label).isNotNull()).join(docs.select("doc_id"), "doc_id", "left_semi")
    mixed = known.groupBy("doc_id").agg(F.max(label).alias("label")).withColumn("k", F.xxhash64(F.lit("sample"), "doc_id"))
    found = None
    for value in (0, 1):
        part = mixed.filter(F.col("label") == value).orderBy("k", "doc_id").limit(rows)
        found = part if found is None else found.unionByName(part)
    return docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(found), "doc_id").select("k", "doc_id", "text", "label")  # at most 2 * rows ids


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, longest: int, text: str = "text") -> list[tuple[str, int]]:
    """(text, label) of the ``chosen`` documents in the order of k. Of a text over ``longest`` characters a window of so many
    is taken, at a place that a hash of the id chooses; this bounds what reaches the driver."""
    start = F.pmod(F.xxhash64(F.lit("window"), "doc_id"), F.greatest(F.length("text") - longest + 1, F.lit(1))).cast("int") + 1
    found = chosen(docs, labels, label, learn, rows, text).withColumn("text", F.substr("text", start, F.lit(longest))).toArrow().to_pylist()
    return [(r["text"], int(r["label"])) for r in sorted(found, key=lambda r: (r["k"], r["doc_id"], r["text"]))]
