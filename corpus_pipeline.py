"""The training-data pipeline: quality rules, toxicity, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of documents.
Rows without a doc_id are judged like any others, and none of them is a near duplicate. Of rows that repeat a doc_id one
stays. Other columns pass through whatever their names; n_chars follows a text that is redacted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.llm import ngram_jaccard, packing, pii, quality_rules, toxicity
from sheetwise.runtime import discard, materialize

#: Ids of dropped documents, 8 bytes each, that may be broadcast.
BROADCAST = 1_000_000


def _shielded(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with all columns but doc_id and text under names that no operator uses, and the columns to restore it."""
    names = {c: c if c in ("doc_id", "text") else f"_given_{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), [F.col(n).alias(c) for c, n in names.items()]


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST else ids


def keep_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, columns = _shielded(docs)
    return quality_rules.quality_rules(own).filter("kept").select(columns)


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, columns = _shielded(docs)
    net = toxicity.learn(own, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxicity(own, net).filter(f"score < {toxicity.THRESHOLD}").select(columns)


def keep_one_of_each_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, columns = _shielded(docs)
    found = materialize(ngram_jaccard.jaccard_components(own).filter("doc_id is not null"), "components")
    dropped = found.filter("doc_id != component_id").select("doc_id").distinct()
    repeated = found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    once = own.join(_small(dropped.unionByName(repeated)), "doc_id", "left_anti")
    return once.unionByName(own.join(_small(repeated), "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(columns)


def redact_pii(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, columns = _shielded(docs)
    out = pii.redact(pii.find_pii(own)).select(columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_each_group),
    ("pii", redact_pii),
    ("packing", pack),
]
#: SQL can express neither the network nor the packing.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if name != STAGES[0][0]:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
