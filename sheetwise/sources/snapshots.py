"""Frozen tables: written once with a manifest of counts and digests, read back only if they still agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_digest(df: DataFrame) -> tuple[int, str]:
    """Rows and a digest of the content, whatever the order of rows: sums of 64-bit halves of each row's sha256."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    half = lambda k: F.conv(F.substring(row, k, 15), 16, 10).cast("decimal(38,0)")
    r = df.agg(F.count("*").alias("n"), F.sum(half(1)).alias("a"), F.sum(half(16)).alias("b")).first()
    return r.n, f"{int(r.a or 0):x}-{int(r.b or 0):x}"


def freeze(tables: dict[str, DataFrame], path: str) -> None:
    """Writes each table and the manifest; refuses to overwrite."""
    spark, rows = next(iter(tables.values())).sparkSession, []
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        rows.append((name, *content_digest(spark.read.parquet(f"{path}/{name}"))))
    spark.createDataFrame(rows, "name string, n long, digest string").coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


def replay(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The frozen tables; raises if one has changed."""
    out = {}
    for r in spark.read.schema("name string, n long, digest string").option("mode", "FAILFAST").json(f"{path}/manifest").collect():
        out[r.name] = spark.read.parquet(f"{path}/{r.name}")
        if content_digest(out[r.name]) != (r.n, r.digest):
            raise ValueError(f"{r.name} differs from its manifest")
    return out


def stable_id(*parts: str):
    """A surrogate key over an element's source, region, class and name."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)
