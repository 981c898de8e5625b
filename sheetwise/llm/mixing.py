"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with built-in functions only.

A document's size is its words ``[^\\x20\\x09-\\x0D]+``. The mix takes ``share`` percent of all sizes, dealt to the sources
by weight; a source gives at most ``repeats`` times its size, and what it can't give goes to the others by weight. Each
source first gives all its documents as many whole times as its target holds. The rest of its target is filled by a
weighted sample without replacement: documents in the order of an exponential key divided by their quality weight, up to
the budget of words; of the document in which the budget ends the first words are taken, so that a source's words are its
target rounded down.

Sources are ordered by code point, a null source being one of its own and last. Running totals, over documents within a
source and over sources, go by ranges of the order (``ordered``), so a source may hold any share of the rows, and there
may be many sources.

Null and empty texts have size 0 and are taken 0 words. A null doc_id has the key of the empty id. Rows that repeat an id
are drawn one by one; equal rows tie, and any of them may come first. A table without words has targets 0, and an empty one
gives no rows. Other columns are dropped unless they are carried; those with the names of results give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.ordered import running_totals
from sheetwise.runtime import discard, materialize

BLANKS = " \t\n\x0b\x0c\r"
SPACE = "[\\x20\\x09-\\x0D]"
#: Weights of sources in their order, repeating.
WEIGHTS = (1, 2, 3)
REPEATS = 3
SEED = 13


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))


def quality_weight(words: Column) -> Column:
    """The share of distinct words, never 0: a text that repeats itself is drawn later."""
    return (F.size(F.array_distinct(words)) + 1) / (F.size(words) + 1)


def draw_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """An exponential variate that the id fixes, divided by the weight: the least keys are drawn first."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 12), 16, 10).cast("double")
    return -F.ln((h + 0.5) / F.lit(float(1 << 48))) / weight


def source_targets(sources: DataFrame, share: int = 100, repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Sources (_last, _source, source_size) with target. A source is full if the level of words per weight, reckoned without
    the fuller sources before it, reaches ``repeats`` times its size; the others share what is left by weight."""
    one = sources.withColumn("_one", F.lit(1).cast("long"))
    placed = running_totals(one, [], [F.col("_last"), F.col("_source")], {"_place": "_one"})
    weight = F.element_at(F.lit(list(weights)), (F.col("_place") % len(weights) + 1).cast("int"))
    wide = lambda c: F.col(c).cast("decimal(38,0)") if isinstance(c, str) else c.cast("decimal(38,0)")
    d = placed.withColumns({"_weight": weight.cast("long"), "_most": F.col("source_size") * repeats})
    d = running_totals(d, [], [F.col("_most") / F.col("_weight"), F.col("_last"), F.col("_source")], {"_given": "_most", "_used": "_weight"})
    whole = d.agg((F.sum("source_size") * share).alias("words"), F.sum("_weight").alias("weights")).first()
    words, total = int(whole["words"] or 0), int(whole["weights"] or 0)
    words = words // 100  # whole words
    full = wide("_most") * wide(F.lit(total) - F.col("_used")) <= wide("_weight") * wide(F.lit(words) - F.col("_given"))
    d = materialize(d.withColumn("_full", full), "sources")
    taken = d.filter("_full").agg(F.sum("_most"), F.sum("_weight")).first()
    left, among = words - int(taken[0] or 0), total - int(taken[1] or 0)
    level = F.col("_weight").cast("double") * F.lit(float(left)) / F.lit(float(among or 1))
    return d.select("_last", "_source", "source_size", F.when(F.col("_full"), F.col("_most").cast("double")).otherwise(level).alias("target"))


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", carry: tuple[str, ...] = (), share: int = 100, repeats: int = REPEATS,
    weights: tuple[int, ...] = WEIGHTS, quality: Column | None = None, seed: int = SEED,
) -> DataFrame:
    """doc_id, the source, the columns ``carry``, and size, source_size, target (of the source), epochs (whole copies), part
    (words of one more copy, from its first) and taken (words in all). ``quality`` is a positive weight over the columns of
    ``docs`` and _words, by default the share of distinct words."""
    d = docs.withColumn("_words", words_of(F.col(text)))
    key = draw_key(F.col("doc_id"), quality_weight(F.col("_words")) if quality is None else quality, seed)
    given = list(dict.fromkeys(["doc_id", source, *carry]))
    own = [F.col(source).isNull().alias("_last"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source")]
    d = d.select(*[F.col(c).alias(f"_given_{k}") for k, c in enumerate(given)], *own, F.size("_words").cast("long").alias("size"), key.alias("_key"))
    sized = materialize(d, "sized")
    by = ["_last", "_source"]
    sources = materialize(sized.groupBy(*by).agg(F.sum("size").alias("source_size")), "source-sizes")
    order = [F.col("_key"), F.asc_nulls_last("_given_0"), F.col("size")]
    d = running_totals(sized, by, order, {"_before": "size"}, source_targets(sources, share, repeats, weights))
    discard(sized)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0)).cast("long")
    d = d.withColumn("epochs", epochs)
    part = F.greatest(F.lit(0), F.least("size", budget - F.col("epochs") * F.col("source_size") - F.col("_before"))).cast("long")
    d = d.withColumn("part", part).withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
    results = ["size", "source_size", "target", "epochs", "part", "taken"]
    return d.select(*[F.col(f"_given_{k}").alias(c) for k, c in enumerate(given) if c not in results], *results)


def mixture(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: a row for each copy that ``mixed`` (with ``text`` carried) takes, with its number ``copy`` and its text;
    the last copy may be cut behind a word."""
    word_ends = F.split(F.col(text), f"(?<=[^\\x20\\x09-\\x0D])(?={SPACE})")
    cut = F.when(F.col("part") == F.col("size"), F.col(text)).otherwise(F.array_join(F.slice(word_ends, F.lit(1), F.col("part").cast("int")), ""))
    copies = F.concat(F.array_repeat(F.col(text), F.col("epochs").cast("int")), F.when(F.col("part") > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    return mixed.filter("taken > 0").select(*[c for c in mixed.columns if c not in (text, "copy")], F.posexplode(copies).alias("copy", text))


def op13_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, list_filter(string_split_regex(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '') AS words FROM documents),
z AS (SELECT doc_id, source, CAST(len(words) AS BIGINT) AS size,
  -ln((CAST(('0x' || substr(sha256('{SEED}:' || doc_id), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE) / (CAST(len(list_distinct(words)) + 1 AS DOUBLE) / (len(words) + 1)) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY 1),
p AS (SELECT *, (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
r AS (SELECT *, coalesce(sum(3 * source_size) OVER w, 0) AS given, coalesce(sum(weight) OVER w, 0) AS used, sum(source_size) OVER () AS words, sum(weight) OVER () AS total FROM p
      WINDOW w AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, 3 * source_size * (total - used) <= weight * (words - given) AS filled FROM r),
l AS (SELECT coalesce(sum(3 * source_size) FILTER (filled), 0) AS given, coalesce(sum(weight) FILTER (filled), 0) AS used FROM f),
g AS (SELECT source, source_size, CASE WHEN filled THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(weight AS DOUBLE) * CAST(words - l.given AS DOUBLE) / CAST(total - l.used AS DOUBLE) END AS target FROM f, l),
b AS (SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs,
  coalesce(sum(size) OVER (PARTITION BY z.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM z JOIN g ON g.source IS NOT DISTINCT FROM z.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - earlier)) AS BIGINT) AS taken FROM b
"""
