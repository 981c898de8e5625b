"""Document fingerprints: a canonical exact digest, with DataFrame and SQL functions only.

The canonical text is NFKC, then full case folding, then NFKC again (folding can leave marks apart), by the ICU library
that Spark brings for its collations, called through the SQL function java_method; then one space for each run of white
space, none at the ends. ASCII texts are only lower-cased, which is the same. Its fingerprint is 128 bits of xxhash in
hexadecimal. Documents of equal fingerprints are compared by the bytes of their canonical texts before they count as one
group, whose id is its least doc_id; only members of such buckets are read again for that. Large groups of copies are
dealt over tasks, each with the one text that all are compared with.

Each document is also edited: the last floor(n/2) characters give way to as many (or all) of the next document in order
of doc_id, the first following the last. The order is found inside ranges of ids, whose ends are quantiles; the first
text of each range is handed to the last row of the one before.

Null text is empty. Rows that repeat a doc_id follow each other in the order of their texts. A row without doc_id has no
next document: its edit only cuts, its near_next is 0 and its group_id null. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.runtime import discard, materialize

#: Documents of one range of ids, and the most ranges (a bound of what the driver and each task hold).
RANGE = 256
RANGES = 4096
#: Members of a bucket that one task compares with a copy of its first text.
DEALT = 2000
#: Buckets with more than 1 in ``HOT`` of all rows (fewer than ``HOT``) are broadcast apart from the rest.
HOT = 1000
#: Documents of shared fingerprints (24 bytes each) that may be broadcast.
BROADCAST = 1_000_000
_SPACE = "[\\s\\x1C-\\x1F\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"


def _icu(owner: str, method: str, text: Column) -> Column:
    return F.java_method(F.lit(f"com.ibm.icu.{owner}"), F.lit(method), text, F.lit(True))


def canonical(text: Column) -> Column:
    """The canonical form of a text; null is empty."""
    given = F.coalesce(text, F.lit(""))
    normal = lambda t: _icu("text.Normalizer", "compose", t)
    folded = normal(_icu("lang.UCharacter", "foldCase", normal(given)))
    return F.trim(F.regexp_replace(F.when(given.rlike("[^\\x00-\\x7F]"), folded).otherwise(F.lower(given)), _SPACE, " "))


def fingerprint(canonical_text: Column) -> Column:
    """128 bits of xxhash, as 32 hexadecimal digits."""
    halves = [F.lpad(F.hex(F.xxhash64(*salt, canonical_text)), 16, "0") for salt in ((), (F.lit("wide"),))]
    return F.lower(F.concat(*halves))


def range_ends(docs: DataFrame) -> list[int]:
    """Ends of ranges of doc_id with some ``RANGE`` documents each, or more where that'd be over ``RANGES`` ranges."""
    n = docs.count()
    k = min(RANGES, n // RANGE)
    if k < 2:
        return []
    found = docs.select(F.percentile_approx("doc_id", [i / k for i in range(1, k)], 20 * k).alias("ends")).first().ends or []
    return sorted(set(found))


def _range_of(doc_id: Column, ends: list[int]) -> Column:
    """How many of ``ends`` are below ``doc_id``, by bisection."""
    if not ends:
        return F.lit(0)
    array = F.split(F.lit(",".join(map(str, ends))), ",").cast("array<bigint>")
    steps = F.lit([1 << k for k in reversed(range(len(ends).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(ends)) & (F.try_element_at(array, at + step) < doc_id), at + step).otherwise(at))


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``docs`` (doc_id and ``carried``, the first of which orders rows of one doc_id) with next_<c> of each of ``carried``."""
    ends = range_ends(docs.select("doc_id"))
    known = F.col("doc_id").isNotNull()
    keyed = docs.withColumn("known", known).withColumn("range", F.when(known, _range_of(F.col("doc_id"), ends)).otherwise(F.pmod(F.xxhash64(*carried), F.lit(RANGES)).cast("int")))
    # the first row of each range follows the last of the range before: at most RANGES rows
    least = docs.filter(known).groupBy(_range_of(F.col("doc_id"), ends).alias("range")).agg(F.min("doc_id").alias("doc_id")).collect()
    firsts = sorted((r["range"], r["doc_id"]) for r in least)
    before = {d: firsts[i - 1][0] for i, (_, d) in enumerate(firsts)}
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(d, r) for d, r in before.items()], "doc_id long, range int"))
    value = F.struct(*[F.col(c).alias(f"next_{c}") for c in carried])
    edges = docs.join(wanted, "doc_id").groupBy("range").agg(F.min(value).alias("edge"))
    placed = keyed.withColumn("inside", F.lead(value).over(Window.partitionBy("known", "range").orderBy("doc_id", carried[0])))
    following = F.when(F.col("known"), F.coalesce("inside", "edge"))
    return placed.join(F.broadcast(edges.withColumn("known", F.lit(True))), ["known", "range"], "left").select("doc_id", *carried, *[following[f"next_{c}"].alias(f"next_{c}") for c in carried])


def _members(marked: DataFrame) -> DataFrame:
    """doc_id, rep and how many of the buckets that hold several documents; the largest buckets are met by broadcast."""
    known = marked.filter("doc_id is not null")
    buckets = materialize(known.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1"), "shared-fingerprints")
    hot = F.col("n") > F.lit(max(DEALT, known.count() // HOT))
    few = buckets.filter(hot)
    most = buckets.filter(~hot)
    one = known.join(F.broadcast(few), "fingerprint")
    rest = known.join(F.broadcast(few.select("fingerprint")), "fingerprint", "left_anti").join(F.broadcast(most) if most.count() <= BROADCAST else most, "fingerprint")
    out = materialize(one.unionByName(rest).select("doc_id", "rep", "n").distinct(), "buckets")
    discard(buckets)
    return out


def _groups(marked: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and group_id of the members of buckets of several documents, after comparing bytes."""
    members = _members(marked)
    named = F.broadcast(members) if members.count() <= BROADCAST else members
    # written once: joins on the canonical text would have Spark infer filters on it, and so compute it for every document
    texts = materialize(docs.join(named, "doc_id").select("doc_id", "rep", "n", canonical(F.col("t")).alias("c")), "bucket-texts")
    discard(members)
    parts = F.ceil(F.col("n") / DEALT).cast("int")
    reps = texts.filter("doc_id = rep").select("rep", F.col("c").alias("rep_c"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    compared = texts.withColumn("part", F.pmod(F.xxhash64("doc_id"), parts).cast("int")).join(reps, ["rep", "part"], "left").withColumn("same", F.col("c") == F.col("rep_c"))
    judged = materialize(compared.select("doc_id", "rep", F.coalesce("same", F.lit(False)).alias("same"), F.when(~F.coalesce("same", F.lit(False)), F.col("c")).alias("c")), "compared")
    discard(texts)
    equal = judged.filter("same").select("doc_id", F.col("rep").alias("group_id"))
    others = judged.filter("not same")
    own = others.groupBy("rep", "c").agg(F.min("doc_id").alias("group_id"))
    return equal.unionByName(others.join(own, ["rep", "c"]).select("doc_id", "group_id")).groupBy("doc_id").agg(F.min("group_id").alias("group_id"))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and group_id of every row."""
    plain = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = F.length("t")
    edited = F.concat(F.col("t").substr(F.lit(1), n - F.floor(n / 2)), F.coalesce(F.col("next_t").substr(F.lit(1), F.floor(n / 2)), F.lit("")))
    own = plain.withColumn("fingerprint", fingerprint(canonical(F.col("t"))))
    rows = with_next(own, ["t", "fingerprint"]).withColumn("edited", edited)
    like = lambda c: F.when(F.col("fingerprint") == c, 1.0).otherwise(0.0)
    edited_fingerprint = fingerprint(canonical(F.col("edited")))
    rows = rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        edited_fingerprint.alias("edited_fingerprint"),
        like(F.col("next_fingerprint")).alias("near_next"),
    )
    marked = materialize(rows, "fingerprints").withColumn("near_edited", like(F.col("edited_fingerprint")))
    out = marked.join(_groups(marked, plain), "doc_id", "left")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.coalesce("group_id", "doc_id").alias("group_id"))


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
