"""Importance resampling towards a target distribution, by hashed runs of words.

A feature is a run of 1 to ``n`` consecutive words, its bucket the crc32 of its bytes modulo ``buckets``. A bucket's gain
is the logarithm of its smoothed share in the target texts over that in the documents, a document's weight the sum of
gains over its features, and the documents drawn are those of the highest weight plus Gumbel noise that its id fixes.

A text longer than ``CHUNK`` code points is cut into chunks at the ends of words. A chunk owns the runs that start in it and
carries the n-1 words that follow, so that runs over a cut count once; chunks are dealt over tasks, and what they find is
summed by document. Words are coded once and written as buckets; both passes read those. The order of scores is found by
ranges, so no task sees all documents.

Null and empty texts have no words: weight 0, and they are never drawn, as texts under ``least_words`` are not. A null doc_id
has the noise of the empty id. Repeated rows are scored and drawn one by one. An empty table draws nothing; with an empty
target all gains come from smoothing. Other columns of the documents are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.ordered import running_totals
from sheetwise.runtime import discard, materialize

#: Code points after which a text is cut at the next end of a word.
CHUNK = 1 << 14
BUCKETS = 10_000
#: Characters outside words, lower-casing done.
OUTSIDE = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(text: Column) -> Column:
    """A-Z lower-cased only; a text in ASCII can take the faster way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{OUTSIDE}]+"), lambda w: w != "")


def _carries(pieces: str, n: int) -> str:
    """For each piece the n-1 words after it, from the pieces behind: a fold from the last piece to the first."""
    outside = OUTSIDE.replace("\\", "\\\\")  # within SQL text
    head = f"regexp_extract(p, '^[{outside}]*(?:[^{outside}]+[{outside}]*){{0,{n - 1}}}', 0)"
    first = f"slice(filter(split(concat({head}, ' ', s[0]), '[{outside}]+'), w -> w <> ''), 1, {n - 1})"
    # s[0] is the carry of the piece at hand, which the next step prefixes; reversed at the end
    return f"reverse(aggregate(reverse({pieces}), array(''), (s, p) -> concat(array(array_join({first}, ' ')), s), s -> reverse(slice(s, 2, size(s) - 1))))"


def chunks_of(docs: DataFrame, text: str = "text", n: int = 1, chunk: int = CHUNK) -> DataFrame:
    """doc_id, key (null for a text in one chunk), chunk, own and carry: the text of each chunk and the words behind it."""
    t = F.coalesce(F.col(text), F.lit(""))
    plain = docs.select("doc_id", _lowered(t).alias("t"))
    short = plain.filter(F.length("t") <= chunk).select("doc_id", F.lit(None).cast("string").alias("key"), F.lit(0).alias("chunk"), F.col("t").alias("own"), F.lit("").alias("carry"))
    # NUL is no character of a word: it marks the cuts, each behind the word that the chunk's last code point belongs to
    cut = F.split(F.regexp_replace("t", f"(?s).{{{chunk}}}[^{OUTSIDE}]*+", "$0\x00"), "\x00")
    long = plain.filter(F.length("t") > chunk).select("doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("key"), cut.alias("_pieces"))
    if n > 1:
        long = long.select("doc_id", "key", F.posexplode(F.arrays_zip(F.col("_pieces").alias("own"), F.expr(_carries("_pieces", n)).alias("carry"))).alias("chunk", "piece")).select("doc_id", "key", "chunk", "piece.own", "piece.carry")
    else:
        long = long.select("doc_id", "key", F.posexplode("_pieces").alias("chunk", "own")).withColumn("carry", F.lit(""))
    return short.unionByName(long.repartition("key", "chunk"))


def coded(docs: DataFrame, text: str = "text", n: int = 1, buckets: int = BUCKETS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, key, chunk, n_words and codes: how many words each chunk owns and the buckets of the runs that start in it."""
    d = chunks_of(docs, text, n, chunk).withColumns({"_own": _words(F.col("own")), "_words": _words(F.concat("own", F.lit(" "), "carry"))} if n > 1 else {"_own": _words(F.col("own"))})

    def runs_of(k: int) -> Column:
        starts = F.slice("_own", F.lit(1), F.greatest(F.least(F.size("_own"), F.size("_words") - k + 1), F.lit(0)))
        return F.transform(starts, lambda _, i: F.crc32(F.array_join(F.slice("_words", i + 1, F.lit(k)), " ").cast("binary")) % buckets)

    runs = [F.transform("_own", lambda w: F.crc32(w.cast("binary")) % buckets), *(runs_of(k) for k in range(2, n + 1))]
    codes = F.concat(*runs) if n > 1 else runs[0]
    return d.select("doc_id", "key", "chunk", F.size("_own").cast("long").alias("n_words"), codes.cast("array<int>").alias("codes"))


def _counts(codes: DataFrame, name: str) -> DataFrame:
    return codes.select(F.explode("codes").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains_of(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket in thousandths; both sides are ``coded``. Only these ``buckets`` numbers reach the driver."""
    both = documents.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(_counts(documents, "s"), "bucket", "left").join(_counts(target, "t"), "bucket", "left")
    both = both.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"]).toArrow().to_pylist()
    total = {c: sum(r[c] for r in both) for c in "st"}
    rows = documents.sparkSession.createDataFrame([(r["bucket"], r["s"], r["t"]) for r in both], "bucket int, s double, t double")
    ratio = (F.col("t") + 1) * (F.lit(total["s"]) + buckets) / ((F.col("s") + 1) * (F.lit(total["t"]) + buckets))
    found = dict(rows.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio))).collect())
    return [found[b] for b in range(buckets)]


def weighed(codes: DataFrame, gains: list[int]) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row that ``codes`` came from."""
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")
    weight = F.aggregate("codes", F.lit(0).cast("long"), lambda a, b: a + F.element_at(table, b + 1))
    d = codes.select("doc_id", "key", "chunk", "n_words", F.size("codes").cast("long").alias("n_features"), weight.alias("weight"))
    names = ("n_words", "n_features", "weight")
    # rows that repeat an id and its text have the same chunks: their sums are shared out again
    sums = d.filter("key is not null").groupBy("doc_id", "key").agg(F.count_if(F.col("chunk") == 0).alias("times"), *[F.sum(c).alias(c) for c in names])
    long = sums.select("doc_id", *[F.expr(f"{c} div times").alias(c) for c in names], F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).drop("col")
    return d.filter("key is null").select("doc_id", *names).unionByName(long)


def noise(seed: int) -> Column:
    """Gumbel noise of a document in thousandths, from sha256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", n: int = 1, buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: int = 2024, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; rank is null where it isn't drawn. ``percent``
    of the documents with ``least_words`` words are drawn, the highest scores first, ties to the smaller doc_id."""
    codes = materialize(coded(docs, text, n, buckets, chunk), "codes")
    gains = gains_of(codes, coded(target, text, n, buckets, chunk) if "doc_id" in target.columns else coded(target.withColumn("doc_id", F.lit(None).cast("long")), text, n, buckets, chunk), buckets)
    scored = materialize(weighed(codes, gains).withColumn("score", F.col("weight") + noise(seed)), "scored")
    discard(codes)
    able = F.col("n_words") >= least_words
    drawn = scored.filter(able).count() * percent // 100
    place = running_totals(scored.filter(able).withColumn("_one", F.lit(1).cast("long")), [], [F.desc("score"), F.asc_nulls_last("doc_id")], {"_place": "_one"})
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    ranked = place.select(*columns, F.when(F.col("_place") < drawn, F.col("_place") + 1).alias("rank"))
    return ranked.unionByName(scored.filter(~able).select(*columns, F.lit(None).cast("long").alias("rank")))


def op11_importance(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs.select("doc_id", "text"), target.select("text")).select("doc_id", "n_features", "weight", "score", "rank")


_CODE = """list_reduce([CAST(('0x' || substr(hex(encode(word)), 2 * i + 1, 2)) AS BIGINT) for i in range(strlen(word))],
  lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295)"""
ORACLE_SQL = rf"""
WITH crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b) ORDER BY b) AS steps FROM range(256) r(b)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
x AS (SELECT doc_id, word, count(*) AS k FROM (SELECT doc_id, unnest(words) AS word FROM d) GROUP BY 1, 2),
y AS (SELECT word, count(*) AS k FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark) GROUP BY 1),
w AS (SELECT word, xor({_CODE}, 4294967295) % 10000 AS bucket FROM (SELECT word FROM x UNION SELECT word FROM y), crc),
s AS (SELECT bucket, sum(k) AS s FROM x JOIN w USING (word) GROUP BY 1), t AS (SELECT bucket, sum(k) AS t FROM y JOIN w USING (word) GROUP BY 1),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS ns, (SELECT coalesce(sum(t), 0) FROM t) AS nt),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(ns + 10000 AS DOUBLE) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(nt + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM (SELECT * FROM s FULL JOIN t USING (bucket)), n),
v AS (SELECT x.doc_id, CAST(sum(k * gain) AS BIGINT) AS weight FROM x JOIN w USING (word) JOIN g USING (bucket) GROUP BY 1),
o AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('2024:' || d.doc_id), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN v ON v.doc_id = d.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM o WHERE n_features >= 20)
SELECT o.doc_id, n_features, weight, score, r.rank FROM o LEFT JOIN r ON r.doc_id = o.doc_id AND r.rank <= 10 * able // 100
"""
