"""Personal data: base patterns, and bootstrapped contextual extraction of further identifiers. Built-in functions only.

Base kinds are email, ip, card and phone, each matched from left to right without overlaps. Positions come from the
lengths of the parts between matches, so they are characters (code points) and nothing is scanned by hand. Dots and
separators inside runs are first replaced, one character for one, so that each pattern is a run of one character class:
no pattern nests loops, and long runs cost neither stack nor quadratic time.

Bootstrapping: the base matches are the seed instances, of score 1. Every instance, seed or candidate (a run of
``SHORTEST`` or more letters and digits, with a digit, outside the base spans), has lexical patterns: the word to its left
(at most its last ``CONTEXT`` characters, digits as 9), with the kind of character to its right. On the bipartite graph of
patterns and instances Spark alternates two steps. A pattern's confidence is the mean score of its instances (with
``PRIOR`` instances of score 0 added); with ``SUPPORT`` known instances and a confidence of ``CONFIDENCE`` it is trusted.
A candidate's score is the chance that not all its trusted patterns err, and never falls; from ``CONFIDENCE`` on the
candidate is known, and supports further patterns with its score. Rounds end when one makes no further candidate known
and raises no score by more than ``RISE``, so chains of discoveries are followed to their end.
Known candidates that stand in a trusted pattern become spans of the kind id. Base spans always stay.

Null text is empty. Repeated rows are read one by one. An empty table gives no rows. Columns of the caller named email,
ip, card, phone or id give way to the result's; those of any other name stay (names that begin with _pii_ are ours).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.runtime import discard, materialize

KINDS = ("email", "ip", "card", "phone")
SHORTEST = 5
PRIOR = 1.0
SUPPORT = 3
CONFIDENCE = 0.7
RISE = 0.001
#: Characters of the word to the left that make a pattern.
CONTEXT = 24
#: Accepted patterns (some 30 bytes each) that may be broadcast.
BROADCAST = 500_000
_MARK = "\u0001"
_LOCAL = f"[A-Za-z0-9._%+{_MARK}-]"
_SPAN = "array<struct<start:int,end:int,value:string>>"


def _scan(items: Column, zero: Column, step) -> Column:
    """Running states of ints: step over all items so far, for each item. In blocks, so that building the array takes
    neither quadratic time nor a deep expression."""
    size = 64
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")), lambda b: F.slice(items, b * size + 1, size))
    carried = F.aggregate(blocks, F.array(zero), lambda acc, block: F.concat(acc, F.array(F.aggregate(block, F.element_at(acc, -1), step))))
    inner = F.zip_with(blocks, carried, lambda block, first: F.slice(F.aggregate(block, F.array(first), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x)))), 2, size))
    return F.when(F.size(items) > 0, F.flatten(F.filter(inner, lambda x: x.isNotNull()))).otherwise(F.array().cast("array<int>"))


def _matches(text: Column, read: Column, pattern: str, possible: Column) -> Column:
    """Spans of ``pattern`` in ``read``, whose characters stand where those of ``text`` do; none where not ``possible``."""
    values = F.regexp_extract_all(read, F.lit(pattern), F.lit(0))
    # let-bindings: each array is computed once
    found = F.transform(
        F.array(F.struct(values.alias("v"), F.split(read, pattern, -1).alias("p"))),
        lambda x: F.struct(x["v"].alias("v"), F.zip_with(x["v"], F.slice(x["p"], 1, F.size(x["v"])), lambda v, p: F.length(p) + F.length(v)).alias("n")),
    )
    spans = F.transform(found, lambda x: F.zip_with(x["v"], _scan(x["n"], F.lit(0), lambda s, n: s + n), lambda v, end: F.struct((end - F.length(v)).alias("start"), end.alias("end"), F.substr(text, end - F.length(v) + 1, F.length(v)).alias("value"))))
    return F.when(possible & read.rlike(pattern), spans[0]).otherwise(F.array().cast(_SPAN))


def _luhn(value: Column) -> Column:
    digits = F.split(F.regexp_replace(value, "[^0-9]", ""), "")
    total = F.aggregate(
        F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.floor(d.cast("int") * 2 / 10).cast("int") + d.cast("int") * 2 % 10)),
        F.lit(0),
        lambda s, d: s + F.coalesce(d, F.lit(0)),
    )
    return total % 10 == 0


def _n_digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def with_base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the arrays email, ip, card and phone of (start, end, value)."""
    t = F.coalesce(F.col(text), F.lit(""))
    clean = F.translate(t, _MARK, "\u0002")
    dotted = F.regexp_replace(clean, "(?<=[A-Za-z0-9-])\\.(?=[A-Za-z0-9-])", _MARK)
    grouped = F.regexp_replace(clean, "(?<=[0-9])[\\x20-](?=[0-9])", _MARK)
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    d = docs.withColumns({"_pii_at": F.instr(t, "@") > 0, "_pii_plus": F.instr(t, "+") > 0, "_pii_digit": t.rlike("[0-9][0-9.\\x20-]")})
    return d.withColumns(
        {
            "email": _matches(t, dotted, f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++{_MARK}[A-Za-z0-9{_MARK}-]++", F.col("_pii_at")),
            "ip": F.filter(_matches(t, clean, "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", F.col("_pii_digit")), lambda s: s["value"].rlike(f"^{part}\\.{part}\\.{part}\\.{part}$")),
            "card": F.filter(
                _matches(t, grouped, f"(?<![0-9{_MARK}])[0-9](?:{_MARK}?[0-9]){{12,18}}(?![0-9{_MARK}])", F.col("_pii_digit")), lambda s: _luhn(s["value"])
            ),
            "phone": F.filter(_matches(t, clean, "\\+[0-9][\\x20().0-9-]+[0-9]", F.col("_pii_plus")), lambda s: _n_digits(s["value"]).between(9, 15)),
        }
    ).drop("_pii_at", "_pii_plus", "_pii_digit")


def with_candidates(based: DataFrame, text: str = "text") -> DataFrame:
    """Adds the array _pii_candidates of (start, end, value): identifier-like runs outside the base spans."""
    t = F.coalesce(F.col(text), F.lit(""))
    taken = F.concat(*[F.col(k) for k in KINDS])
    runs = _matches(t, t, f"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{{{SHORTEST},}}+", t.rlike("[0-9]"))
    free = F.filter(runs, lambda c: ~F.exists(taken, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return based.withColumn("_pii_candidates", free)


def _pattern(t: Column, span: Column) -> Column:
    """What stands left of a span, digits as 9, and the kind of the character to its right."""
    first = F.greatest(span["start"] - CONTEXT, F.lit(0))
    left = F.regexp_extract(F.lower(F.substr(t, first + 1, span["start"] - first)), "(\\S*\\s?)$", 1)
    right = F.substr(t, span["end"] + 1, F.lit(1))
    kind = F.when(right == "", "end").when(right.rlike("\\s"), "space").when(right.rlike("[\\p{L}\\p{N}]"), "word").otherwise(right)
    return F.concat(F.regexp_replace(left, "[0-9]+", "9"), F.lit("\t"), kind)


def _value(span: Column) -> Column:
    return F.xxhash64(F.lower(span["value"]))


def _instances(found: DataFrame, text: str) -> DataFrame:
    """(pattern, value, seed) of every span, distinct."""
    t = F.coalesce(F.col(text), F.lit(""))
    of = lambda c, seed: F.transform(c, lambda s: F.struct(_pattern(t, s).alias("pattern"), _value(s).alias("value"), F.lit(seed).alias("seed")))
    rows = F.concat(of(F.concat(*[F.col(k) for k in KINDS]), True), of(F.col("_pii_candidates"), False))
    return found.select(F.inline(rows)).groupBy("pattern", "value").agg(F.max("seed").alias("seed"))


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST else df


def learn_patterns(found: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The trusted patterns (pattern, confidence, n_known) and the known candidates (value, score), at the fixpoint.

    Hot patterns are summed before they are shuffled, and only trusted patterns and known candidates meet the edges
    again: by broadcast where they are few.
    """
    edges = materialize(_instances(found, text), "pattern-edges")
    seeds = edges.filter("seed").select("value").distinct()
    known = None
    while True:
        scored = edges.withColumn("score", F.lit(None).cast("double")) if known is None else edges.join(_sized(known.select("value", "score")), "value", "left")
        score = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
        summed = scored.groupBy("pattern").agg((F.sum(score) / (F.count("*") + PRIOR)).alias("confidence"), F.sum(F.when(score > 0, 1).otherwise(0)).alias("n_known"))
        patterns = materialize(summed.filter((F.col("n_known") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)), "patterns")
        trusted = patterns.select("pattern", F.least("confidence", F.lit(0.999)).alias("trust"))
        reached = edges.filter("not seed").join(_sized(trusted), "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("score"))
        reached = reached.filter(F.col("score") >= CONFIDENCE).join(seeds, "value", "left_anti").withColumn("before", F.lit(0.0))
        if known is not None:
            reached = reached.unionByName(known.select("value", "score", F.col("score").alias("before")))
        last, known = known, materialize(reached.groupBy("value").agg(F.max("score").alias("score"), F.max("before").alias("before")), "known-candidates")
        if last is not None:
            discard(last)
        if not known.filter(F.col("score") > F.col("before") + RISE).limit(1).count():
            discard(edges)
            return patterns, known
        discard(patterns)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with email, ip, card, phone and id: arrays of (start, end, value), in order of start."""
    key = "_pii_row"
    found = materialize(with_candidates(with_base_spans(docs, text), text).withColumn(key, F.monotonically_increasing_id()), "pii")
    patterns, known = learn_patterns(found, text)
    t = F.coalesce(F.col(text), F.lit(""))
    spans = F.transform("_pii_candidates", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), _pattern(t, s).alias("pattern"), _value(s).alias("hash")))
    held = found.filter(F.size("_pii_candidates") > 0).select(key, F.inline(spans))
    kept = held.join(_sized(patterns.select("pattern")), "pattern", "left_semi").join(_sized(known.select(F.col("value").alias("hash"))), "hash", "left_semi")
    ids = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "value"))).alias("id"))
    return found.drop("id").join(ids, key, "left").withColumn("id", F.coalesce("id", F.array().cast(_SPAN))).drop(key, "_pii_candidates")


def span_text(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by kind and start, joined by commas."""

    def parts(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(parts, kinds)), ",")


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """``found`` of find_pii with each span of ``text`` replaced by its kind in brackets; overlapping spans join, and take
    the kind of the first."""
    t = F.coalesce(F.col(text), F.lit(""))

    def named(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(f"[{kind.upper()}]").alias("name")))

    d = found.withColumn("_pii_spans", F.array_sort(F.concat(*map(named, (*KINDS, "id")))))
    d = d.withColumn("_pii_ends", _scan(F.transform("_pii_spans", lambda x: -x["back"]), F.lit(0), lambda a, b: F.greatest(a, b)))
    pieces = F.transform(
        F.arrays_zip(F.col("_pii_spans").alias("s"), F.concat(F.array(F.lit(0)), F.slice("_pii_ends", 1, F.size("_pii_ends") - 1)).alias("e")),
        lambda x: F.when(x["s"]["start"] >= x["e"], F.concat(F.substr(t, x["e"] + 1, x["s"]["start"] - x["e"]), x["s"]["name"])).otherwise(""),
    )
    done = F.concat(F.array_join(pieces, ""), F.substr(t, F.element_at("_pii_ends", -1) + 1))
    return d.withColumn(text, F.when(F.size("_pii_spans") > 0, done).otherwise(F.col(text))).drop("_pii_spans", "_pii_ends")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in (*KINDS, "id")]
    return found.select("doc_id", *counts, F.sha2(span_text(KINDS).cast("binary"), 256).alias("base_sha256"), span_text((*KINDS, "id")).alias("spans"))
