"""Quality rules: one threshold table compiled into one Spark projection, with built-in functions only.

Words are ``[^\\x20\\x09-\\x0D]+``. Every statistic is an exact integer over the whole text, and every rule compares
integers, so that verdicts do not depend on floating point. A null, empty or blank text has no words and fails the
base rule. Extra input columns pass through; columns of the same names as the statistics are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages that the corpus has.
STOP_WORDS = (
    "the of and to in is that it for was on with as by be are this from at or an "
    "de la le les et des en un une du que qui dans pour par sur est au avec "
    "der die das und den von zu mit ist im dem nicht ein eine als auf für sich auch es "
    "el los las y se del con una su para al lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if ``least * per <= scale * value`` and ``scale * value <= most * per`` hold for the bounds given."""

    name: str
    value: str
    per: str
    scale: int = 1000
    least: int | None = None
    most: int | None = None


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 100, least=200, most=1500),
    Rule("symbols_per_word", "n_symbols", "n_words", most=100),
    Rule("shouts_per_word", "n_shouts", "n_words", most=250),
    Rule("stop_words_per_word", "n_stop_words", "n_words", least=40),
    Rule("dup_lines_per_line", "n_dup_lines", "n_lines", most=500),
    Rule("repeat_words_per_word", "n_repeat_words", "n_words", most=300),
)
MIN_WORDS = 50


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeat_words(words: str, hashes: str, bits: str) -> Column:
    """Words within 3-word windows that occur twice or more. Equal hashes meet in a sorted array of packed
    (hash, position) longs, and the words themselves are compared before a window counts."""
    low = f"(shiftleft(1L, {bits}) - 1L)"
    sorted_windows = f"sort_array(transform({hashes}, (h, i) -> shiftleft(h, {bits}) | cast(i as bigint)))"

    def same(k: int) -> str:
        return f"get({words}, cast(a & {low} as int) + {k}) = get({words}, cast(b & {low} as int) + {k})"

    equal = f"shiftrightunsigned(a, {bits}) = shiftrightunsigned(b, {bits}) and " + " and ".join(same(k) for k in range(3))
    pairs = f"transform(array({sorted_windows}), p -> zip_with(p, slice(p, 2, size(p)), (a, b) -> if({equal}, array(a & {low}, b & {low}), null)))[0]"
    starts = f"sort_array(array_distinct(flatten(filter({pairs}, x -> x is not null))))"
    covered = (
        f"transform(array({starts}), s -> aggregate(zip_with(s, slice(s, 2, size(s)), (a, b) -> least(3L, coalesce(b - a, 3L))), 0L, (t, x) -> t + x))[0]"
    )
    return F.expr(f"if(size(array_distinct({hashes})) = size({hashes}), 0L, {covered})")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_shouts, n_stop_words, n_lines, n_dup_lines and n_repeat_words (all long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    d = docs.withColumns({"_words": words, "_lines": lines})
    d = d.withColumns(
        {
            "_hashes": F.expr("if(size(_words) < 3, cast(array() as array<bigint>), slice(transform(_words, (w, i) -> xxhash64(w, get(_words, i + 1), get(_words, i + 2))), 1, size(_words) - 2))"),
            "_bits": F.expr("cast(ceil(log2(size(_words) + 2)) as int)"),
        }
    )
    statistics = {
        "n_words": F.size("_words"),
        "word_chars": F.length(_without(t, BLANKS)),
        "n_symbols": F.length(t) - F.length(_without(t, SYMBOLS)),
        "n_shouts": F.length(t) - F.length(_without(t, "!")),
        "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": _repeat_words("_words", "_hashes", "_bits"),
    }
    # inline() keeps a filter on a statistic above the projection that computes it; pushed below, it would split again for each word
    d = d.select(*[c for c in d.columns if c not in statistics], F.inline(F.array(F.struct(*[v.cast("long").alias(k) for k, v in statistics.items()]))))
    return d.drop("_words", "_lines", "_hashes", "_bits")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression."""
    out = F.lit(True)
    for r in rules:
        value = F.col(r.value) * r.scale
        if r.least is not None:
            out = out & (value >= F.col(r.per) * r.least)
        if r.most is not None:
            out = out & (value <= F.col(r.per) * r.most)
    return out


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the statistics, base_failed and kept. Repeated rows are judged one by one; an empty table gives none."""
    base_failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return with_statistics(docs, text).withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).drop("text")


def _in_sql(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


def _verdict_sql() -> str:
    parts = []
    for r in RULES:
        parts += [f"{r.value} * {r.scale} >= {r.per} * {r.least}"] if r.least is not None else []
        parts += [f"{r.value} * {r.scale} <= {r.per} * {r.most}"] if r.most is not None else []
    return " AND ".join(parts)


_SPACE = "[\\x20\\x09-\\x0D]"
ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '{_SPACE}+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT doc_id, i, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM g WHERE c IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + s) AS n_repeat_words FROM n, (VALUES (0), (1), (2)) v(s) WHERE k > 1 GROUP BY doc_id),
s AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_shouts,
             CAST(len(list_filter(words, lambda x: lower(x) IN ({_in_sql(STOP_WORDS)}))) AS BIGINT) AS n_stop_words,
             CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
b AS (SELECT *, (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * 50) AS base_failed FROM s)
SELECT *, (NOT base_failed AND {_verdict_sql()}) AS kept FROM b
"""
