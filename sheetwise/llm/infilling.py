"""Fill-in-the-middle: a document is cut in three at unit borders and its parts are put in another order.

Units are code points, words or lines. Where a unit starts is a predicate of a character and the one before it, so a text
can be cut into chunks that overlap by one character, and each chunk counts the starts it owns by itself. Running sums of
those counts say which chunk owns the start that a cut falls on, and only that chunk is read again to find its place.

A text of up to ``CHUNK`` code points is one chunk and stays where it is. The chunks of longer texts are written and dealt
over tasks; their counts, a row for each chunk, meet in a window by document, and each cut goes back to its chunk by a join.

Both cuts, and the form, come from a hash of the id. A text that is empty, that contains a mark, or that its hash leaves as it
is, stays plain. Null text is empty. A null doc_id has the hash of the empty id. Rows that repeat an id and text are
changed alike. An empty table gives no rows. Other columns pass through; those with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.llm.batches import arrow_schema, extended, map_batches, texts, with_columns
from sheetwise.runtime import materialize

#: Code points that a chunk owns.
CHUNK = 1 << 14
MARKS = ("<P>", "<S>", "<M>")
SEED = 1
#: Percent of the documents that stay plain, and of the others that have their suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: What stands before the first character of a text.
BEFORE = 10


def _blank(c: np.ndarray) -> np.ndarray:
    return (c == 32) | ((c >= 9) & (c <= 13))


#: Whether a unit starts at a character, given the one before it.
STARTS = {
    "characters": lambda before, now: np.ones(len(now), bool),
    "words": lambda before, now: _blank(before) & ~_blank(now),
    "lines": lambda before, now: before == 10,
}


def _starts(text: str, before: int, unit: str) -> np.ndarray:
    """Places in ``text``, which follows the character ``before``, where units start."""
    now = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.flatnonzero(STARTS[unit](np.concatenate([[before], now[:-1]]), now)) if len(now) else np.zeros(0, "int64")


def _hash(k: int, seed: int) -> Column:
    """The ``k``-th group of eight hex digits of the id's sha256, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _short_cuts(docs: DataFrame, text: str, unit: str) -> DataFrame:
    """``docs`` of one chunk each, with _n, _first and _second: units, and the places of the cuts that _a and _b choose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_a", "_b")))
            rows = []
            for t, (a, b) in zip(texts(batch, text), ranks):
                at = np.append(_starts(t, BEFORE, unit), len(t))
                n = len(at) - 1
                rows.append((n, *sorted((int(at[a % (n + 1)]), int(at[b % (n + 1)])))))
            yield with_columns(batch, {c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(("_n", "_first", "_second"))})

    return map_batches(docs, run, extended(docs, *[T.StructField(c, T.LongType()) for c in ("_n", "_first", "_second")]))


def _chunks(docs: DataFrame, text: str, chunk: int) -> DataFrame:
    """key, _a, _b, chunk, before and piece of long texts: each chunk with the character before it, dealt over tasks."""
    schema = T.StructType([T.StructField("key", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("_a", "_b", "chunk", "before")], T.StructField("piece", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "_a", "_b")))
            for t, own in zip(texts(batch, text), head):
                at = range(0, len(t), chunk)
                for few in (at[k : k + 256] for k in range(0, len(at), 256)):
                    columns = [[x] * len(few) for x in own] + [[s // chunk for s in few], [ord(t[s - 1]) if s else BEFORE for s in few], [t[s : s + chunk] for s in few]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow_schema(schema))], schema=arrow_schema(schema))

    return map_batches(docs.select("key", "_a", "_b", text), run, schema).repartition("key", "chunk")


def _counts(chunks: DataFrame, unit: str) -> DataFrame:
    schema = T.StructType([T.StructField("key", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("_a", "_b", "chunk", "n")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(batch.schema.get_field_index("before")).to_pylist()
            n = [len(_starts(p, b, unit)) for p, b in zip(texts(batch, "piece"), before)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in schema.names[:-1]), pa.array(n, pa.int64())], schema=arrow_schema(schema))

    return map_batches(chunks, run, schema).distinct()  # rows that repeat a text have the same chunks


def _places(owners: DataFrame, unit: str, chunk: int) -> DataFrame:
    """key, cut and place: where in its text the start of each cut's rank, counted within the owning chunk, lies."""
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("cut", T.IntegerType()), T.StructField("place", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            place = [k * chunk + int(_starts(p, b, unit)[r]) for k, p, b, r in zip(column("chunk").to_pylist(), texts(batch, "piece"), column("before").to_pylist(), column("rank").to_pylist())]
            yield pa.RecordBatch.from_arrays([column("key"), column("cut"), pa.array(place, pa.int64())], schema=arrow_schema(schema))

    return map_batches(owners.select("key", "cut", "chunk", "before", "piece", "rank"), run, schema)


def _long_cuts(docs: DataFrame, text: str, unit: str, chunk: int) -> DataFrame:
    """As ``_short_cuts``, for texts of several chunks."""
    own = docs.withColumn("key", F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col(text)).cast("binary"), 256))
    chunks = materialize(_chunks(own, text, chunk), "chunks")
    counts = materialize(_counts(chunks, unit), "chunk-counts")
    each = Window.partitionBy("key")
    ahead = each.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    d = counts.withColumns({"total": F.sum("n").over(each), "ahead": F.coalesce(F.sum("n").over(ahead), F.lit(0))})
    cuts = F.array(*[F.struct(F.lit(k).alias("cut"), (F.col(c) % (F.col("total") + 1)).alias("at")) for k, c in enumerate(("_a", "_b"))])
    d = d.select("key", "chunk", "n", "total", "ahead", F.explode(cuts).alias("c"))
    routed = d.filter((F.col("c.at") >= F.col("ahead")) & (F.col("c.at") < F.col("ahead") + F.col("n"))).select("key", "chunk", "c.cut", (F.col("c.at") - F.col("ahead")).alias("rank"))
    pieces = chunks.select("key", "chunk", "before", "piece").join(routed.select("key", "chunk").distinct(), ["key", "chunk"], "left_semi").dropDuplicates(["key", "chunk"])
    found = _places(pieces.join(routed, ["key", "chunk"]), unit, chunk)
    place = lambda k: F.max(F.when(F.col("cut") == k, F.col("place")))
    totals = counts.groupBy("key").agg(F.sum("n").alias("_n"))
    known = totals.join(found.groupBy("key").agg(place(0).alias("_p"), place(1).alias("_q")), "key", "left")
    d = own.join(known, "key")
    p, q = (F.coalesce(c, F.length(text).cast("long")) for c in ("_p", "_q"))  # a cut behind the last unit is in no chunk
    return d.withColumns({"_first": F.least(p, q), "_second": F.greatest(p, q)}).drop("key", "_p", "_q")


def fill_in_middle(
    docs: DataFrame, text: str = "text", unit: str = "characters", seed: int = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS, chunk: int = CHUNK
) -> DataFrame:
    """``docs`` with n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points; null if plain) and output."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumns({text: t, "_a": _hash(0, seed), "_b": _hash(1, seed)})
    short = _short_cuts(d.filter(F.length(text) <= chunk), text, unit)
    d = short.unionByName(_long_cuts(d.filter(F.length(text) > chunk), text, unit, chunk))
    stays = (F.length(text) == 0) | (_hash(2, seed) % 100 >= 100 - plain)
    for m in marks:
        stays = stays | F.col(text).contains(m)
    form = F.when(stays, "plain").when(_hash(3, seed) % 100 < suffix_first, "spm").otherwise("psm")
    d = d.withColumn("_form", form)
    part = lambda lo, hi: F.substr(F.col(text), (lo + 1).cast("int"), (hi - lo).cast("int"))
    prefix, middle, suffix = part(F.lit(0), F.col("_first")), part(F.col("_first"), F.col("_second")), part(F.col("_second"), F.length(text))
    p, s, m = (F.lit(x) for x in marks)
    output = F.when(F.col("_form") == "plain", F.col(text)).when(F.col("_form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    moved = F.col("_form") != "plain"
    out = {"n": F.col("_n"), "form": F.col("_form"), "prefix_chars": F.when(moved, F.col("_first")), "middle_chars": F.when(moved, F.col("_second") - F.col("_first")), "output": output}
    return d.select(*[c for c in docs.columns if c not in out], *[v.alias(k) for k, v in out.items()])


def restore(done: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``done`` (form and output) with the text ``restored``. A moved text holds no mark of its own, so the first of each counts."""
    out = F.col("output")
    at = {k: F.instr(out, m) for k, m in zip("psm", marks)}
    size = {k: len(m) for k, m in zip("psm", marks)}
    between = lambda k, until: F.substr(out, at[k] + size[k], (F.length(out) + 1 if until is None else at[until]) - at[k] - size[k])
    psm = F.concat(between("p", "s"), between("m", None), between("s", "m"))
    spm = F.concat(between("p", "m"), between("m", None), between("s", "p"))
    return done.withColumn("restored", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(out))


def op12_infilling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return restore(fill_in_middle(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS hex FROM documents),
h AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST(('0x' || substr(hex, 1, 8)) AS BIGINT) % (length(t) + 1) AS a, CAST(('0x' || substr(hex, 9, 8)) AS BIGINT) % (length(t) + 1) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST(('0x' || substr(hex, 17, 8)) AS BIGINT) % 100 >= 90 THEN 'plain'
       WHEN CAST(('0x' || substr(hex, 25, 8)) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, substr(t, 1, least(a, b)) AS prefix, substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS middle, substr(t, greatest(a, b) + 1) AS suffix FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(least(a, b) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(greatest(a, b) - least(a, b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM c
"""
