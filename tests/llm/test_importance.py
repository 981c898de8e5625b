import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from sheetwise.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def features(text, n):
    w = words(text)
    return [" ".join(w[i : i + k]) for i in range(len(w)) for k in range(1, n + 1) if i + k <= len(w)]


def brute(docs, target, n=1, buckets=10_000, percent=10, least=20, seed=2024):
    code = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(code(f) for x in side for f in features(x, n)) for side in ([x for _, x in docs], target))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets))))
    rows = []
    for d, x in docs:
        f = features(x, n)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(code(y)) for y in f)
        rows.append([d, len(words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ODD = [(1, None), (2, ""), (3, " \n"), (4, "A" * 5000 + " tail"), (5, "Été naïve İstanbul 42\x00x ẞ " * 30), (5, "Été naïve İstanbul 42\x00x ẞ " * 30), (6, "word other " * 400), (7, "...!" * 400 + "the end"), (None, "no id here " * 9), (8, "one two three"), (9, "日本 語 " * 200), (10, "x" * 39 + " y" + "z" * 200 + " " + "w " * 100)]


@pytest.mark.parametrize("n", [1, 3])
@pytest.mark.parametrize("chunk", [7, 1 << 14])
def test_equals_brute_force(spark, n, chunk):
    target = ["Word the END of naïve text", None, "日本 tail y"]
    docs = spark.createDataFrame([(d, x, "clash") for d, x in ODD], "doc_id long, text string, weight string")
    out = importance.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), n=n, buckets=97, percent=60, chunk=chunk)
    assert got(out) == brute(ODD, target, n, 97, 60)


def test_chunks_give_back_the_words(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    for n in (1, 3):
        parts = {}
        for r in importance.chunks_of(docs.dropDuplicates(["doc_id"]), n=n, chunk=11).collect():
            parts.setdefault(r.doc_id, {})[r.chunk] = r
        for d, x in ODD:
            own = [words(parts[d][k].own) for k in sorted(parts[d])]
            assert sum(own, []) == words(x)
            for k in parts[d]:
                assert words(parts[d][k].carry) == sum(own[k + 1 :], [])[: n - 1]
            assert len(x or "") < 12 or len(parts[d]) > 1 or len(words(x)) == 1


def test_empty_tables(spark):
    docs, none = spark.createDataFrame(ODD, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, docs).count() == 0
    assert got(importance.resample(docs, none)) == brute(ODD, [])


def test_rows_without_a_hash_of_their_own(spark):
    """A hot score: all rows alike, more than one range of them."""
    rows = [(7, "same words here again " * 6)] * 300 + [(8, "other")] * 20
    assert got(importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("words",)], "text string"))) == brute(rows, ["words"])


def test_query_equals_sql(spark, small):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    rows = importance.op11_importance(spark, small).select("doc_id", "n_features", "weight", "score", "rank")
    assert got(rows) == sorted((tuple(r) for r in con.sql(importance.ORACLE_SQL).fetchall()), key=str)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    target = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert got(rows) == sorted(((r[0], *r[2:]) for r in brute([tuple(r) for r in docs], target)), key=str)
