import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from sheetwise.llm import mixing
from sheetwise.llm.ordered import running_totals

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, "b", "one two three four"), (2, "b", None), (3, None, "words of no source " * 10), (4, "", "empty name " * 7), (5, "a", " \n "), (6, "c", "x y z " * 50), (6, "c", "x y z " * 50), (7, "é", "last by code point"),
    (None, "b", "no id at all"), (8, "B", "upper first " * 30), (9, "c", "word " * 500), (10, "b", "  lead\nand  tail \t"), (11, "zero", ""), (12, "\U0001f600", "far " * 3), (13, "�", "near " * 90),
]


def targets(sizes, share=100, repeats=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    words, full = sum(sizes.values()) * share // 100, set()
    while True:  # the excess of those above their most, reshared until none is
        left, among = words - sum(repeats * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and weight[s] * left > repeats * sizes[s] * among}
        if not more:
            return {s: float(repeats * sizes[s]) if s in full else weight[s] * left / among for s in names}
        full |= more


def brute(rows, share=100):
    by = defaultdict(list)
    for d, s, t in rows:
        w = WORD.findall(t or "")
        h = int(hashlib.sha256(f"{mixing.SEED}:{'' if d is None else d}".encode()).hexdigest()[:12], 16)
        by[s].append((-math.log((h + 0.5) / 2**48) / ((len(set(w)) + 1) / (len(w) + 1)), math.inf if d is None else d, len(w), d))
    sizes = {s: sum(x[2] for x in v) for s, v in by.items()}
    target, out = targets(sizes, share), []
    for s, v in by.items():
        epochs = math.floor(target[s]) // sizes[s] if sizes[s] else 0
        left = math.floor(target[s]) - epochs * sizes[s]
        for _, _, n, d in sorted(v, key=lambda x: x[:3]):
            out.append((d, s, n, sizes[s], round(target[s], 6), epochs * n + min(n, left)))
            left -= min(n, left)
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=str)


@pytest.mark.parametrize("share", [100, 37, 5])
def test_equals_brute_force(spark, share):
    docs = spark.createDataFrame([(*r, "clash") for r in ODD], "doc_id long, source string, text string, size string")
    out = mixing.mix(docs, share=share)
    assert got(out) == brute(ODD, share)
    taken = Counter()
    for r in out.collect():
        assert r.taken <= 3 * r.size and r.taken == r.epochs * r.size + r.part
        taken[r.source, math.floor(r.target)] += r.taken
    assert all(v == target for (_, target), v in taken.items())


def test_a_hot_source(spark):
    rows = [(k, "hot" if k % 3 else f"s{k % 40}", f"w{k} " * (k % 17)) for k in range(2000)]
    assert got(mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))) == brute(rows)


def test_many_full_sources(spark):
    rows = [(k, f"s{k:03}", "w " * (3**(k % 9))) for k in range(200)]
    assert got(mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))) == brute(rows)


def test_the_mix_itself(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, source string, text string")
    mixed = mixing.mix(docs, carry=("text",))
    copies = defaultdict(list)
    for r in mixing.mixture(mixed).collect():
        copies[r.doc_id, r.part, r.epochs].append((r.copy, r.text))
    for r in mixed.collect():
        own = sorted(copies[r.doc_id, r.part, r.epochs])
        assert sum(len(WORD.findall(t)) for _, t in own) == r.taken * sum(1 for o in mixed.collect() if (o.doc_id, o.part, o.epochs) == (r.doc_id, r.part, r.epochs))
        assert all(r.text.startswith(t) for _, t in own)


def test_tables_without_rows_or_words(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")
    assert {(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()} == {(0, 0.0, 0)}


def test_running_totals(spark):
    from pyspark.sql import functions as F

    rows = [(k % 3 if k % 2 else 0, k * 37 % 101, k) for k in range(500)]
    d = running_totals(spark.createDataFrame(rows, "g long, o long, v long"), ["g"], [F.col("o"), F.col("v")], {"before": "v"})
    for r in d.collect():
        assert r.before == sum(v for g, o, v in rows if g == r.g and (o, v) < (r.o, r.v))


def test_query_equals_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{small}/documents.parquet')")
    plain = lambda rows: sorted(([float(f"{v:.9g}") if isinstance(v, float) else v for v in r] for r in rows), key=str)
    d = mixing.op13_mixing(spark, small)
    assert plain(d.collect()) == plain(con.sql(f"SELECT {', '.join(d.columns)} FROM ({mixing.ORACLE_SQL})").fetchall())
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "text").collect()]
    assert sorted((r.doc_id, r.size, r.source_size, r.taken) for r in d.collect()) == sorted((b[0], b[2], b[3], b[5]) for b in brute(docs))
