import hashlib
import re

import duckdb
import pytest

from sheetwise.llm import infilling

STARTS = {"characters": lambda t: range(len(t)), "words": lambda t: [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)], "lines": lambda t: [i for i in range(len(t)) if i == 0 or t[i - 1] == "\n"]}
ODD = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "abc def\nghi"), (5, "abc def\nghi"), (6, "with <P> mark"), (7, "<<S"), (8, "é\U0001f600日本\n\n語 " * 50), (9, "word  \t next\n" * 300),
    (10, "x" * 700), (None, "no id but a text, long enough to be cut"), (11, "\n\n\n\n"), (12, "<P" * 40), (13, " lead and tail "), (14, "M>" * 30),
]


def brute(doc_id, text, unit, plain=10, suffix_first=20):
    t = text or ""
    hex_ = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hex_[8 * k : 8 * k + 8], 16) for k in range(4)]
    at = [*STARTS[unit](t), len(t)]
    n = len(at) - 1
    a, b = sorted(at[x % (n + 1)] for x in h[:2])
    form = "plain" if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain else "spm" if h[3] % 100 < suffix_first else "psm"
    out = {"plain": t, "psm": f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "spm": f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"}[form]
    return (doc_id, n, form, None if form == "plain" else a, None if form == "plain" else b - a, out, t)


@pytest.mark.parametrize("unit", list(STARTS))
@pytest.mark.parametrize("chunk", [1, 64])
def test_equals_brute_force(spark, unit, chunk):
    docs = spark.createDataFrame([(d, t, "clash") for d, t in ODD], "doc_id long, text string, form string")
    done = infilling.restore(infilling.fill_in_middle(docs, unit=unit, chunk=chunk, plain=5, suffix_first=50))
    got = sorted((tuple(r) for r in done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()), key=str)
    assert got == sorted((brute(d, t, unit, 5, 50) for d, t in ODD), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert infilling.restore(infilling.fill_in_middle(none)).count() == 0


def test_only_owning_chunks_are_read_again(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"{k} " * 500) for k in range(20)], "doc_id long, text string")
    seen = []
    real = infilling._places
    monkeypatch.setattr(infilling, "_places", lambda owners, unit, chunk: seen.append(owners.select("key", "chunk").distinct().count()) or real(owners, unit, chunk))
    assert infilling.fill_in_middle(docs, chunk=16).count() == 20
    assert seen[0] <= 40


def test_query_equals_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{small}/documents.parquet')")
    got = infilling.op12_infilling(spark, small)
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert rows == sorted((tuple(r) for r in con.sql(f"SELECT {', '.join(got.columns)} FROM ({infilling.ORACLE_SQL})").fetchall()), key=str)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert rows == sorted(((*b[:5], digest(b[5]), digest(b[6])) for b in (brute(d, t, "characters") for d, t in docs)), key=str)
