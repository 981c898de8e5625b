import hashlib
import re
import unicodedata

import pytest
import xxhash

from sheetwise.llm import fingerprints as fp

SPACE = re.compile("[\\s\x1c-\x1f\x85\xa0  -     　]+")


def canonical(text):
    normal = lambda t: unicodedata.normalize("NFKC", t)
    return SPACE.sub(" ", normal(normal(text).casefold())).strip(" ")


def digest(text):
    c = canonical(text).encode()
    salted = xxhash.xxh64_intdigest(b"wide", 42)
    return f"{xxhash.xxh64_intdigest(c, 42):016x}{xxhash.xxh64_intdigest(c, salted):016x}"


def brute(rows):
    rows = sorted((d, t or "") for d, t in rows)
    groups = {}
    for d, t in rows:
        groups[canonical(t)] = min(d, groups.get(canonical(t), d))
    out = []
    for k, (d, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), digest(t), digest(e), float(digest(t) == digest(e)), float(digest(t) == digest(nxt)), groups[canonical(t)]))
    return out


COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id")


@pytest.mark.parametrize("bucket", [2, 256])
def test_equals_brute_force(spark, small, monkeypatch, bucket):
    monkeypatch.setattr(fp, "RANGE", bucket)
    monkeypatch.setattr(fp, "DEALT", bucket)
    rows = [(r.doc_id * 7, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000, "Café  au LAIT ﬁn"), (10_001, "café au lait fin "), (10_900, "ＡＢＣ ế x"), (90_000, "abc ế X"), (10_950, "\U0001d400bc"), (10_951, "Abc"), (10_952, "Straße ΣΑΣ ς"), (10_953, "STRASSE σας Σ"), (90_001, None), (90_002, " ")]
    got = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == sorted(brute(rows))


def test_odd_rows(spark, odd):
    got = fp.fingerprints(odd).collect()
    assert len(got) == odd.count()
    known = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got if r.doc_id is not None) == sorted(brute(known))
    (unknown,) = [r for r in got if r.doc_id is None]
    assert unknown.group_id is None and unknown.near_next == 0 and unknown.n_chars == 10
    assert fp.fingerprints(odd.limit(0)).count() == 0


def test_canonical_of_all_characters(spark):
    """Every assigned character by itself, and marks and Jamo in every order; only characters new to ICU are left out."""
    texts = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    packed = ["x" + "x".join(texts[k : k + 50]) + "x" for k in range(0, len(texts), 50)]
    marks = ["\u0301", "\u0323", "\u0308", "\u0345", "\u0327", "\u302a"]
    packed += [f"{b}{x}{y}{z}" for b in "aeΩαſ" for x in marks for y in marks for z in marks]
    packed += ["\u1100\u1161\u11a8", "\uac00\u11a8", "각", "ﾊﾟ", "ㄱㅏ", "İ", "ŉ", "ΐ", "ﬃ"]
    got = spark.createDataFrame([(t,) for t in packed], "t string").select("t", fp.canonical(fp.F.col("t")).alias("c")).collect()
    assert [(r.t, r.c) for r in got] == [(t, canonical(t)) for t in packed]


def test_hot_group_and_collisions(spark, monkeypatch):
    """A group of copies larger than a task's share, and texts that share a fingerprint without being equal."""
    monkeypatch.setattr(fp, "DEALT", 7)
    monkeypatch.setattr(fp, "HOT", 10)
    monkeypatch.setattr(fp, "BROADCAST", 0)
    rows = [(k, "same text") for k in range(60)] + [(100 + k, f"other {k % 5}") for k in range(20)]
    assert sorted(tuple(r[c] for c in COLUMNS) for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == sorted(brute(rows))
    monkeypatch.setattr(fp, "fingerprint", lambda c: fp.F.substr(c, fp.F.lit(1), fp.F.lit(1)))
    got = {r.doc_id: r.group_id for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: 0 if d < 60 else 100 + d % 5 for d, _ in rows}
