import hashlib
import re

import pytest

from sheetwise.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


HARD = [
    "a@b.c%x@d.e a@b@c.d x@y.z. q@-.- +1 (234) 555-2345 and +1 234 +12345678901234567890 +1  2345678 9",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1..2.3.4 1.2.3.4.",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 4111111111111111 41111111111111112 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1 0000000000000",
    "é😀 x@mail.example.com 😀 10.0.0.1 \n+44 20 7946 0958\n", "a" * 20000 + "@" + "b" * 9000, "1 " * 9000, "1." * 9000, "a.b" * 5000 + "@" + "c.d" * 4000, "+" * 3000 + "1", "\u0001a@b\u0001c.d 4111\u00011111",
    "u@h.co " * 700,
]


def test_base_spans(spark, small, odd):
    rows = [(k, t) for k, t in enumerate(HARD)] + [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows += [(5000 + k, r.text) for k, r in enumerate(odd.collect())]
    got = pii.with_base_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        t = texts[r.doc_id]
        assert [(k, s.start, s.end) for k in pii.KINDS for s in r[k]] == base(t), t
        assert all(s.value == t[s.start : s.end] for k in pii.KINDS for s in r[k])


def contexts():
    """Seeds behind 'contact ' and unknown ids behind it, and the same kind of id elsewhere."""
    rows = [(k, f"word contact user{k}@mail.example.com then") for k in range(12)]
    rows += [(100 + k, f"word contact QX{k}7781234AB then; order QZ{k}7781234AB now") for k in range(2)]
    return [*rows, (200, None), (201, ""), (202, "plain words only")]


def candidates(t):
    taken = base(t)
    runs = re.finditer(r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])[A-Za-z0-9]{5,}", t)
    return [(m.start(), m.end()) for m in runs if not any(s < m.end() and m.start() < e for _, s, e in taken)]


def pattern(t, s, e):
    left = re.sub("[0-9]+", "9", re.search(r"(\S*\s?)$", t[max(0, s - pii.CONTEXT) : s].lower()).group(1))
    right = t[e : e + 1]
    return left + "\t" + ("end" if not right else "space" if right.isspace() else "word" if right.isalnum() else right)


def brute_patterns(rows):
    """Trusted patterns with confidence, and known candidates with score, by plain loops to the fixpoint."""
    edges = {}
    for _, t in rows:
        t = t or ""
        for s, e, seed in [(s, e, True) for _, s, e in base(t)] + [(s, e, False) for s, e in candidates(t)]:
            key = (pattern(t, s, e), t[s:e].lower())
            edges[key] = edges.get(key, False) or seed
    seeds, known = {v for (_, v), seed in edges.items() if seed}, {}
    while True:
        group = {}
        for (p, v), seed in edges.items():
            group.setdefault(p, []).append(1.0 if seed else known.get(v, 0.0))
        facts = {p: (sum(x) / (len(x) + pii.PRIOR), sum(s > 0 for s in x)) for p, x in group.items()}
        trusted = {p: c for p, (c, n) in facts.items() if n >= pii.SUPPORT and c >= pii.CONFIDENCE}
        doubt = {}
        for p, v in edges:
            if p in trusted and v not in seeds:
                doubt[v] = doubt.get(v, 1.0) * (1 - min(trusted[p], 0.999))
        risen = {v: max(known.get(v, 0.0), 1 - d) for v, d in doubt.items() if 1 - d >= pii.CONFIDENCE}
        done = not any(s > known.get(v, 0.0) + pii.RISE for v, s in risen.items())
        known |= risen
        if done:
            return trusted, known


def ids(t, trusted, known):
    return [(s, e) for s, e in candidates(t) if pattern(t, s, e) in trusted and t[s:e].lower() in known]


@pytest.mark.parametrize("limit", [0, 500_000])
def test_patterns_find_unseen_ids(spark, small, monkeypatch, limit):
    monkeypatch.setattr(pii, "BROADCAST", limit)
    rows = contexts() + [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    patterns, _ = pii.learn_patterns(pii.with_candidates(pii.with_base_spans(docs)))
    kept = {r.pattern: r.confidence for r in patterns.collect()}
    expected, known = brute_patterns(rows)
    assert kept.keys() == expected.keys() and "contact \tspace" in kept
    assert all(kept[p] == pytest.approx(expected[p]) for p in kept)
    found = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert {d: [(x.start, x.end) for x in r.id] for d, r in found.items()} == {d: ids(t or "", expected, known) for d, t in rows}
    assert len(found) == len(rows)
    assert [s.value for s in found[100].id] == ["QX07781234AB"] and [s.value for s in found[101].id] == ["QX17781234AB"]
    red = {r.doc_id: r.text for r in pii.redact(pii.find_pii(docs)).collect()}
    assert red[100] == "word contact [ID] then; order QZ07781234AB now" and red[3] == "word contact [EMAIL] then"
    assert red[200] is None and red[201] == "" and red[202] == "plain words only"


def test_redacted_texts(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(HARD)], "doc_id long, text string")
    for r in pii.redact(pii.find_pii(docs)).collect():
        t, out, at = HARD[r.doc_id], "", 0
        spans = sorted((s, -e, f"[{k.upper()}]") for k, s, e in [*base(t), *(("id", x.start, x.end) for x in r.id)])
        for s, e, name in spans:
            if s >= at:
                out += t[at:s] + name
            at = max(at, -e)
        assert r.text == out + t[at:]


def chain(hops=3):
    """Emails behind one word; ids that stand there and behind a second word; ids behind the second and a third; and so on."""
    words = ["mailto", *(f"marker{'abcdefgh'[k]}" for k in range(hops))]
    rows = [f"{words[0]} user{k}@mail.example.com then" for k in range(600)]
    for hop in range(hops):
        for k in range((200, 50, 11)[hop]):
            name = f"{'pqrstuvw'[hop]}X{k}77812"
            rows += [f"x {words[hop]} {name} then", f"y {words[hop + 1]} {name} then"]
    rows += [f"z {words[-1]} last{k}9000 then" for k in range(1)] + [f"nothing here{k}123 then" for k in range(9)]
    return list(enumerate(rows))


def test_chain_of_hops(spark, tmp_path):
    """Discovered ids support the pattern that discovers the next, to the end of the chain; the query gives all spans."""
    rows = chain()
    trusted, known = brute_patterns(rows)
    assert {"markera \tspace", "markerb \tspace", "markerc \tspace"} <= trusted.keys() and "last09000" in known
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.op7_pii(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        found = [*(f"{k}:{s}:{e}" for k, s, e in base(t)), *(f"id:{s}:{e}" for s, e in ids(t, trusted, known))]
        assert got[d].spans == ",".join(found) and got[d].n_id == len(ids(t, trusted, known))


def test_query_spans_on_documents(spark, small):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    trusted, known = brute_patterns(rows)
    got = {r.doc_id: r for r in pii.op7_pii(spark, small).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        found = ",".join(f"{k}:{s}:{e}" for k, s, e in base(t))
        assert got[d].base_sha256 == hashlib.sha256(found.encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(x == k for x, _, _ in base(t)) for k in pii.KINDS]
        assert got[d].spans == ",".join([*([found] if found else []), *(f"id:{s}:{e}" for s, e in ids(t, trusted, known))])


def test_query_columns(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op7_pii(spark, str(tmp_path)).collect()
    assert len(got) == odd.count()
    assert {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pii.op7_pii(spark, f"{tmp_path}/none").count() == 0
