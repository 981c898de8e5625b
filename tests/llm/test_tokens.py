import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sheetwise.llm import bpe, packing, token_counts

PATH = bpe.default_path()
LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


SPACES = st.sampled_from([" ", "  ", "   ", "\n", " \n", "\n ", "\t", " ", " ", "\x1c", "\x85", "​", "'s", "'ll", "é", "é", "½", "٣", "Ⅷ", "日本", "<|endoftext|>", "<|", "!?"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(SPACES, st.text(max_size=6), st.text("abc 1'", max_size=12)), max_size=12).map("".join))
def test_ids_equal_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    expected = library_ids(text)
    own = bpe.encoder(PATH)
    ids = np.frombuffer(own.encode_bytes(text), "<u4")
    assert ids.tolist() == expected
    assert own.decode(ids) == LIBRARY.decode(expected, skip_special_tokens=False) == text
    assert np.frombuffer(packing.library_encoder(PATH).encode_bytes(text), "<u4").tolist() == expected


@pytest.mark.parametrize("word", ["a" * 3000, "abcdefgh" * 400, "é" * 900, "the" * 500 + "ring" * 300])
def test_long_words(word):
    assert np.frombuffer(bpe.encoder(PATH).encode_bytes(word), "<u4").tolist() == library_ids(word)


def test_round_trip_of_odd_rows(odd):
    rows = bpe.decode_documents(bpe.encode_documents(odd)).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.ids == library_ids(r.text) and r.decoded == (r.text or "")


def test_sections_add_up(odd):
    got = {}
    for r in token_counts.token_counts(odd.dropDuplicates(["doc_id"])).collect():
        got.setdefault(r.doc_id, []).append(r)
    for doc_id, text in {(r.doc_id, r.text) for r in odd.collect()}:
        rows = sorted(got[doc_id], key=lambda r: r.section)
        assert sum(r.n_tokens for r in rows) == len(library_ids(text)) == rows[0].doc_tokens
        assert [r.start for r in rows[1:]] == [r.end for r in rows[:-1]] and rows[-1].end == len(text or "")
        spans = LIBRARY.encode(text or "", add_special_tokens=False).offsets
        for r in rows:  # brute force: each token against each section
            share = lambda s, q: min(s[1], q.end) - max(s[0], q.start)
            assert r.n_tokens == sum(max(rows, key=lambda q: (share(s, q), -q.section)) is r for s in spans)


def test_packing(spark, odd):
    check_packing(packing.pack_documents(odd.filter("doc_id != 5 or doc_id is null")).collect(), [(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 5])
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_packing_of_a_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.op8_packing(spark, small).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    used, windows = sum(r.length for r in rows), len({r.sequence_id for r in rows})
    assert used / (windows * packing.CAPACITY) > 0.985


def check_packing(rows, docs):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {d for d, _ in docs}
    for doc_id, text in docs:
        ids, at = [*library_ids(text), packing.END_ID], 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : at], "<u4").tobytes())
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(1).integers(1, 257, 250).tolist()
    windows = packing.difference(sizes, 32)
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(len(sizes))) and max(sums) - min(sums) <= 8


def test_differencing_balances_like_the_plain_form():
    """Against partial partitions kept as lists of windows."""
    rng = np.random.default_rng(2)
    for n, ways in ((1, 1), (1, 3), (5, 2), (40, 7), (90, 13)):
        sizes = rng.integers(1, 257, n).tolist()
        parts = [[[s, [i]]] + [[0, []] for _ in range(ways - 1)] for i, s in enumerate(sizes)]
        while len(parts) > 1:
            parts.sort(key=lambda p: p[0][0] - p[-1][0])
            a, b = parts.pop(), parts.pop()
            parts.append(sorted(([x[0] + y[0], x[1] + y[1]] for x, y in zip(a, b[::-1])), key=lambda x: -x[0]))
        windows = packing.difference(sizes, ways)
        spread = lambda sums: max(sums) - min(sums)
        assert sorted(i for w in windows for i in w) == list(range(n))
        assert abs(spread([sum(sizes[i] for i in w) for w in windows]) - spread([x[0] for x in parts[0]])) <= 40


def test_windows_rise_when_the_capacity_is_exceeded():
    sizes = [7, 7, 7, 7]  # two to a window would be 14
    windows = packing.pack(sizes, 10)
    assert len(windows) == 4 > -(-sum(sizes) // 10) and sorted(i for w in windows for i in w) == [0, 1, 2, 3]
    rng = np.random.default_rng(3)
    for _ in range(50):
        sizes = rng.integers(1, 101, int(rng.integers(1, 60))).tolist()
        windows = packing.pack(sizes, 100)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes))) and max(sum(sizes[i] for i in w) for w in windows) <= 100


def test_packing_of_repeated_rows_and_long_texts(spark):
    rows = [(1, "one two three")] * 3 + [(2, "word " * 5000), (3, None)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for doc_id, text, times in ((1, "one two three", 3), (2, "word " * 5000, 1), (3, "", 1)):
        n = len(library_ids(text)) + 1
        pieces = [r for r in got if r.doc_id == doc_id]
        assert sum(r.length for r in pieces) == times * n and {r.doc_tokens for r in pieces} == {n}
        cuts = sorted({(r.start, r.length) for r in pieces})
        assert sorted((r.start, r.length) for r in pieces) == sorted(cuts * times)


def test_coders_take_no_rows_and_repeated_rows(spark, odd):
    assert bpe.encode_documents(odd.limit(0)).count() == 0 and token_counts.token_counts(odd.limit(0)).count() == 0
    for coded in (token_counts.token_counts, lambda d: bpe.encode_documents(d).select("doc_id", "ids")):
        twice = odd.filter("doc_id = 5")
        assert sorted(map(str, coded(twice).collect())) == sorted(map(str, coded(twice.limit(1)).collect() * 2))


def test_queries_on_documents(spark, small):
    """op5 and op6 as registered, against the library."""
    import hashlib

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: r for r in bpe.op5_bpe(spark, small).collect()}
    assert got.keys() == docs.keys()
    for d, t in docs.items():
        ids = library_ids(t)
        assert got[d].n_tokens == len(ids) and got[d].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    total = {}
    for r in token_counts.op6_token_counts(spark, small).collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == {d: len(library_ids(t)) for d, t in docs.items()}
