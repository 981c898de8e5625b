import importlib.util
import re
import sys
from pathlib import Path

from sheetwise.llm import pii, toxicity

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as cp  # noqa: E402

_spec = importlib.util.spec_from_file_location("jaccard_tests", Path(__file__).with_name("test_ngram_jaccard.py"))
jaccard_tests = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(jaccard_tests)
_spec = importlib.util.spec_from_file_location("pii_tests", Path(__file__).with_name("test_pii.py"))
pii_tests = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(pii_tests)
_spec = importlib.util.spec_from_file_location("token_tests", Path(__file__).with_name("test_tokens.py"))
token_tests = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(token_tests)


def brute_quality(text):
    """Kept or not, by plain loops."""
    from sheetwise.llm.quality_rules import STOP_WORDS, SYMBOLS

    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = list(zip(words, words[1:], words[2:]))
    many = {w for w in windows if windows.count(w) > 1}
    repeat = len({i + s for i, w in enumerate(windows) if w in many for s in range(3)})
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n, chars = len(words), sum(map(len, words))
    if n < 50 or 100 * repeat > 50 * n:
        return False
    return (
        200 * n <= 100 * chars <= 1500 * n
        and 1000 * sum(c in SYMBOLS for c in text) <= 100 * n
        and 1000 * text.count("!") <= 250 * n
        and 1000 * sum(w.lower() in STOP_WORDS for w in words) >= 40 * n
        and 1000 * (len(lines) - len(set(lines))) <= 500 * len(lines)
        and 1000 * repeat <= 300 * n
    )


def test_stages_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    got, expected = docs, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in cp.STAGES:
        before, got = got, stage(spark, got, small)
        got = got.cache()
        if name == "packing":
            token_tests.check_packing(got.collect(), list(expected.items()))
            continue
        assert got.columns == columns
        if name == "quality_rules":
            expected = {d: t for d, t in expected.items() if brute_quality(t)}
        elif name == "toxicity":
            net = toxicity.learn(before, spark.read.parquet(f"{small}/labels.parquet"))
            ids = list(expected)
            scores = toxicity.Scorer(net).score([expected[d] for d in ids])
            expected = {d: expected[d] for d, s in zip(ids, scores) if s < toxicity.THRESHOLD}
        elif name == "ngram_jaccard":
            groups = jaccard_tests.brute(list(expected.items()))
            expected = {d: t for d, t in expected.items() if groups[d][1] == d}
        elif name == "pii":
            kept, _ = pii_tests.brute_patterns(list(expected.items()))
            assert {r.pattern for r in pii.learn_patterns(pii.with_candidates(pii.with_base_spans(before)))[0].collect()} == kept.keys()
            assert all(not pii_tests.base(r.text) and r.n_chars == len(r.text) for r in got.collect())
            for r in got.collect():
                if not pii_tests.base(expected[r.doc_id]) and "[ID]" not in r.text:
                    assert r.text == expected[r.doc_id]
            expected = {r.doc_id: r.text for r in got.collect()} if expected.keys() == {r.doc_id for r in got.collect()} else None
        assert {r.doc_id: r.text for r in got.collect()} == expected and len(expected) > 20
    assert cp.run(spark, small).count() == got.count()


def test_odd_rows_and_clashing_columns(spark, odd, tmp_path):
    labels = "doc_id long, quality int, toxic int"
    docs = odd.selectExpr("*", "1.5 as score", "'x' as kept", "array(1) as id", "2 as email", "3L as n_chars", "4 as _row", "5 as component", "6 as label")
    for name, table in (("some", docs), ("none", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(4, 1, 0), (5, 1, 1)][: 2 * (name == "some")], labels).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        for k, (_, stage) in enumerate(cp.STAGES[:-1]):
            out = stage(spark, table, f"{tmp_path}/{name}")
            assert out.columns == docs.columns
            rows = out.collect()
            if k == 2:
                assert len(rows) == (table.count() - 1 if name == "some" else 0)
            assert {(r.score, r.kept, r.email) for r in rows} <= {(docs.first().score, "x", 2)}
        assert cp.run(spark, f"{tmp_path}/{name}").count() >= 0
