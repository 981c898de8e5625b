import math
import zlib
from collections import Counter

import numpy as np
import pytest

from sheetwise.llm import class_lm as lm


def base(rows):
    """The base scores by direct counting."""
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows if d is not None}
    tokens = {(d, t): [*lm.words_of(t), lm.END] for d, t in rows}
    c = Counter(w for d, t in rows if not held.get(d) for w in tokens[d, t])
    n, v = sum(c.values()), len(c)
    return {k: (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for k, w in tokens.items()}, held


@pytest.mark.parametrize("least", [3, 200_000])
def test_base_scores_and_gain(spark, small, monkeypatch, least):
    monkeypatch.setattr(lm, "LEAST", least)
    got = {r.doc_id: r for r in lm.op3_class_lm(spark, small).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    expected, held = base(rows)
    assert len(got) == len(rows)
    for (d, _), (n, k, total, score) in expected.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, k, total, held[d])
        assert r.base_score == pytest.approx(score, rel=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-r.score / n), rel=1e-9)
    unseen = [r for r in got.values() if r.held_out]
    assert unseen and sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_probabilities_sum_to_one(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    counts = lm.word_counts(docs).cache()
    model = lm.train(docs, counts)
    assert np.allclose((10**model.log_transition).sum(1), 1)
    mass = np.ones(len(model.log_total))  # one for what is unseen
    for r in counts.collect():
        mass[model.label[model.units.of(bytes(r.word))]] += r.c + 1
    assert np.allclose(np.log10(mass), model.log_total)


def test_scores_equal_a_recount(spark, small, monkeypatch):
    """The query's score from the classes alone, everything else being counted again."""
    monkeypatch.setattr(lm, "LEAST", 3)
    got = {r.doc_id: r for r in lm.op3_class_lm(spark, small).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    training = [t for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    docs = spark.createDataFrame([(t,) for t in training], "text string")
    model = lm.train(docs, lm.word_counts(docs).cache())
    of = lambda w: int(model.label[model.units.of(w)])
    c = Counter(w for t in training for w in [*lm.words_of(t), lm.END])
    assert all(w in model.units.words for w, n in c.items() if n >= 3)
    pairs = Counter((of(a), of(b)) for t in training for w in [lm.words_of(t)] for a, b in zip([lm.END, *w], [*w, lm.END]))
    tokens, types, given = Counter(), Counter(of(w) for w in c), Counter()
    for (a, b), n in pairs.items():
        tokens[b] += n
        given[a] += n
    k = len(model.log_total)
    everything = sum(tokens.values()) + k

    def log_p(a, b, w):
        unigram = (tokens[b] + 1) / everything
        return math.log10((pairs[a, b] + lm.SMOOTHING * unigram) / (given[a] + lm.SMOOTHING)) + math.log10((c[w] + 1) / (tokens[b] + types[b] + 1))

    for d, t in rows:
        words = [lm.END, *lm.words_of(t), lm.END]
        assert got[d].score == pytest.approx(sum(log_p(of(a), of(b), b) for a, b in zip(words, words[1:])), rel=1e-9)


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(3)
    kind = np.r_[0, rng.integers(1, 4, 60)]
    likely = np.array([[0, 1, 1, 1], [1, 20, 1, 1], [1, 1, 1, 20], [1, 1, 20, 1]])
    label = lm.exchange(rng.poisson(likely[kind][:, kind] * 5.0), 4)
    assert all(len(set(label[kind == k])) == 1 for k in range(4)) and len(set(label)) == 4


def test_words_beyond_the_head_choose_their_classes(spark, monkeypatch):
    for k, v in {"UNITS": 20, "CLASSES": 4, "LEAST": 3}.items():
        monkeypatch.setattr(lm, k, v)
    rng = np.random.default_rng(5)  # p and q words take turns and have one ending
    lines = [" ".join(f"{'pq'[i % 2]}{rng.integers(10) if rng.random() < 0.7 else rng.integers(60)}zzz" for i in range(40)) for _ in range(60)]
    docs = spark.createDataFrame([(t,) for t in lines], "text string")
    counts = lm.word_counts(docs).cache()
    model = lm.train(docs, counts)
    words = [bytes(r.word) for r in counts.filter(f"c >= {lm.LEAST}").collect() if bytes(r.word) != lm.END]
    of = {k: {int(model.label[model.units.of(w)]) for w in words if w.startswith(k)} for k in (b"p", b"q")}
    assert len(words) > 60 and len({model.units.of(w) for w in words}) == len(words)
    assert of[b"p"] and of[b"q"] and not of[b"p"] & of[b"q"]
    mass = np.ones(len(model.log_total))
    for r in counts.collect():
        mass[model.label[model.units.of(bytes(r.word))]] += r.c + 1
    assert np.allclose(np.log10(mass), model.log_total)


def test_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = lm.op3_class_lm(spark, str(tmp_path)).collect()
    assert len(got) == odd.count() and all(r.score < 0 and r.base_score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert lm.op3_class_lm(spark, f"{tmp_path}/none").count() == 0
