import numpy as np
import pytest

from sheetwise.llm import ngram_jaccard as nj


def words_of(text):
    return (text or "").encode().lower().split()


def brute(rows):
    """n_shingles and component by comparing all pairs of word-level sets."""
    sets = {}
    for doc_id, text in rows:
        w = words_of(text)
        s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
        sets[doc_id] = s
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * (k := len(x & y)) >= 75 * (len(x) + len(y) - k):
                p, q = sorted((find(a), find(b)))
                label[q] = p
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed):
    """Random texts of many sizes, chains of edits, copies, a shared passage and sets at the threshold."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    draw = lambda n: [vocabulary[i] for i in rng.integers(0, 3000, n)]
    passage, texts = draw(60), []
    for n in (1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 45, 60, 90, 130, 200, 400, 700):
        for _ in range(3):
            words = draw(n)
            texts += [words, words]
            for _ in range(6):  # each is an edit of the one before, so that ends of a chain needn't be linked
                words = list(words)
                for _ in range(int(rng.integers(0, 1 + n // 40)) + 1):
                    at = int(rng.integers(0, len(words)))
                    kind = rng.integers(0, 3)
                    words[at : at + (kind != 1)] = draw(1) if kind < 2 else []
                    words = words or draw(1)
                texts.append(words)
    texts += [draw(int(n)) + passage + draw(int(m)) for n, m in rng.integers(1, 60, (60, 2))]
    for s in range(40, 80, 3):  # unions of s + d shingles with s in common
        base = draw(s + 4)
        texts += [base, base + draw(s // 3), base + draw(s // 3 + 1)]
    order = rng.permutation(len(texts))
    return [(int(k) * 3, " ".join(texts[i])) for k, i in enumerate(order)]


@pytest.mark.parametrize("small", [1, 6])
def test_equals_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(nj, "SMALL", small)
    rows = corpus(small)
    got = nj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows) and len(got) == len(rows)


def test_signatures_of_linked_pairs_meet():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        a = int(rng.integers(1, 400))
        shared = rng.integers(0, 1 << 63, a).astype("u8")
        extra = rng.integers(0, 1 << 63, a // 3 + 1).astype("u8")
        k = int(rng.integers(0, a // 3 + 1))
        x, y = np.unique(np.r_[shared, extra[:k]]), np.unique(np.r_[shared, extra[k : a // 3]])
        assert set(nj.signatures(x)[0].tolist()) & set(nj.signatures(y)[0].tolist())


def test_odd_rows(spark, odd):
    got = nj.jaccard_components(odd).collect()
    assert sorted((r.doc_id or -1) for r in got) == sorted((r.doc_id or -1) for r in odd.collect())
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].n_shingles for i in (1, 2, 3, 4, 5, 8)] == [0, 0, 0, 1, 1, 1] and by_id[None].component_id is None
    assert all(by_id[i].component_id == i for i in (1, 2, 3, 4, 5))
    assert nj.jaccard_components(odd.limit(0)).count() == 0


def test_part_counts_bound_the_differences():
    rng = np.random.default_rng(9)
    for _ in range(300):
        a, b = int(rng.integers(1, 900)), int(rng.integers(0, 300))
        x = np.unique(rng.integers(0, 1 << 63, a).astype("u8") * np.uint64(2))
        y = np.unique(np.r_[x[: len(x) - min(len(x) - 1, b // 3)], rng.integers(0, 1 << 63, b // 3 + 1).astype("u8")])
        p, q = nj.part_counts(x).astype(int), nj.part_counts(y).astype(int)
        while len(p) != len(q):
            p, q = (p.reshape(-1, 2).sum(1), q) if len(p) > len(q) else (p, q.reshape(-1, 2).sum(1))
        assert np.abs(p - q).sum() <= len(set(x.tolist()) ^ set(y.tolist()))


def test_large_groups_in_blocks(spark, monkeypatch):
    """Near copies of one text around the threshold, with blocks and small groups of a few members."""
    monkeypatch.setattr(nj, "SMALL", 2)
    monkeypatch.setattr(nj, "BLOCK", 7)
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(90):
        words = list(base)
        for at in rng.integers(0, 150, int(rng.integers(1, 12))):
            words[at] = f"x{rng.integers(0, 40)}"
        rows.append((k, " ".join(words)))
    got = nj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_crowded_groups_of_unequal_spares(spark):
    """A pair that shares 51 signatures, all in crowded groups: the smaller set has a spare of 50, the larger one of 66."""
    meta = lambda spare: (9 << 32) + spare + (1 << 31)
    rows = []
    for sig in range(51):
        rows += [(sig, 1, 1000, meta(50), 1), (sig, 2, 1333, meta(66), 2)] + [(sig, 1000 + 10 * sig + k, 1100, meta(70), 1000 + 10 * sig + k) for k in range(6)]
    rows += [(900, 3, 1000, meta(50), 3)] + [(900, 5000 + k, 1000, meta(60), 5000 + k) for k in range(7)]  # one signature binds nobody
    mixed = spark.createDataFrame([(*r, 8) for r in rows], "sig long, id long, n long, meta long, component long, n_sets long")
    got = {r.id for r in nj._crowded(mixed).collect()}
    assert got == {1, 2}


def test_linked_pairs_share_more_than_the_lesser_spare():
    rng = np.random.default_rng(8)
    for _ in range(400):
        a = int(rng.integers(80, 1500))
        shared = rng.integers(0, 1 << 63, a).astype("u8")
        k, m = rng.integers(0, a // 3 + 1), int(rng.integers(0, a // 3 + 1))
        extra = rng.integers(0, 1 << 63, m).astype("u8")
        x, y = np.unique(np.r_[shared, extra[: min(k, m)]]), np.unique(np.r_[shared, extra[min(k, m) :]])
        found = [dict(zip(s.tolist(), meta.tolist())) for s, meta in map(nj.signatures, (x, y))]
        for family in {meta >> 32 for f in found for meta in f.values()}:
            own = [{s: (meta & 0xFFFFFFFF) - (1 << 31) for s, meta in f.items() if meta >> 32 == family} for f in found]
            if all(own):
                spares = [min(o.values()) for o in own]
                assert len(own[0].keys() & own[1].keys()) > min(spares)


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_signatures(spark, monkeypatch, hot):
    monkeypatch.setattr(nj, "SAMPLED", 1)
    monkeypatch.setattr(nj, "HOT", hot)
    rows = corpus(3)
    got = nj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows) and len(got) == len(rows)
