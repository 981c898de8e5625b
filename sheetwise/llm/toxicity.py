"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input joins the means of the vectors of its character n-grams and of its beginnings with a vector of the word
itself (all hashed). Two
gated recurrent layers read a window of words in either direction; attention pools their states into one logit. A text
is scored over all its overlapping windows, from its first word to its last, and has the score of its worst window.

Training takes a bounded sample of labelled documents (``SAMPLE`` of each label; of texts over ``LONGEST`` characters a
window of so many, at a place that a hash of the id chooses). The label belongs to a document and not to its windows: of a toxic document the window is learnt that holds
the word with the highest document-level log-odds, of a clean one the window so chosen and others at random; later
epochs choose the windows by the network itself. The logit is centred at the cut with the fewest errors on the sample.

Null, empty and blank texts have no words and score as the network's empty window, 0. Without labelled rows of both
kinds every text scores 0. Repeated rows are scored one by one. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.llm.batches import extended, map_batches, texts, with_columns
from sheetwise.llm.labelled import remainder, sample

WINDOW = 24
STRIDE = 16
HIDDEN = 8
VECTOR = 8
BUCKETS = 1 << 14
GRAMS = (3, 4, 5)
#: Bytes of the word beginnings that have vectors of their own.
BEGINNINGS = range(4, 11)
SAMPLE = 1000
LONGEST = 20_000
CLEAN_WINDOWS = 6
#: Epochs, of which there are more where they'd make fewer than ``STEPS`` steps.
EPOCHS = 6
STEPS = 450
BATCH = 256
RATE = 0.01
SEED = 7
THRESHOLD = 0.5
#: Words whose gate inputs a Python worker remembers.
REMEMBERED = 250_000
_EDGE = b".,;:!?\"'()[]{}<>|#*$%&-_/\\"


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().split()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def character_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words with their edges, and where each word's begin."""
    data = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), "u1").astype("u8")
    sizes = np.fromiter((len(w) + 2 for w in words), "i8", len(words))
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    left = (starts + sizes)[word] - np.arange(len(data))  # bytes up to the word's end
    hashes, owners, rolling = [], [], np.zeros(len(data), "u8")
    for n in range(1, max(GRAMS) + 1):
        shifted = np.zeros(len(data), "u8")
        shifted[: len(data) - n + 1] = data[n - 1 :]
        rolling = rolling * np.uint64(0x100000001B3) + shifted + np.uint64(1)
        if n in GRAMS:
            ok = left >= n
            h = rolling[ok] * np.uint64(0x9E3779B97F4A7C15)
            hashes.append(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 14))
            owners.append(word[ok])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(hashes)[order].astype("i8"), np.searchsorted(owner[order], np.arange(len(words)))


def grams_of_many(words: list[bytes], step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """character_grams of a long list, with little memory."""
    parts = [character_grams(words[k : k + step]) for k in range(0, len(words), step)]
    base = np.cumsum([0, *(len(b) for b, _ in parts)])
    return np.concatenate([b.astype("u2") for b, _ in parts]), np.concatenate([s + at for (_, s), at in zip(parts, base)])


def word_buckets(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.strip(_EDGE)) % BUCKETS for w in words), "i8", len(words))


def beginnings(words: list[bytes]) -> np.ndarray:
    """Buckets of the word's beginnings, a row for each word; short words repeat their last."""
    out = np.empty((len(words), len(BEGINNINGS)), "i8")
    for k, n in enumerate(BEGINNINGS):
        out[:, k] = np.fromiter((xxhash.xxh3_64_intdigest(w.lstrip(_EDGE)[:n]) % BUCKETS for w in words), "i8", len(words))
    return out


def windows_of(n_words: int) -> list[tuple[int, int]]:
    """Overlapping windows that cover all words."""
    return [(s, min(s + WINDOW, n_words)) for s in range(0, max(n_words - WINDOW + STRIDE, 1), STRIDE)] if n_words else []


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        h, d = HIDDEN, 3 * VECTOR
        init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype("f4")
        self.p = {
            "grams": rng.normal(0, 0.3, (BUCKETS, VECTOR)).astype("f4"), "words": rng.normal(0, 0.05, (BUCKETS, VECTOR)).astype("f4"),
            "beginnings": rng.normal(0, 0.1, (BUCKETS, VECTOR)).astype("f4"),
            "W": init(d, 6 * h), "b": np.zeros(6 * h, "f4"), "A": init(2 * h, h), "v": init(h), "w": init(2 * h), "bias": np.array([-1.0], "f4"),
        }
        for side in "fb":
            self.p |= {f"Uzr{side}": init(h, 2 * h), f"Un{side}": init(h, h)}

    def inputs(self, buckets: np.ndarray, starts: np.ndarray, whole: np.ndarray, begun: np.ndarray) -> np.ndarray:
        """Word inputs: means of the n-gram and beginning vectors, and the word's own."""
        counts = np.diff(np.append(starts, len(buckets)))
        mean = np.add.reduceat(self.p["grams"][buckets], starts, axis=0) / counts[:, None].astype("f4")
        return np.concatenate([mean, self.p["words"][whole], self.p["beginnings"][begun].mean(1)], 1)

    def gates(self, words: list[bytes]) -> np.ndarray:
        return self.inputs(*character_grams(words), word_buckets(words), beginnings(words)) @ self.p["W"] + self.p["b"]

    def forward(self, gates: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; at: (steps, windows) rows of ``gates``, mask: 1 where there is a word."""
        h, (steps, n) = HIDDEN, at.shape
        states = np.zeros((steps, n, 2 * h), "f4")
        tape: dict[str, list] = {"f": [], "b": []}
        for side, order, half in (("f", range(steps), 0), ("b", range(steps - 1, -1, -1), 1)):
            own = np.ascontiguousarray(gates[:, half * 3 * h : (half + 1) * 3 * h])
            zr_of, n_of = self.p[f"Uzr{side}"], self.p[f"Un{side}"]
            state = np.zeros((n, h), "f4")
            for t in order:
                x = own[at[t]]
                zr = x[:, : 2 * h] + state @ zr_of
                np.multiply(zr, np.float32(0.5), out=zr)
                np.tanh(zr, out=zr)
                zr *= np.float32(0.5)
                zr += np.float32(0.5)
                q = state @ n_of
                new = np.tanh(x[:, 2 * h :] + zr[:, h:] * q)
                moved = (new + zr[:, :h] * (state - new) - state) * mask[t][:, None]
                if keep:
                    tape[side].append((t, state, zr, q, new))
                state = state + moved
                states[t, :, half * h : (half + 1) * h] = state
        hidden = np.tanh(states @ self.p["A"])
        e = np.where(mask > 0, hidden @ self.p["v"], np.float32(-1e9))
        a = np.exp(e - e.max(0)) * mask
        a /= np.maximum(a.sum(0), np.float32(1e-9))
        pooled = np.einsum("tn,tnh->nh", a, states)
        logit = pooled @ self.p["w"] + self.p["bias"]
        return (logit, (states, hidden, a, pooled, tape)) if keep else logit

    def gradients(self, gates, at, mask, d_logit, kept) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of all but the vectors and the gate inputs, and those of ``gates``."""
        states, hidden, a, pooled, tape = kept
        h, p, g = HIDDEN, self.p, {}
        g["w"], g["bias"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["w"]
        d_states = a[:, :, None] * d_pooled
        d_a = np.einsum("tnh,nh->tn", states, d_pooled)
        d_e = a * (d_a - (a * d_a).sum(0))
        g["v"] = np.einsum("tnk,tn->k", hidden, d_e)
        d_hidden = d_e[:, :, None] * p["v"] * (1 - hidden**2)
        g["A"] = np.einsum("tnh,tnk->hk", states, d_hidden)
        d_states = d_states + d_hidden @ p["A"].T
        d_gates = np.zeros_like(gates)
        for half, side in enumerate("fb"):
            g[f"Uzr{side}"], g[f"Un{side}"] = np.zeros_like(p[f"Uzr{side}"]), np.zeros_like(p[f"Un{side}"])
            d = np.zeros((at.shape[1], h), "f4")
            for t, before, zr, q, new in reversed(tape[side]):
                d = d + d_states[t, :, half * h : (half + 1) * h]
                m = mask[t][:, None]
                z, r, step = zr[:, :h], zr[:, h:], d * m
                d_new = step * (1 - z) * (1 - new**2)
                d_zr = np.concatenate([step * (before - new), d_new * q], 1) * zr * (1 - zr)
                d_q = d_new * r
                g[f"Uzr{side}"] += before.T @ d_zr
                g[f"Un{side}"] += before.T @ d_q
                np.add.at(d_gates[:, half * 3 * h : (half + 1) * 3 * h], at[t], np.concatenate([d_zr, d_new], 1))
                d = d * (1 - m) + step * z + d_zr @ p[f"Uzr{side}"].T + d_q @ p[f"Un{side}"].T
        return g, d_gates


def _lay(windows: list) -> tuple[np.ndarray, np.ndarray]:
    at, mask = np.zeros((WINDOW, len(windows)), "i8"), np.zeros((WINDOW, len(windows)), "f4")
    for k, w in enumerate(windows):
        at[: len(w), k], mask[: len(w), k] = w, 1
    return at, mask


class _Adam:
    def __init__(self, p: dict[str, np.ndarray]):
        self.m, self.v, self.t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.t += 1
        rate = RATE * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, x in g.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            p[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype("f4")


def _suspects(documents: list[np.ndarray], labels: np.ndarray, begun: np.ndarray) -> list[int]:
    """Of each document the position of the word with a beginning of the highest log-odds over documents."""
    seen = np.zeros((2, BUCKETS))
    for d, y in zip(documents, labels):
        seen[y, np.unique(begun[np.unique(d)])] += 1
    share = (seen + 0.5) / (np.bincount(labels, minlength=2)[:, None] + 1)
    best = np.log(share[1] / share[0])[begun].max(1)
    return [int(np.argmax(best[d])) for d in documents]


def train(rows: list[tuple[str, int]], seed: int = SEED) -> Network | None:
    """The network of labelled texts; None without both labels."""
    rows = [(w, y) for t, y in rows if (w := words_of(t))]
    labels = np.array([y for _, y in rows], "i8")
    if len(set(labels.tolist())) < 2:
        return None
    documents = [w for w, _ in rows]
    rng, net = np.random.default_rng(seed), Network(seed)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for d in documents for w in d))}
    words = list(vocabulary)
    buckets, starts = grams_of_many(words)
    ends, whole, begun = np.append(starts[1:], len(buckets)), word_buckets(words), beginnings(words).astype("u2")
    coded = [np.fromiter((vocabulary[w] for w in d), "i4", len(d)) for d in documents]
    del documents, rows, vocabulary
    adam, suspects = _Adam(net.p), _suspects(coded, labels, begun)
    per_epoch = 1 + int((1 + CLEAN_WINDOWS * (labels == 0).mean()) * len(coded) / BATCH)
    epochs = max(EPOCHS, -(-STEPS // per_epoch))
    for epoch in range(epochs):
        if epoch >= epochs // 2 and (epoch - epochs // 2) % max(1, epochs // EPOCHS) == 0:
            suspects, _ = _worst(net, words, coded)
        windows, targets = [], []
        for d, y, s in zip(coded, labels, suspects):
            near = max(0, s - int(rng.integers(0, WINDOW)))
            windows.append(d[near : near + WINDOW])
            targets.append(y)
            if not y:
                for at in rng.integers(0, max(1, len(d) - WINDOW // 2), CLEAN_WINDOWS):
                    windows.append(d[at : at + int(rng.integers(1, WINDOW + 1))])
                    targets.append(0)
        order = rng.permutation(len(windows))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            at, mask = _lay([windows[i] for i in part])
            used, at = np.unique(at, return_inverse=True)
            at = at.reshape(mask.shape)
            sizes = ends[used] - starts[used]
            first = np.cumsum(sizes) - sizes
            grams = buckets[np.repeat(starts[used] - first, sizes) + np.arange(sizes.sum())]
            x = net.inputs(grams, first, whole[used], begun[used])
            gates = x @ net.p["W"] + net.p["b"]
            logit, kept = net.forward(gates, at, mask, keep=True)
            y = np.array([targets[i] for i in part], "f4")
            g, d_gates = net.gradients(gates, at, mask, ((_sigmoid(logit) - y) / len(part)).astype("f4"), kept)
            g["W"], g["b"] = x.T @ d_gates, d_gates.sum(0)
            d_x = d_gates @ net.p["W"].T
            g |= {k: np.zeros_like(net.p[k]) for k in ("grams", "words", "beginnings")}
            np.add.at(g["grams"], grams, np.repeat(d_x[:, :VECTOR] / sizes[:, None].astype("f4"), sizes, axis=0))
            np.add.at(g["words"], whole[used], d_x[:, VECTOR : 2 * VECTOR])
            np.add.at(g["beginnings"], begun[used].ravel(), np.repeat(d_x[:, 2 * VECTOR :] / np.float32(len(BEGINNINGS)), len(BEGINNINGS), axis=0))
            adam.step(net.p, g)
    net.p["bias"] -= np.float32(_centre(_worst(net, words, coded)[1], labels))
    return net


def _centre(logits: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the fewest errors on document logits, in the middle of its gap."""
    order = np.argsort(logits, kind="stable")
    x, y = logits[order], labels[order]
    errors = np.cumsum(np.r_[(1 - y).sum(), np.where(y == 1, 1, -1)])
    best = np.flatnonzero(errors == errors.min())
    edges = np.r_[x[0] - 2, x, x[-1] + 2]
    return float((edges[best[0]] + edges[best[-1] + 1]) / 2)


def _worst(net: Network, words: list[bytes], coded: list[np.ndarray]) -> tuple[list[int], np.ndarray]:
    """Of each document the middle of its window with the highest logit, and that logit."""
    gates = np.concatenate([net.gates(words[k : k + 20_000]) for k in range(0, len(words), 20_000)])
    spans = [(k, s, e) for k, d in enumerate(coded) for s, e in windows_of(len(d))]
    best: dict[int, tuple[float, int]] = {}
    for i in range(0, len(spans), 8192):
        part = spans[i : i + 8192]
        for (k, s, e), logit in zip(part, net.forward(gates, *_lay([coded[k][s:e] for k, s, e in part])).tolist()):
            best[k] = max(best.get(k, (-1e9, 0)), (logit, (s + e) // 2))
    return [best[k][1] for k in range(len(coded))], np.array([best[k][0] for k in range(len(coded))])


class Scorer:
    """Scores texts, remembering the gate inputs of words."""

    def __init__(self, net: Network):
        self.net = net
        self.rows: dict[bytes, int] = {}
        self.table = np.zeros((REMEMBERED, 6 * HIDDEN), "f4")

    def code(self, words: list[bytes]) -> np.ndarray:
        """Rows of ``table`` for the words; a batch with more new words than there is room starts the table anew."""
        new = list(set(words).difference(self.rows))
        if len(self.rows) + len(new) > len(self.table):
            self.rows, new = {}, list(set(words))
            if len(new) > len(self.table):
                self.table = np.zeros((len(new), 6 * HIDDEN), "f4")
        if new:
            at = len(self.rows)
            self.rows.update(zip(new, range(at, at + len(new))))
            for k in range(0, len(new), 20_000):
                self.table[at + k : at + k + len(new[k : k + 20_000])] = self.net.gates(new[k : k + 20_000])
        return np.fromiter(map(self.rows.__getitem__, words), "i8", len(words))

    def score(self, documents: list[str]) -> np.ndarray:
        words = [words_of(t) for t in documents]
        sizes = np.fromiter(map(len, words), "i8", len(words))
        out = np.zeros(len(words))
        if not sizes.sum():
            return out
        flat = [w for d in words for w in d]
        del words
        pad = np.append(self.code(flat), 0)
        base = np.cumsum(sizes) - sizes
        counts = np.where(sizes > 0, np.maximum(-(-(sizes - WINDOW + STRIDE) // STRIDE), 1), 0)
        owner = np.repeat(np.arange(len(sizes)), counts)
        start = base[owner] + STRIDE * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
        end = (base + sizes)[owner]
        logits = np.empty(len(owner), "f4")
        for k in range(0, len(owner), 4096):
            at = start[k : k + 4096] + np.arange(WINDOW)[:, None]
            mask = (at < end[k : k + 4096]).astype("f4")
            logits[k : k + 4096] = self.net.forward(self.table, pad[np.minimum(at, len(flat))], mask)
        worst = np.full(len(sizes), -np.inf, "f4")
        np.maximum.at(worst, owner, logits)
        return np.where(sizes > 0, _sigmoid(worst), 0.0).astype("f8")


_SCORERS: dict[str, Scorer] = {}


def toxicity(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``THRESHOLD``)."""
    schema = extended(docs, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of a fixed size
    name = f"{docs.sparkSession.sparkContext.applicationId}-{shared._jbroadcast.id()}" if net else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        if shared.value:
            if name not in _SCORERS:
                _SCORERS.clear()
                _SCORERS[name] = Scorer(shared.value)
            scorer = _SCORERS[name]
        for batch in batches:
            found = texts(batch, text)
            scores = scorer.score(found) if scorer else np.zeros(len(found))
            yield with_columns(batch, {"score": pa.array(scores), "predicted": pa.array((scores >= THRESHOLD).astype("i4"))})

    return map_batches(docs, run, schema)


def held_out():
    return F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Network | None:
    return train(sample(docs, labels, "toxic", remainder("doc_id", 5) != 0, SAMPLE, LONGEST))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs, net).select("doc_id", held_out().alias("held_out"), "score", "predicted")
