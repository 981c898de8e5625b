"""Brown class-based bigram language model.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case, and each text closes with an end token. The model
is p(word | previous) = p(class | class of previous) * p(word | class).

Training runs over every training document. Word counts are summed by Spark. A word has a class of its own choice if it
occurs ``LEAST`` times or more and makes up at least 1 in ``SHARE`` of all tokens; so there can never be more than
``SHARE`` such words, and up to ``LEAST`` * ``SHARE`` tokens the count alone decides. All documents are coded once into
ids of these words and, for rarer and unseen words, of their endings (the ``ENDINGS`` most frequent last three
characters, or one id for the rest); everything after reads the codes.

First the ``UNITS`` most frequent words are clustered each by itself and every other word by its ending: Spark sums their
bigram counts over the whole corpus, and exchange clustering moves one at a time to the class that gives the bigram
classes the highest likelihood, until a sweep moves none. Then all other words with a class of their own leave their
ending's class: in each sweep Spark sums how often each class stands before and behind a word, tasks find the class
that gives each word the highest likelihood, and all move at once; the corpus is counted again with the new classes,
and the best of these labellings stays. The number of classes grows with the root of the number of words so moved.
Ties are settled by count, then by word, and between classes by their number.

What reaches the driver and every task: the unit bigram matrix, and the words with classes of their own. The counts of all
other words stay a table, with which the rare words of the texts are joined.

p(class | previous class) is interpolated with the class unigram; p(word | class) = (c + 1) / (N + V + 1) with the count
of the word, and the tokens and distinct words of its class in training. A null or empty text is its end token alone.
Repeated rows are scored one by one and, if trained on, count as often as they are there. A null doc_id is not held out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.llm.batches import arrow_schema, map_batches
from sheetwise.runtime import discard, materialize

UNITS = 1000
ENDINGS = 500
#: Words that occur so often, and make up 1 in ``SHARE`` tokens, have a class of their own choice.
LEAST = 20
SHARE = 4_000_000
#: Classes, or ``CLASSES_BY_ROOT`` times the root of the number of words beyond ``UNITS`` that choose theirs, if more.
CLASSES = 40
CLASSES_BY_ROOT = 0.4
SWEEPS = 12
#: Sweeps of the words beyond ``UNITS``, each of which reads the corpus.
WORD_SWEEPS = 3
#: Neighbours that a task holds before it sums them and hands them on.
NEIGHBOURS = 1_000_000
#: Weight of the class unigram against the bigram, in observations of the previous class.
SMOOTHING = 5.0
#: Distinct words that a task counts before it hands them on.
HELD = 300_000
#: The end token; no word has a space.
END = b" "

COUNTS = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("c", T.LongType())])
BIGRAMS = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("c", T.LongType())])
CODED = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("codes", T.ArrayType(T.IntegerType())),
        T.StructField("rare", T.ArrayType(T.BinaryType())),
    ]
)
SCORES = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        *[T.StructField(n, T.LongType()) for n in ("n_tokens", "n_own")],
        *[T.StructField(n, T.DoubleType()) for n in ("log_own", "log_model")],
    ]
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # of bytes: ASCII only


def ending(word: bytes) -> bytes:
    """The last three characters."""
    return word.decode("utf-8", "replace")[-3:].encode()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) over all ``docs``, the end token among them; summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            rows, counts = list(held), list(held.values())
            held.clear()
            for at in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(rows[at : at + 50_000], pa.binary()), pa.array(counts[at : at + 50_000], pa.int64())], schema=arrow_schema(COUNTS))

        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.update(words_of(t))
                held[END] += 1
            if len(held) > HELD:
                yield from out()
        yield from out()

    return map_batches(docs.select(text), run, COUNTS).groupBy("word").agg(F.sum("c").alias("c"))


class Units:
    """Words to units: 0 is the end, then the frequent words, the frequent endings, the unit of the rest, and ``more`` words."""

    def __init__(self, words: list[bytes], endings: list[bytes], more: list[bytes] = ()):
        self.words = {END: 0} | {w: i for i, w in enumerate(words, 1)}
        self.endings = {e: i for i, e in enumerate(endings, 1 + len(words))}
        self.rest = 1 + len(words) + len(endings)
        self.size = self.rest + 1
        self.more = list(more)
        self.words |= {w: i for i, w in enumerate(more, self.size)}

    def by_ending(self, word: bytes) -> int:
        return self.endings.get(ending(word), self.rest)

    def of(self, word: bytes) -> int:
        found = self.words.get(word)
        return found if found is not None else self.by_ending(word)


class _Memo(dict):
    def __init__(self, make, most: int = 200_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def vocabulary(counts: DataFrame) -> Units:
    """The words with classes of their own, the first ``UNITS`` by count apart from the others, and the endings."""
    words = counts.filter(F.col("word") != END)
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first().n
    frequent = [bytes(r.word) for r in words.orderBy(F.desc("c"), "word").limit(UNITS).collect()]
    last = words.groupBy(_tail().alias("e")).agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "e").limit(ENDINGS)
    endings = [r.e.encode() for r in last.collect()]
    often = words.filter((F.col("c") >= LEAST) & (F.col("c") * SHARE >= total)).select("word").toArrow().column(0).to_pylist()
    return Units(frequent, endings, sorted(set(often) - set(frequent)))


def _tail():
    return F.substring(F.col("word").cast("string"), -3, 3)


def encode(docs: DataFrame, units: Units, text: str = "text") -> DataFrame:
    """``docs`` (with held_out) as codes, the end's last, and the words that have no class of their own, repeats included."""
    own = docs.sparkSession.sparkContext.broadcast(units)  # fewer than SHARE words
    low, high = len(units.endings) and min(units.endings.values()), units.rest
    low = low or high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(own.value.of)
        for batch in batches:
            lines, sizes, rare, n_rare = [np.zeros(0, "i4")], [0], [], [0]
            for t in batch.column(3).to_pylist():
                words = words_of(t)
                line = np.fromiter(map(memo.__getitem__, words), "i4", len(words))
                odd = np.flatnonzero((line >= low) & (line <= high)).tolist()
                rare += [words[i] for i in odd]
                n_rare.append(len(odd))
                lines += [line, np.zeros(1, "i4")]
                sizes.append(len(words) + 1)
            codes = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(lines)))
            words_column = pa.ListArray.from_arrays(pa.array(np.cumsum(n_rare), pa.int32()), pa.array(rare, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), codes, words_column], schema=arrow_schema(CODED))

    return map_batches(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", text), run, CODED)


def _flat(batch: pa.RecordBatch) -> np.ndarray:
    """All codes of a batch, behind an end: texts close with one, and so each begins behind one."""
    return np.r_[np.zeros(1, "i4"), batch.column(0).flatten().to_numpy()]


def unit_bigrams(coded: DataFrame, units: Units) -> DataFrame:
    """(i, j, c): how often unit j follows unit i, words beyond the units counting as their endings."""
    n = units.size
    small = np.arange(n + len(units.more), dtype="i4")
    small[n:] = [units.by_ending(w) for w in units.more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, "i8")
        for batch in batches:
            line = small[_flat(batch)].astype("i8")
            pair, counts = np.unique(line[:-1] * n + line[1:], return_counts=True)
            total[pair] += counts
        found = np.flatnonzero(total)
        for at in range(0, len(found), 100_000):
            x = found[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array((x // n).astype("i4")), pa.array((x % n).astype("i4")), pa.array(total[x])], schema=arrow_schema(BIGRAMS))

    return map_batches(coded.select("codes"), run, BIGRAMS).groupBy("i", "j").agg(F.sum("c").alias("c"))


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Exchange clustering: the class of each unit. Class 0 is the end's own; the rest start in turn by frequency.

    The bigram class likelihood is sum f(N(c, d)) - sum f(N(c, .)) - sum f(N(., d)) with f(x) = x log x.
    """
    n = len(bigrams)
    b = bigrams.astype("f8")
    weight = b.sum(0)
    classes = max(2, min(classes, n))
    label = np.zeros(n, "i8")
    order = np.argsort(-weight[1:], kind="stable") + 1
    label[order] = np.arange(n - 1) % (classes - 1) + 1
    member = np.zeros((n, classes))
    member[np.arange(n), label] = 1
    table = member.T @ b @ member
    for _ in range(sweeps):
        moved = 0
        for u in order:
            old = label[u]
            out, into, own = b[u] @ member, member.T @ b[:, u], b[u, u]
            out[old] -= own  # without the unit itself
            into[old] -= own
            table[old] -= out
            table[:, old] -= into
            table[old, old] -= own
            rows, columns = table.sum(1), table.sum(0)
            # change when u joins class c: row c gains out, column c gains into, and cell (c, c) all three
            gain = (_plogp(table + out) - _plogp(table)).sum(1) + (_plogp(table + into[:, None]) - _plogp(table)).sum(0)
            corner = np.diag(table)
            gain += _plogp(corner + out + into + own) - _plogp(corner + out) - _plogp(corner + into) + _plogp(corner)
            gain -= _plogp(rows + out.sum() + own) - _plogp(rows) + _plogp(columns + into.sum() + own) - _plogp(columns)
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            table[new] += out
            table[:, new] += into
            table[new, new] += own
            if new != old:
                member[u, old], member[u, new], label[u] = 0, 1, new
                moved += 1
        if not moved:
            break
    return label


def likelihood(transitions: np.ndarray) -> float:
    """What ``exchange`` makes large, of the class bigrams."""
    t = transitions.astype("f8")
    return float(_plogp(t).sum() - _plogp(t.sum(1)).sum() - _plogp(t.sum(0)).sum())


def class_bigrams(coded: DataFrame, units: Units, label: np.ndarray, classes: int, neighbours: bool) -> DataFrame:
    """(i, j, c): the class bigrams, i being -1 - the first class and j the second. With ``neighbours`` also, for the word of
    unit ``units.size`` + i, how often class j follows it, class j - ``classes`` precedes it, and it follows itself
    (j = 2 * ``classes``; these are in no other row)."""
    width, first_more = 2 * classes + 1, units.size
    labels = coded.sparkSession.sparkContext.broadcast(label.astype("i4"))  # four bytes a word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(classes * classes, "i8")
        held: list[np.ndarray] = []

        def rows(i: np.ndarray, j: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(i), 100_000):
                x = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(i[x].astype("i4")), pa.array(j[x].astype("i4")), pa.array(c[x].astype("i8"))], schema=arrow_schema(BIGRAMS))

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            yield from rows(keys // width, keys % width, counts)

        for batch in batches:
            line = _flat(batch).astype("i8")
            first, second, of = line[:-1], line[1:], labels.value[line].astype("i8")
            table += np.bincount(of[:-1] * classes + of[1:], minlength=classes * classes)
            if neighbours:
                same = first == second
                before, behind = first >= first_more, (second >= first_more) & ~same
                held.append((first[before] - first_more) * width + np.where(same, 2 * classes, of[1:])[before])
                held.append((second[behind] - first_more) * width + classes + of[:-1][behind])
                if sum(map(len, held)) > NEIGHBOURS:
                    yield from out()
        if held:
            yield from out()
        found = np.flatnonzero(table)
        yield from rows(-1 - found // classes, found % classes, table[found])

    return map_batches(coded.select("codes"), run, BIGRAMS).groupBy("i", "j").agg(F.sum("c").alias("c"))


def best_classes(sums: DataFrame, table: np.ndarray, label: np.ndarray) -> DataFrame:
    """(i, j): the class j that gives word i of ``class_bigrams`` the highest likelihood, all others staying. ``table`` has
    the class bigrams and ``label`` the words' classes."""
    n = len(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = table.astype("f8")
        for batch in batches:
            chosen = []
            cells = batch.column(1).flatten()
            classes, counted = (cells.field(k).to_numpy() for k in ("j", "c"))
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy())
            for word, start, end in zip(batch.column(0).to_pylist(), np.r_[0, ends[:-1]], ends):
                counts = np.zeros(2 * n + 1)
                counts[classes[start:end]] = counted[start:end]
                out, into, own, old = counts[:n], counts[n:-1], counts[-1], label[word]
                now[old] -= out
                now[:, old] -= into
                now[old, old] -= own
                follow, precede = np.flatnonzero(out), np.flatnonzero(into)
                right, left, corner = now[:, follow], now[precede], np.diag(now).copy()
                rows, columns = now.sum(1), now.sum(0)
                gain = (_plogp(right + out[follow]) - _plogp(right)).sum(1) + (_plogp(left + into[precede, None]) - _plogp(left)).sum(0)
                gain += _plogp(corner + out + into + own) - _plogp(corner + out) - _plogp(corner + into) + _plogp(corner)
                gain -= _plogp(rows + out.sum() + own) - _plogp(rows) + _plogp(columns + into.sum() + own) - _plogp(columns)
                gain[0] = -np.inf
                new = int(np.argmax(gain))
                chosen.append(new if gain[new] > gain[old] + 1e-9 else int(old))
                now[old] += out
                now[:, old] += into
                now[old, old] += own
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chosen, pa.int32())], names=["i", "j"])

    each = sums.filter("i >= 0").groupBy("i").agg(F.collect_list(F.struct("j", "c")).alias("cells"))  # at most 2 * classes + 1
    return map_batches(each, run, T.StructType(BIGRAMS.fields[:2]))


class Model:
    """Classes with log10 transitions and, for each class, its log10 emission total."""

    def __init__(self, units: Units, label: np.ndarray, transitions: np.ndarray, tokens: np.ndarray, types: np.ndarray):
        self.units, self.label = units, label
        unigram = (tokens + 1) / (tokens + 1).sum()
        given = transitions.sum(1, keepdims=True)
        self.log_transition = np.log10((transitions + SMOOTHING * unigram) / (given + SMOOTHING))
        self.log_total = np.log10(tokens + types + 1.0)


def exchange_words(coded: DataFrame, units: Units, label: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best labels of ``units`` and their class bigrams after sweeps that move the words behind ``units.size``."""
    classes = len(transitions)
    best = label, transitions
    for sweep in range(WORD_SWEEPS + 1):
        last = sweep == WORD_SWEEPS
        sums = class_bigrams(coded, units, label, classes, not last)
        if not last:
            sums = materialize(sums, "class-neighbours")
        now = np.zeros((classes, classes))
        for part in sums.filter("i < 0").toArrow().to_batches():  # at most classes squared cells
            now[-1 - part.column(0).to_numpy(), part.column(1).to_numpy()] = part.column(2).to_numpy()
        if sweep and likelihood(now) <= likelihood(best[1]):
            break
        best = label, now
        if last:
            break
        moves = best_classes(sums, now, label[units.size :]).toArrow()  # eight bytes a word
        discard(sums)
        label = label.copy()
        label[units.size + moves.column(0).to_numpy()] = moves.column(1).to_numpy()
        if (label == best[0]).all():
            break
    return best


def learn(coded: DataFrame, counts: DataFrame, units: Units) -> Model:
    """The model of coded training documents with their word counts."""
    table = unit_bigrams(coded, units)
    matrix = np.zeros((units.size, units.size), "i8")
    for part in table.toArrow().to_batches():  # at most units.size squared cells
        matrix[part.column(0).to_numpy(), part.column(1).to_numpy()] = part.column(2).to_numpy()
    label = exchange(matrix, max(CLASSES, round(CLASSES_BY_ROOT * math.sqrt(len(units.more)))))
    classes = int(label.max()) + 1
    member = np.eye(classes)[label]
    transitions = member.T @ matrix @ member
    if units.more:
        label = np.concatenate([label, label[[units.by_ending(w) for w in units.more]]])
        label, transitions = exchange_words(coded, units, label, transitions)
    # distinct words by class; those of endings beyond the units' are one row
    types = np.zeros(len(label))
    types[list(units.words.values())] = 1
    kept = [e.decode() for e in units.endings]
    rare = counts.filter(F.col("word") != END).groupBy(F.when(_tail().isin(kept), _tail()).alias("e")).agg(F.count("*").alias("v"))
    for r in rare.collect():
        types[units.endings[r.e.encode()] if r.e is not None else units.rest] += r.v
    for w in units.words:
        if w != END:
            types[units.by_ending(w)] -= 1
    return Model(units, label, transitions, transitions.sum(0), np.bincount(label, types, classes))


def train(docs: DataFrame, counts: DataFrame, text: str = "text") -> Model:
    """The model of training documents with their word counts."""
    units = vocabulary(counts)
    coded = materialize(encode(docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), text), units, text), "coded")
    model = learn(coded, counts, units)
    discard(coded)
    return model


def score(coded: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every coded row."""
    spark, units = coded.sparkSession, model.units
    whole = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    tokens, types = whole.n or 0, whole.v
    names = spark.createDataFrame([(bytearray(w), i) for w, i in units.words.items()], "word binary, i int")
    own = np.full(len(model.label), -1, "i8")  # counts of the words with classes of their own
    for part in counts.join(F.broadcast(names), "word").select("i", "c").toArrow().to_batches():
        own[part.column(0).to_numpy()] = part.column(1).to_numpy()
    shared = spark.sparkContext.broadcast((own, model.label.astype("i4"), model.log_transition, model.log_total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, label, log_transition, log_total = shared.value
        known = (own > 0).astype("i8")
        logs = np.log10(np.maximum(own, 0) + 1.0)
        for batch in batches:
            codes = batch.column(3)
            flat = codes.flatten().to_numpy()
            starts = codes.offsets.to_numpy()[:-1] - codes.offsets.to_numpy()[0]
            of = label[flat]
            before = np.roll(of, 1)
            before[starts] = 0
            sums = lambda x: np.add.reduceat(x, starts)  # noqa: E731  no text is without its end
            values = [np.diff(codes.offsets.to_numpy()).astype("i8"), sums(known[flat]), sums(logs[flat]), sums(log_transition[before, of] - log_total[of])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *map(pa.array, values)], schema=arrow_schema(SCORES))

    rows = map_batches(coded.select("row", "doc_id", "held_out", "codes"), run, SCORES)
    rare = coded.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    rare = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("log_rare"))
    summed = rows.join(rare, "row", "left")
    log_counts = F.col("log_own") + F.coalesce("log_rare", F.lit(0.0))
    return summed.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_own") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (log_counts - F.col("n_tokens") * F.lit(math.log10(tokens + types + 1))).alias("base_score"),
        (log_counts + F.col("log_model")).alias("score"),
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """``scored`` with the model's perplexity of each text."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def op3_class_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", held_out())
    counts = materialize(word_counts(docs.filter("not held_out")), "word-counts")
    units = vocabulary(counts)
    coded = materialize(encode(docs, units), "coded")
    model = learn(coded.filter("not held_out"), counts, units)
    return perplexity(score(coded, counts, model)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
