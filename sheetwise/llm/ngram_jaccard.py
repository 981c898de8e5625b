"""N-gram Jaccard self-join by PartEnum signatures, exact at the threshold 3/4.

A document's set holds its distinct 5-word shingles as 64-bit hashes. Sets fall into bands of sizes 2^j to 2^(j+1)-1;
a set that has partners of the next band also signs there, so that every linked pair signs in one common band. In a
band the shingle domain is partitioned into n parts. A linked pair of sizes a and b differs in at most (a+b)/7 shingles,
hence in at most D parts; a set signs its first D+1+spare non-empty parts in the order of the parts, each by the hash
of its whole content there. One of the first D+1 non-empty parts of either set is untouched by the differences, so the
pair shares a signature. (Sets with fewer non-empty parts than D+1 also sign each shingle by itself.) Documents that
share a signature are candidates, and candidates are verified on whole sets.

Groups are never expanded into all pairs. Equal sets meet through a 128-bit digest and are one representative. Each set
is first verified against the hub with which it shares most signatures (a group's hub is its least id); what is linked
becomes one component. Only groups that still hold several components yield further pairs, of different components:
all, in groups of up to ``SMALL`` sets. A linked pair shares one signature more than the lesser of its two spares. So it
can meet in larger groups alone only if either set has more signatures in such groups than the least spare of any set in
them; those sets are compared in blocks, by the parts of the hash range that hold a shingle, and only pairs leave that
this exact bound doesn't rule out.

Signatures that very many sets share are found in a sample of the documents, and their rows are then dealt over tasks
instead of being counted in one; that changes no result.

Cases: documents without words, empty or null, have the set size 0 and are linked with nothing. A row without doc_id
gets its set size and no component. Rows that repeat a doc_id are one document, each row being returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.llm.batches import arrow_schema, map_batches
from sheetwise.operators.graph import components
from sheetwise.runtime import discard, materialize

SHINGLE = 5
#: Groups of up to so many sets are compared in full after the hubs.
SMALL = 6
#: Members of larger groups are compared in blocks of this size.
BLOCK = 1024
#: Parts of a band for each shingle of its largest set.
PARTS = 0.36
#: Bands whose sets have fewer shingles than this have a part for each shingle.
SINGLE = 64
#: Pairs of ids, 16 bytes each, that may be broadcast.
BROADCAST = 1_000_000
#: One in so many documents is signed to find signatures that at least ``HOT`` of them share (1 in ``HOT_SHARE`` of all
#: that were signed, if that is more, so fewer than ``HOT_SHARE`` are broadcast).
SAMPLED, HOT, HOT_SHARE = 64, 64, 100_000
#: Digests of sets that a task remembers, so as to sign copies once.
COPIES = 1_000_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], "u8")

SIGNATURES = T.StructType([T.StructField(n, T.LongType()) for n in ("id", "sig", "check", "meta")])
SETS = T.StructType([T.StructField("id", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.ByteType())), T.StructField("fine", T.BinaryType())])
PAIRS = T.StructType([T.StructField(n, T.LongType()) for n in "ab"])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text, A-Z in lower case."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII only
    if not words:
        return np.zeros(0, "u8")
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
    k = min(SHINGLE, len(words))
    out = np.full(len(words) - k + 1, k, "u8")
    for i in range(k):
        out += hashes[i : len(hashes) - k + 1 + i] * _ODD[i]
    return np.unique(_mix(out))


def differences(size: int, largest: int) -> int:
    """The most shingles in which a set of ``size`` differs from a linked partner of up to ``largest``."""
    return (size + min(size * 4 // 3, largest)) // 7


def signatures(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and their metas: the family (band, with a sign for single shingles) above 2^32 and the spare below."""
    size = len(shingles)
    band = size.bit_length() - 1
    bands = [(band, (2 << band) - 1)] + ([(band + 1, (4 << band) - 1)] if size * 4 // 3 >= 2 << band else [])
    sigs, metas = [], []
    for j, largest in bands:
        most = differences(size, largest)
        if (2 << j) <= SINGLE:
            found = shingles
        else:
            n = int(PARTS * (2 << j)) + 8
            part = shingles % np.uint64(n)
            order = np.argsort(part, kind="stable")
            part = part[order]
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            found = np.add.reduceat(shingles[order], first) ^ (part[first] * _ODD[1])
        need = most + 1
        taken = found[: need + max(2, need * 3 // 20)]
        families = [(j, taken, len(taken) - need)] + ([(64 + j, shingles, size - need)] if len(taken) < need else [])
        for family, x, spare in families:
            sigs.append(_mix(x + np.array([family + 1], "u8") * _ODD[2]))
            metas.append(np.full(len(x), (family << 32) + spare + (1 << 31), "i8"))
    return np.concatenate(sigs), np.concatenate(metas)


def _signature_rows(docs: DataFrame, text: str) -> DataFrame:
    """Rows (id, sig, 0, meta) of signatures, and for each document (id, digest, second digest, set size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids, sigs, checks, metas = [], [], [], []
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shingles = shingle_set(t)
                digest = (int(np.bitwise_xor.reduce(shingles * _ODD[3])), int(np.add.reduce(shingles * _ODD[4], dtype="u8")) | 1) if len(shingles) else (0, 1)
                s, m = (np.zeros(0, "u8"), np.zeros(0, "i8")) if digest in seen or not len(shingles) else signatures(shingles)
                if len(seen) < COPIES:
                    seen.add(digest)
                ids.append(np.full(len(s) + 1, doc_id, "i8"))
                sigs += [s, np.array([digest[0]], "u8")]
                checks += [np.zeros(len(s), "u8"), np.array([digest[1]], "u8")]
                metas += [m, np.array([len(shingles)], "i8")]
            if ids:
                columns = [np.concatenate(ids), np.concatenate(sigs).view("i8"), np.concatenate(checks).view("i8"), np.concatenate(metas)]
                for at in range(0, len(columns[0]), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 200_000]) for c in columns], schema=arrow_schema(SIGNATURES))

    return map_batches(docs.select("doc_id", text), run, SIGNATURES)


def _hot_signatures(docs: DataFrame, text: str) -> DataFrame:
    """(sig): signatures of so many documents that no task should hold all their rows."""
    sampled = _signature_rows(docs.filter(F.pmod(F.xxhash64(F.lit("hot"), "doc_id"), F.lit(SAMPLED)) == 0), text).filter("check = 0")
    counts = materialize(sampled.groupBy("sig").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT), "signature-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    out = materialize(counts.filter(F.col("n") > total / HOT_SHARE).select("sig"), "hot-signatures")
    discard(counts)
    return out


def part_counts(shingles: np.ndarray) -> np.ndarray:
    """How many shingles each of some size/4 equal parts of the hash range holds, up to 127; the number of parts is a
    power of two, so that neighbours can be added to compare sets of different bands."""
    bits = max(3, len(shingles).bit_length() - 3)
    return np.minimum(np.bincount((shingles >> np.uint64(64 - bits)).astype("i8"), minlength=1 << bits), 127).astype("i1")


def _lists(parts: list[np.ndarray], kind: str) -> pa.Array:
    ends = pa.array(np.cumsum([0, *map(len, parts)]).astype("int32"))
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, kind), *parts]).astype(kind, copy=False)))


def _set_rows(docs: DataFrame, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([x.view("i8") for x in sets], "i8"), _lists([part_counts(x) for x in sets], "i1"), pa.array([presence_bits(x).tobytes() for x in sets])], schema=arrow_schema(SETS))

    return map_batches(docs.select("doc_id", text), run, SETS)


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= 75 * union, written.

    First by the counts of their parts, whose differences add up to no more than the sets' own: that is exact, and keeps
    nearly all pairs of unlike sets from moving whole sets. Then only the sets that the rest names are shuffled: up to
    ``BROADCAST`` pairs are sent to all tasks to choose them, more are joined.
    """
    counts = lambda name: sets.select(F.col("id").alias(name), F.col("counts").alias(f"p{name}"), F.size("shingles").alias(f"n{name}"))
    folded = "if(size({0}) > size({1}), transform(sequence(0, size({1}) - 1), i -> cast({0}[2 * i] as int) + {0}[2 * i + 1]), transform({0}, x -> cast(x as int)))"
    apart = f"aggregate(zip_with({folded.format('pa', 'pb')}, {folded.format('pb', 'pa')}, (x, y) -> abs(x - y)), 0, (s, x) -> s + x)"
    near = pairs.join(counts("a"), "a").join(counts("b"), "b").filter(_close(F.col("na"), F.col("nb")) & F.expr(f"7L * {apart} <= na + nb"))
    pairs = materialize(near.select("a", "b"), "pairs")
    named = F.broadcast if pairs.count() <= BROADCAST else lambda x: x
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")).join(named(pairs), "a")
    other = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")).join(named(pairs.select("b").distinct()), "b", "left_semi")
    both = one.join(other, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    links = materialize(both.filter(F.expr("100L * common >= 75L * (size(x) + size(y) - common)")).select("a", "b"), "links")
    discard(pairs)
    return links


def _mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The distinct representatives of each signature group that has more than one component."""
    known = rows.select("sig", "id", "n", "meta").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_groups = known.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("id").alias("least"), F.count("*").alias("n_sets")).filter("lo < hi")
    return known.join(open_groups.drop("lo", "hi"), "sig")


def _crowded(mixed: DataFrame) -> DataFrame:
    """(sig, id, component, n): the groups over ``SMALL``, of sets that may meet a partner in such groups alone.

    A pair shares more signatures than the lesser of its spares. If all lie in such groups, either set has as many there,
    and the least spare of the groups' members is no more than that of the pair.
    """
    full = mixed.filter(F.col("n_sets") > SMALL).withColumn("family", F.expr("shiftright(meta, 32)"))
    least = full.groupBy("sig").agg(F.min(F.expr("(meta & 4294967295L) - 2147483648L")).alias("spare"))
    reach = full.join(least, "sig").groupBy("id", "family").agg(F.count("*").alias("n_crowded"), F.min("spare").alias("spare"))
    return full.join(reach.filter("n_crowded > spare"), ["id", "family"], "left_semi").select("sig", "id", "component", "n")


def _close(a, b):
    return (a * 4 >= b * 3) & (b * 4 >= a * 3)


def presence_bits(shingles: np.ndarray) -> np.ndarray:
    """Which of some 8 to 16 * size equal parts of the hash range hold a shingle, as packed bits; sets that differ in a part
    differ in a shingle of it, so parts that differ never outnumber shingles that do."""
    bits = max(6, len(shingles).bit_length() + 3)
    held = np.zeros(1 << bits, "u1")
    held[(shingles >> np.uint64(64 - bits)).astype("i8")] = 1
    return np.packbits(held)


def _halved(packed: np.ndarray) -> np.ndarray:
    return np.packbits(np.unpackbits(packed).reshape(-1, 2).max(1))


def near_in_blocks(ids, components_, sizes, fine: list[bytes], block, first: int, second: int) -> list[tuple[int, int]]:
    """Pairs (a, b) of different components, one of each block (or both of one), whose sizes and presence bits allow a link."""
    width = min(map(len, fine))
    rows_of = [np.frombuffer(f, "u1") for f in fine]
    while max(map(len, rows_of)) > width:
        rows_of = [_halved(f) if len(f) > width else f for f in rows_of]
    bits = np.ascontiguousarray(np.array(rows_of)).view("u8")
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    out = []
    step = max(1, 1_000_000 // (len(right) * bits.shape[1])) if len(right) else 1
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        a, b = sizes[rows][:, None], sizes[right][None, :]
        possible = (components_[rows][:, None] != components_[right][None, :]) & (b * 4 >= a * 3) & (a * 4 >= b * 3)
        if first == second:
            possible &= ids[rows][:, None] < ids[right][None, :]
        if not possible.any():
            continue
        apart = np.bitwise_count(bits[rows][:, None, :] ^ bits[right][None, :, :]).sum(2, dtype="i4")
        i, j = np.nonzero(possible & (apart * 7 <= a + b))
        x, y = ids[rows[i]], ids[right[j]]
        out += zip(np.maximum(x, y).tolist(), np.minimum(x, y).tolist())
    return out


def _near_in_large_groups(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of ``rows`` (sig, id, component, n) in one group and of different components that may be linked. Members
    are dealt into blocks by a hash; each pair of blocks is one unit of work, and only near pairs leave it."""
    n_blocks = rows.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    dealt = rows.join(n_blocks, "sig").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int")).join(sets.select("id", "fine"), "id")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    keyed = dealt.select("sig", "id", "component", "n", "fine", "block", other).select(F.xxhash64("sig", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "sig", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "id", "component", "n", "block", "fine")
    names = ("sig", "first", "second")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> list[tuple[int, int]]:
            ids, comps, sizes, blocks = (np.array([r[k] for r in held], "i8") for k in (3, 4, 5, 6))
            return near_in_blocks(ids, comps, sizes, [r[7] for r in held], blocks, held[0][1], held[0][2])

        def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], schema=arrow_schema(PAIRS))

        for batch in batches:
            found: set[tuple[int, int]] = set()
            for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                if held and row[:3] != held[0][:3]:
                    found.update(out())
                    held = []
                held.append(row)
            yield batch_of(list(found))
        if held:
            yield batch_of(out())

    columns = [*names, "id", "component", "n", "block", "fine"]
    return map_batches(keyed.repartition(*names).sortWithinPartitions(*names).select(columns), run, PAIRS).distinct()


def jaccard_components(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row; component_id: the least doc_id that links reach."""
    known = docs.filter("doc_id is not null")
    hot = _hot_signatures(known, text)
    signed = _signature_rows(known, text).join(F.broadcast(hot.withColumn("hot", F.lit(True))), "sig", "left")
    # rows of hot signatures and of digests stay in any case; the others meet in one window, whose key is one long: sorted by radix
    signed = signed.withColumn("key", F.expr("if(hot or check != 0, xxhash64(sig, id), sig)"))
    found = signed.selectExpr("id", "sig", "check", "meta", "hot or check != 0 or count(*) over (partition by key) > 1 as stays")
    grouped = materialize(found.filter("stays").drop("stays"), "signatures")
    discard(hot)
    digests = grouped.filter("check != 0")
    least = digests.groupBy("sig", "check").agg(F.min("id").alias("hub"))
    members = digests.join(least, ["sig", "check"]).select("id", F.col("meta").alias("n"), F.when(F.col("meta") > 0, F.col("hub")).otherwise(F.col("id")).alias("rep"))
    copies = members.select("id", "rep", "n").distinct()
    shared = grouped.filter("check = 0").select("id", "sig", "meta")
    # copies that different tasks signed are one representative from here on
    rows = shared.join(copies, "id").select("sig", F.col("rep").alias("id"), "n", "meta").distinct()
    multiple = rows.groupBy("sig").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    rows = materialize(rows.join(multiple, "sig"), "groups")
    members = materialize(members, "members")
    discard(grouped)
    wanted = rows.select("id").distinct()
    sets = materialize(_set_rows(known.select("doc_id", text).join(wanted, F.col("doc_id") == F.col("id"), "left_semi"), text), "sets")

    shared = rows.filter("id > least").groupBy("id", "least").agg(F.count("*").alias("k"))
    hub = shared.groupBy("id").agg(F.max(F.struct("k", -F.col("least"))).alias("hub"))  # the one of most shared signatures
    first = hub.select(F.col("id").alias("a"), (-F.col("hub.col2")).alias("b"))
    links = _linked(first, sets)
    labels = components(links)
    mixed = materialize(_mixed(rows, labels), "mixed")
    discard(rows, labels)
    pairs = materialize(_across(mixed.filter(F.col("n_sets") <= SMALL)).distinct().unionByName(_near_in_large_groups(_crowded(mixed), sets)).distinct(), "candidates")
    more = _linked(pairs, sets)
    discard(pairs, mixed, sets)
    labels = components(links.unionByName(more))
    discard(links, more)
    out = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").groupBy("id", "n", "rep").agg(F.count("*").alias("k"), F.min("component").alias("component"))
    # rows that repeat an id share the least component of their texts
    out = out.withColumn("component_id", F.coalesce("component", "rep")).select("id", "n", "k", "component_id")
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.explode(F.sequence(F.lit(1), F.col("k").cast("int")))).drop("col")
    unknown = _set_rows(docs.filter("doc_id is null"), text).select(F.col("id").alias("doc_id"), F.size("shingles").cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(unknown)


def _across(rows: DataFrame) -> DataFrame:
    """Pairs of different components within the groups of ``rows``, of sizes that can link."""
    one = rows.select("sig", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"))
    other = rows.select("sig", F.col("id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"))
    return one.join(other, (one.sig == other.sig) & (F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb")) & _close(F.col("na"), F.col("nb"))).select("a", "b")


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
