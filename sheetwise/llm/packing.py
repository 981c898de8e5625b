"""Packing into windows by Karmarkar-Karp multiway differencing.

Each document's ids, closed by id 0, are cut into full windows, which have no room for more, and a rest; a rest over
``PIECE`` is cut into as few nearly equal pieces as that allows. The rests of ``GROUP`` documents become one multiway problem: every piece starts as a
partial partition with itself in one window and nothing in the others, and the two partial partitions of the largest
imbalance are merged with opposing order until one is left, whose windows are nearly equal. The first try has the fewest
windows that could hold the group; while a window exceeds the capacity, the group is solved again with one window more.
Groups form within a task in the order of its rows, so no task holds more than one group, nothing is shuffled, and a
rerun gives the same windows.

Null text is an empty document: it has the one id 0. Repeated rows are packed one by one. An empty table packs to
nothing. Sequence ids carry the task's partition in their upper bits and are unique in one result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sheetwise.llm.batches import arrow_schema, map_batches, texts
from sheetwise.llm.bpe import PATTERN, REMEMBERED, Vocabulary, default_path

CAPACITY = 1024
#: The most ids of a piece: windows of several pieces can be evened out, those of one or two can't.
PIECE = CAPACITY // 4
#: Documents whose rests are packed together.
GROUP = 256
END_ID = 0
NAMES = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(n, T.LongType()) for n in NAMES]])


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp: the positions of ``sizes`` in ``ways`` nearly equal windows."""
    queue = []
    for i, size in enumerate(sizes):
        sums = np.zeros(ways, "int64")
        sums[0] = size
        queue.append((-size, i, sums))
    heapq.heapify(queue)
    merges = []  # (one, other, order): node len(sizes) + k joins one's window order[j] and, from its end, the other's
    while len(queue) > 1:
        _, one, a = heapq.heappop(queue)  # both have their largest window first
        _, other, b = heapq.heappop(queue)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        heapq.heappush(queue, (-int(sums[0]), len(sizes) + len(merges), sums))
        merges.append((one, other, order))
    windows: list[list[int]] = [[] for _ in range(ways)]
    place = {len(sizes) + len(merges) - 1: np.arange(ways)}  # of each node's windows in the result
    for k in range(len(merges) - 1, -1, -1):
        one, other, order = merges[k]
        mine, left = place.pop(len(sizes) + k), np.empty(ways, "int64")
        left[order] = mine
        place[one], place[other] = left, left[::-1]
    for i in range(len(sizes)):
        windows[place[i][0]].append(i)
    return windows


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most ``capacity``; no size may exceed it."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = difference(sizes, ways)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return [w for w in windows if w]
        ways += 1


class _Pieces(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = np.array(self.encode(piece), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class LibraryEncoder:
    """Ids through tiktoken over the vocabulary of a tokenizers file; pieces between single spaces are remembered. The
    library merges by id, so the ids of merged tokens must ascend in the order of the file's merges, which is checked."""

    def __init__(self, path: str):
        import tiktoken

        vocabulary = Vocabulary(path)
        self.special = vocabulary.special
        merged = [made for _, made in sorted(vocabulary.merges.values())] if isinstance(vocabulary.merges, dict) else []
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError(f"the ids of {path} are not in the order of its merges")
        ranks = {b: i for i, b in enumerate(vocabulary.token_bytes) if i not in self.special.values()}
        self.library = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.known = _Pieces(lambda t: self.library.encode(t, allowed_special="all"))

    def encode_bytes(self, text: str) -> bytes:
        if "  " in text or any(s in text for s in self.special):
            return np.array(self.library.encode(text, allowed_special="all"), "<u4").tobytes()
        first, *rest = text.split(" ")
        known = self.known
        return (known[first] if first else b"") + b"".join([known[" " + p] for p in rest])


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


class _Packer:
    """Rows of one task; ``rests`` never holds more than a group."""

    def __init__(self, partition: int):
        self.sequence = partition << 40
        self.rests: list[tuple] = []
        self.documents = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        total = len(ids) // 4
        full = total - total % CAPACITY
        crc = lambda start, end: zlib.crc32(ids[4 * start : 4 * end])
        for start in range(0, full, CAPACITY):
            self.rows.append((doc_id, start, CAPACITY, crc(start, start + CAPACITY), total, self._next(), 0))
        if full == total:
            return
        pieces = -(-(total - full) // PIECE)
        ends = [full + (total - full) * k // pieces for k in range(pieces + 1)]
        self.rests += [(doc_id, start, end - start, crc(start, end), total) for start, end in zip(ends, ends[1:])]
        self.documents += 1
        if self.documents == GROUP:
            self.flush()

    def flush(self) -> None:
        for window in pack([r[2] for r in self.rests]):
            sequence, offset = self._next(), 0
            for i in window:
                self.rows.append((*self.rests[i], sequence, offset))
                offset += self.rests[i][2]
        self.rests, self.documents = [], 0

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(SCHEMA))], schema=arrow_schema(SCHEMA))


def pack_documents(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or default_path()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = library_encoder(path)
        packer = _Packer(TaskContext.get().partitionId())
        for batch in batches:
            for doc_id, t in zip(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), texts(batch, text)):
                packer.add(doc_id, own.encode_bytes(t) + end)
            yield packer.batch()
        packer.flush()
        yield packer.batch()

    return map_batches(docs.select("doc_id", text), run, SCHEMA)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
