"""BPE encoding and decoding over a contiguous rank array.

A word keeps its part boundaries in one array and the rank of each adjacent pair in another. The lowest rank is
searched, its boundary deleted, and the two neighbouring ranks refreshed, until no pair can merge. Words over
``LONG_WORD`` bytes go through a heap with the same choice of pairs, so that time does not grow with their square.

Ids equal those of the `tokenizers` library for a byte-level BPE file without added special tokens: text that spells a
special token becomes that token. Null text counts as empty and gives no ids; repeated rows are encoded one by one; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.llm.batches import extended, map_batches, texts, with_columns

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = 256
#: Pieces between spaces whose ids a Python worker remembers; it forgets all when full.
REMEMBERED = 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE file: token bytes by id, and for each mergeable pair of ids its rank and result."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes: list[bytes] = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token) if token not in self.special else token.encode()
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = [ids[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left], ids[right]] = (rank, ids[left + right])


NEVER = (1 << 62, -1)


def merge_word(vocabulary: Vocabulary, word: bytes) -> list[int]:
    """The ids of one word."""
    if len(word) > LONG_WORD:
        return _merge_long_word(vocabulary, word)
    get = vocabulary.merges.get
    parts = [vocabulary.byte_ids[b] for b in word]
    ranks = [get(pair, NEVER) for pair in zip(parts, parts[1:])]
    while ranks:
        least = min(ranks)
        if least is NEVER:
            break
        at = ranks.index(least)
        parts[at] = least[1]
        del parts[at + 1], ranks[at]
        if at:
            ranks[at - 1] = get((parts[at - 1], parts[at]), NEVER)
        if at < len(ranks):
            ranks[at] = get((parts[at], parts[at + 1]), NEVER)
    return parts


def _merge_long_word(vocabulary: Vocabulary, word: bytes) -> list[int]:
    get = vocabulary.merges.get
    parts = [vocabulary.byte_ids[b] for b in word]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    queue = [(found[0], i, pair, found[1]) for i, pair in enumerate(zip(parts, parts[1:])) if (found := get(pair))]
    heapq.heapify(queue)

    def offer(i: int) -> None:
        j = after[i]
        if j < len(parts) and (found := get(pair := (parts[i], parts[j]))):
            heapq.heappush(queue, (found[0], i, pair, found[1]))

    while queue:
        _, i, pair, merged = heapq.heappop(queue)
        j = after[i]
        if j >= len(parts) or (parts[i], parts[j]) != pair:
            continue
        parts[i], parts[j], after[i] = merged, -1, after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [p for p in parts if p >= 0]


class Encoder:
    """Text to ids. Text is cut at single spaces, where no word of the pattern can cross, and pieces are remembered."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.pattern = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.vocabulary.special)) + ")") if self.vocabulary.special else None
        self.known = _Remembered(self.encode_piece)

    def encode_piece(self, piece: str) -> bytes:
        ids: list[int] = []
        for word in self.pattern.findall(piece):
            ids += merge_word(self.vocabulary, word.encode())
        return np.array(ids, "<u4").tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.specials and any(s in text for s in self.vocabulary.special):
            return b"".join(np.array([self.vocabulary.special[p]], "<u4").tobytes() if k % 2 else self._plain(p) for k, p in enumerate(self.specials.split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if "  " in text:  # a run of spaces gives its last to the next word
            return b"".join(map(self.known.__getitem__, self.pattern.findall(text)))
        first, *rest = text.split(" ")
        return (self.known[first] if first else b"") + b"".join([self.known[" " + p] for p in rest])

    def decode(self, ids: np.ndarray) -> str:
        table = self.vocabulary.token_bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


class _Remembered(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.make(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder in each Python worker."""
    return Encoder(path)


def encode_documents(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with the column ``ids`` (array of int)."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            coded = [own.encode_bytes(t) for t in texts(batch, text)]
            ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype("int32")
            values = pa.array(np.frombuffer(b"".join(coded), "<u4").astype("int32"))
            yield with_columns(batch, {ids: pa.ListArray.from_arrays(pa.array(ends), values)})

    return map_batches(docs, run, extended(docs, T.StructField(ids, T.ArrayType(T.IntegerType()))))


def decode_documents(coded: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """``coded`` with the decoded text; null ids give an empty text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            decoded = [own.decode(x.values.to_numpy()) if x.is_valid else "" for x in lists]
            yield with_columns(batch, {text: pa.array(decoded, pa.string())})

    return map_batches(coded, run, extended(coded, T.StructField(text, T.StringType())))


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode_documents(docs).select("doc_id", "ids")
    return decode_documents(coded).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
