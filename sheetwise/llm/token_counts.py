"""Token counts by section, through one encoding of the whole document.

A document is encoded once; token character spans meet section spans in an interval join, both sides being sorted, so
that encoding sections apart (which would shift merges at their edges) is never needed. A token that crosses a section
boundary goes to the section that holds most of its characters, and to the earlier one in a tie; a token that covers
only part of a character counts as covering it. Sections are the lines of a text, each with its closing line feed, so
the counts of a document's sections add up to its own count. Null or empty text has one empty section without tokens.
Repeated rows each have their own rows, which are alike; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sheetwise.llm.batches import arrow_schema, map_batches, texts
from sheetwise.llm.bpe import default_path, encoder

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *[T.StructField(n, T.LongType()) for n in ("section", "start", "end", "n_tokens", "n_crossing", "doc_tokens")],
    ]
)


def token_spans(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens from their lengths in bytes."""
    character = np.cumsum((np.frombuffer(data, "u1") & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths)
    return character[ends - lengths], character[ends - 1] + 1


def line_starts(text: str) -> np.ndarray:
    """The first character of each section."""
    at, found = [0], text.find("\n")
    while found >= 0:
        at.append(found + 1)
        found = text.find("\n", found + 1)
    return np.array(at if len(at) == 1 or at[-1] < len(text) else at[:-1], "int64")


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section; sections: their first characters, in order."""
    first = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, ends - 1, "right") - 1
    owner = first.copy()
    edges = np.append(sections, total)
    for t in np.flatnonzero(first != last):
        inside = range(first[t], last[t] + 1)
        owner[t] = max(inside, key=lambda s: (min(ends[t], edges[s + 1]) - max(starts[t], edges[s]), -s))
    return np.bincount(owner, minlength=len(sections)), np.bincount(owner[first != last], minlength=len(sections))


def token_counts(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """A row for each document and section: its span, its tokens, those that cross its edges, and the document's tokens."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        sizes = np.array([len(b) for b in own.vocabulary.token_bytes], "int64")
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in SCHEMA.names[1:]]
            counts = []
            for t in texts(batch, text):
                ids = np.frombuffer(own.encode_bytes(t), "<u4")
                sections = line_starts(t)
                tokens, crossing = attribute(*token_spans(t.encode(), sizes[ids]), sections, len(t)) if len(ids) else (np.zeros(1, "int64"),) * 2
                k = len(sections)
                counts.append(k)
                for column, values in zip(parts, (np.arange(k), sections, np.append(sections[1:], len(t)), tokens, crossing, np.full(k, len(ids)))):
                    column.append(values)
            if counts:
                ids_column = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
                yield pa.RecordBatch.from_arrays([ids_column.cast(pa.int64()), *(pa.array(np.concatenate(p).astype("int64")) for p in parts)], schema=arrow_schema(SCHEMA))

    return map_batches(docs.select("doc_id", text), run, SCHEMA)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
