"""Arrow-batch plumbing that the Python-side operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sheetwise.runtime import ship_package

#: Rows that a function sees at once. Texts may be long; Spark itself bounds the bytes of a batch.
ROWS = 512


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow with small batches, the package being sent to the executors first."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return function(b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS))

    return df.mapInArrow(run, schema)


def extended(df: DataFrame, *fields: T.StructField) -> T.StructType:
    """The schema of ``df`` with ``fields``; a column of a new field's name gives way to it."""
    new = {f.name for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name not in new] + list(fields))


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with ``columns`` behind its own, in place of those of the same names."""
    kept = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in kept), *columns.values()], names=[*kept, *columns])


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields])


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The text column; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]
