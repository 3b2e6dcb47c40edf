"""User functions over batches of rows of an exact size.

Arrow batches come in whatever size the reader and the session's settings give
them. Here the rows of a partition are cut anew: a batch has exactly ``size``
rows, except for the last one of a partition and for batches whose texts would
pass ``max_bytes``. So a function sees the batches it was written for (a model's
batch, say), and long values do not pile up in a worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MAX_BYTES = 1 << 26


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of the texts and binary values of each row, and an equal share of all other columns."""
    total, varied = np.zeros(batch.num_rows, np.int64), 0
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
            size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            total, varied = total + size, varied + column.nbytes
    return total + -(-max(0, batch.nbytes - varied) // max(1, batch.num_rows))


def cut(batches: Iterator[pa.RecordBatch], size: int, max_bytes: int = MAX_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of ``size`` rows; fewer where ``max_bytes`` or the end come first.

    A batch has at least one row, however long.
    """
    held, rows, held_bytes = [], 0, 0

    def together() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        return whole.to_batches()[0] if whole.num_columns else pa.RecordBatch.from_arrays([], names=[])

    for batch in batches:
        ends, at = np.cumsum(row_bytes(batch)), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            fitting = int(np.searchsorted(ends, before + max_bytes - held_bytes, side="right")) - at
            if fitting <= 0 and rows:
                yield together()
                rows, held_bytes = 0, 0
                continue
            n = min(size - rows, batch.num_rows - at, max(1, fitting))
            held.append(batch.slice(at, n))
            rows, held_bytes, at = rows + n, held_bytes + int(ends[at + n - 1] - before), at + n
            if rows == size or held_bytes >= max_bytes:
                yield together()
                rows, held_bytes = 0, 0
    if rows:
        yield together()


def _column(values: Sequence, kind: pa.DataType, name: str) -> pa.Array:
    try:
        return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)
    except (pa.ArrowInvalid, pa.ArrowTypeError, pa.ArrowNotImplementedError, OverflowError) as error:
        raise TypeError(f"column {name} of the function's result is no {kind}: {error}") from None


def map_batches(
    df: DataFrame,
    function: Callable[[dict[str, list]], Mapping[str, Sequence]],
    schema: T.StructType | str,
    size: int = 1000,
    inputs: Sequence[str] | None = None,
    keep: bool = True,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Apply a function of column lists to batches of rows.

    ``function`` gets ``inputs`` (all columns by default) as lists and returns the
    columns of ``schema`` as equally long sequences. With ``keep`` they are added to
    the rows, or replace columns of their name, and must be as many as the rows came
    in; without, they are the result, and there may be more or fewer. A result that
    lacks a column, has another one, or has values of another type is an error.
    """
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kept = [f for f in df.schema.fields if keep and f.name not in out.names]
    wanted = list(df.columns if inputs is None else inputs)
    whole = T.StructType(kept + out.fields)
    read = df.select(*[f.name for f in kept], *[c for c in wanted if c not in {f.name for f in kept}])
    kinds = {f.name: f.type for f in to_arrow_schema(out)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, size, max_bytes):
            made = function({c: batch.column(c).to_pylist() for c in wanted})
            if set(made) != set(kinds):
                raise ValueError(f"the function returned columns {sorted(made)}, the schema has {sorted(kinds)}")
            columns = [_column(made[c], kinds[c], c) for c in kinds]
            lengths = {len(c) for c in columns} | ({batch.num_rows} if keep else set())
            if len(lengths) > 1:
                raise ValueError(f"columns of {sorted(lengths)} rows in a batch of {batch.num_rows}")
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + columns, names=whole.names)

    return read.mapInArrow(run, whole)


def filter_batches(
    df: DataFrame,
    function: Callable[[dict[str, list]], Sequence[bool]],
    size: int = 1000,
    inputs: Sequence[str] | None = None,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Keep the rows that a function of column lists marks; null marks drop a row."""
    wanted = list(df.columns if inputs is None else inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, size, max_bytes):
            marks = _column(function({c: batch.column(c).to_pylist() for c in wanted}), pa.bool_(), "mark")
            if len(marks) != batch.num_rows:
                raise ValueError(f"{len(marks)} marks for a batch of {batch.num_rows}")
            yield batch.filter(marks)

    return df.mapInArrow(run, df.schema)
