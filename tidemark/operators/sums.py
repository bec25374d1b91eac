"""Sums of array-valued statistics over all rows, merged in a tree so that no task or driver gets many rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

FAN_IN = 64


def as_matrix(column: pa.Array) -> np.ndarray:
    """A batch's array column as a matrix; rows of other lengths or with nulls raise."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n and len(flat) % n or column.null_count:
        raise ValueError("vectors of different lengths, or null")
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def summed(df: DataFrame, fn: Callable[..., np.ndarray], *columns: str) -> np.ndarray:
    """The sum over all batches of fn(column 1, column 2, ...): array columns come as matrices, others as vectors.

    fn must return an array of one fixed length. An empty table gives an empty array.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                args = [as_matrix(c) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
                part = np.asarray(fn(*args), np.float64).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = as_matrix(batch.column(0)).sum(0)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

    some = df.select(*columns)
    parts = some.mapInArrow(partial, "v array<double>")
    # one merge in a few tasks, whatever the number of parts, which to ask for would run the plan once more
    parts = parts.repartition(min(FAN_IN, df.sparkSession.sparkContext.defaultParallelism)).mapInArrow(merged, "v array<double>")
    rows = parts.toArrow().column("v").combine_chunks()
    return as_matrix(rows).sum(0) if len(rows) else np.empty(0)


def vector_map(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], x: str, out: str) -> DataFrame:
    """df with a column out: fn applied to each batch's matrix, a row of doubles for each row."""
    at, names = df.columns.index(x), [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = fn(as_matrix(batch.column(at))) if batch.num_rows else np.empty((0, 1))
            ends = np.arange(0, y.size + 1, max(1, y.shape[1]), dtype=np.int32)[: batch.num_rows + 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(y.ravel(), pa.float64()))], names)

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, ArrayType(DoubleType()))]))
