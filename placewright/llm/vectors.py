"""Vectors as whole numbers, for exact arithmetic on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beyond this magnitude a component is an error: sums of squares and counts of rows would leave 64 bits.
LARGEST = 1 << 27


def usable(vector: str) -> Column:
    """Whether a vector is there, has components, and none of them is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def whole(batches: Iterator[pa.RecordBatch], vector: str, scale: float) -> Iterator[pa.RecordBatch]:
    """``batches`` with ``vector`` as floor(scale * x) of each component, x as double."""
    for batch in batches:
        own = batch.column(vector)
        values = np.floor(scale * own.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        if len(values) and np.abs(values).max() > LARGEST:
            raise ValueError(f"a component of {vector} times {scale} is beyond {LARGEST}")
        sizes = np.cumsum([0, *own.value_lengths().to_pylist()], dtype=np.int32)
        made = pa.ListArray.from_arrays(pa.array(sizes), pa.array(values.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([made if c == vector else batch.column(c) for c in batch.schema.names], names=batch.schema.names)


def quantised(rows: DataFrame, key: str, label: str, vector: str, scale: float) -> DataFrame:
    """``id, label, v``: usable vectors as whole numbers (array of int)."""
    kept = rows.where(usable(vector)).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    return kept.mapInArrow(lambda batches: whole(batches, "v", scale), "id long, label long, v array<int>")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of vectors of one width, as rows of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)
