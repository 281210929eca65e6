"""Columns of vectors as numpy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A matrix of a slice holds about this many entries.
SLICE_ENTRIES = 1 << 20


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """The rows whose `vector` (an array of numbers) is there and has no null, NaN or infinite entry; as array<double>."""
    as_double = rows.withColumn(vector, F.col(vector).cast("array<double>"))
    return as_double.where(F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def of_one_length(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vector has the most frequent length (of several the largest), and that length; 0 without entries."""
    found = (rows.groupBy(F.size(vector).alias("size")).count().where("size > 0")
             .agg(F.max(F.struct("count", "size")).alias("top")).first()["top"])
    size = found["size"] if found else 0
    return rows.where(F.size(vector) == size) if size else rows.limit(0), size


def matrices(batches: Iterator[pa.RecordBatch], vector: str, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches, each with its vectors as rows of a matrix of doubles."""
    step = max(1, SLICE_ENTRIES // max(size, 1))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            yield part, part.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)
