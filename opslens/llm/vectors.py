"""Vectors of a table in a form that tasks can use: valid ones only, as bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.store import NO_ID, arrow_map


def unpacked(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal dimension as one matrix of doubles."""
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1) if blobs else np.zeros((0, 1))


def _valid(rows: pa.Table) -> pa.Table:
    """Vectors without null or non-finite components and of a length above zero, -0.0 as 0.0."""
    column = rows["embedding"].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten()
    numbers = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    lengths = np.array([n or 0 for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(numbers))])
    some = np.concatenate([[0], np.cumsum(numbers != 0)])
    fine = (bad[ends] == bad[ends - lengths]) & (some[ends] > some[ends - lengths])
    blobs = [numbers[e - n : e].tobytes() if ok else None for e, n, ok in zip(ends, lengths, fine)]
    return pa.table({"vec_id": rows["vec_id"], "vec": pa.array(blobs, pa.binary())})


def packed(vectors: DataFrame) -> DataFrame:
    """vec_id (a null as the largest number) and vec: its doubles as bytes, or null for one that takes no part."""
    held = vectors.select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    return held.mapInArrow(arrow_map(_valid), "vec_id long, vec binary")
