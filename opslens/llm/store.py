"""Intermediate tables in the folder that driver and executors share, and small helpers for Arrow tasks."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.sources.sinks import work_folder

#: Stands for a missing document id inside the operators: larger than every real one.
NO_ID = 2**63 - 1
SLICE_BYTES = 4 << 20
#: Settings of writes: shuffle files go with the query, and batches to Python stay small beside several workers.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def table(spark: SparkSession, location: str, name: str) -> DataFrame:
    """A base table by its path, which may be any that Spark can read."""
    return spark.read.parquet(f"{location.rstrip('/')}/{name}.parquet")


def store(rows: DataFrame, path: str, *by: str) -> DataFrame:
    """Write the rows to a new folder and read them back; the write's shuffle files go when it is done."""
    spark = rows.sparkSession
    before = {key: spark.conf.get(key) for key in _WRITING}
    for key, value in _WRITING.items():
        spark.conf.set(key, value)
    try:
        (rows.write.partitionBy(*by) if by else rows.write).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(rows.schema).parquet(path)


#: Folders of the tables that the innermost ``passing`` block deletes at its end.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def cut(rows: DataFrame, purpose: str, lasting: bool = False) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends there, lost executors cost nothing.

    Inside a ``passing`` block the table goes at the end of the block, unless it is ``lasting``.
    """
    path, made = work_folder(rows.sparkSession, purpose), _passing.get()
    if made is not None and not lasting:
        made.append(path)
    return store(rows, path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables cut inside are deleted at the end: what is needed of them is in a lasting table by then."""
    before = _passing.set([])
    try:
        yield
        discard(spark, *_passing.get())
    finally:
        _passing.reset(before)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that no later step reads."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of steps whose result is stored.

    The first round frees what the finished query's own clean-up still held, the second what hung on that.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def total(rows: DataFrame, column) -> int:
    """One number over all rows, 0 for none."""
    return int(rows.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0])


def text_bytes(rows: DataFrame, column: str = "text") -> int:
    return total(rows, F.octet_length(column))


def parts_for(size: int, each: int) -> int:
    """How many parts of about ``each`` a whole of ``size`` makes; at least one."""
    return max(1, -(-size // each))


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``size`` bytes, so that working arrays stay small; a longer row is a piece of its own."""
    rows = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def arrow_map(function: Callable[[pa.Table], pa.Table | Iterable[pa.Table] | None]) -> Callable:
    """``mapInArrow`` form of a function from one batch to tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                made = function(pa.Table.from_batches([piece]))
                for one in [made] if isinstance(made, pa.Table) else made or ():
                    yield from one.combine_chunks().to_batches()

    return run
