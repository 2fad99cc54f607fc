"""Keeping derived tables fresh with Structured Streaming.

A stream applies the same function as the batch job, so both give the same rows.  ``lag_seconds``
sets how often a running stream refreshes; without it one call takes what is new and stops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from opslens.operators.spans import AgentFilter, flatten_spans, span_view
from opslens.sources.tables import is_folder

Transform = Callable[[DataFrame], DataFrame]


def stream_files(spark: SparkSession, folder: str, name: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table as a stream: all files of the folder, or of what is called ``name`` in it.

    ``name`` may be a folder of files or one file; a name that is not there is an error.
    """
    target = f"{folder.rstrip('/')}/{name}" if name else folder
    reader = spark.readStream.schema(spark.read.parquet(target).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if is_folder(spark, target):
        return reader.parquet(target)
    # a file source reads folders: the one file is singled out by its name
    return reader.option("pathGlobFilter", name).parquet(folder)


def refresh(stream: DataFrame, path: str, checkpoint: str, lag_seconds: int | None = None) -> StreamingQuery:
    """Append a stream to a Parquet table, continuously or once for all that is available."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if lag_seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{lag_seconds} seconds").start()


def refresh_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Bring the table up to date on demand and read it."""
    spark = stream.sparkSession
    schema = stream.schema
    refresh(stream, path, checkpoint).awaitTermination()
    return spark.read.schema(schema).parquet(path)


def flatten_stream(events: DataFrame, agent: AgentFilter | None, path: str, checkpoint: str) -> DataFrame:
    """The span table kept fresh from a stream of event rows with VARIANT attributes."""
    return refresh_once(flatten_spans(events, agent), path, checkpoint)


def current_view(events: DataFrame, agent: AgentFilter | None, name: str) -> DataFrame:
    """A view of the span table that is always current: nothing is stored, so nothing lags."""
    span_view(events, agent).createOrReplaceTempView(name)
    return events.sparkSession.table(name)
