"""Clustered file layout: writing it, measuring it, looking single rows up in it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cluster_write(
    rows: DataFrame,
    path: str,
    keys: Sequence[str],
    lookups: Sequence[str] = (),
    files: int | None = None,
    rows_per_file: int = 20_000_000,
    derive: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Write a sorted copy: files hold disjoint key ranges, rows are sorted inside.

    A hash of the row is the last range key, so even rows that share all cluster keys (one store type,
    one day) are spread over several tasks and files.  ``lookups`` get Parquet bloom filters for
    equality reads on ids, which no sort order can help.  Columns that follow from a row alone may be left to ``derive``:
    they are made after sorting, so they neither travel nor are made a second time when Spark samples the key ranges.
    """
    spread = F.xxhash64(*rows.columns)
    ranged = (
        rows.repartitionByRange(files, *keys, spread) if files else rows.repartitionByRange(*keys, spread)
    )
    ordered = ranged.sortWithinPartitions(*keys)
    whole = derive(ordered) if derive else ordered
    writer = whole.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    for column in lookups:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)


def parts_for(rows: DataFrame, rows_a_part: int = 2_000_000, least: int = 8) -> int:
    """How many parts keep each at ``rows_a_part`` rows or fewer on average; the rows are counted."""
    return max(least, -(-rows.count() // rows_a_part))


def recluster(spark: SparkSession, path: str, keys: Sequence[str], lookups: Sequence[str] = ()) -> str:
    """Sort an existing table again.  The new files are complete before the table is switched.

    Returns the path the previous files were set aside at, a new one for every run; removing them is
    the caller's decision.
    """
    run = uuid.uuid4().hex[:12]
    fresh, aside = f"{path}.sorted-{run}", f"{path}.before-{run}"
    cluster_write(spark.read.parquet(path), fresh, keys, lookups)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not (system.rename(place, hadoop.Path(aside)) and system.rename(hadoop.Path(fresh), place)):
        raise OSError(f"could not switch {path} to its sorted copy at {fresh}")
    spark.catalog.refreshByPath(path)
    return aside


def file_ranges(table: DataFrame, key: str) -> DataFrame:
    """Key range, rows and size of every file; reads the key column only."""
    return (
        table.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), key)
        .groupBy("file", "bytes")
        .agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("rows"))
    )


def overlap_depths(ranges: DataFrame) -> DataFrame:
    """How many files (itself included) each file's key range meets.

    Counted without comparing files pairwise: a file meets all files that start at or before its high
    end except those that finish before its low end.  Both counts come from running totals over the
    distinct range ends, at most two rows per file of the table.
    """
    known = ranges.where(F.col("low").isNotNull())
    ends = known.select(F.inline(F.array(
        F.struct(F.col("low").alias("at"), F.lit(1).alias("starts"), F.lit(0).alias("stops")),
        F.struct(F.col("high").alias("at"), F.lit(0).alias("starts"), F.lit(1).alias("stops")),
    ))).groupBy("at").agg(F.sum("starts").alias("starts"), F.sum("stops").alias("stops"))
    upto = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    running = ends.select(
        "at",
        F.sum("starts").over(upto).alias("started"),
        F.coalesce(F.sum("stops").over(before), F.lit(0)).alias("stopped"),
    )
    return (
        known.join(running.select(F.col("at").alias("high"), "started"), "high")
        .join(running.select(F.col("at").alias("low"), "stopped"), "low")
        .select("file", "bytes", "rows", "low", "high", (F.col("started") - F.col("stopped")).alias("depth"))
    )


def overlap_report(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Files and average and largest overlap depth per table; a depth of 1 is perfectly clustered."""
    found = [
        overlap_depths(file_ranges(table, key)).agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("files"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
            F.avg("depth").alias("average_depth"),
            F.max("depth").alias("max_depth"),
        )
        for name, table in tables.items()
    ]
    return reduce(DataFrame.unionAll, found)


def scan_report(tables: Mapping[str, DataFrame], key: str, low: Any, high: Any) -> DataFrame:
    """Files and bytes a range filter has to open, per table, against all it has."""
    hit = (F.col("high") >= F.lit(low)) & (F.col("low") <= F.lit(high))
    found = [
        file_ranges(table, key).agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("files"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
            F.sum("bytes").alias("bytes"),
            F.count_if(hit).alias("files_read"),
            F.coalesce(F.sum(F.when(hit, F.col("bytes"))), F.lit(0)).alias("bytes_read"),
        )
        for name, table in tables.items()
    ]
    return reduce(DataFrame.unionAll, found).withColumn(
        "skipped_share", F.lit(1.0) - F.col("bytes_read") / F.nullif(F.col("bytes"), F.lit(0))
    )


def lookup_by_id(table: DataFrame, **ids: Any) -> DataFrame:
    """Rows with the given ids; on a table written with ``lookups``, bloom filters skip the other files."""
    return table.where(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in ids.items()]))
