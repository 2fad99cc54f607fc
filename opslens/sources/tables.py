"""Reading tables and files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_EVENT_COLUMNS = (
    "start_timestamp", "timestamp", "trace", "record", "record_type",
    "record_attributes", "resource_attributes",
)

TURN_LOG_SCHEMA = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("tier", T.StringType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("error", T.StringType()),
        T.StructField("total_s", T.DoubleType()),
        T.StructField("first_event_s", T.DoubleType()),
        T.StructField("sql_tool_uses", T.IntegerType()),
        T.StructField("query_ids", T.ArrayType(T.StringType())),
        T.StructField("verified_query_used", T.BooleanType()),
        T.StructField("answer_chars", T.LongType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("thread_id", T.LongType()),
        T.StructField("assistant_message_id", T.LongType()),
        T.StructField("turn_index", T.IntegerType()),
        T.StructField("expected_sql_calls", T.ArrayType(T.IntegerType())),
        T.StructField("clause_tables", T.ArrayType(T.StringType())),
        T.StructField("label", T.StringType()),
        T.StructField("run", T.IntegerType()),
    ]
)


def read_table(spark: SparkSession, location: str, name: str) -> DataFrame:
    """A named base table: ``<location>/<name>.parquet``, ``<location>/<name>`` or a catalog table."""
    if not location:
        return spark.table(name)
    path = f"{location.rstrip('/')}/{name}"
    return spark.read.parquet(path if is_folder(spark, path) else f"{path}.parquet")


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether the path is a folder, asked of the file system it belongs to."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(place) and system.getFileStatus(place).isDirectory()


def instant(column: Column) -> Column:
    """TIMESTAMP in the session time zone; zone-less input is taken as UTC wall time."""
    return column.cast("timestamp")


def wall_time(day: dt.date) -> Column:
    """Midnight of a day as a zone-less literal, for filters that must reach a zone-less scan."""
    return F.lit(dt.datetime.combine(day, dt.time())).cast("timestamp_ntz")


def read_turn_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines turn log with a fixed schema; blank lines are skipped by the reader.

    The two expected-call bounds become columns of their own.
    """
    rows = spark.read.schema(TURN_LOG_SCHEMA).json(path)
    return rows.select(
        "*",
        F.try_element_at("expected_sql_calls", F.lit(1)).alias("expected_lo"),
        F.try_element_at("expected_sql_calls", F.lit(2)).alias("expected_hi"),
    ).drop("expected_sql_calls")


def read_events(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Semi-structured event rows; attribute columns become VARIANT."""
    return parse_attributes(spark.read.format(form).load(path))


def parse_attributes(events: DataFrame) -> DataFrame:
    """Turn JSON text columns of an event table into VARIANT; text that is no JSON becomes NULL."""
    kinds = dict(events.dtypes)
    return events.select(
        *[
            F.try_parse_json(c).alias(c)
            if c in ("trace", "record", "record_attributes", "resource_attributes") and kinds[c] == "string"
            else F.col(c)
            for c in RAW_EVENT_COLUMNS
        ]
    )
