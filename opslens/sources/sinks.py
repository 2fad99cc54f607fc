"""Writing tables and logs, and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for one run below the cluster's shared ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="run-")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can write; one that is not there is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def create_table_as(rows: DataFrame, path: str) -> DataFrame:
    """Replace the table at ``path`` with the rows, and read it back."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """One JSON object per line; NULL fields are kept, so every record has all keys."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_turn_log(turns: DataFrame, path: str) -> None:
    """Turn records as JSON lines, the expected range as one two-element list."""
    record = turns.withColumn("expected_sql_calls", F.array("expected_lo", "expected_hi"))
    write_json_lines(record.drop("expected_lo", "expected_hi"), path)


def append_summary(summary: DataFrame, path: str) -> None:
    """Add a labelled summary to those already there."""
    summary.coalesce(1).write.mode("append").parquet(path)


class ColumnsChanged(ValueError):
    """A source does not offer the columns a table was declared with."""


def pinned(rows: DataFrame, columns: Sequence[str], types: dict[str, str] | None = None) -> DataFrame:
    """Exactly the declared columns in the declared order.

    Columns added to the source are not picked up; a missing or retyped column is an error.
    """
    found = dict(rows.dtypes)
    missing = [c for c in columns if c not in found]
    retyped = {c: found[c] for c, t in (types or {}).items() if c in found and found[c] != t}
    if missing or retyped:
        raise ColumnsChanged(f"missing columns {missing}, changed types {retyped}")
    return rows.select(*columns)
