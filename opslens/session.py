"""Session settings every operator relies on, and parameterised SQL."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # HotSpot never compiles methods above 8000 bytes: larger stages run faster split into expressions
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; sizes (shuffle partitions, broadcast threshold) stay the cluster's."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def run_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None, **args: Any) -> DataFrame:
    """``spark.sql`` over named DataFrames with bound parameters.

    Values are bound as ``:name`` markers (LIMIT included), never pasted into the text; tables are
    referenced as ``{name}``.
    """
    return spark.sql(text, args=args or None, **(tables or {}))
