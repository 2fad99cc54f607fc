"""Joining a large side to a dimension of unknown size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def estimated_bytes(rows: DataFrame) -> int:
    """Catalyst's size estimate of a DataFrame."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def stored_bytes(rows: DataFrame) -> int:
    """Bytes of the tables a DataFrame is read from.

    A dimension is joined to its attributes on unique keys, so it is no larger than what it is read from; Catalyst's own
    estimate multiplies the sizes at every join.
    """
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))


def join_dimension(facts: DataFrame, dimension: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Broadcast the dimension when the tables behind it are within the session's limit.

    Beyond it Spark decides, with adaptive execution free to change its mind, except where the facts look
    small: rows that come out of an ``explode`` are estimated by the size before it, and Spark would
    broadcast them, so there the join is a sort-merge.
    """
    limit = facts.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if stored_bytes(dimension) <= limit:
        return facts.join(F.broadcast(dimension), on, how)
    return facts.join(dimension.hint("merge") if estimated_bytes(facts) <= limit else dimension, on, how)


def join_splitting_heavy_keys(rows: DataFrame, lookup: DataFrame, key: str, at_least: int = 100_000, most: int = 1000) -> DataFrame:
    """Left join of stored ``rows`` with a ``lookup`` that has each key once, without a task for a key many rows share.

    The up to ``most`` keys with ``at_least`` rows or more meet their lookup rows as a broadcast of no more rows than that; the
    others are joined by shuffle.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    heavy = F.broadcast(counts.where(F.col("_rows") >= at_least).orderBy(F.desc("_rows"), key).limit(most).select(key))
    hot = rows.join(heavy, key, "left_semi").join(F.broadcast(lookup.join(heavy, key, "left_semi")), key, "left")
    return hot.unionByName(rows.join(heavy, key, "left_anti").join(lookup, key, "left"))
