"""Exact and approximate percentiles that do not gather rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percentiles(
    rows: DataFrame,
    wanted: Mapping[str, tuple[str, float]],
    by: Sequence[str] = (),
    largest: Mapping[str, str] | None = None,
    count_as: str | None = None,
    approximate: bool = False,
    accuracy: int = 10_000,
) -> DataFrame:
    """Percentiles per group, as ``{output: (column, p)}``; NULL values are skipped.

    ``largest`` adds maxima as ``{output: column}`` and ``count_as`` the number of rows.

    The exact form counts equal values first, spread over the cluster by (group, column, value), and
    only then interpolates over those counts.  The last step therefore sees one row per *distinct*
    value: for durations in whole milliseconds, token counts or tenths of seconds that is bounded by
    the range of the measure and not by the number of rows, and a hot group costs no more than any
    other.  ``approximate=True`` keeps a sketch of fixed size for measures without such a range.
    """
    by, largest = list(by), dict(largest or {})
    if approximate:
        aggs = [
            F.percentile_approx(F.col(column), F.lit(p), F.lit(accuracy)).cast("double").alias(name)
            for name, (column, p) in wanted.items()
        ]
        aggs += [F.max(column).cast("double").alias(name) for name, column in largest.items()]
        if count_as:
            aggs.append(F.count(F.lit(1)).alias(count_as))
        return rows.groupBy(*by).agg(*aggs)
    columns = dict.fromkeys([column for column, _ in wanted.values()] + list(largest.values()))
    measures = [F.struct(F.lit(c).alias("_measure"), F.col(c).cast("double").alias("_value")) for c in columns]
    if count_as:
        measures.append(F.struct(F.lit("*").alias("_measure"), F.lit(0.0).alias("_value")))
    long = rows.select(*by, F.inline(F.array(*measures))).where(F.col("_value").isNotNull())
    counts = long.groupBy(*by, "_measure", "_value").agg(F.count(F.lit(1)).alias("_n"))

    def of(column: str, what: str) -> Column:
        return F.when(F.col("_measure") == F.lit(column), F.col(what))

    aggs = [F.percentile(of(c, "_value"), F.lit(p), F.col("_n")).alias(name) for name, (c, p) in wanted.items()]
    aggs += [F.max(of(c, "_value")).alias(name) for name, c in largest.items()]
    if count_as:
        aggs.append(F.coalesce(F.sum(of("*", "_n")), F.lit(0)).alias(count_as))
    return counts.groupBy(*by).agg(*aggs)
