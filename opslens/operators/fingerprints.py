"""Content fingerprints: whether a derived table holds the same rows as its base, and which rows differ."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SALTS = ("first", "second")


def _row_hash(columns: Sequence[str], salt: str) -> Column:
    """A 64-bit hash of a row in which NULL and its place count."""
    held = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(salt), *held).cast("decimal(38,0)")


def fingerprints(rows: DataFrame, by: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows and two additive hashes per partition of ``by``.

    Sums do not depend on order and count repeated rows, so partitions are summed in the map tasks and equal
    fingerprints of parts add up to equal fingerprints of wholes.
    """
    columns = sorted(columns or rows.columns)
    sums = [F.sum(_row_hash(columns, s)).alias(f"hash_{k}") for k, s in enumerate(_SALTS)]
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), *sums)


def differing_partitions(derived: DataFrame, base: DataFrame, by: str) -> DataFrame:
    """Partitions whose fingerprints differ, with the rows on either side; 0 where a side lacks the partition.

    Either side may be a stored table of fingerprints.
    """
    names = [c for c in derived.columns if c != by]
    one, two = derived.select(by, F.struct(*names).alias("_derived")), base.select(F.col(by).alias("_by"), F.struct(*names).alias("_base"))
    both = one.join(two, one[by].eqNullSafe(two["_by"]), "full_outer")
    differs = ~F.col("_derived").eqNullSafe(F.col("_base"))
    rows = [F.coalesce(F.col(f"_{side}.rows"), F.lit(0)).alias(f"{side}_rows") for side in ("derived", "base")]
    return both.where(differs).select(F.coalesce(by, "_by").alias(by), *rows)


def differing_rows(derived: DataFrame, base: DataFrame, by: str, partitions: DataFrame) -> DataFrame:
    """The rows that one side has more often, ``surplus`` times: above 0 for the derived table, below 0 for the base.

    Only the given partitions are read: their values become a filter on both scans.
    """
    values = [r[0] for r in partitions.select(by).distinct().collect()]
    columns = sorted(base.columns)
    wanted = F.col(by).isin([v for v in values if v is not None])
    wanted = wanted | F.col(by).isNull() if None in values else wanted
    sides = [rows.where(wanted).select(*columns, F.lit(n).alias("_n")) for rows, n in ((derived, 1), (base, -1))]
    return sides[0].unionAll(sides[1]).groupBy(*columns).agg(F.sum("_n").alias("surplus")).where("surplus <> 0")
