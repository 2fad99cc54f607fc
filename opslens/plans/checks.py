"""Checks of the data against the metrics model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.plans.model import RETAIL_MODEL, Dimension, Model, Tables, pick


def _enums(model: Model) -> dict[str, list[Dimension]]:
    """Enumerated dimensions by table: each table is read once for all of its own."""
    by_table: dict[str, list[Dimension]] = {}
    for d in model.dimensions:
        if d.is_enum:
            by_table.setdefault(d.table, []).append(d)
    return by_table


def enum_violations(tables: Tables, model: Model = RETAIL_MODEL) -> DataFrame:
    """Values outside the declared ones, per enumerated dimension, with their row counts.

    Only values outside the literal lists leave the scan, and they are counted before they travel.
    """
    found = []
    for table, enums in _enums(model).items():
        pairs = [F.struct(F.lit(d.name).alias("dimension"), F.when(~F.col(d.name).isin(*d.values), F.col(d.name).cast("string")).alias("value")) for d in enums]
        values = pick(tables, table, [d.name for d in enums]).select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull())
        found.append(values.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("occurrences")))
    return reduce(DataFrame.unionAll, found)


def enum_summary(tables: Tables, model: Model = RETAIL_MODEL) -> DataFrame:
    """Per enumerated dimension: rows inside and outside the declared values, and rows without one."""
    found = []
    for table, enums in _enums(model).items():
        counts, rows = [], []
        for d in enums:
            inside = F.col(d.name).isin(*d.values)
            tests = {"inside": inside, "outside": ~inside, "missing": F.col(d.name).isNull()}
            counts += [F.count_if(test).alias(f"{d.name}__{kind}") for kind, test in tests.items()]
            rows.append(F.struct(F.lit(d.name).alias("dimension"), *[F.col(f"{d.name}__{kind}").alias(kind) for kind in tests]))
        found.append(pick(tables, table, [d.name for d in enums]).agg(*counts).select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionAll, found)


def key_violations(tables: Tables, model: Model = RETAIL_MODEL) -> DataFrame:
    """Per table: rows, rows with a NULL key part, keys used twice and the rows beyond the first."""
    found = []
    for t in model.tables:
        missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in t.primary_key])
        sizes = pick(tables, t.name, t.primary_key).groupBy(*t.primary_key).agg(F.count(F.lit(1)).alias("_n"))
        twice = (F.col("_n") > 1) & ~F.col("_missing")
        found.append(
            sizes.withColumn("_missing", missing).agg(
                F.lit(t.name).alias("table_name"),
                F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
                F.coalesce(F.sum(F.when(F.col("_missing"), F.col("_n"))), F.lit(0)).alias("null_keys"),
                F.count_if(twice).alias("duplicate_keys"),
                F.coalesce(F.sum(F.when(twice, F.col("_n") - 1)), F.lit(0)).alias("extra_rows"),
            )
        )
    return reduce(DataFrame.unionAll, found)


def orphans(tables: Tables, model: Model = RETAIL_MODEL) -> DataFrame:
    """Per relationship: foreign keys without a partner and the rows carrying them.

    Keys are counted before the anti-join, so a key on many rows travels once.
    """
    found = []
    for r in model.relationships:
        keys = (
            pick(tables, r.source, [r.column])
            .where(F.col(r.column).isNotNull())
            .groupBy(F.col(r.column).alias("_key"))
            .agg(F.count(F.lit(1)).alias("_n"))
        )
        target = pick(tables, r.target, [r.target_column]).select(F.col(r.target_column).alias("_key"))
        lost = keys.join(target, "_key", "left_anti")
        found.append(
            lost.agg(
                F.lit(f"{r.source}.{r.column} -> {r.target}").alias("relationship"),
                F.count(F.lit(1)).alias("orphan_keys"),
                F.coalesce(F.sum("_n"), F.lit(0)).alias("orphan_rows"),
            )
        )
    return reduce(DataFrame.unionAll, found)
