"""Ordered computations (ranks, running values) split so that no task holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions.columns import DRAW_SIZE

_SLOTS = 4096


def rank_by_draw(rows: DataFrame, draw: str, tie: str, name: str) -> DataFrame:
    """1-based position in the order (draw, tie) over the whole table.

    A plain ``row_number`` without partition would sort everything in one task.  Draws are uniform
    over a known range, so the rows fall into equal slots of that range: each slot is numbered by
    itself and shifted by the size of the slots before it.  The shift is a window over the slot
    counts, at most 4096 rows.
    """
    slotted = rows.withColumn("_slot", F.floor(F.col(draw) / F.lit(DRAW_SIZE // _SLOTS)))
    sizes = slotted.groupBy("_slot").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_slot", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy("_slot").orderBy(draw, tie)
    return (
        slotted.withColumn("_place", F.row_number().over(within))
        .join(shifts, "_slot")
        .withColumn(name, (F.col("_place") + F.col("_shift")).cast("long"))
        .drop("_slot", "_place", "_shift")
    )


def carry_forward(
    rows: DataFrame, by: Sequence[str], order: str, value: Column, name: str, chunk: int = 10_000
) -> DataFrame:
    """The last non-NULL ``value`` on an *earlier* row of the same group, by the whole number ``order``.

    Groups are cut into chunks of the order column.  A window inside each chunk finds the value
    within it; a second window over one row per chunk carries it across chunks.  One group holding a
    third of all rows is therefore many tasks, not one.
    """
    by = list(by)
    cut = rows.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk))).withColumn("_value", value)
    inside = Window.partitionBy(*by, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = (
        cut.where(F.col("_value").isNotNull())
        .groupBy(*by, "_chunk")
        .agg(F.max_by("_value", order).alias("_last"))
    )
    # every chunk that has rows, with what the chunks before it leave behind
    chunks = cut.groupBy(*by, "_chunk").agg(F.count(F.lit(1)).alias("_rows"))
    across = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.join(last, [*by, "_chunk"], "left").select(
        *by, "_chunk", F.last("_last", ignorenulls=True).over(across).alias("_carried")
    )
    return (
        cut.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside))
        .join(carried, [*by, "_chunk"], "left")
        .withColumn(name, F.coalesce("_inside", "_carried"))
        .drop("_chunk", "_value", "_inside", "_carried")
    )


def number_rows(
    rows: DataFrame, by: Sequence[str], position: str, order: Sequence[Column], name: str, chunk: int
) -> DataFrame:
    """0-based row number per group, ordered by ``order`` whose first key is the number ``position``.

    Rows are numbered inside slices of ``position`` and shifted by the rows of the slices before.  The
    shift is a window over one row per slice.
    """
    by = list(by)
    cut = rows.withColumn("_slice", F.floor(F.col(position) / F.lit(chunk)))
    sizes = cut.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*by, "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(*by, "_slice").orderBy(*order)
    return (
        cut.withColumn("_place", F.row_number().over(within) - 1)
        .join(shifts, [*by, "_slice"])
        .withColumn(name, F.col("_place") + F.col("_shift"))
        .drop("_slice", "_place", "_shift")
    )
