"""Exact quantiles of measures with any number of distinct values, by brackets that are refined in passes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOUND = 100_000
ACCURACY = 2_000


@dataclass(frozen=True)
class _Bracket:
    """Values strictly between ``low`` and ``high`` (None: no end), ``inside`` of them, ``before`` at or below ``low``."""

    low: float | None
    high: float | None
    before: int
    inside: int

    def holds(self) -> Column:
        above = F.lit(True) if self.low is None else F.col("v") > F.lit(self.low)
        return above if self.high is None else above & (F.col("v") < F.lit(self.high))


def _splits(values: DataFrame, brackets: Mapping[int, _Bracket], margin: float, accuracy: int) -> dict[int, tuple[float, float]]:
    """A smaller pair of values around each rank, from sketches of the values inside its bracket; one pass for all."""
    aggs = []
    for rank, b in brackets.items():
        share = (rank - b.before + 0.5) / b.inside
        around = [max(0.0, share - margin), min(1.0, share + margin)]
        aggs.append(F.percentile_approx(F.when(b.holds(), F.col("v")), around, accuracy).alias(f"r{rank}"))
    row = values.agg(*aggs).first()
    return {rank: tuple(row[f"r{rank}"]) for rank in brackets}


def _counts(values: DataFrame, brackets: Mapping[int, _Bracket], splits: Mapping[int, tuple[float, float]]):
    """For each rank: values of its bracket below the lower end, equal to it, up to below the upper end, equal to that."""
    aggs = []
    for rank, (low, high) in splits.items():
        v, held = F.col("v"), brackets[rank].holds()
        conditions = (v < low, v == low, (v > low) & (v < high), (v == high) & (v > low))
        aggs += [F.count_if(held & c).alias(f"r{rank}_{k}") for k, c in enumerate(conditions)]
    row = values.agg(*aggs).first()
    return {rank: [row[f"r{rank}_{k}"] for k in range(4)] for rank in splits}


def order_statistics(
    rows: DataFrame, column: str, ranks: Sequence[int], size: int, bound: int = BOUND, accuracy: int = ACCURACY
) -> dict[int, float]:
    """The values at 0-based ``ranks`` among the ``size`` values of a column that are neither NULL nor NaN.

    Each round takes two passes of map-side aggregates: sketches give a bracket around every rank that is still open, and exact
    counts say where the rank lies.  A bracket shrinks to about ``4 / accuracy`` of itself, so a trillion values take four
    rounds; at most ``bound`` distinct values of a last bracket leave the cluster.  Values that repeat end a search at once.
    """
    values = _values(rows, column)
    open_ranks = {r: _Bracket(None, None, 0, size) for r in dict.fromkeys(ranks)}
    found: dict[int, float] = {}
    while True:
        for rank, b in [(r, b) for r, b in open_ranks.items() if b.inside <= bound]:
            at = b.before
            for value, n in values.where(b.holds()).groupBy("v").count().orderBy("v").collect():
                if rank < at + n:
                    found[rank] = value
                    break
                at += n
            del open_ranks[rank]
        if not open_ranks:
            return found
        splits = _splits(values, open_ranks, 2.0 / accuracy, accuracy)
        for rank, (below, low, between, high) in _counts(values, open_ranks, splits).items():
            b, ends = open_ranks[rank], splits[rank]
            place = rank - b.before
            if place < below:  # the sketch was off: its lower end still cuts the bracket
                open_ranks[rank] = _Bracket(b.low, ends[0], b.before, below)
            elif place < below + low:
                found[rank] = ends[0]
            elif place < below + low + between:
                open_ranks[rank] = _Bracket(*ends, b.before + below + low, between)
            elif place < below + low + between + high:
                found[rank] = ends[1]
            else:
                gone = below + low + between + high
                open_ranks[rank] = _Bracket(ends[1], b.high, b.before + gone, b.inside - gone)
        open_ranks = {r: b for r, b in open_ranks.items() if r not in found}


def _values(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))


def exact_quantiles(
    rows: DataFrame, column: str, wanted: Sequence[float], bound: int = BOUND, accuracy: int = ACCURACY
) -> dict[float, float | None]:
    """Interpolated quantiles of a whole column, as ``percentile`` gives them; None where there is no value.

    ``rows`` is read several times and should be a stored table.
    """
    size = _values(rows, column).count()
    if not size:
        return dict.fromkeys(wanted)
    places = {p: p * (size - 1) for p in wanted}
    ends = {p: (int(x), min(int(x) + 1, size - 1)) for p, x in places.items()}
    at = order_statistics(rows, column, [r for pair in ends.values() for r in pair], size, bound, accuracy)
    out = {}
    for p, (one, two) in ends.items():
        share = places[p] - one
        # equal ends, infinite ones too, need no arithmetic
        out[p] = at[one] if share == 0 or at[one] == at[two] else at[one] * (1 - share) + at[two] * share
    return out
