"""Named reporting periods as half-open day ranges."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.fixed_values import RELATIVE_PERIODS
from opslens.functions.columns import as_date


@dataclass(frozen=True)
class Period:
    """Days from ``start`` (included) to ``end`` (excluded)."""

    name: str
    start: dt.date
    end: dt.date

    def covers(self, day: Column) -> Column:
        return (day >= F.lit(self.start)) & (day < F.lit(self.end))


def _month(day: dt.date, shift: int = 0) -> dt.date:
    index = day.year * 12 + day.month - 1 + shift
    return dt.date(index // 12, index % 12 + 1, 1)


def period_range(name: str, as_of: dt.date | str | None = None) -> Period:
    """Resolve a period name; the bounds are literals, so they reach the scan as pushed filters."""
    today = as_date(as_of)
    tomorrow = today + dt.timedelta(days=1)
    month = _month(today)
    quarter = _month(today, -((today.month - 1) % 3))
    monday = today - dt.timedelta(days=today.weekday())
    label = " ".join(name.lower().split())
    fixed = {
        "last month": (_month(today, -1), month),
        "this month": (month, tomorrow),
        "last quarter": (_month(quarter, -3), quarter),
        "this quarter": (quarter, tomorrow),
        "year to date": (dt.date(today.year, 1, 1), tomorrow),
        "last week": (monday - dt.timedelta(days=7), monday),
    }
    if label in fixed:
        return Period(name, *fixed[label])
    trailing = re.fullmatch(r"last (\d+) days", label)
    if trailing:
        return Period(name, today - dt.timedelta(days=int(trailing[1])), tomorrow)
    named = re.fullmatch(r"q([1-4]) (\d{4})", label)
    if named:
        first = dt.date(int(named[2]), int(named[1]) * 3 - 2, 1)
        return Period(name, first, _month(first, 3))
    raise ValueError(f"unknown period {name!r}; use one of {RELATIVE_PERIODS}, 'last N days' or 'Qn YYYY'")


def between(first: dt.date | str, last: dt.date | str) -> Period:
    """A closed day range as a Period."""
    start, end = as_date(first), as_date(last)
    return Period(f"{start} to {end}", start, end + dt.timedelta(days=1))


def quarters_in_window(first: dt.date | str, last: dt.date | str) -> list[str]:
    """Labels of the calendar quarters touching [first, last]."""
    start, end = as_date(first), as_date(last)
    month = dt.date(start.year, (start.month - 1) // 3 * 3 + 1, 1)
    labels = []
    while month <= end:
        labels.append(f"Q{(month.month + 2) // 3} {month.year}")
        month = _month(month, 3)
    return labels


def totals_by_period(
    facts: DataFrame, day: str, periods: Sequence[Period], measures: dict[str, Column]
) -> DataFrame:
    """Sum measures over several, possibly overlapping, periods in one pass and no join.

    Each period is one conditional aggregate, so a row is read once however many periods hold it.
    """
    totals = []
    for i, period in enumerate(periods):
        inside = period.covers(F.col(day))
        for name, measure in measures.items():
            totals.append(F.sum(F.when(inside, measure)).alias(f"{name}_{i}"))
    rows = [
        F.struct(
            F.lit(p.name).alias("period"),
            F.lit(p.start).alias("period_start"),
            F.lit(p.end).alias("period_end"),
            *[F.col(f"{name}_{i}").alias(name) for name in measures],
        )
        for i, p in enumerate(periods)
    ]
    widest = max(p.end for p in periods)
    earliest = min(p.start for p in periods)
    inside_any = (F.col(day) >= F.lit(earliest)) & (F.col(day) < F.lit(widest))
    return facts.where(inside_any).agg(*totals).select(F.inline(F.array(*rows)))
