"""Metric queries: names in, one DataFrame out.

``semantic_query`` only composes DataFrame operations.  For every base table of the wanted metrics it

1. filters the table's own columns (the filter reaches its scan),
2. aggregates the additive measures by the foreign keys and own dimensions in use, before any join,
   so hot stores or products are combined inside the map tasks,
3. joins the dimension tables to that aggregate and sums again by the wanted dimensions.

Metrics of several base tables meet only then, one row per group on each side, in a null-safe full
outer join; measures of different grains are never multiplied.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.plans.model import RETAIL_MODEL, Dimension, Metric, Model, Relationship, Tables, pick


class UnknownName(ValueError):
    """A name the model does not register, or one it registers more than once."""


def _plain(name: str) -> str:
    return " ".join(name.lower().replace("_", " ").split())


def _table(name: str, model: Model) -> str:
    """A table's name by its name or synonym; a name of no table stays as it is."""
    plain = _plain(name)
    return next((t.name for t in model.tables if plain in map(_plain, (t.name, *t.synonyms))), name)


def _find(kind: str, name: str, options: Sequence[Dimension] | Sequence[Metric], model: Model) -> Any:
    wanted = _plain(name.split(".")[-1])
    prefix = _table(name.split(".")[0], model) if "." in name else None
    by_name = [o for o in options if _plain(o.name) == wanted and prefix in (None, o.table)]
    found = by_name or [o for o in options if wanted in map(_plain, o.synonyms) and prefix in (None, o.table)]
    if not found:
        raise UnknownName(f"unknown {kind} {name!r}; registered: {sorted(o.name for o in options)}")
    if len(found) > 1:
        raise UnknownName(f"ambiguous {kind} {name!r}: {[f'{o.table}.{o.name}' for o in found]}")
    return found[0]


def find_dimension(name: str, model: Model = RETAIL_MODEL) -> Dimension:
    """A dimension by name, ``table.name`` or synonyms of either, whatever the case."""
    return _find("dimension", name, model.dimensions, model)


def find_metric(name: str, model: Model = RETAIL_MODEL) -> Metric:
    return _find("metric", name, model.metrics, model)


def join_path(source: str, target: str, model: Model = RETAIL_MODEL) -> list[Relationship]:
    """The shortest chain of many-to-one relationships from one table to another."""
    paths: list[list[Relationship]] = [[r] for r in model.relationships if r.source == source]
    seen = {source}
    while paths:
        for path in paths:
            if path[-1].target == target:
                return path
        seen |= {p[-1].target for p in paths}
        paths = [
            [*p, r] for p in paths for r in model.relationships if r.source == p[-1].target and r.target not in seen
        ]
    raise UnknownName(f"{target!r} cannot be reached from {source!r} by many-to-one relationships")


@dataclass(frozen=True)
class Where:
    """A condition on one dimension: ``test`` makes a Boolean column from the dimension's column."""

    dimension: str
    test: Any

    def on(self, column: Column) -> Column:
        return self.test(column) if callable(self.test) else column == F.lit(self.test)


def semantic_query(
    tables: Tables,
    metrics: Sequence[str],
    dimensions: Sequence[str] = (),
    where: Sequence[Where] = (),
    order_by: Sequence[str] = (),
    limit: int | None = None,
    model: Model = RETAIL_MODEL,
    block: Callable[..., DataFrame] | None = None,
) -> DataFrame:
    """Metrics by dimensions.  ``order_by`` takes output names, ``-name`` for descending order.

    ``block`` makes the sums of one base table; by default they are aggregated from it.
    """
    block = block or aggregate_base
    if not metrics:
        raise UnknownName("at least one metric is needed")
    wanted = [find_metric(m, model) for m in metrics]
    groups = [find_dimension(d, model) for d in dimensions]
    tests = [(find_dimension(w.dimension, model), w) for w in where]
    parts = [p for m in wanted for p in ([find_metric(n, model) for n in m.parts] or [m])]
    bases = list(dict.fromkeys(p.table for p in parts))
    blocks = []
    for base in bases:
        of_base = list({p.name: p for p in parts if p.table == base}.values())
        blocks.append(block(tables, base, of_base, groups, tests, model))
    names = [g.name for g in groups]
    joined = reduce(lambda left, right: _align(left, right, names), blocks)
    values = {p.name: _closed(p) for p in parts}
    outputs = [
        (m.close({n: values[n] for n in m.parts}) if m.parts else values[m.name]).alias(m.name) for m in wanted
    ]
    result = joined.select(*names, *outputs)
    if order_by:
        keys = [F.desc_nulls_first(k[1:]) if k.startswith("-") else F.asc_nulls_last(k) for k in order_by]
        result = result.orderBy(*keys, *[F.asc_nulls_last(n) for n in names])
    return result if limit is None else result.limit(limit)


def _closed(metric: Metric) -> Column:
    return metric.close({m: F.col(f"{metric.name}__{m}") for m in metric.measures})


def aggregate_base(
    tables: Tables,
    base: str,
    metrics: Sequence[Metric],
    groups: Sequence[Dimension],
    tests: Sequence[tuple[Dimension, Where]],
    model: Model,
) -> DataFrame:
    """The measures of one base table, summed by the groups; columns are ``metric__measure``."""
    own = [g.name for g in groups if g.table == base]
    asked = [d.name for d, _ in tests if d.table == base]
    links = [r.column for r in model.relationships if r.source == base]
    read = [f.column for f in model.facts_of(base)] + [c for m in metrics for c in m.needs]
    rows = pick(tables, base, [*links, *own, *asked, *read])
    for dimension, test in tests:
        if dimension.table == base:
            rows = rows.where(test.on(F.col(dimension.name)))
    # the tables needed beyond the base, in join order, with the columns wanted from each
    needed = [d for d in [*groups, *[d for d, _ in tests]] if d.table != base]
    steps: dict[str, Relationship] = {}
    for dimension in needed:
        for step in join_path(base, dimension.table, model):
            steps.setdefault(step.target, step)
    keys = list(dict.fromkeys(s.column for s in steps.values() if s.source == base))
    facts = {f.name: F.col(f.column) for f in model.facts_of(base)}
    sums = [make().alias(f"{m.name}__{n}") for m in metrics for n, make in m.measures.items()]
    named = rows.withColumns(facts)
    pre = named.groupBy(*dict.fromkeys([*keys, *own])).agg(*sums) if (keys or own) else named.agg(*sums)
    if not steps:
        return pre
    onward = {s.column for s in steps.values() if s.source != base}
    for target, step in steps.items():
        columns = {d.name for d in needed if d.table == target} | (onward & {r.column for r in model.relationships if r.source == target})
        side = pick(tables, target, [step.target_column, *sorted(columns)]).select(
            F.col(step.target_column).alias(f"{target}__key"), *[c for c in sorted(columns) if c != step.target_column]
        )
        reached = [test.on(F.col(d.name)) for d, test in tests if d.table == target]
        side = side.where(reduce(lambda a, b: a & b, reached)) if reached else side
        kept = "inner" if reached else "left"
        taken = [c for c in pre.columns if c in side.columns]
        pre = pre.join(side.drop(*taken), F.col(step.column) == F.col(f"{target}__key"), kept).drop(f"{target}__key")
    again = [F.sum(f"{m.name}__{n}").alias(f"{m.name}__{n}") for m in metrics for n in m.measures]
    names = [g.name for g in groups]
    return pre.groupBy(*names).agg(*again) if names else pre.agg(*again)


def _align(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Full outer join of two aggregates on their group columns; NULL groups match each other."""
    if not names:
        # two one-row totals: put both beside each other by stacking and taking the only value
        both = left.unionByName(right, allowMissingColumns=True)
        return both.agg(*[F.max(c).alias(c) for c in both.columns])
    other = right.withColumnsRenamed({n: f"{n}__r" for n in names})
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}__r")) for n in names])
    joined = left.join(other, same, "full_outer")
    merged = [F.coalesce(n, f"{n}__r").alias(n) for n in names]
    rest = [c for c in joined.columns if c not in names and not c.endswith("__r")]
    return joined.select(*merged, *rest)
