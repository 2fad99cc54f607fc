"""Connected components of a link table: contraction inside partitions, then large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.store import cut, parts_for

LINKS_A_PART = 500_000
_ROUNDS = 60


def roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of ``size`` positions over links a-b."""
    root = np.arange(size)
    while len(a):
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as stars around the smallest ids."""
    held = [(b["a"].to_numpy(), b["b"].to_numpy()) for b in batches if b.num_rows]
    if held:
        a, b = (np.concatenate(side) for side in zip(*held))
        ids, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = roots(len(ids), places[: len(a)], places[len(a) :])
        moved = root != np.arange(len(ids))
        yield pa.record_batch({"a": ids[moved], "b": ids[root[moved]]})


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Tie the larger (or the smaller, own one included) neighbours of every node to its smallest one.

    The smallest neighbour is an aggregate that is joined back, so a node with a third of all links is
    combined in the map tasks and adaptive execution may split its rows in the join.
    """
    if large:
        near = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    tied = near.join(least, F.col("a") == F.col("u"))
    if large:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()


def _mark(links: DataFrame):
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, purpose: str = "components", part: int = LINKS_A_PART) -> DataFrame:
    """(id, component) for every id that has a link; ``component`` is the smallest id reachable.

    ``links``: columns a, b.  Loops and repeated links do no harm; no link gives no row.  Partitions of at most about
    ``part`` links are contracted by themselves; with one partition that is the answer, with more, star steps tie the
    partitions together.
    """
    links = cut(links.where("a <> b").select("a", "b"), purpose)
    parts = parts_for(links.count(), part)
    links = cut(links.repartition(parts, "a").mapInArrow(_contract, "a long, b long"), purpose)
    mark = _mark(links) if parts > 1 else None
    for _ in range(_ROUNDS):
        if not mark or not mark[0]:
            break
        # both steps of a round run as one query, and each round ends in a stored table
        links = cut(_star(_star(links, True), False), purpose)
        now = _mark(links)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {_ROUNDS} rounds")
    ends = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.unionAll(links.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
