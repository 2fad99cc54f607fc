"""Approximate nearest neighbours by collision counting.

Every shard of the table projects its vectors on ``projections`` random lines and sorts each line once.  A query
opens a window around its own projection on every line; virtual rehashing widens all windows together by
``widen`` per round, starting one round below the width of the query before, and each round counts only what the
wider windows add.  A vector inside the window on at
least ``share`` of the lines is frequent; as soon as ``EACH`` vectors for every
wanted neighbour and a share ``verify`` of the shard are frequent, all frequent ones are computed exactly.  Nothing is indexed on a sample.

Inner products become distances by one extra coordinate that brings all vectors to the length of the longest
(the longest length is a maximum over the whole table).  Queries, the rows with ids divisible by ``every``, meet
all shards in blocks; each meeting returns its best and the blocks' answers are merged.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those of
another dimension than the query; equal scores go to the smaller id, a null id last; rows that repeat an id are
vectors of their own, a query never meets its own row; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslens.llm.store import NO_ID, cut, parts_for
from opslens.llm.vectors import packed, unpacked

NEAREST = 20
PROJECTIONS = 64
SHARE = 0.9
VERIFY = 0.05
EACH = 40
WIDEN = 1.1
SHARD = 8_192
QUERIES = 4_096


class Lines:
    """The sorted projections of a shard, and counting of collisions in windows around a query."""

    def __init__(self, points: np.ndarray, projections: int):
        dim = points.shape[1]
        self.axes = np.random.Generator(np.random.PCG64([dim, 7])).standard_normal((dim, projections))
        places = (points @ self.axes).T
        self.order = np.argsort(places, axis=1, kind="stable")
        self.size, self.lines = len(points), projections
        # all lines in one ascending row, far enough apart: one search finds the windows on all of them
        self.apart = 4 * (np.abs(places).max() + np.abs(self.axes).sum()) * np.arange(projections)
        self.sorted = (np.take_along_axis(places, self.order, axis=1) + self.apart[:, None]).reshape(-1)
        self.starts = self.size * np.arange(projections)

    def _members(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How often each vector lies in low:high of the lines."""
        found = [o[a:b] for o, a, b in zip(self.order, low.tolist(), high.tolist()) if a < b]
        return np.bincount(np.concatenate(found), minlength=self.size) if found else np.zeros(self.size, np.int64)

    def frequent(self, query: np.ndarray, wanted: int, share: float, widen: float, width: float) -> tuple[np.ndarray, float]:
        """Positions of vectors that collide on enough lines, in the first round that has ``wanted`` of them; and its width.

        The first round counts the smaller side of its windows, inside or outside; later ones count what they add.
        """
        at = query @ self.axes + self.apart
        need = int(np.ceil(share * self.lines))
        nothing, all_ = np.zeros(self.lines, np.int64), np.full(self.lines, self.size)
        counts = low = high = None
        while True:
            ends = np.searchsorted(self.sorted, np.concatenate([at - width, at + width])).reshape(2, -1) - self.starts
            lower, upper = np.clip(ends, 0, self.size)
            if counts is None and 2 * (upper - lower).sum() > self.lines * self.size:
                counts = self.lines - self._members(nothing, lower) - self._members(upper, all_)
            elif counts is None:
                counts = self._members(lower, upper)
            else:
                counts += self._members(lower, low) + self._members(high, upper)
            low, high = lower, upper
            found = counts >= need
            if found.sum() >= min(wanted, self.size):
                return np.flatnonzero(found), width
            width *= widen


def _search(nearest: int, projections: int, share: float, verify: float, widen: float, longest: float):
    names = ["query", "query_id", "row", "vec_id", "score"]

    def run(rows: pa.Table) -> pa.Table:
        asked = rows.filter(rows["asks"])
        # in the order of ids, so that position breaks ties
        shard = rows.filter(pa.compute.invert(rows["asks"])).sort_by([("vec_id", "ascending"), ("row", "ascending")])
        out: list[tuple] = []
        if asked.num_rows and shard.num_rows:
            x, ids, own = unpacked(shard["vec"]), shard["vec_id"].to_numpy(), shard["row"].to_numpy()
            rest = np.sqrt(np.maximum(0, longest**2 - (x**2).sum(axis=1)))
            lines = Lines(np.hstack([x, rest[:, None]]) / longest, projections)
            queries = unpacked(asked["vec"])
            width = 1.0
            for q, query, number in zip(queries, asked["row"].to_numpy(), asked["vec_id"].to_numpy()):
                toward = np.append(q / np.linalg.norm(q), 0.0)
                # queries need much the same width: start a round below the last one's
                some, width = lines.frequent(toward, EACH * nearest + 1 + int(verify * lines.size), share, widen, width / widen)
                some = some[own[some] != query]
                score = x[some] @ q
                if len(some) > nearest:
                    edge = np.partition(score, -nearest)[-nearest]
                    some = some[score >= edge - 1e-9 * (1 + abs(edge))]
                score = (x[some] * q).sum(axis=1)  # row by row: equal vectors get equal scores
                best = np.argsort(-score, kind="stable")[:nearest]
                out += zip([query] * len(best), [number] * len(best), own[some[best]], ids[some[best]], score[best])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 5, kinds)], names)

    return run


def nearest_vectors(
    vectors: DataFrame, every: int = 20, nearest: int = NEAREST, projections: int = PROJECTIONS, share: float = SHARE,
    verify: float = VERIFY, widen: float = WIDEN, shard: int = SHARD, queries: int = QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``nearest`` rows of largest inner product for each query."""
    rows = packed(vectors).where("vec is not null").withColumn("row", F.monotonically_increasing_id())
    rows = cut(rows, "vectors")
    asks = (F.col("vec_id") % every == 0) & (F.col("vec_id") != NO_ID)
    square = F.aggregate(F.transform(F.filter("embedding", F.isnotnull), lambda v: v.cast("double") * v.cast("double")), F.lit(0.0), lambda a, b: a + b)
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    counted = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if(asks).alias("asked")).first()
    longest = vectors.where(fine).agg(F.max(square)).first()[0]
    longest = float(np.sqrt(longest)) * (1 + 1e-12) if longest else 1.0
    shards, blocks = parts_for(counted["all"], shard), parts_for(counted["asked"], queries)

    dim = F.octet_length("vec")
    mine = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    here = rows.select("*", dim.alias("dim"), mine.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(False).alias("asks"))
    asked = rows.where(asks).select(
        "*", dim.alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"),
        F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int").alias("b"), F.lit(True).alias("asks"),
    )
    search = _search(nearest, projections, share, verify, widen, longest)
    met = here.unionByName(asked).groupBy("dim", "s", "b").applyInArrow(search, "query long, query_id long, row long, vec_id long, score double")
    # at most ``nearest`` rows of each shard for a query
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
