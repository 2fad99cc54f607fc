"""Embedding near-dedup with randomised-rotation binary codes.

Unit vectors are rotated at random; the signs of a rotated vector are its code, and the inner product of vector and
code is stored with it as a correction factor.  <code, other> / factor then estimates the inner product of two
vectors without bias, and the factor also bounds the error.  Vectors meet where ``bits`` code bits agree, in
``tables`` independent choices of bits: both follow from the number of vectors, so that a bucket holds about
``BUCKET`` of them by chance, and a pair at the threshold is missed less than once in ten thousand times.  In a
bucket, only pairs whose upper bound reaches the threshold are computed exactly.

Equal vectors are one node with a weight from the start.  A pair counts in the first table where it meets, so
no pair is ever written out: tasks return sums of links and spanning links.  A large bucket is
cut into blocks that meet two by two.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different dimension never link; a null ``vec_id`` counts as larger than every other; rows that
repeat an id are vectors of their own; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.components import components, roots
from opslens.llm.store import NO_ID, arrow_map, cut
from opslens.llm.vectors import packed, unpacked

BUCKET = 512
BLOCK = 2048
MISSED = 1e-4
CERTAINTY = 4.0  # bounds hold with a chance of 1 - 2 exp(-CERTAINTY**2 / 2)


def rotation(dim: int, number: int) -> np.ndarray:
    """The ``number``-th random rotation of a dimension; the same in every task."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([dim, number])).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def plan(count: int, threshold: float) -> tuple[int, int]:
    """Bits and tables for a number of vectors."""
    bits = max(4, min(48, math.ceil(math.log2(max(1, count / BUCKET)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log(1 - agree))


def _keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket number of each vector in each table, from the signs of as many rotations as that takes."""
    n, dim = unit.shape
    need = bits * tables
    signs = np.concatenate([unit @ rotation(dim, k + 1).T > 0 for k in range(-(-need // dim))], axis=1)[:, :need]
    return signs.reshape(n, tables, bits) @ (np.int64(1) << np.arange(bits))


def _deal(bits: int, tables: int):
    def run(rows: pa.Table):
        # tasks see vectors of one dimension at a time
        blobs = rows["vec"].to_pylist()
        sizes = np.array([len(b) for b in blobs])
        for size in np.unique(sizes):
            some = rows.take(pa.array(np.flatnonzero(sizes == size)))
            x = unpacked(some["vec"])
            keys = _keys(x / np.linalg.norm(x, axis=1, keepdims=True), bits, tables)
            own = pa.array([k.astype("<i8").tobytes() for k in keys], pa.binary())
            for t in range(tables):
                yield pa.table(
                    {
                        "dim": pa.array(np.full(len(x), size // 8)), "t": pa.array(np.full(len(x), t)), "bucket": pa.array(keys[:, t]),
                        "rep": some["rep"], "weight": some["weight"], "vec": some["vec"], "keys": own,
                    }
                )

    return arrow_map(run)


def _sides(rows: pa.Table) -> tuple[np.ndarray, ...]:
    x = unpacked(rows["vec"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    keys = np.frombuffer(b"".join(rows["keys"].to_pylist()), "<i8").reshape(len(x), -1)
    return rows["rep"].to_numpy(), rows["weight"].to_numpy(), unit, keys


def estimates(codes_of: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of all rows of two sets of rotated unit vectors, and the bound of each row's error."""
    dim = codes_of.shape[1]
    codes = np.where(codes_of > 0, 1.0, -1.0).astype(np.float32) / np.float32(math.sqrt(dim))
    factor = np.abs(codes_of).sum(axis=1) / math.sqrt(dim)
    found = codes @ others.T.astype(np.float32) / factor[:, None].astype(np.float32)
    bound = CERTAINTY * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, dim - 1))
    return found, bound


def _compare(threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rep")
        i, j, t = rows["i"][0].as_py(), rows["j"][0].as_py(), rows["t"][0].as_py()
        rep, weight, unit, keys = _sides(rows)
        block = rows["block"].to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        turn = rotation(unit.shape[1], 0)
        turned = unit @ turn.T
        links, a_all, b_all = np.zeros(len(rep), np.int64), [], []
        for at in range(0, len(left), 256):
            part = left[at : at + 256]
            found, bound = estimates(turned[part], turned[right])
            a, b = np.nonzero(found + bound[:, None] >= threshold - 1e-5)
            a, b = part[a], right[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            for s in range(0, len(a), 1 << 17):
                p, q = a[s : s + (1 << 17)], b[s : s + (1 << 17)]
                hit = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
                p, q = p[hit], q[hit]
                if t:
                    first = ~(keys[p, :t] == keys[q, :t]).any(axis=1)
                    p, q = p[first], q[first]
                np.add.at(links, p, weight[q])
                np.add.at(links, q, weight[p])
                a_all.append(p)
                b_all.append(q)
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a_all, b_all))
        root = rep[roots(len(rep), a, b)]
        some = links > 0
        return pa.table({"rep": pa.array(rep[some]), "root": pa.array(root[some]), "links": pa.array(links[some])})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per vector."""
    rows = cut(packed(vectors), "vectors")
    valid = rows.where("vec is not null")
    classes = cut(valid.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "classes")
    # an id of several different vectors would tie them together: nodes get numbers of their own
    nodes = cut(classes.select(F.monotonically_increasing_id().alias("node"), "rep", "weight", "vec"), "nodes")
    bits, tables = plan(nodes.count(), threshold)

    kinds = "dim long, t long, bucket long, rep long, weight long, vec binary, keys binary"
    dealt = nodes.select(F.col("node").alias("rep"), "weight", "vec").mapInArrow(_deal(bits, tables), kinds)
    place = ["dim", "t", "bucket"]
    sizes = dealt.groupBy(*place).agg(F.count(F.lit(1)).alias("size"))
    sizes = cut(sizes.where("size > 1").withColumn("blocks", F.ceil(F.col("size") / block).cast("int")), "buckets")
    met = dealt.join(sizes, place).withColumn("block", F.pmod(F.xxhash64("rep", "t"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    # both sides of a pair of blocks meet under the same key, each row once in it
    parts = met.select(*place, "i", "j", "block", "rep", "weight", "vec", "keys")
    compared = parts.groupBy(*place, "i", "j").applyInArrow(_compare(threshold), "rep long, root long, links long")
    compared = cut(compared, "compared")

    joined = components(compared.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    sums = compared.groupBy("rep").agg(F.sum("links").alias("links")).withColumnRenamed("rep", "node")
    groups = nodes.join(joined.withColumnRenamed("id", "node"), "node", "left").withColumn("group", F.coalesce("component", "node"))
    least = groups.groupBy("group").agg(F.min("rep").alias("component_id"))
    result = groups.join(least, "group").join(sums, "node", "left")
    result = result.select("vec", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.join(result, "vec", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.nullif(component, F.lit(NO_ID)).alias("component_id"), (F.col("vec_id") == component).alias("kept"),
    )
