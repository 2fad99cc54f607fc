"""Embedding whitening by a bidiagonal qd solver.

1. Every vector is rounded to whole numbers; the distinct ones are the fit list, with exact sums by dimension.
2. Blockwise QR: tasks reduce the centred rows of the fit list to one triangle each, and triangles are stacked and reduced
   again in a tree, so only one d x d triangle R reaches the driver; the covariance is R'R / n.
3. Householder reflections from both sides make R bidiagonal.
4. The dqds algorithm finds the squared singular values of the bidiagonal matrix to high relative accuracy.
5. Twisted factorisations of B'B - lambda give the singular vectors, which the reflections carry back to directions; vectors of
   values too close together are made orthogonal to each other.

Steps 3 to 5 work on one d x d matrix, whatever the number of rows.

Defined cases: rows whose vector is null, or holds null or non-finite entries, or entries too large to be rounded to a long,
take no part, nor do rows of another length than the most frequent one (ties: the longest); zero vectors do; repeated
rows count once in the fit and each get their own result; a null ``vec_id`` stays null.  Directions without variance
have no whitened value and are left out, so a table with one distinct vector, or none, gives no rows.  A
deviation is a decimal of 38 digits; one beyond that is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.store import cut, parts_for, slices

SCALE, SHIFT = 64, 1_000_000
BLOCK = 4096
FAN_IN = 32
FIT_ROWS_A_TASK = 200_000
EPS = float(np.finfo(np.float64).eps)
_LARGEST = float(2**62)
_WHOLE_BITS = 62


def _whole(rows: pa.Table | pa.RecordBatch) -> tuple[list[bytes | None], list[int]]:
    """Each vector as the bytes of its whole numbers, None for one that takes no part; and the lengths."""
    column = rows["embedding"]
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.array([n or 0 for n in pc.list_value_length(column).to_pylist()], np.int64)
    numbers = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(numbers * SCALE)
    fine = np.isfinite(numbers) & (np.abs(scaled) < _LARGEST)
    x = np.where(fine, scaled, 0.0).astype(np.int64) + SHIFT
    bad = np.concatenate([[0], np.cumsum(~fine)])
    ends = np.cumsum(lengths)
    ok = (bad[ends] == bad[ends - lengths]) & (lengths > 0)
    return [x[e - n : e].tobytes() if o else None for e, n, o in zip(ends.tolist(), lengths.tolist(), ok)], lengths.tolist()


def _rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch):
            blobs, lengths = _whole(rows)
            yield pa.record_batch({"vec_id": rows["vec_id"], "x": pa.array(blobs, pa.binary()), "d": pa.array(lengths, pa.int32())})


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), np.int64).reshape(len(blobs), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums by dimension of this task's vectors, as digits."""
    n, sums = 0, None
    for batch in batches:
        for rows in slices(batch):
            if rows.num_rows:
                x = matrix(rows["x"])
                # high and low halves, so that no sum passes 64 bits
                high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
                part = [(h << 32) + v for h, v in zip(high, low)]
                n, sums = n + len(x), part if sums is None else [a + b for a, b in zip(sums, part)]
    if sums is not None:
        yield pa.record_batch({"n": [n], "sums": pa.array([[str(s) for s in sums]], pa.list_(pa.string()))})


def scaled_difference(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: as 64-bit numbers where they hold it, else as Python's whole numbers."""
    top = max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, sums)) if len(x) else 0
    if top.bit_length() <= _WHOLE_BITS:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (scaled_difference(x, n, sums) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums of squares of n * x - S."""
    wide = scaled_difference(x, n, sums)
    if wide.dtype == np.int64:
        top = int(np.abs(wide).max()) if wide.size else 0
        if 2 * top.bit_length() + wide.shape[1].bit_length() <= _WHOLE_BITS:
            return (wide * wide).sum(axis=1).tolist()
        wide = wide.astype(object)
    return (wide * wide).sum(axis=1).tolist()


def _triangles(n: int, sums: list[int]):
    """One triangle R with R'R equal to the sum of x x' over this task's centred vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, len(sums)))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = centred(matrix(batch.slice(at, BLOCK)["x"]), n, sums)
                held = np.linalg.qr(np.vstack([held, block]), mode="r")
        if len(held):
            yield pa.record_batch({"rows": [len(held)], "r": pa.array([held.tobytes()], pa.binary())})

    return run


def _stacked(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, d))
        for batch in batches:
            for blob in batch["r"].to_pylist():
                held = np.linalg.qr(np.vstack([held, np.frombuffer(blob).reshape(-1, d)]), mode="r")
        if len(held):
            yield pa.record_batch({"rows": [len(held)], "r": pa.array([held.tobytes()], pa.binary())})

    return run


def triangle(fit: DataFrame, n: int, sums: list[int], rows_a_task: int = FIT_ROWS_A_TASK, fan_in: int = FAN_IN) -> np.ndarray:
    """The d x d triangle of all centred vectors; tasks' triangles meet ``fan_in`` at a time."""
    d = len(sums)
    parts = parts_for(n, rows_a_task)
    schema = "rows long, r binary"
    held = cut(fit.repartition(parts, "x").mapInArrow(_triangles(n, sums), schema), "triangles")
    while parts > 1:
        parts = parts_for(parts, fan_in)
        held = cut(held.repartition(parts).mapInArrow(_stacked(d), schema), "triangles")
    out = np.zeros((d, d))
    for row in held.collect():
        r = np.frombuffer(bytes(row["r"])).reshape(-1, d)
        out[: len(r)] = r
    return out


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a, superdiagonal b and orthogonal W with r = U B W' for some orthogonal U."""
    m = r.astype(np.float64).copy()
    d = m.shape[1]
    w = np.eye(d)

    def reflector(v: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(v)
        if size == 0 or not np.any(v[1:]):
            return None
        v = v / size
        v[0] += math.copysign(1.0, v[0])
        return v / np.linalg.norm(v)

    for k in range(d):
        v = reflector(m[k:, k].copy())
        if v is not None:
            m[k:, k:] -= 2 * np.outer(v, v @ m[k:, k:])
        if k < d - 2:
            v = reflector(m[k, k + 1 :].copy())
            if v is not None:
                m[k:, k + 1 :] -= 2 * np.outer(m[k:, k + 1 :] @ v, v)
                w[:, k + 1 :] -= 2 * np.outer(w[:, k + 1 :] @ v, v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), w


def _transformed(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One dqds sweep: the qd array of the matrix less ``shift``, or None where that is not positive."""
    n = len(q)
    qq, ee = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    least = d
    for i in range(n - 1):
        if d < 0:
            return None
        qq[i] = d + e[i]
        if qq[i] == 0.0:
            # a zero pivot: the next value starts afresh
            ee[i], d = 0.0, q[i + 1] - shift
        else:
            t = q[i + 1] / qq[i]
            ee[i] = e[i] * t
            d = d * t - shift
        least = min(least, d)
    if d < 0 or math.isnan(d):
        return None
    qq[n - 1] = d
    return qq, ee, least


def _pair(q: float, e: float, last: float) -> tuple[float, float]:
    """Both eigenvalues of a 2 x 2 qd array, larger first, without cancellation."""
    high = (q + e + last + math.sqrt((q - last + e) ** 2 + 4 * last * e)) / 2
    return high, last * (q / high) if high else 0.0


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix by dqds, falling."""
    found: list[float] = []
    work = [([float(v) ** 2 for v in a], [float(v) ** 2 for v in b], 0.0)]
    while work:
        q, e, base = work.pop()
        sweeps = 0
        if len(q) > 2 and q[0] < q[-1]:
            q, e = q[::-1], e[::-1]  # the small values belong at the end
        while q:
            n = len(q)
            if n == 1:
                found.append(base + q[0])
                break
            if n == 2:
                found += [base + v for v in _pair(q[0], e[0], q[1])]
                break
            split = next((i for i in range(n - 2, -1, -1) if e[i] <= EPS * EPS * (base + min(q[i], q[i + 1])) or e[i] == 0.0), None)
            if split is not None:
                work.append((q[: split + 1], e[:split], base))
                q, e = q[split + 1 :], e[split + 1 :]
                continue
            if sweeps > 100 * n:
                raise ArithmeticError("dqds did not settle")
            # the smaller eigenvalue of the last 2 x 2 block, less a margin, then smaller shifts down to none
            shift = _pair(q[-2], e[-1], q[-1])[1] * (1 - 4 * EPS)
            for guess in (shift, shift * 0.75, shift * 0.25, 0.0):
                done = _transformed(q, e, guess)
                if done is not None:
                    break
            if done is None:
                raise ArithmeticError("a qd array is not positive")
            q, e, _ = done
            base += guess
            sweeps += 1
    return np.sort(np.array(found))[::-1]


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """A vector z with (B'B - value) z = gamma e_r, from the twisted factorisation with the smallest gamma."""
    n = len(a)
    tiny = np.finfo(np.float64).tiny * 4
    big = a * a
    low = b / np.where(a[:-1] == 0, 1, a[:-1]) if n > 1 else np.zeros(0)
    down, up = np.zeros(max(0, n - 1)), np.zeros(max(0, n - 1))
    s, p = np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):  # stationary qd, from the top
        pivot = s[i] + big[i]
        pivot = pivot if abs(pivot) > tiny else math.copysign(tiny, pivot)
        down[i] = big[i] * low[i] / pivot
        s[i + 1] = down[i] * low[i] * s[i] - value
    p[n - 1] = big[n - 1] - value
    for i in range(n - 2, -1, -1):  # progressive qd, from the bottom
        pivot = big[i] * low[i] ** 2 + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else math.copysign(tiny, pivot)
        t = big[i] / pivot
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    gamma = s + p + value
    r = int(np.argmin(np.abs(np.where(np.isfinite(gamma), gamma, np.inf))))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -up[i] * z[i]
    size = np.linalg.norm(z)
    return z / size if np.isfinite(size) and size > 0 else np.eye(n)[r]


def _blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of the bidiagonal matrix between entries that are nothing beside its norm."""
    norm = max(np.abs(a).max(), np.abs(b).max() if len(b) else 0.0)
    # b_i couples i and i + 1 in B'B through a_i * b_i
    ends = [i + 1 for i in range(len(b)) if abs(a[i] * b[i]) <= (EPS * norm) ** 2 or abs(b[i]) <= EPS * EPS * norm]
    return list(zip([0] + ends, ends + [len(a)]))


def _refined(a: np.ndarray, b: np.ndarray, z: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Vectors of close values made orthogonal, by one Rayleigh-Ritz step inside each cluster."""
    t = np.diag(a * a)
    if len(b):
        t[np.arange(1, len(a)), np.arange(1, len(a))] += b * b
        t += np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    scale = values[0] if len(values) and values[0] > 0 else 1.0
    low = 0
    rng = np.random.Generator(np.random.PCG64(7))
    while low < len(values):
        high = low + 1
        while high < len(values) and values[high - 1] - values[high] <= 1e-3 * max(values[high - 1], EPS * scale):
            high += 1
        if high - low > 1:
            for j in range(low, high):
                v = z[:, j].copy()
                for attempt in range(4):
                    for _ in range(2):
                        v -= z[:, low:j] @ (z[:, low:j].T @ v)
                    size = np.linalg.norm(v)
                    if size > 1e-3:
                        break
                    # the vector repeats another one of its cluster: inverse iteration from a new start
                    off = values[j] + (attempt + 1) * 8 * EPS * scale
                    v = np.linalg.solve(t - off * np.eye(len(a)), rng.standard_normal(len(a)))
                    v /= np.linalg.norm(v)
                z[:, j] = v / size
            part = z[:, low:high]
            _, turn = _small_eigen(part.T @ t @ part)
            z[:, low:high] = part @ turn
        low = high
    return z


def _small_eigen(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and vectors of the small symmetric matrix of one cluster, by Jacobi rotations."""
    m, v = (m + m.T) / 2, np.eye(len(m))
    for _ in range(30):
        if np.abs(m - np.diag(np.diag(m))).max() <= EPS * np.abs(m).max():
            break
        for i in range(len(m) - 1):
            for j in range(i + 1, len(m)):
                if m[i, j] != 0:
                    tau = (m[j, j] - m[i, i]) / (2 * m[i, j])
                    t = math.copysign(1.0, tau) / (abs(tau) + math.hypot(1.0, tau))
                    c = 1 / math.hypot(1.0, t)
                    turn = np.array([[c, t * c], [-t * c, c]])
                    m[:, [i, j]] = m[:, [i, j]] @ turn
                    m[[i, j], :] = turn.T @ m[[i, j], :]
                    v[:, [i, j]] = v[:, [i, j]] @ turn
    order = np.argsort(-np.diag(m), kind="stable")
    return np.diag(m)[order], v[:, order]


def principal_directions(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues of r'r and their unit vectors as columns."""
    a, b, w = bidiagonal(r)
    values, vectors = np.zeros(0), np.zeros((len(a), 0))
    for low, high in _blocks(a, b):
        aa, bb = a[low:high].copy(), b[low : high - 1]
        norm = max(np.abs(a).max(), 1e-300)
        aa[:-1] = np.where(np.abs(aa[:-1]) < EPS * EPS * norm, EPS * EPS * norm, aa[:-1])
        own = squared_singular_values(aa, bb)
        z = np.stack([_twisted(aa, bb, v) for v in own], axis=1)
        z = _refined(aa, bb, z, own)
        wide = np.zeros((len(a), len(own)))
        wide[low:high] = z
        values, vectors = np.append(values, own), np.hstack([vectors, wide])
    order = np.argsort(-values, kind="stable")
    return values[order], w @ vectors[:, order]


def _moments(n: int, sums: list[int], into: np.ndarray):
    """Sums and products of the whitened vectors of this task."""
    k = into.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                z = centred(matrix(batch.slice(at, BLOCK)["x"]), n, sums) @ into
                one, two = one + z.sum(axis=0), two + z.T @ z
        flat = np.concatenate([one, two.ravel()])
        yield pa.record_batch({"at": pa.array(np.arange(len(flat), dtype=np.int32)), "v": pa.array(flat)})

    return run


def _applied(n: int, sums: list[int], into: np.ndarray, shares: np.ndarray, error: float):
    k = into.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(at, BLOCK)
                x = matrix(rows["x"])
                z = centred(x, n, sums) @ into
                which = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.record_batch(
                    {
                        "vec_id": rows["vec_id"].take(which),
                        "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        "n": pa.array(np.full(len(x) * k, n)),
                        "deviation": pa.array([str(v) for v in deviations(x, n, sums)]).take(which),
                        "whitened": pa.array(z.ravel()),
                        "explained": pa.array(np.tile(shares, len(x))),
                        "identity_error": pa.array(np.full(len(x) * k, error)),
                    }
                )

    return run


_OUT = "vec_id long, component int, n long, deviation string, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 16, rows_a_task: int = FIT_ROWS_A_TASK) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per vector and component."""
    spark = vectors.sparkSession
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    held = cut(plain.mapInArrow(_rounded, "vec_id long, x binary, d int").where("x is not null"), "rounded-vectors")
    dims = held.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    empty = spark.createDataFrame([], _OUT).withColumn("deviation", F.expr("cast(deviation as decimal(38, 0))"))
    if dims is None:
        return empty
    held = held.where(F.col("d") == dims["d"])
    fit = cut(held.select("x").distinct(), "fit-vectors")
    parts = fit.mapInArrow(_sums, "n long, sums array<string>")
    added = parts.select("n", F.posexplode("sums").alias("dim", "s")).groupBy("dim")
    by_dim = added.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38, 0)")).alias("s")).orderBy("dim").collect()
    n, sums = by_dim[0]["n"], [int(r["s"]) for r in by_dim]

    values, directions = principal_directions(triangle(fit, n, sums, rows_a_task))
    values = values / n
    rank = int((values > len(values) * EPS * values[0]).sum()) if values[0] > 0 else 0
    k = min(components, rank)
    if not k:
        return empty
    into = directions[:, :k] / np.sqrt(values[:k])
    flat = np.zeros(k + k * k)
    for row in fit.mapInArrow(_moments(n, sums, into), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        flat[row["at"]] = row["v"]
    mean = flat[:k] / n
    error = float(np.abs(flat[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    out = held.mapInArrow(_applied(n, sums, into, values[:k] / values.sum(), error), _OUT)
    return out.withColumn("deviation", F.expr("try_cast(deviation as decimal(38, 0))"))
