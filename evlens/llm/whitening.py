"""Embedding whitening with principal components found by FEAST contour integration.

Spark passes over the vectors three times; each pass hands on sums only, whose number
depends on the dimensions alone:

1. the sum of every dimension;
2. the scatter matrix, exact: entries are integers, centred on the rounded mean before
   they are multiplied, and the part that rounding left is taken off in integers too, so
   the covariance does not depend on partitions or order;
3. the whitened covariance, for its distance from the identity.

Components: inertia counts (signs of the pivots of a symmetric factorisation with a
shift) cut the spectrum into intervals of few eigenvalues, until those above the last cut
are enough. Every interval is a Spark row of its own. Its eigenvectors come from a
contour around it: Gauss-Legendre quadrature of solves with the complex shifted
covariance projects a block of vectors onto the interval, Rayleigh-Ritz in that space
gives values and vectors, and this repeats until residuals are at rounding level. An
interval is done only if it holds as many values as the inertia counts of its ends say,
so none can be missed. One Rayleigh-Ritz step over the vectors of all intervals makes
them orthogonal to double precision.

Results: a row for every remaining vector (repeated rows and null ids too) and component.
Vectors that are null, empty, or hold a null or non-finite entry do not take part, nor do
those of another length than the most frequent one (the longer of equally frequent ones)
or with an entry of 2^40 or more in size, whose integer form is not exact here. Directions
without variance, relative to the largest, cannot be whitened: they are no components, so
fewer vectors than dimensions give fewer components, and one vector or equal ones none.
``deviation`` is null where it does not fit a long. Other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlens.llm.common import workers_find_package

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
PER_INTERVAL = 8          # eigenvalues an interval may hold, unless they are too close to be cut apart
NODES = 8                 # quadrature points on half a contour
SWEEPS = 40
SEED = 20_011
LARGEST = 1 << 40
_EXACT = 1 << 53
_LONG = (1 << 63) - 1


# Vectors as integers

def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, v)``: the vectors that take part, as doubles; all of one length."""
    rows = (table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
            .where(F.expr(f"size(v) > 0 AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < {LARGEST})")))
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    return rows.join(F.broadcast(width.select("d")), F.size("v") == F.col("d"), "left_semi")


def _integers(batch: pa.RecordBatch, d: int) -> np.ndarray:
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
    return (np.floor(SCALE * flat.reshape(-1, d)).astype(np.int64) + SHIFT)


def _product(a: np.ndarray) -> np.ndarray:
    """a' a, exact, as Python integers where doubles are not."""
    most = int(np.abs(a).max(initial=0))
    step = max(1, (_EXACT - 1) // max(1, most * most))
    if most * most >= _EXACT:
        b = a.astype(object)
        return b.T @ b
    out = np.zeros((a.shape[1],) * 2, object)
    for i in range(0, len(a), step):
        part = a[i:i + step].astype(np.float64)
        out = out + (part.T @ part).astype(np.int64)
    return out


def _summed(rows: DataFrame, fn, d: int, kind: str) -> np.ndarray:
    """Sum of the d x d (or d x 1) matrices that ``fn`` makes of every batch, added up in tasks, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = fn(b)
                total = part if total is None else total + part
        if total is None:
            return
        at = np.indices(total.shape).reshape(2, -1)
        value = [str(x) for x in total.ravel()] if kind != "double" else total.ravel().tolist()
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(value)],
                                         names=["i", "j", "x"])

    parts = rows.mapInArrow(run, f"i int, j int, x {'double' if kind == 'double' else 'string'}")
    found = parts.groupBy("i", "j").agg(F.sum(F.col("x").cast(kind)).alias("x")).collect()
    out = np.zeros((max((r["i"] for r in found), default=-1) + 1, max((r["j"] for r in found), default=-1) + 1),
                   np.float64 if kind == "double" else object)
    for r in found:
        out[r["i"], r["j"]] = r["x"] if kind == "double" else int(r["x"])
    return out


# Spectrum of one symmetric matrix

def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix ``a`` are larger than ``shift``.

    Signs of the pivots of a symmetric factorisation of ``a - shift``, by Sylvester's law;
    each step takes the largest diagonal entry, or the largest pair off the diagonal,
    which has one eigenvalue of either sign.
    """
    m = a - shift * np.eye(len(a))
    positive = 0
    while len(m):
        diagonal = np.abs(np.diag(m))
        p = int(diagonal.argmax())
        off = np.abs(np.triu(m, 1))
        i, j = np.unravel_index(int(off.argmax()), off.shape)
        if diagonal[p] == 0 and off[i, j] == 0:
            break
        pivot = [p] if diagonal[p] >= 0.6404 * off[i, j] else [i, j]
        rest = np.delete(np.arange(len(m)), pivot)
        block = m[np.ix_(pivot, pivot)]
        positive += int((m[p, p] > 0)) if len(pivot) == 1 else 1
        column = m[np.ix_(rest, pivot)]
        m = m[np.ix_(rest, rest)] - column @ np.linalg.solve(block, column.T)
        m = (m + m.T) / 2
    return positive


def intervals(a: np.ndarray, k: int, most: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """``(low, high, eigenvalues between)``, falling, that together hold at least the k largest eigenvalues."""
    reach = float(np.abs(a).sum(axis=1).max()) * 1.01 or 1.0
    floor = reach * 1e-14
    todo, out, have = [(-reach, reach, len(a), 0)], [], 0      # low, high, above low, above high
    while todo and have < k:
        low, high, at_low, at_high = todo.pop()
        count = at_low - at_high
        if not count:
            continue
        if count <= most and high - low < 0.5 * reach or high - low <= floor:
            out.append((low, high, count))
            have += count
            continue
        middle = (low + high) / 2
        at_middle = above(a, middle)
        todo += [(low, middle, at_low, at_middle), (middle, high, at_middle, at_high)]
    return out


def feast(a: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues in (low, high] and unit eigenvectors, from a contour around the interval."""
    d = len(a)
    norm = float(np.abs(a).sum(axis=1).max()) or 1.0
    size = min(d, 2 * count + 4)
    x = np.random.default_rng(SEED).standard_normal((d, size))
    node, part = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for _ in range(SWEEPS):
        q = np.zeros_like(x)
        for t, w in zip(node, part):
            turn = np.exp(-0.5j * np.pi * (t - 1))             # upper half; the lower half is its conjugate
            solved = np.linalg.solve((centre + radius * turn) * np.eye(d) - a, x.astype(complex))
            q += 0.5 * w * (radius * turn * solved).real
        q, _ = np.linalg.qr(q)
        value, small = np.linalg.eigh(q.T @ a @ q)             # Rayleigh-Ritz
        x = q @ small
        inside = np.flatnonzero((value > low) & (value <= high))
        if len(inside) != count:                               # values at the very ends, within rounding
            inside = np.argsort(np.abs(value - centre), kind="stable")[:count]
            inside = inside[np.abs(value[inside] - centre) <= radius + 1e-13 * norm]
        if len(inside) == count:
            residual = float(np.linalg.norm(a @ x[:, inside] - x[:, inside] * value[inside], axis=0).max(initial=0))
            if best is None or residual < best[0]:
                best = (residual, value[inside], x[:, inside])
            elif best[0] <= 1e-11 * norm:                      # no longer falling: rounding level
                break
    if best is None or best[0] > 1e-9 * norm:
        raise ArithmeticError(f"the contour around ({low}, {high}] does not hold {count} eigenvalues")
    return best[1], best[2]


def components(spark, covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors (columns); fewer where there is no variance."""
    d = len(covariance)
    cuts = intervals(covariance, min(k, d))

    def run(batches):
        for b in batches:
            for low, high, count in zip(*(c.to_pylist() for c in b.columns)):
                _, vector = feast(covariance, low, high, count)
                yield pa.RecordBatch.from_arrays([pa.array(list(vector.T), pa.list_(pa.float64()))], names=["v"])

    rows = spark.createDataFrame(cuts, "low double, high double, n long").repartition(len(cuts))
    basis = np.array([r["v"] for r in rows.mapInArrow(run, "v array<double>").collect()]).T
    q, _ = np.linalg.qr(basis)
    value, small = np.linalg.eigh(q.T @ covariance @ q)
    order = np.argsort(-value, kind="stable")[:k]
    value, vector = value[order], (q @ small)[:, order]
    real = value > 1e-12 * value[0]
    value, vector = value[real], vector[:, real]
    return value, vector * np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(vector.shape[1])])


# Whitening of a table

_OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(table: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened vectors: one row per remaining row of ``table`` and component."""
    spark = table.sparkSession
    workers_find_package(spark)
    rows = vectors(table, id_col, vector_col)
    count = rows.groupBy(F.size("v").alias("d")).count().first()
    if count is None:
        return spark.createDataFrame([], _OUT)
    d, n = count["d"], count["count"]
    total = _summed(rows, lambda b: _integers(b, d).sum(axis=0).astype(object)[:, None], d, "decimal(38,0)")[:, 0]
    middle = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)         # rounded means
    scatter = _summed(rows, lambda b: _product(_integers(b, d) - middle), d, "decimal(38,0)")
    off = [int(s) - n * int(m) for s, m in zip(total, middle)]
    covariance = np.array([[(n * int(scatter[i, j]) - off[i] * off[j]) / (n * n) for j in range(d)] for i in range(d)])
    if not covariance.any():
        return spark.createDataFrame([], _OUT)
    value, vector = components(spark, covariance, k)
    project = vector / np.sqrt(value)
    explained = value / np.trace(covariance)
    rest = np.array(off, object)

    def centred(x: np.ndarray) -> np.ndarray:
        """n x - S as exact integers; Python integers where longs could overflow."""
        y = x - middle
        if n * (int(np.abs(y).max(initial=0)) + 1) < _LONG:
            return y * n - rest.astype(np.int64)
        return y.astype(object) * n - rest

    def whitened(b: pa.RecordBatch) -> np.ndarray:
        return (centred(_integers(b, d)) / n).astype(np.float64) @ project

    def squares(b: pa.RecordBatch) -> np.ndarray:
        w = np.concatenate([whitened(b), np.ones((b.num_rows, 1))], axis=1)      # the last column sums
        return w.T @ w

    moments = _summed(rows, squares, d, "double")
    mean = moments[-1, :-1] / n
    error = float(np.abs(moments[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(value))).max())

    def emit(batches):
        width = len(value)
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                y = centred(_integers(part, d))
                if y.dtype == object or d * int(np.abs(y).max(initial=0)) ** 2 > _LONG:
                    y = y.astype(object)
                squared = [int(s) if s <= _LONG else None for s in (y * y).sum(axis=1)]
                w = (y / n).astype(np.float64) @ project
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(len(y)), width))),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(y))),
                    pa.array(np.full(len(y) * width, n, np.int64)),
                    pa.array(squared, pa.int64()).take(pa.array(np.repeat(np.arange(len(y)), width))),
                    pa.array(w.ravel()), pa.array(np.tile(explained, len(y))),
                    pa.array(np.full(len(y) * width, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(emit, _OUT)
