"""Embedding whitening: a distributed centred covariance, its leading eigenpairs by
Householder tridiagonalisation, Sturm-count bisection and inverse iteration, and
a broadcast projection."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, ship, store, table

#: Steps of the grid that entries are rounded down to.
GRID = 256
COMPONENTS = 4
#: Rows of a fit block that a task multiplies at a time.
BLOCK_ROWS = 4096
#: Partial matrices of tasks are added up in this many groups a matrix row first.
GROUPS = 64
#: Eigenvalues nearer than this share of the largest absolute row sum are one cluster: their vectors are made orthogonal to each other.
CLUSTER = 1e-3
#: Eigenvalues below this share of the largest count as zero: such components do not exist.
LEAST_SHARE = 1e-12


# ---- eigenpairs of a symmetric matrix (d x d, on the driver: bounded by the dimension) ----

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder: diagonal, off-diagonal, and the unit reflectors v_k, where
    A = H_0 H_1 .. T .. H_1 H_0 and H_k = I - 2 v v' acts on rows k + 1 and on."""
    a, n, reflectors = a.astype(np.float64).copy(), len(a), []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        rest = np.abs(x[1:]).max(initial=0.0)
        if rest == 0.0:
            reflectors.append(np.zeros(n - k - 1))
            continue
        scale = max(abs(x[0]), rest)
        x /= scale
        norm = math.copysign(float(np.linalg.norm(x)), x[0])
        v = x.copy()
        v[0] += norm
        v /= np.linalg.norm(v)
        part = a[k + 1:, k + 1:]
        p = part @ v
        w = p - (v @ p) * v
        part -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] = a[k, k + 1:] = 0.0
        a[k + 1, k] = a[k, k + 1] = -norm * scale
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm_count(diagonal: np.ndarray, off: np.ndarray, x: float) -> int:
    """Eigenvalues of the tridiagonal matrix below ``x``: negative pivots of T - x I."""
    tiny = np.finfo(float).tiny
    count, q, floor = 0, 1.0, max(tiny, np.finfo(float).eps * (np.abs(off).max(initial=0.0)) ** 2 * np.finfo(float).eps)
    for i in range(len(diagonal)):
        q = float(diagonal[i]) - x - (float(off[i - 1]) ** 2 / q if i else 0.0)
        if abs(q) < floor:
            q = -floor
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> list[float]:
    """The ``k`` largest eigenvalues, falling, each by bisection of the Gershgorin interval to the last bit that matters."""
    n = len(diagonal)
    radius = np.r_[np.abs(off), 0.0] + np.r_[0.0, np.abs(off)]
    low0, high0 = float((diagonal - radius).min()), float((diagonal + radius).max())
    slack = np.finfo(float).eps * max(abs(low0), abs(high0), np.finfo(float).tiny) * 2
    out = []
    for j in range(min(k, n)):
        low, high = low0 - slack, high0 + slack  # the value number n - 1 - j from below
        while True:
            mid = 0.5 * (low + high)
            if not low < mid < high or high - low <= slack:
                break
            if sturm_count(diagonal, off, mid) > n - 1 - j:
                high = mid
            else:
                low = mid
        out.append(0.5 * (low + high))
    return out


def _solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, floor: float) -> np.ndarray:
    """(T - shift I) x = b by elimination with row exchanges; zero pivots are lifted to ``floor``."""
    n = len(diagonal)
    d, up, up2, b = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n, b.tolist()
    low = off.tolist()
    for i in range(n - 1):
        if abs(low[i]) > abs(d[i]):
            d[i], low_i = low[i], d[i]
            up[i], d_next = d[i + 1], up[i]
            up2[i], up_next = up[i + 1], 0.0
            b[i], b[i + 1] = b[i + 1], b[i]
            f = low_i / d[i]
            d[i + 1], up[i + 1] = d_next - f * up[i], up_next - f * up2[i]
        else:
            if abs(d[i]) < floor:
                d[i] = floor
            f = low[i] / d[i]
            d[i + 1] -= f * up[i]
        b[i + 1] -= f * b[i]
    if abs(d[-1]) < floor:
        d[-1] = floor
    x = [0.0] * n
    for i in range(n - 1, -1, -1):
        x[i] = (b[i] - (up[i] * x[i + 1] if i + 1 < n else 0.0) - (up2[i] * x[i + 2] if i + 2 < n else 0.0)) / d[i]
    return np.array(x)


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: list[float]) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix (rows) by inverse iteration; those of a
    cluster of near values are made orthogonal to each other at every step."""
    n, norm = len(diagonal), max(float(np.abs(diagonal).max(initial=0.0) + 2 * np.abs(off).max(initial=0.0)), np.finfo(float).tiny)
    floor, out, start, shift = np.finfo(float).eps * norm, [], 0, math.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            start = j
        shift = min(value, shift - 4 * floor) if j > start else value  # equal values get shifts of their own
        x = np.random.default_rng(j).standard_normal(n)
        for _ in range(6):
            for y in out[start:]:
                x = x - (y @ x) * y
            x = x / np.linalg.norm(x)
            x = _solve_shifted(diagonal, off, shift, x, floor)
            x = x / np.abs(x).max()
        for _ in range(2):
            for y in out[start:]:
                x = x - (y @ x) * y
            x = x / np.linalg.norm(x)
        out.append(x)
    return np.array(out).reshape(len(values), n)


def leading_pairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows, the entry largest in size positive."""
    scale = float(np.abs(a).max(initial=0.0))
    if not scale:
        return np.zeros(0), np.zeros((0, len(a)))
    diagonal, off, reflectors = tridiagonal(a / scale)
    values = leading_values(diagonal, off, k)
    vectors = leading_vectors(diagonal, off, values)
    for k in range(len(reflectors) - 1, -1, -1):
        part = vectors[:, k + 1:]
        part -= 2.0 * np.outer(part @ reflectors[k], reflectors[k])
    lead = np.abs(vectors).argmax(axis=1)
    vectors *= np.sign(vectors[np.arange(len(vectors)), lead])[:, None]
    return np.array(values) * scale, vectors


# ---- Spark side ----

def grid_rows(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): rows with a finite vector, entries as whole steps of the grid (a double
    beyond the range of a long stops at its end)."""
    steps = F.transform("v", lambda e: F.floor(F.lit(float(GRID)) * e.cast("double")))
    fine = F.col("v").isNotNull() & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where(fine).select("vec_id", steps.alias("x"))


def _matrix(column) -> np.ndarray:
    """A list column whose rows are all of one length as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def add_up(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the arrays ``v`` by ``i`` over rows (part, i, v), in two levels of groups and the order of parts."""
    def run(key, t):
        t = t.sort_by("part")
        total = np.zeros(0)
        for v in t["v"].to_pylist():
            total = np.array(v) if not len(total) else total + np.array(v)
        return pa.table({"part": [t["part"][0].as_py()], "i": [key[-1].as_py()], "v": [total.tolist()]},
                        schema=pa.schema([("part", pa.int64()), ("i", pa.int32()), ("v", pa.list_(pa.float64()))]))

    once = rows.groupBy((F.col("part") % GROUPS).alias("g"), "i").applyInArrow(run, "part long, i int, v array<double>")
    done = once.groupBy("i").applyInArrow(run, "part long, i int, v array<double>")
    return {r.i: np.array(r.v) for r in done.collect()}


def covariance(fit: DataFrame, mean: np.ndarray, n: int, project: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) of the fit vectors, or of their projections: every task centres and multiplies blocks of its rows; the partial matrices are added up row by row."""
    mean_of = fit.sparkSession.sparkContext.broadcast((mean, project))

    def run(batches):
        from pyspark import TaskContext
        centre, w = mean_of.value
        d = len(centre) if w is None else w.shape[1]
        total, seen = np.zeros((d, d)), False
        for batch in batches:
            x = _matrix(batch.column(0))
            for at in range(0, len(x), BLOCK_ROWS):
                part = x[at:at + BLOCK_ROWS] - centre
                part = part if w is None else part @ w
                total += part.T @ part
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, TaskContext.get().partitionId(), np.int64)), pa.array(np.arange(d, dtype=np.int32)),
                                              pa.array(total.tolist(), pa.list_(pa.float64()))], ["part", "i", "v"])

    rows = add_up(fit.select("x").mapInArrow(run, "part long, i int, v array<double>"))
    return np.array([rows[i] for i in range(len(rows))]) / n


def sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of fit vectors and exact sums by dimension."""
    def run(batches):
        n, s = 0, [0] * d
        for batch in batches:
            x = _matrix(batch.column(0))
            n += len(x)
            high, low = x >> 32, x & 0xFFFFFFFF  # the sums of halves stay within a long
            s = [a + (int(h) << 32) + int(b) for a, h, b in zip(s, high.sum(axis=0), low.sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(d)], pa.int32()), pa.array([str(v) for v in [n, *s]], pa.string())], ["i", "s"])

    got = fit.select("x").mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r.i: int(r.s) for r in got.collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(d)]


class Whitening:
    """The fitted model: n, S, eigenpairs, shares of the trace and the identity error."""

    def __init__(self, n, total, values, vectors, trace, error):
        self.n, self.sums, self.values, self.vectors, self.error = n, total, values, vectors, error
        self.mean = np.array([s / n for s in total]) if n else np.zeros(len(total))
        self.explained = [float(v / trace) for v in values]
        self.project = (vectors / np.sqrt(values)[:, None]).T if len(values) else np.zeros((len(total), 0))


def fit(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> tuple[Whitening, DataFrame]:
    """The whitening of ``rows`` and the rows it applies to (vec_id, x).

    Every distinct vector of whole grid steps counts once.  Rows whose vector is null, or holds
    null or non-finite entries, drop out, as do those that have not the commonest
    number of entries (the larger of equally common ones).  Repeated rows and null
    ids do not matter to the fit.  Where all vectors are equal, or there is none, there
    is no component; components whose eigenvalue is 0 do not exist.
    """
    ship(rows.sparkSession)
    grid = grid_rows(rows, id_col, vector_col)
    sizes = grid.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    grid = grid.where(F.size("x") == d)
    once = store(grid.groupBy("x").agg(F.lit(1).alias("one")).select("x"))
    n, total = sums(once, d) if d else (0, [])
    if not n:
        return Whitening(0, total, np.zeros(0), np.zeros((0, d)), 1.0, 0.0), grid
    mean = np.array([s / n for s in total])
    v = covariance(once, mean, n)
    values, vectors = leading_pairs(v, components)
    real = values > LEAST_SHARE * max(values.max(initial=0.0), 0.0)
    model = Whitening(n, total, values[real], vectors[real], float(np.trace(v)) or 1.0, 0.0)
    if len(model.values):
        got = covariance(once, mean, n, model.project)
        model.error = float(np.abs(got - np.eye(len(got))).max())
    return model, grid


def deviation(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n * x - S)^2 for each row, exactly; null where it passes a long."""
    most = max((abs(s) for s in total), default=0) + n * max(1, int(x.max(initial=0)), -int(x.min(initial=0)))
    if most < 1 << 62 and most * most * max(1, len(total)) < 1 << 63:
        y = x * n - np.array(total, np.int64)
        return (y * y).sum(axis=1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, total)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per kept row of ``rows`` and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Dropped rows and missing components as in ``fit``.  Repeated rows give a row each, null ids stay null; other
    columns are not read.  ``deviation`` is null where it does not fit a long.  An empty table gives no rows.
    """
    model, grid = fit(rows, id_col, vector_col, components)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        k = len(m.values)
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = _matrix(batch.column(1))
            z = (x - m.mean) @ m.project
            rep = np.repeat(np.arange(len(x)), k)
            dev = pa.array(deviation(x, m.n, m.sums), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rep)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rep), m.n, np.int64)),
                 dev.take(pa.array(rep)), pa.array(z.ravel()), pa.array(np.tile(m.explained, len(x))), pa.array(np.full(len(rep), m.error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return grid.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, SCHEMA)


@query("op12_embedding_whitening")
def op12(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
