"""Multi-label logistic regression by blocks of labels (M1, M3).

Rows are packed once into chunks (a matrix of features, a matrix of label cells)
per block of labels.  A Newton step is one pass over the chunks: tasks add up
gradients and Hessians of their labels in numpy, groups of partial sums meet by
label, and executors solve.  Only the fact that a label is still moving reaches
the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import drop_table, parts_of, ship_package, write_table
from .features import dense_ids

#: Bytes of the Hessians that a task holds; a block has as many labels as fit in.
HESSIAN_BYTES = 32 << 20
#: Most labels of a block, and rows of a chunk.
BLOCK_LABELS, CHUNK_ROWS = 128, 1024
#: Cells of a partition where they meet their features.
CELLS_EACH = 1 << 21
#: Partial sums of a label meet in so many groups first.
GROUPS = 32
#: Bytes of coefficients in one broadcast of the scoring pass; more labels take more passes.
SCORE_BYTES = 32 << 20


def _width(features: DataFrame, vec: str) -> int:
    sizes = features.where(F.col(vec).isNotNull()).agg(F.min(F.size(vec)).alias("a"), F.max(F.size(vec)).alias("b")).first()
    if sizes.a != sizes.b:
        raise ValueError(f"feature vectors of {sizes.a} and of {sizes.b} entries")
    return sizes.a or 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A column of lists of ``d`` numbers as rows; a null among them is NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)


def pack(features: DataFrame, cells: DataFrame, d: int, block_labels: int, vec: str) -> tuple[DataFrame, DataFrame]:
    """Chunks (block, x, y) of the joined rows, and the labels (label_id, block, pos).  A cell that stands
    more than once counts once, as its largest value; null cells are unknown."""
    known = write_table(cells.where("y is not null").select("entry", "label_id", F.col("y").cast("double").alias("y")))
    labels = dense_ids(known.select("label_id").distinct(), "label_id", "_no")
    labels = write_table(labels.select("label_id", F.expr(f"_no div {block_labels}").alias("block"), F.expr(f"cast(_no % {block_labels} as int)").alias("pos")))
    n = parts_of(cells.sparkSession, known.count(), CELLS_EACH)  # cells and features are dealt by entry, once
    rows = (known.join(labels, "label_id").where("entry is not null").repartition(n, "entry").groupBy("entry", "block", "pos").agg(F.max("y").alias("y"))
            .groupBy("entry", "block").agg(F.collect_list("pos").alias("pos"), F.collect_list("y").alias("y"))
            .join(features.where(F.col(vec).isNotNull() & F.col("entry").isNotNull()).select("entry", F.transform(vec, lambda e: e.cast("double")).alias("x")).repartition(n, "entry"), "entry")
            .select("block", "x", "pos", "y").sortWithinPartitions("block"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            block, x, many = b.column(0).to_numpy(), matrix(b.column(1), d), b.column(2).value_lengths().to_numpy()
            y = np.full((len(x), block_labels), np.nan, np.float32)
            y[np.repeat(np.arange(len(x)), many), b.column(2).flatten().to_numpy()] = b.column(3).flatten().to_numpy()
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            for first, last in zip(cuts[:-1], cuts[1:]):
                for at in range(first, last, CHUNK_ROWS):
                    end = min(at + CHUNK_ROWS, last)
                    yield pa.RecordBatch.from_arrays([pa.array([block[at]], pa.int64()), pa.array([x[at:end].tobytes()], pa.binary()),
                                                      pa.array([y[at:end].tobytes()], pa.binary())], ["block", "x", "y"])

    return write_table(rows.mapInArrow(run, "block long, x binary, y binary")), labels


def _partial_sums(chunks: DataFrame, state: DataFrame, d: int, block_labels: int) -> DataFrame:
    """(label_id, part, n, g, h) of one pass over the chunks with the coefficients of ``state``."""
    now = state.where("not done").groupBy("block").agg(F.collect_list(F.struct("label_id", "pos", "w")).alias("now"))
    kind, arrow = state.schema["label_id"].dataType.simpleString(), to_arrow_type(state.schema["label_id"].dataType)

    def run(batches):
        from pyspark import TaskContext
        part, block, sums, names = TaskContext.get().partitionId(), None, [], []

        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array(names, arrow), pa.array([part] * len(names), pa.int32()), pa.array([s[0] for s in sums], pa.int64()),
                 pa.array([s[1].tobytes() for s in sums], pa.binary()), pa.array([s[2].tobytes() for s in sums], pa.binary())], ["label_id", "part", "n", "g", "h"])

        for b in batches:
            for at, raw, cells, state_of in zip(*(c.to_pylist() for c in b.columns)):
                if at != block:
                    if sums:
                        yield rows()
                    block, names = at, [s["label_id"] for s in state_of]
                    pos, w = [s["pos"] for s in state_of], np.array([s["w"] for s in state_of])
                    sums = [[0, np.zeros(d + 1), np.zeros((d + 1, d + 1))] for _ in names]
                x = np.frombuffer(raw).reshape(-1, d) if d else np.zeros((len(cells) // (4 * block_labels), 0))
                x = np.hstack([np.ones((len(x), 1)), x])
                y = np.frombuffer(cells, np.float32).reshape(len(x), block_labels)[:, pos].astype(np.float64)
                known = ~np.isnan(y)
                p = 1 / (1 + np.exp(-np.clip(x @ w.T, -700, 700)))
                off, weight = np.where(known, p - y, 0), np.where(known, p * (1 - p), 0)
                for k, s in enumerate(sums):
                    s[0] += int(known[:, k].sum())
                    s[1] += x.T @ off[:, k]
                    s[2] += (x * weight[:, [k]]).T @ x
        if sums:
            yield rows()

    return (chunks.join(now, "block").select("block", "x", "y", "now")
            .mapInArrow(run, f"label_id {kind}, part int, n long, g binary, h binary"))


def _steps(sums: DataFrame, state: DataFrame, alpha: float, lr: float, tol: float) -> DataFrame:
    """The state after a Newton step of every label that still moves."""
    kind = state.schema["label_id"].dataType.simpleString()

    def add(t):
        t = t.sort_by("part")
        g = np.sum([np.frombuffer(v.as_buffer()) for v in t["g"]], axis=0)
        h = np.sum([np.frombuffer(v.as_buffer()) for v in t["h"]], axis=0)
        return t.slice(0, 1).set_column(2, "n", pa.array([sum(t["n"].to_pylist())], pa.int64())).set_column(
            3, "g", pa.array([g.tobytes()], pa.binary())).set_column(4, "h", pa.array([h.tobytes()], pa.binary()))

    def solve(batches):
        for b in batches:
            out = []
            for g, h, n, w in zip(*(b.column(c).to_pylist() for c in ("g", "h", "n", "w"))):
                w = np.array(w)
                g = np.frombuffer(g) / n + alpha * w
                h = np.frombuffer(h).reshape(len(w), len(w)) / n + alpha * np.eye(len(w))
                delta = np.linalg.solve(h, g)
                out.append(((w - lr * delta).tolist(), float((delta ** 2).sum())))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("label_id", "block", "pos", "n")), pa.array([w for w, _ in out], pa.list_(pa.float64())), pa.array([e for _, e in out], pa.float64()),
                 pa.array([v + 1 for v in b.column("steps").to_pylist()], pa.int32()), pa.array([e < tol for _, e in out], pa.bool_())], ["label_id", "block", "pos", "n", "w", "moved", "steps", "done"])

    schema = f"label_id {kind}, part int, n long, g binary, h binary"
    for keys in (("label_id", F.col("part") % GROUPS), ("label_id",)):
        sums = sums.groupBy(*keys).applyInArrow(add, schema)
    moving = state.where("not done").drop("n", "moved", "done").join(sums.drop("part"), "label_id")
    moved = moving.select("label_id", "block", "pos", "n", "w", "steps", "g", "h").mapInArrow(solve, state.schema)
    return state.where("done").unionByName(moved)


def fit_newton(features: DataFrame, cells: DataFrame, alpha: float = 1e-3, max_iter: int = 20, lr: float = 1.0,
               tol: float = 1e-5, vec: str = "vec") -> DataFrame:
    """M1: ridge-penalised logistic regressions, one a label: (label_id, n, w, moved, steps, done).

    ``features``: (entry, vec ARRAY); ``cells``: (entry, label_id, y in {0, 1}), null or
    absent cells are unknown and count for nothing.  ``w`` has the intercept first, which is
    penalised like the rest.  A label is done when the squared length of its step falls below
    ``tol`` (each label by itself), at most after ``max_iter`` steps of rate ``lr``.
    The Hessians of a block of labels take a bounded part of a task's memory.
    """
    ship_package(features.sparkSession)
    d = _width(features, vec)
    block_labels = max(1, min(BLOCK_LABELS, HESSIAN_BYTES // (8 * (d + 1) ** 2)))
    chunks, labels = pack(features, cells, d, block_labels, vec)
    state = labels.select("label_id", "block", "pos", F.lit(0).cast("long").alias("n"), F.array_repeat(F.lit(0.0), d + 1).alias("w"),
                          F.lit(None).cast("double").alias("moved"), F.lit(0).alias("steps"), F.lit(False).alias("done"))
    old = labels
    for _ in range(max_iter):
        new = write_table(_steps(_partial_sums(chunks, state, d, block_labels), state, alpha, lr, tol))
        drop_table(old)
        old = state = new
        if state.where("not done").isEmpty():
            break
    drop_table(chunks)
    return state.select("label_id", "n", "w", "moved", "steps", "done")


def coefficients(fitted: DataFrame) -> DataFrame:
    """(label_id, feature, coefficient): the coefficient table in long form; feature 0 is the intercept."""
    return fitted.select("label_id", F.posexplode("w").alias("feature", "coefficient"))


def score_newton(fitted: DataFrame, features: DataFrame, vec: str = "vec", score_bytes: int = SCORE_BYTES) -> DataFrame:
    """M3: (entry, label_id, prob) of every entry with features and every label, by one pass over
    the features with the coefficient table, or one for each block of labels where it passes ``score_bytes``."""
    ship_package(features.sparkSession)
    size = fitted.agg(F.sum(F.size("w") * 8)).first()[0] or 0
    passes, sc = max(1, -(-size // score_bytes)), features.sparkSession.sparkContext
    x = features.where(F.col(vec).isNotNull()).select("entry", F.transform(vec, lambda e: e.cast("double")).alias("x"))
    kinds = f"entry {features.schema['entry'].dataType.simpleString()}, label_id {fitted.schema['label_id'].dataType.simpleString()}, prob double"
    out = None
    for k in range(passes):
        part = fitted.where(F.pmod(F.xxhash64("label_id"), F.lit(passes)) == k).select("label_id", "w").toArrow()
        w = np.array(part["w"].to_pylist()) if part.num_rows else np.zeros((0, 1))
        sent = sc.broadcast((part["label_id"].combine_chunks(), w))

        def run(batches, sent=sent):
            names, w = sent.value
            for b in batches:
                if not b.num_rows or not len(names):
                    continue
                x = matrix(b.column(1), w.shape[1] - 1)
                step = max(1, (1 << 18) // len(names))
                for at in range(0, len(x), step):
                    p = 1 / (1 + np.exp(-np.clip(w[:, 0] + x[at:at + step] @ w[:, 1:].T, -700, 700)))
                    row = pa.array(np.repeat(np.arange(at, at + len(p)), len(names)))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(row), pa.concat_arrays([names] * len(p)), pa.array(p.ravel())], ["entry", "label_id", "prob"])

        got = x.mapInArrow(run, kinds)
        out = got if out is None else out.unionByName(got)
    return out
