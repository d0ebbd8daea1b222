"""Shared pieces of the training-data operators: the query registry, table
reading, stored intermediates, sorted-run iteration and connected components."""

from __future__ import annotations

import ctypes
import functools
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termflow.session import ensure_checkpoint_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: White space of the contracts, [\x20\x09-\x0D]; bytes.split() uses the same six.
SPACE = " \t\n\x0b\x0c\r"


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` as a catalogued query."""
    def put(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run
    return put


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package (once an application),
    unless the environment already puts it on their path."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if os.path.realpath(top) in paths or app in _SHIPPED:
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "termflow")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), top))
    path = os.path.join(tempfile.mkdtemp(prefix="termflow-code-"), "termflow_code.zip")
    with open(path, "wb") as f:
        f.write(data.getvalue())
    spark.sparkContext.addPyFile(path)  # Spark's file server hands it to the executors
    _SHIPPED.add(app)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a restart point
    that survives lost executors, and a plain scan for the plans above it.  The shuffle
    files of the write go with its end: nothing reads them again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path  # for drop_table
    return out


def fresh(name: str, taken: list[str]) -> str:
    """``name``, longer by underscores until no column has it (Spark compares names without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


KEY = "__row_key"


#: Keys of rows that have no id of their own lie from here on.
SHARED_KEYS = 1 << 62


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with a unique row key: the id of a row that no other row has; rows whose id is missing or repeats come after
    all others, in the order of (id, null last, hash of the text).  No other row's key depends on them, nor any key on
    how the table is laid out."""
    ids = docs.select(F.col(id_col).cast("long").alias("i"))
    n, kinds, most = ids.agg(F.count(F.lit(1)), F.count_distinct("i"), F.max("i")).first()
    if n == kinds and (most or 0) < SHARED_KEYS:
        return docs.withColumn(key, F.col(id_col).cast("long"))
    i, h, part, nth = (fresh(x, [*docs.columns, key]) for x in ("_i", "_h", "_part", "_nth"))
    again = ids.groupBy("i").count().where(F.col("count") > 1).select(F.col("i").alias(fresh("_again", docs.columns)))
    marked = docs.withColumn(i, F.col(id_col).cast("long")).join(again, F.col(i) == again[again.columns[0]], "left")
    own = F.col(i).isNotNull() & F.col(again.columns[0]).isNull() & (F.col(i) < SHARED_KEYS)
    shared = marked.where(~own).drop(again.columns[0]).withColumn(h, F.xxhash64(text_col))
    order = (F.col(i).asc_nulls_last(), F.col(h))
    shared = store(shared.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()).withColumn(nth, F.monotonically_increasing_id() % (1 << 33)))
    sizes = shared.groupBy(F.col(part).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a part
    shared = shared.join(F.broadcast(sizes.select("p", before.alias("before"))), F.col(part) == F.col("p")).withColumn(key, F.lit(SHARED_KEYS) + F.col("before") + F.col(nth))
    cols = [*docs.columns, key]
    return marked.where(own).withColumn(key, F.col(i)).select(*cols).unionByName(shared.select(*cols))


def words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def sorted_runs(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames cut between two values of ``key``; the input must come sorted by it.
    Only the last, still open run is carried from one frame to the next."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        values = frame[key].to_numpy()
        last = int(np.flatnonzero(values == values[-1])[0])
        if held and values[0] != held[-1][key].iloc[-1]:
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held = []
        if last:
            yield pd.concat([*held, frame.iloc[:last]], ignore_index=True)
            held = []
        held.append(frame.iloc[last:])
    if held:
        yield pd.concat(held, ignore_index=True)


def tidied(run):
    """``run`` over batches, and after its last batch the worker's freed memory goes back to the system: workers stay
    for later tasks, several to an executor."""
    def all_batches(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library
    return all_batches


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return start, np.r_[start[1:], len(values)]


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, xor-shift) over a uint64 array."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: (node, root), root = smallest id reachable.

    A label is a node, so the labels are trees.  Each round every node and every
    label hook under the smallest label that the node, or any member of the label's
    tree, sees at an edge: whole trees merge, not only the nodes next to a smaller
    tree.  Then every node takes its label's label.  So rounds grow as the logarithm
    of the nodes, on chains too.  The labels are a stored table each round, so both
    sides of the joins are plain shuffles that adaptive execution splits where a
    node has very many edges.  The loop ends when no edge joins two labels.
    """
    edges = store(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = edges.select("a", "b").union(edges.select("b", "a"))
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        at = labels.select(F.col("node").alias("b"), F.col("root").alias("r"))
        near = both.join(at, "b").select(F.col("a").alias("node"), "r").groupBy("node").agg(F.min("r").alias("r"))
        low = store(labels.join(near, "node").select("node", "root", F.least("root", "r").alias("low")))
        if low.where("low <> root").isEmpty():
            return labels
        hooks = low.select("node", "low").union(low.select("root", "low")).groupBy("node").agg(F.min("low").alias("root"))
        hooks = store(hooks)
        jump = hooks.select(F.col("node").alias("root"), F.col("root").alias("up"))
        labels = store(hooks.join(jump, "root").select("node", F.col("up").alias("root")))
