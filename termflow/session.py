"""Session helpers: building a session, the checkpoint folder, size-checked broadcasts."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes up to which a dimension side of known row count and width is hinted for
# broadcast.  Sides of unknown size are left to adaptive execution, which
# broadcasts them by their measured shuffle size.
BROADCAST_MAX_BYTES = 32 << 20
PAIR_BYTES = 16  # a row of two long ids (edges, closure)
# The same for a table of terms that meets propagated cells: those are many times
# the input, and without the broadcast all of them would cross an exchange.
TERMS_MAX_BYTES = 160 << 20

_CHECKPOINT_SET: dict[str, str] = {}
_SHIPPED: set[str] = set()


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "termflow") -> SparkSession:
    """Local session with the settings the library expects (UI off, AQE on, UTC)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # iterative plans (closure, level loops) grow long unions; constraint
        # propagation over them is costly and hits a union-rewrite bug
        .config("spark.sql.constraintPropagation.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only when it is unset
    (local runs, tests) fall back to a fresh folder under /tmp."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _CHECKPOINT_SET:
        return _CHECKPOINT_SET[key]
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="termflow-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    _CHECKPOINT_SET[key] = path
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint into the shared checkpoint folder (survives
    executor loss, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Cut lineage by writing ``df`` as a parquet table in the shared
    checkpoint folder and reading it back (columnar, partition-prunable).
    Used for loop state that later steps read in slices."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    out = spark.read.parquet(path)
    out._stored_at = path
    return out


def parts_of(spark: SparkSession, rows: int, rows_each: int = 1 << 21) -> int:
    """Partitions of about ``rows_each`` of ``rows`` rows, and no fewer than shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def write_buckets(df: DataFrame, key: str | list[str], rows: int, rows_each: int = 1 << 21) -> DataFrame:
    """``df`` stored once in buckets of its ``key`` (one or more columns), which joins on ``key`` read as they lie: loop steps deal only their own
    state.  About ``rows_each`` of its ``rows`` rows a bucket, and no fewer buckets than shuffle partitions."""
    spark = df.sparkSession
    n = parts_of(spark, rows, rows_each)
    name, path = f"termflow_{uuid.uuid4().hex}", f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    keys = [key] if isinstance(key, str) else key
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", path).saveAsTable(name)
    return spark.table(name)


def drop_table(df: DataFrame) -> None:
    """Delete the folder of a table that ``write_table`` wrote, once nothing reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package (once an application),
    unless the environment already puts it on their path."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
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
    path = os.path.join(tempfile.mkdtemp(prefix="termflow-code-"), "termflow_package.zip")
    with open(path, "wb") as f:
        f.write(data.getvalue())
    spark.sparkContext.addPyFile(path)  # Spark's file server hands it to the executors
    _SHIPPED.add(app)


def broadcast_if_small(df: DataFrame, rows: int | None = None, row_bytes: int = PAIR_BYTES) -> DataFrame:
    """Hint ``df`` for broadcast when its size is known (``rows`` counted by the
    caller, of ``row_bytes`` each) and under the bound.  Without a known size the
    frame is returned as it is: nothing is counted twice, and adaptive execution
    decides from the size of the finished stage."""
    return F.broadcast(df) if rows is not None and rows * row_bytes <= BROADCAST_MAX_BYTES else df


def broadcast_terms(df: DataFrame, rows: int) -> DataFrame:
    """Hint a table of ``rows`` terms for broadcast under its own, larger bound."""
    return F.broadcast(df) if rows * PAIR_BYTES <= TERMS_MAX_BYTES else df
