"""Incremental ingest with Structured Streaming (ST1-ST4).

Batch and stream share one transform: every function below takes a
(streaming or static) DataFrame and returns a DataFrame.  ``run_to_table``
drives a stream to completion (``availableNow``) with its checkpoint under the
session's shared checkpoint folder.  Sink and checkpoint paths follow from the
job's name, so a restarted job of that name resumes where it stopped; a job over a
folder that was rewritten gets another name.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def annotation_rows(events: DataFrame) -> DataFrame:
    """Events seen as annotation rows: (entry = user, term = event type,
    source = JSON ``k`` property, prob = value in [0,1], ts)."""
    return events.select(F.col("user_id").alias("entry"), F.col("event_type").alias("term"),
                         F.get_json_object("props", "$.k").alias("source"),
                         (F.col("value") / 100.0).alias("prob"), "ts")


def clean_annotations(rows: DataFrame) -> DataFrame:
    """Annotation rows that name an entry and a term."""
    return rows.where(F.col("entry").isNotNull() & F.col("term").isNotNull())


def dedupe_annotations(rows: DataFrame) -> DataFrame:
    """ST1, batch form: filter + dedupe of (entry, term, source).  The stream
    form is ``distinct_to_table`` over ``clean_annotations``."""
    return clean_annotations(rows).dropDuplicates(["entry", "term", "source"])


def remove_negatives(preds: DataFrame, negatives: DataFrame) -> DataFrame:
    """ST2: stream-static anti join -- drop predictions whose (entry, term)
    is a known negative."""
    return preds.join(negatives.select("entry", "term").distinct(), ["entry", "term"], "left_anti")


def top_k_scores(df: DataFrame, vec: str, centroids: list[list[float]], k: int = 3) -> DataFrame:
    """ST3/M3: score each row against a small fixed set of class vectors (dot
    products as built-in array expressions) and keep the top-k classes of the
    row -- row-local, so it streams without state."""
    cents = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])
    scores = F.transform(cents, lambda c, i: F.struct(
        F.aggregate(F.zip_with(c, F.col(vec), lambda a, b: a * b.cast("double")), F.lit(0.0),
                    lambda s, x: s + x).alias("score"), i.alias("label")))
    ranked = F.slice(F.array_sort(scores, lambda a, b: F.when(a["score"] > b["score"], -1)
                                  .when(a["score"] < b["score"], 1)
                                  .when(a["label"] < b["label"], -1).otherwise(1)), 1, k)
    return df.select("*", F.posexplode(ranked).alias("rank", "_s")).select(
        *[c for c in df.columns if c != vec], (F.col("rank") + 1).alias("rank"),
        F.col("_s.label").alias("label"), F.col("_s.score").alias("score"))


def snapshot_missing(reference: DataFrame, arrived: DataFrame) -> DataFrame:
    """ST4: pairs of the reference release that the arrived release does not hold."""
    return (reference.select("entry", "term").distinct()
            .join(arrived.select("entry", "term"), ["entry", "term"], "left_anti"))


def stream_files(spark: SparkSession, folder: str, name: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet file-source stream of the files ``<folder>/<name>*.parquet``
    (a glob under ``folder``; new matching files are picked up as they land)."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .option("basePath", folder).parquet(f"{folder.rstrip('/')}/{name}*.parquet"))


def stream_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Stream of the event files in ``folder``."""
    return stream_files(spark, folder, "events", EVENT_SCHEMA, files_per_trigger)


def job_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """(sink, stream checkpoint) of a named job in the shared folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/tables/stream-{name}", f"{root}/streams/{name}"


def listing(spark: SparkSession, pattern: str) -> dict[str, str]:
    """Files under a glob: path -> length and time of change."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found, todo = {}, list(system.globStatus(path) or [])
    while todo:
        s = todo.pop()
        name = s.getPath().getName()
        if name.startswith(("_", ".")):
            continue
        if s.isDirectory():
            todo += list(system.listStatus(s.getPath()))
        else:
            found[s.getPath().toString()] = f"{s.getLen()}@{s.getModificationTime()}"
    return found


def job_name(spark: SparkSession, name: str, folder: str, table: str) -> str:
    """The name of the job of a query over the files ``<folder>/<table>*``.

    A folder that only gained files since the job's last run goes on as the same job; one whose
    files were changed or removed is another input, and starts a job of its own."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    base = f"{name}-{hashlib.sha256(folder.rstrip('/').encode()).hexdigest()[:12]}"
    now = listing(spark, f"{folder.rstrip('/')}/{table}*")
    jvm = spark._jvm
    system = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/jobs/{base}.json")
    job, before = None, {}
    if system.exists(path):
        source = system.open(path)
        try:
            known = json.loads(jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()
        job, before = known["job"], known["files"]
    if job is None or any(now.get(f) != state for f, state in before.items()):
        job = f"{base}-{hashlib.sha256(json.dumps(now, sort_keys=True).encode()).hexdigest()[:12]}"
    out = system.create(path, True)
    try:
        out.write(bytearray(json.dumps({"job": job, "files": now}).encode()))
    finally:
        out.close()
    return job


def run_to_table(df: DataFrame, name: str) -> DataFrame:
    """Run a streaming DataFrame until all available input is processed
    (``availableNow``) into an exactly-once parquet file sink and return that
    table as a batch DataFrame (nothing is held on the driver)."""
    spark = df.sparkSession
    path, checkpoint = job_paths(spark, name)
    q = (df.writeStream.format("parquet").option("path", path).outputMode("append")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
               "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def distinct_to_table(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """ST1 sink: the distinct ``key`` values of a stream, over all its batches.

    The keys seen are state, dealt by hash over the executors and kept on their disks (RocksDB), with changes written to the
    shared folder: a batch looks up its own keys only, so its work does not grow with what came before, no row is
    dropped for being late, and a restarted job goes on from its last batch.  The file sink gives every row once."""
    spark = df.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        return run_to_table(df.select(*key).dropDuplicates(key), name)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
