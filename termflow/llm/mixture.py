"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets come from water-filling over a table of sources.  Within a source whole
epochs come first; the rest of its target is taken in the order of exponential
keys scaled by a quality weight.  The order is a two-level prefix sum: buckets
of the key space first, then only the bucket in which the target falls."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termflow.session import ensure_checkpoint_dir  # noqa: F401  (store() needs the shared folder)

from .common import query, store, table, text_of, words

#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (3, 1, 2)
PRIME = 2147483647  # 2^31 - 1
BUCKET_ROWS = 2000
MAX_BROADCAST_SOURCES = 10_000


def uniform(doc_id: Column, seed: int) -> Column:
    """A value in (0, 1) from the id alone: two squarings modulo a prime, so that
    reruns agree and any SQL engine can repeat it."""
    x0 = F.pmod(F.coalesce(doc_id, F.lit(-1)), F.lit(PRIME))
    x1 = F.pmod(x0 * 48271 + seed, F.lit(PRIME))
    x2 = F.pmod(x1 * x1 + x0, F.lit(PRIME))
    x3 = F.pmod(x2 * x2 + 69621, F.lit(PRIME))
    return (x3 + 0.5) / PRIME


def sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(doc_id, source, size, distinct): words and distinct words of each whole text."""
    def run(frames):
        for f in frames:
            ws = [words(t) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "source": f["source"],
                                "size": [len(w) for w in ws], "n_distinct": [len(set(w)) for w in ws]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), text_of(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, source string, size long, n_distinct long")


def targets(sized: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, n_rows, target), by water-filling: sources in the order in which
    a rising level fills them; a source is full at ``most`` times its size.
    The windows run over one row per source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    per = (per.withColumn("rank", F.row_number().over(place) - 1)
           .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
           .withColumn("cap", F.col("source_size") * F.lit(float(most))))
    fill = Window.orderBy((F.col("cap") / F.col("weight")), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("budget", F.sum("source_size").over(all_) * F.lit(float(share)))
    per = per.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # the level settles at the first source in fill order that it no longer fills
    per = per.withColumn("nth", F.row_number().over(fill))
    settled = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("nth", "level"))
    water = F.min(settled).over(all_)["level"]
    return per.select("source", "source_size", "n_rows",
                      F.least(F.col("cap"), F.coalesce(water * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        share: float = 1.5, most: float = 2.0, seed: int = 20, whole: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    ``copies`` whole copies; ``taken`` words.  The document at the end of the
    budget gives the words that are still missing, so that a source meets its
    target to the word; with ``whole`` it comes whole if that is nearer.

    A null text has size 0; a null source is a source of its own (last); a null
    id is keyed like id -1; repeated rows count as often as they stand.  Empty
    documents and an empty table take 0 words.  No group is sorted as a whole: keys fall in
    buckets of about ``BUCKET_ROWS`` rows and only the bucket with the boundary is ordered.
    """
    sized = store(sizes(docs, id_col, source_col, text_col))
    plan = store(targets(sized, share, most))
    if plan.count() <= MAX_BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    weight = 0.25 + 0.75 * F.col("n_distinct") / F.greatest("size", F.lit(1))
    key = -F.log(uniform(F.col("doc_id"), seed)) / weight
    n_buckets = F.ceil(F.col("n_rows") / BUCKET_ROWS)
    keyed = (sized.withColumnRenamed("source", "own")
             .join(plan, F.col("own").eqNullSafe(plan["source"])).drop("own")
             .withColumn("key", key)
             .withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * n_buckets))
             .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
             .withColumn("rest", F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("bucket")
    sums = store(sums.withColumn("upto", F.sum("words").over(upto)))
    # the one bucket of a source in which the target falls
    edge = (sums.where("upto - words < rest and upto >= rest")
            .select(F.col("source").alias("s"), F.col("bucket").alias("edge"), (F.col("upto") - F.col("words")).alias("before")))
    if plan.count() <= MAX_BROADCAST_SOURCES:
        edge = F.broadcast(edge)
    dealt = keyed.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    at_edge = dealt.where("bucket = edge")
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("rest") - F.col("before") - (F.sum("size").over(order) - F.col("size"))
    if whole:
        part = F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(0)
    else:
        part = F.greatest(F.lit(0), F.least(F.col("size"), left))
    inner = at_edge.withColumn("part", part)
    outer = dealt.where("edge is null or bucket <> edge").withColumn(
        "part", F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(0))
    cols = ["doc_id", "source", "size", "source_size", "target",
            (F.col("epochs") + ((F.col("part") == F.col("size")) & (F.col("size") > 0)).cast("long")).cast("long").alias("copies"),
            (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken")]
    return inner.select(*cols).unionByName(outer.select(*cols))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS size, len(list_distinct(w)) AS n_distinct FROM d),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s GROUP BY source),
capped AS (SELECT *, CAST([3, 1, 2][rank % 3 + 1] AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS cap FROM per),
fill AS (SELECT *, row_number() OVER (ORDER BY cap / weight, rank) AS nth,
  (sum(source_size) OVER () * CAST(1.5 AS DOUBLE)
   - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
water AS (SELECT arg_min(level, nth) FILTER (WHERE level <= cap / weight) AS level FROM fill),
plan AS (SELECT f.source, f.source_size, least(f.cap, coalesce(water.level * f.weight, f.cap)) AS target FROM fill f, water),
x0 AS (SELECT s.*, p.source_size, p.target, coalesce(doc_id, -1) % 2147483647 AS x0 FROM s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
x1 AS (SELECT *, (x0 * 48271 + 20) % 2147483647 AS x1 FROM x0),
x2 AS (SELECT *, (x1 * x1 + x0) % 2147483647 AS x2 FROM x1),
x3 AS (SELECT *, (x2 * x2 + 69621) % 2147483647 AS x3 FROM x2),
keyed AS (SELECT *, -ln((x3 + CAST(0.5 AS DOUBLE)) / 2147483647) / (0.25 + 0.75 * n_distinct / CAST(greatest(size, 1) AS DOUBLE)) AS key,
  CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM x3),
upto AS (SELECT *, CAST(round(target) AS BIGINT) - epochs * source_size AS rest,
  CAST(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS before FROM keyed),
part AS (SELECT *, greatest(0, least(size, rest - before)) AS part FROM upto)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(epochs * size + part AS BIGINT) AS taken,
  CAST(epochs + CASE WHEN part = size AND size > 0 THEN 1 ELSE 0 END AS BIGINT) AS copies, source FROM part"""


@query("op3_mix_sources", ORACLE)
def op3(spark, sf_dir):
    got = mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "copies", "source")
