"""Catalogued streaming queries (ST*): each runs its stream to completion over
the driver's files and returns the sink table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import fixtures as fx
from ..streaming import ingest as st
from .common import SNAP_NEW, SNAP_OLD, register, sql


def _events_stream(s, d):
    return st.stream_events(s, d)


def _negatives(s, d):
    ev = fx.table(s, d, "events")
    return (ev.where((F.col("event_type") == "error") & (F.col("value") > 90))
            .select(F.col("user_id").alias("entry"), F.lit("purchase").alias("term")).distinct())


@register("st1_stream_dedupe", """
SELECT DISTINCT user_id AS entry, event_type AS term, json_extract_string(props, '$.k') AS source
FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL""")
def st1_stream_dedupe(s, d):
    rows = st.clean_annotations(st.annotation_rows(_events_stream(s, d)))
    return st.distinct_to_table(rows, ["entry", "term", "source"], st.job_name(s, "st1", d, "events"))


@register("st2_stream_static_anti_join", """
SELECT event_id, user_id AS entry, event_type AS term, round(value / 100.0, 6) AS prob FROM events e
WHERE NOT EXISTS (SELECT 1 FROM events n WHERE n.event_type = 'error' AND n.value > 90
                  AND n.user_id = e.user_id AND e.event_type = 'purchase')""")
def st2_stream_static_anti_join(s, d):
    ev = _events_stream(s, d).select("event_id", F.col("user_id").alias("entry"),
                                     F.col("event_type").alias("term"),
                                     F.round(F.col("value") / 100.0, 6).alias("prob"))
    out = st.remove_negatives(ev, _negatives(s, d))
    return st.run_to_table(out, st.job_name(s, "st2", d, "events"))


@register("st3_stream_top_k_scoring", """
WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
cent AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS c FROM e GROUP BY label, i),
names AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT label FROM embeddings)),
scored AS (SELECT e.vec_id, cent.label, sum(CAST(e.x AS DOUBLE) * cent.c) AS score FROM e JOIN cent ON e.i = cent.i GROUP BY e.vec_id, cent.label)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, CAST(idx AS INTEGER) AS label, round(score, 6) AS score FROM (
  SELECT s.vec_id, n.idx, s.score, row_number() OVER (PARTITION BY s.vec_id ORDER BY s.score DESC, n.idx) AS rank
  FROM scored s JOIN names n ON s.label = n.label) WHERE rank <= 3""")
def st3_stream_top_k_scoring(s, d):
    emb = fx.table(s, d, "embeddings")
    # class centroids: one mean vector per label (bounded by the label count)
    dim = len(emb.select("embedding").first()[0])
    cent = (emb.groupBy("label").agg(*[F.avg(F.col("embedding")[i]).alias(f"c{i}") for i in range(dim)])
            .orderBy("label").collect())
    centroids = [[r[f"c{i}"] for i in range(dim)] for r in cent]
    stream = st.stream_files(s, d, "embeddings", emb.schema)
    scored = st.top_k_scores(stream.select("vec_id", "embedding"), "embedding", centroids, k=3)
    return st.run_to_table(scored.withColumn("score", F.round("score", 6)), st.job_name(s, "st3", d, "embeddings"))


@register("st4_snapshot_compare_batches", sql(SNAP_OLD, SNAP_NEW, body="""
SELECT DISTINCT entry, term FROM snap_old EXCEPT SELECT DISTINCT entry, term FROM snap_new"""))
def st4_snapshot_compare_batches(s, d):
    old = fx.snapshot(s, d, fx.OLD_SNAPSHOT)
    li_schema = fx.table(s, d, "lineitem").schema
    stream = st.stream_files(s, d, "lineitem", li_schema)
    start, end = fx.NEW_SNAPSHOT
    new = (stream.where((F.col("l_shipdate") >= F.lit(start).cast("timestamp"))
                        & (F.col("l_shipdate") < F.lit(end).cast("timestamp")))
           .select(F.col("l_orderkey").alias("entry"), F.col("l_partkey").alias("term")))
    arrived = st.distinct_to_table(new, ["entry", "term"], st.job_name(s, "st4", d, "lineitem"))
    return st.snapshot_missing(old, arrived)
