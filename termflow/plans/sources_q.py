"""Readers and sinks over files that each query writes from the driver's tables into the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import arrays
from ..sources import fixtures as fx
from ..sources import formats as fm
from .common import LINKS, PRED_A, TERMS, r6, register, sql


def _folder(s) -> str:
    return f"{ensure_checkpoint_dir(s).rstrip('/')}/tables/files-{uuid.uuid4().hex}"


@register("s2_mixed_separator_links", sql(LINKS, body="""
SELECT protein1, protein2, CAST(score AS DOUBLE) AS score, CASE CAST(score AS BIGINT) % 4 WHEN 0 THEN 'tab' WHEN 1 THEN 'comma' WHEN 2 THEN 'blank' ELSE 'packed' END AS kind
FROM links WHERE score >= 5"""))
def s2_mixed_separator_links(s, d):
    """Links in four folders of tab, comma, blank and gzipped files with columns in different orders, read as one."""
    root, links = _folder(s), fx.interaction_links(s, d).withColumn("combined_score", F.col("score").cast("double"))
    kinds = [("tab", "\t", ["protein1", "protein2", "combined_score"], None), ("comma", ",", ["combined_score", "protein2", "protein1"], None),
             ("blank", " ", ["protein2", "protein1", "combined_score"], None), ("packed", "\t", ["protein1", "combined_score", "protein2"], "gzip")]
    for k, (name, sep, cols, codec) in enumerate(kinds):
        w = links.where(F.col("score").cast("long") % 4 == k).select(*cols).write.option("sep", sep).option("header", True)
        (w.option("compression", codec) if codec else w).csv(f"{root}/{name}")
    got = fm.read_links(s, [f"{root}/{k[0]}" for k in kinds], min_score=5, file_col="file")
    return got.select("protein1", "protein2", "score", F.element_at(F.split("file", "/"), -2).alias("kind"))


@register("s12_vector_bundle", sql(body="""
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, round(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE))), 6) AS total,
  CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[len(embedding)] AS DOUBLE) AS last FROM embeddings"""))
def s12_vector_bundle(s, d):
    """Embeddings written as a bundle of array files and read back in byte ranges."""
    path = _folder(s)
    arrays.write_vectors(fx.table(s, d, "embeddings"), path, "vec_id", "embedding")
    v = arrays.read_vectors(s, path, split_bytes=1 << 16)
    total = F.aggregate("vector", F.lit(0.0), lambda a, e: a + e.cast("double"))
    return v.select(F.col("id").cast("long").alias("vec_id"), F.size("vector").alias("dim"), r6(total).alias("total"),
                    F.element_at("vector", 1).cast("double").alias("first"), F.element_at("vector", -1).cast("double").alias("last"))


@register("k1_submission_round_trip", sql(PRED_A, body="""
SELECT CAST(entry AS VARCHAR) AS entry, CAST(term AS VARCHAR) AS term, CAST(printf('%.3f', prob) AS DOUBLE) AS prob FROM pred_a"""))
def k1_submission_round_trip(s, d):
    path = _folder(s)
    fm.write_submission(fx.predictions_a(s, d), path)
    return fm.read_predictions(s, path)


@register("k4_partitioned_tables", sql(TERMS, body="SELECT term, round(ia, 6) AS ia, CAST(namespace AS INTEGER) AS namespace FROM terms WHERE namespace <> 1"))
def k4_partitioned_tables(s, d):
    """One folder a namespace; a reader of two of them never opens the third."""
    path = _folder(s)
    fm.write_partitioned(fx.terms(s, d), path)
    return s.read.parquet(path).where("namespace <> 1").select("term", r6("ia").alias("ia"), F.col("namespace").cast("int").alias("namespace"))


@register("k9_dense_scores_to_long", sql(body="""
WITH e AS (SELECT vec_id AS entry, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
t AS (SELECT p_partkey AS term, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part)
SELECT entry, t.term, round(CAST(x AS DOUBLE), 3) AS prob FROM e JOIN t ON e.pos = t.pos WHERE CAST(x AS DOUBLE) >= CAST(0.001 AS DOUBLE)"""))
def k9_dense_scores_to_long(s, d):
    from ..operators.features import dense_ids
    labels = dense_ids(fx.table(s, d, "part").select(F.col("p_partkey").alias("term")), "term", "idx").select(F.col("idx").cast("int").alias("idx"), "term")
    e = fx.table(s, d, "embeddings").select(F.col("vec_id").alias("entry"), F.transform("embedding", lambda x: x.cast("double")).alias("scores"))
    return fm.dense_to_long(e, labels)


@register("s17_id_list_filter", """SELECT o_orderkey AS entry FROM orders WHERE o_orderstatus = 'F'""")
def s17_id_list_filter(s, d):
    """An id list file (a line an id, blanks around and between) read back as a semi-join key."""
    path, orders = _folder(s), fx.table(s, d, "orders")
    orders.where("o_orderstatus = 'F'").select(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" \n")).alias("value")).write.text(path)
    ids = fm.read_id_list(s, path).select(F.col("id").cast("long").alias("o_orderkey"))
    return orders.join(ids, "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("entry"))


@register("s16_json_vocabulary", """SELECT DISTINCT CAST(c_nationkey AS INTEGER) AS taxon FROM customer ORDER BY 1 LIMIT 10""")
def s16_json_vocabulary(s, d):
    """A vocabulary exported as JSON ({"taxon2idx": {..}}) and its first ten keys read back."""
    path = _folder(s)
    fm.write_json_vocab(fx.table(s, d, "customer").select(F.col("c_nationkey").alias("taxon")).distinct(), path)
    return fm.read_json_vocab(s, path, top_k=10)
