"""Catalogued QA, comparison and model queries (V7-V10, W14, M*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import models as md
from ..operators import newton, qa
from ..sources import fixtures as fx
from .common import ANNOT, PRED_A, PRED_B, TERMS, r6, register, sql


def _raw_submission(s, d):
    """Prediction text as read from a file: strings, repeats, one header row."""
    li = fx.table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_tax")
    rows = li.select(F.col("l_orderkey").cast("string").alias("entry"), F.col("l_partkey").cast("string").alias("term"),
                     F.format_string("%.4f", F.col("l_tax") * 12).alias("prob"))
    header = s.createDataFrame([("EntryID", "term", "prob")], "entry string, term string, prob string")
    return header.unionByName(rows)


def _known(s, d):
    ids = fx.table(s, d, "orders").where(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").cast("string").alias("entry"))
    terms = fx.terms(s, d).where(F.col("term") % 4 != 3).select(F.col("term").cast("string").alias("term"))
    return ids, terms


RAW_SUB = """raw AS (SELECT 'EntryID' AS entry, 'term' AS term, 'prob' AS prob
  UNION ALL SELECT CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), printf('%.4f', l_tax * 12) FROM lineitem),
ids AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS entry FROM orders WHERE o_orderstatus <> 'P'),
tms AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS term FROM part WHERE p_partkey % 4 <> 3),
p AS (SELECT entry, term, TRY_CAST(prob AS DOUBLE) AS p FROM raw)"""


@register("v7_submission_report", sql(RAW_SUB, body="""
SELECT count(*) AS rows, count(*) FILTER (WHERE p IS NULL) AS non_numeric, count(*) FILTER (WHERE isnan(p)) AS nan,
  count(*) FILTER (WHERE p < 0 OR p > 1) AS out_of_range,
  count(*) FILTER (WHERE entry NOT IN (SELECT entry FROM ids)) AS unknown_ids,
  count(*) FILTER (WHERE term NOT IN (SELECT term FROM tms)) AS unknown_terms,
  (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM p WHERE p IS NOT NULL GROUP BY entry, term)) AS duplicates,
  (SELECT count(*) FROM ids WHERE entry NOT IN (SELECT entry FROM p)) AS missing_ids
FROM p"""))
def v7_submission_report(s, d):
    ids, terms = _known(s, d)
    report, _ = qa.validate_submission(_raw_submission(s, d), ids, terms)
    return report


@register("v7_submission_cleaned", sql(RAW_SUB, body="""
SELECT entry, term, round(least(greatest(max(p), 0), 1), 6) AS prob FROM p
WHERE p IS NOT NULL AND NOT isnan(p) AND entry IN (SELECT entry FROM ids) AND term IN (SELECT term FROM tms)
GROUP BY entry, term"""))
def v7_submission_cleaned(s, d):
    ids, terms = _known(s, d)
    _, cleaned = qa.validate_submission(_raw_submission(s, d), ids, terms)
    return cleaned.select("entry", "term", r6("prob").alias("prob"))


NEW_W = """w AS (SELECT p_partkey AS term, CASE WHEN p_partkey // 3 = 0 THEN 0.0
                 WHEN p_size > 45 THEN CAST('NaN' AS DOUBLE) ELSE p_retailprice / 1000.0 END AS ia
  FROM part WHERE p_size > 2)"""


def _weights(s, d):
    p = fx.table(s, d, "part").where(F.col("p_size") > 2)
    return p.select(F.col("p_partkey").alias("term"),
                    F.when(F.expr("p_partkey div 3") == 0, F.lit(0.0))
                    .when(F.col("p_size") > 45, F.lit(float("nan")))
                    .otherwise(F.col("p_retailprice") / 1000.0).alias("ia"))


@register("v8_weight_consistency", sql(TERMS, PRED_A, NEW_W, body="""
, cls AS (SELECT t.term, CASE WHEN w.term IS NULL THEN 'missing' WHEN isnan(w.ia) THEN 'nan'
                 WHEN w.ia = 0 THEN 'zero' ELSE 'positive' END AS class FROM terms t LEFT JOIN w ON t.term = w.term),
o AS (SELECT class, count(*) AS ontology_terms FROM cls GROUP BY class),
pr AS (SELECT CASE WHEN w.term IS NULL THEN 'missing' WHEN isnan(w.ia) THEN 'nan' WHEN w.ia = 0 THEN 'zero'
              ELSE 'positive' END AS class, count(*) AS prediction_rows, count(DISTINCT p.term) AS predicted_terms
       FROM pred_a p LEFT JOIN w ON p.term = w.term GROUP BY 1)
SELECT coalesce(o.class, pr.class) AS class, coalesce(ontology_terms, 0) AS ontology_terms,
       coalesce(prediction_rows, 0) AS prediction_rows, coalesce(predicted_terms, 0) AS predicted_terms
FROM o FULL JOIN pr ON o.class = pr.class""".replace("\n, cls AS", ",\ncls AS", 1)))
def v8_weight_consistency(s, d):
    return qa.weight_consistency(_weights(s, d), fx.terms(s, d), fx.predictions_a(s, d))


@register("v9_alignment_check", sql(body="""
WITH a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS pos FROM embeddings),
b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY CASE WHEN vec_id % 20 = 0 THEN vec_id ELSE -vec_id END) AS pos
      FROM embeddings WHERE label <> 3)
SELECT count(a.id) AS n_a, count(b.id) AS n_b, count(*) FILTER (WHERE a.id IS DISTINCT FROM b.id) AS n_mismatch,
       min(CASE WHEN a.id IS DISTINCT FROM b.id THEN coalesce(a.pos, b.pos) END) AS first_mismatch
FROM a FULL JOIN b ON a.pos = b.pos"""))
def v9_alignment_check(s, d):
    e = fx.table(s, d, "embeddings")
    a = fe.dense_ids(e, "vec_id", "ord").select(F.col("vec_id").alias("id"), "ord")
    key = F.when(F.col("vec_id") % 20 == 0, F.col("vec_id")).otherwise(-F.col("vec_id"))
    b = fe.dense_ids(e.where(F.col("label") != 3).select(key.alias("key")), "key", "ord").select(F.abs("key").alias("id"), "ord")
    a, b = (x.withColumn("ord", F.col("ord") + 1) for x in (a, b))
    return qa.alignment_check(a, b)


@register("w14_rank_comparison", sql(PRED_A, PRED_B, body="""
, ra AS (SELECT entry, term AS term_a, prob AS prob_a, row_number() OVER (PARTITION BY entry ORDER BY prob DESC, term) AS rank FROM pred_a),
rb AS (SELECT entry, term AS term_b, prob AS prob_b, row_number() OVER (PARTITION BY entry ORDER BY prob DESC, term) AS rank FROM pred_b)
SELECT coalesce(ra.entry, rb.entry) AS entry, CAST(coalesce(ra.rank, rb.rank) AS INTEGER) AS rank, term_a,
       round(prob_a, 6) AS prob_a, term_b, round(prob_b, 6) AS prob_b,
       coalesce(term_a <> term_b, true) AS different_term,
       round(CASE WHEN term_a = term_b THEN prob_b - prob_a END, 6) AS delta
FROM ra FULL JOIN rb ON ra.entry = rb.entry AND ra.rank = rb.rank""".replace("\n, ra AS", ",\nra AS", 1)))
def w14_rank_comparison(s, d):
    out = qa.rank_comparison(fx.predictions_a(s, d), fx.predictions_b(s, d))
    return out.select("entry", F.col("rank").cast("int").alias("rank"), "term_a", r6("prob_a").alias("prob_a"),
                      "term_b", r6("prob_b").alias("prob_b"), "different_term", r6("delta").alias("delta"))


@register("m4_fold_logit_ensemble", sql(PRED_A, PRED_B, body="""
, u AS (SELECT entry, term, prob FROM pred_a WHERE prob >= 0.5 UNION ALL SELECT entry, term, prob FROM pred_b),
l AS (SELECT entry, term, ln(least(greatest(prob, 1e-6), 1 - 1e-6) / (1 - least(greatest(prob, 1e-6), 1 - 1e-6))) AS z FROM u)
SELECT entry, term, round(1 / (1 + exp(-avg(z))), 6) AS prob FROM l GROUP BY entry, term""".replace("\n, u AS", ",\nu AS", 1)))
def m4_fold_logit_ensemble(s, d):
    a = fx.predictions_a(s, d).where(F.col("prob") >= 0.5)
    out = md.fold_ensemble([a, fx.predictions_b(s, d)], how="logit")
    return out.select("entry", "term", r6("prob").alias("prob"))


def _one_against_rest(e):
    """(entry, label_id, y) for every label of the table; the label list travels as one row."""
    ids = e.where("label is not null").groupBy(F.lit(1).alias("_one")).agg(F.array_sort(F.collect_set("label")).alias("_ids"))
    return (e.withColumn("_one", F.lit(1)).join(F.broadcast(ids), "_one").select("entry", "label", F.explode("_ids").alias("label_id"))
            .select("entry", "label_id", F.col("label").eqNullSafe(F.col("label_id")).cast("int").alias("y")))


@register("m1_m3_multilabel_logreg")
def m1_m3_multilabel_logreg(s, d):
    e = fx.embeddings(s, d)
    labels = _one_against_rest(e)
    fitted = newton.fit_newton(e.select("entry", "vec"), labels, alpha=1e-2, max_iter=30, tol=1e-10)
    return newton.score_newton(fitted, e.select("entry", "vec")).select("entry", "label_id", r6("prob").alias("prob"))


@register("m2_gbt_selected_labels")
def m2_gbt_selected_labels(s, d):
    e = fx.embeddings(s, d)
    labels = _one_against_rest(e)
    models = md.fit_multilabel_gbt(e.select("entry", "vec"), labels, max_iter=10, max_depth=3)
    return md.score_multilabel(models, e.select("entry", "vec")).select("entry", "label_id", r6("prob").alias("prob"))
