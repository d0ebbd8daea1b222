"""Catalogued pair-algebra queries: blends, ensembles, set operations (J*, O*, A5/A6/A18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ontology as onto
from ..operators import pairs as pr
from ..operators import ranking as rk
from ..sources import fixtures as fx
from .common import (ANNOT, PRED_A, PRED_B, PRED_RAW, SNAP_NEW, SNAP_OLD, TAXONOMY, TERMS, key_hash_sql, r6, register,
                     sql)

PRED_C = """pred_c AS (SELECT entry, term, max(prob) AS prob FROM pred_raw GROUP BY entry, term)"""
HIGH_A = "high_a AS (SELECT * FROM pred_a WHERE prob >= 0.5)"
HIGH_B = "high_b AS (SELECT * FROM pred_b WHERE prob >= 0.5)"
TEST_IDS = "test_ids AS (SELECT o_orderkey AS entry FROM orders WHERE o_orderstatus = 'O')"
TARGETS = "targets AS (SELECT o_orderkey AS entry FROM orders WHERE o_orderpriority = '1-URGENT')"


def _a(s, d):
    return fx.predictions_a(s, d)


def _b(s, d):
    return fx.predictions_b(s, d)


def _c(s, d):
    return fx.predictions_raw(s, d).groupBy("entry", "term").agg(F.max("prob").alias("prob"))


def _high(df):
    return df.where(F.col("prob") >= 0.5)


def _test_ids(s, d):
    return fx.table(s, d, "orders").where(F.col("o_orderstatus") == "O").select(F.col("o_orderkey").alias("entry"))


def _targets(s, d):
    return (fx.table(s, d, "orders").where(F.col("o_orderpriority") == "1-URGENT")
            .select(F.col("o_orderkey").alias("entry")))


def _out(df, value="prob"):
    return df.select("entry", "term", r6(value).alias(value))


@register("j4_full_blend", sql(PRED_A, PRED_B, HIGH_A, HIGH_B, body="""
SELECT coalesce(a.entry, b.entry) AS entry, coalesce(a.term, b.term) AS term,
       round(0.6 * coalesce(a.prob, 0) + 0.4 * coalesce(b.prob, 0), 6) AS prob
FROM high_a a FULL JOIN high_b b ON a.entry = b.entry AND a.term = b.term"""))
def j4_full_blend(s, d):
    return _out(pr.full_blend(_high(_a(s, d)), _high(_b(s, d)), 0.6, 0.4))


A5_UNION = """u AS (SELECT entry, term, prob FROM high_a UNION ALL SELECT entry, term, prob FROM high_b
  UNION ALL SELECT entry, term, prob FROM pred_c WHERE prob >= 0.4)"""


@register("a5_mean_present", sql(PRED_A, PRED_B, PRED_RAW, PRED_C, HIGH_A, HIGH_B, A5_UNION, body="""
SELECT entry, term, round(avg(prob), 6) AS prob FROM u GROUP BY entry, term"""))
def a5_mean_present(s, d):
    srcs = [_high(_a(s, d)), _high(_b(s, d)), _c(s, d).where(F.col("prob") >= 0.4)]
    return _out(pr.mean_present(srcs))


A6_UNION = """u AS (SELECT entry, term, prob FROM high_a UNION ALL SELECT entry, term, prob FROM high_b
  UNION ALL SELECT entry, term, prob FROM pred_c WHERE prob >= 0.4
  UNION ALL SELECT entry, term, CAST(1 AS DOUBLE) AS prob FROM annot)"""


@register("a6_mean_over_four", sql(PRED_A, PRED_B, PRED_RAW, PRED_C, HIGH_A, HIGH_B, ANNOT, A6_UNION, body="""
SELECT entry, term, round(sum(prob) / 4, 6) AS prob FROM u GROUP BY entry, term"""))
def a6_mean_over_four(s, d):
    ann = fx.annotations(s, d).select("entry", "term", F.lit(1.0).alias("prob"))
    srcs = [_high(_a(s, d)), _high(_b(s, d)), _c(s, d).where(F.col("prob") >= 0.4), ann]
    return _out(pr.mean_all(srcs))


@register("a18_weighted_ensemble", sql(PRED_A, PRED_B, PRED_RAW, PRED_C, body="""
SELECT entry, term, round(sum(w * prob), 6) AS prob FROM (
  SELECT entry, term, prob, 0.5 AS w FROM pred_a UNION ALL SELECT entry, term, prob, 0.3 FROM pred_b
  UNION ALL SELECT entry, term, prob, 0.2 FROM pred_c) GROUP BY entry, term"""))
def a18_weighted_ensemble(s, d):
    return _out(pr.weighted_sum([_a(s, d), _b(s, d), _c(s, d)], [0.5, 0.3, 0.2]))


@register("w12_first_source", sql(PRED_A, PRED_B, PRED_RAW, PRED_C, HIGH_A, HIGH_B, body="""
SELECT entry, term, round(arg_min(prob, src), 6) AS prob FROM (
  SELECT entry, term, prob, 0 AS src FROM high_a UNION ALL SELECT entry, term, prob, 1 FROM high_b
  UNION ALL SELECT entry, term, prob, 2 FROM pred_c) GROUP BY entry, term"""))
def w12_first_source(s, d):
    return _out(pr.first_source([_high(_a(s, d)), _high(_b(s, d)), _c(s, d)]))


@register("w11_keep_max", sql(PRED_RAW, PRED_C, body="SELECT entry, term, round(prob, 6) AS prob FROM pred_c"))
def w11_keep_max(s, d):
    from ..operators.ranking import keep_max
    return _out(keep_max(fx.predictions_raw(s, d), ["entry", "term"], "prob"))


@register("j5_compare_join", sql(PRED_A, PRED_B, HIGH_A, HIGH_B, body="""
SELECT a.entry, a.term, round(a.prob, 6) AS prob_a, round(b.prob, 6) AS prob_b
FROM high_a a JOIN high_b b ON a.entry = b.entry AND a.term = b.term"""))
def j5_compare_join(s, d):
    j = pr.compare_join(_high(_a(s, d)), _high(_b(s, d)))
    return j.select("entry", "term", r6("prob_a").alias("prob_a"), r6("prob_b").alias("prob_b"))


@register("j6_semi_annotated_entries", sql(PRED_A, ANNOT, body="""
SELECT entry, term, round(prob, 6) AS prob FROM pred_a WHERE entry IN (SELECT entry FROM annot)"""))
def j6_semi_annotated_entries(s, d):
    return _out(_a(s, d).join(fx.annotations(s, d).select("entry"), "entry", "left_semi"))


@register("j7_anti_known_positives", sql(PRED_A, ANNOT, body="""
SELECT p.entry, p.term, round(p.prob, 6) AS prob FROM pred_a p
WHERE NOT EXISTS (SELECT 1 FROM annot a WHERE a.entry = p.entry AND a.term = p.term)"""))
def j7_anti_known_positives(s, d):
    return _out(_a(s, d).join(fx.annotations(s, d).select("entry", "term"), ["entry", "term"], "left_anti"))


@register("o6_snapshot_diff", sql(SNAP_OLD, SNAP_NEW, TERMS, body="""
SELECT entry, term, CAST(0.99 AS DOUBLE) AS prob FROM (
  SELECT DISTINCT entry, term FROM snap_old
  EXCEPT SELECT DISTINCT entry, term FROM snap_new) WHERE term IN (SELECT term FROM terms)"""))
def o6_snapshot_diff(s, d):
    old, new = fx.snapshot(s, d, fx.OLD_SNAPSHOT), fx.snapshot(s, d, fx.NEW_SNAPSHOT)
    return pr.snapshot_diff(old, new, fx.terms(s, d))


@register("o7_snapshot_targets", sql(SNAP_OLD, TARGETS, body="""
SELECT DISTINCT entry, term FROM snap_old WHERE entry IN (SELECT entry FROM targets)"""))
def o7_snapshot_targets(s, d):
    old = fx.snapshot(s, d, fx.OLD_SNAPSHOT).select("entry", "term").distinct()
    return old.join(_targets(s, d), "entry", "left_semi")


@register("j17_coalesce_blend", sql(PRED_A, PRED_B, HIGH_A, body="""
SELECT coalesce(a.entry, b.entry) AS entry, coalesce(a.term, b.term) AS term,
       round(coalesce(a.prob, b.prob), 6) AS prob
FROM high_a a FULL JOIN pred_b b ON a.entry = b.entry AND a.term = b.term"""))
def j17_coalesce_blend(s, d):
    return _out(pr.coalesce_blend(_high(_a(s, d)), _b(s, d)))


@register("j18_partitioned_blend", sql(PRED_A, PRED_B, HIGH_A, HIGH_B, ANNOT, body="""
, blended AS (
  SELECT coalesce(a.entry, b.entry) AS entry, coalesce(a.term, b.term) AS term,
         CASE WHEN a.prob IS NOT NULL AND b.prob IS NOT NULL THEN (a.prob * 0.25 + b.prob * 0.211) / (0.25 + 0.211)
              ELSE coalesce(a.prob, b.prob) END AS prob
  FROM high_a a FULL JOIN high_b b ON a.entry = b.entry AND a.term = b.term),
pos AS (SELECT DISTINCT entry, term FROM annot)
SELECT coalesce(x.entry, p.entry) AS entry, coalesce(x.term, p.term) AS term,
       round(CASE WHEN p.entry IS NOT NULL THEN 1.0 ELSE x.prob END, 6) AS prob
FROM blended x FULL JOIN pos p ON x.entry = p.entry AND x.term = p.term""".replace("\n, blended", ",\nblended", 1)))
def j18_partitioned_blend(s, d):
    out = pr.partitioned_blend(_high(_a(s, d)), _high(_b(s, d)), 0.25, 0.211, positives=fx.annotations(s, d))
    return _out(out)


@register("p18_consensus_bonus", sql(PRED_A, PRED_B, HIGH_A, body="""
SELECT coalesce(a.entry, b.entry) AS entry, coalesce(a.term, b.term) AS term,
  round(CASE WHEN coalesce(a.prob, 0) > 0 AND coalesce(b.prob, 0) > 0
             THEN least(0.5 * coalesce(a.prob, 0) + 0.5 * coalesce(b.prob, 0) + 0.05, 1.0)
             ELSE 0.5 * coalesce(a.prob, 0) + 0.5 * coalesce(b.prob, 0) END, 6) AS prob
FROM high_a a FULL JOIN pred_b b ON a.entry = b.entry AND a.term = b.term"""))
def p18_consensus_bonus(s, d):
    return _out(pr.consensus_bonus(_high(_a(s, d)), _b(s, d)))


@register("p19_tie_noise", sql(PRED_A, body=f"""
SELECT entry, term, round(least(greatest(prob + ({key_hash_sql('entry', 'term')} / CAST(2147483647 AS DOUBLE) * 2 - 1) * 0.0005, 0), 1), 6) AS prob
FROM pred_a"""))
def p19_tie_noise(s, d):
    return _out(pr.tie_noise(_a(s, d)))


@register("o4_evidence_split", sql(SNAP_NEW, ANNOT, TEST_IDS, body=f"""
, d AS (SELECT DISTINCT entry, term, source FROM snap_new),
tr AS (SELECT DISTINCT entry FROM annot), te AS (SELECT DISTINCT entry FROM test_ids)
SELECT d.entry, d.term, d.source, 'test_leak' AS split FROM d
  WHERE d.entry IN (SELECT entry FROM te) AND d.entry NOT IN (SELECT entry FROM tr)
    AND d.source IN {tuple(fx.EXPERIMENTAL_CODES)}
UNION ALL SELECT d.entry, d.term, d.source, 'train_other' FROM d
  WHERE d.entry IN (SELECT entry FROM tr) AND d.source NOT IN {tuple(fx.EXPERIMENTAL_CODES)}
UNION ALL SELECT d.entry, d.term, d.source, 'test_other' FROM d
  WHERE d.entry IN (SELECT entry FROM te) AND d.source NOT IN {tuple(fx.EXPERIMENTAL_CODES)}"""
   .replace("\n, d AS", ",\nd AS", 1)))
def o4_evidence_split(s, d):
    data = fx.snapshot(s, d, fx.NEW_SNAPSHOT)
    return pr.evidence_split(data, fx.EXPERIMENTAL_CODES, fx.annotations(s, d), _test_ids(s, d))


@register("o3_test_minus_train", sql(ANNOT, TEST_IDS, body="""
SELECT DISTINCT entry FROM test_ids WHERE entry NOT IN (SELECT entry FROM annot)"""))
def o3_test_minus_train(s, d):
    return _test_ids(s, d).distinct().join(fx.annotations(s, d).select("entry"), "entry", "left_anti")


@register("o2_union_distinct_labels", sql(ANNOT, SNAP_NEW, body="""
SELECT entry, term FROM annot UNION SELECT entry, term FROM snap_new"""))
def o2_union_distinct_labels(s, d):
    return (fx.annotations(s, d).select("entry", "term")
            .union(fx.snapshot(s, d, fx.NEW_SNAPSHOT).select("entry", "term")).distinct())


@register("o5_reconcile_entries", sql(ANNOT, TAXONOMY, body="""
SELECT CAST(count(*) FILTER (WHERE b.entry IS NULL) AS BIGINT) AS only_left,
       CAST(count(*) FILTER (WHERE a.entry IS NULL) AS BIGINT) AS only_right,
       CAST(count(*) FILTER (WHERE a.entry IS NOT NULL AND b.entry IS NOT NULL) AS BIGINT) AS common
FROM (SELECT DISTINCT entry FROM annot) a
FULL JOIN (SELECT DISTINCT entry FROM taxonomy WHERE taxon < 12) b ON a.entry = b.entry"""))
def o5_reconcile_entries(s, d):
    tax = fx.taxonomy(s, d).where(F.col("taxon") < 12)
    return pr.reconcile(fx.annotations(s, d), tax, ["entry"])


@register("o8_overlap_classes", sql(PRED_A, PRED_B, HIGH_A, HIGH_B, body="""
SELECT class, n, round(n / sum(n) OVER (), 6) AS share FROM (
  SELECT CASE WHEN a.entry IS NOT NULL AND b.entry IS NOT NULL THEN 'both'
              WHEN a.entry IS NOT NULL THEN 'only_a' ELSE 'only_b' END AS class, count(*) AS n
  FROM high_a a FULL JOIN high_b b ON a.entry = b.entry AND a.term = b.term GROUP BY 1)"""))
def o8_overlap_classes(s, d):
    out = pr.overlap_classes(_high(_a(s, d)), _high(_b(s, d)))
    return out.select("class", "n", r6("share").alias("share"))


NEW_IA = """new_ia AS (
  SELECT p_partkey AS term,
         CASE WHEN p_partkey // 3 = 0 THEN CAST(0 AS DOUBLE)
              WHEN p_size > 25 THEN p_retailprice / CAST(1000 AS DOUBLE) * 1.5
              ELSE p_retailprice / CAST(1000 AS DOUBLE) END AS ia FROM part)"""


def _new_ia(s, d):
    p = fx.table(s, d, "part")
    base = F.col("p_retailprice") / 1000.0
    return p.select(F.col("p_partkey").alias("term"),
                    F.when(F.expr("p_partkey div 3") == 0, F.lit(0.0))
                    .when(F.col("p_size") > 25, base * 1.5)
                    .otherwise(base).alias("ia"))


@register("o10_weight_diff", sql(TERMS, NEW_IA, body="""
SELECT coalesce(o.term, n.term) AS term, round(o.ia, 6) AS old, round(n.ia, 6) AS new,
       round(coalesce(n.ia, 0) - coalesce(o.ia, 0), 6) AS delta
FROM terms o FULL JOIN new_ia n ON o.term = n.term
WHERE abs(coalesce(o.ia, 0) - coalesce(n.ia, 0)) > 1e-6 OR ((coalesce(o.ia, 0) = 0) <> (coalesce(n.ia, 0) = 0))"""))
def o10_weight_diff(s, d):
    out = pr.weight_diff(fx.terms(s, d), _new_ia(s, d))
    return out.select("term", r6("old").alias("old"), r6("new").alias("new"), r6("delta").alias("delta"))


@register("m5_final_merge", sql(PRED_A, PRED_B, PRED_RAW, PRED_C, HIGH_A, HIGH_B, ANNOT, TERMS, body="""
, blend AS (SELECT coalesce(a.entry, b.entry) AS entry, coalesce(a.term, b.term) AS term,
    0.6 * coalesce(a.prob, 0) + 0.4 * coalesce(b.prob, 0) AS prob FROM high_a a FULL JOIN high_b b ON a.entry = b.entry AND a.term = b.term),
u AS (SELECT * FROM blend UNION ALL SELECT entry, term, prob FROM pred_c WHERE prob >= 0.4
  UNION ALL SELECT entry, term, CAST(0.99 AS DOUBLE) AS prob FROM annot),
m AS (SELECT entry, term, round(avg(prob), 6) AS prob FROM u GROUP BY entry, term),
r AS (SELECT m.*, t.namespace, dense_rank() OVER (PARTITION BY m.entry, t.namespace ORDER BY m.prob DESC) - 1 AS rank
  FROM m JOIN terms t ON m.term = t.term)
SELECT entry, term, namespace, prob, CAST(rank AS INTEGER) AS rank FROM r WHERE rank < 500""".replace("\n, blend AS", ",\nblend AS", 1)))
def m5_final_merge(s, d):
    """M5: blend of two models, a third model and a constant-score source, mean over the sources
    that hold a pair, namespace, and the rows of the first 500 score values per entry and namespace."""
    known = fx.annotations(s, d).select("entry", "term", F.lit(0.99).alias("prob"))
    blend = pr.full_blend(_high(_a(s, d)), _high(_b(s, d)), 0.6, 0.4)
    merged = _out(pr.mean_present([blend, _c(s, d).where(F.col("prob") >= 0.4), known]))
    merged = merged.join(fx.terms(s, d).select("term", "namespace"), "term")
    out = rk.dense_rank_cut(merged, ["entry", "namespace"], "prob", 500, distinct_values=True)
    return out.select("entry", "term", "namespace", "prob", F.col("rank").cast("int").alias("rank"))


@register("a23_clipped_sums", sql(PRED_RAW, body="""
SELECT entry, term, round(least(greatest(sum(prob), 0), 1), 6) AS prob FROM pred_raw GROUP BY entry, term"""))
def a23_clipped_sums(s, d):
    """Repeated (entry, term) scores are summed, then clipped."""
    return _out(onto.clip_scores(fx.predictions_raw(s, d)))
