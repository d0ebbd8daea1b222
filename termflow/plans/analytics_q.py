"""Catalogued analytics, label-selection and running-window queries (A*, L*, W6-W10, W13)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import aggregates as ag
from ..operators import ontology as onto
from ..operators import ranking as rk
from ..session import parts_of, write_table
from ..sources import fixtures as fx
from .common import (ANNOT, CLOSURE, EDGE, HITS, PRED_A, PRED_B, PRED_RAW, RCLOSURE, TAXONOMY, TERMS, Dims, key_hash_sql,
                     r6, register, sql)

TERM_FREQ = "term_freq AS (SELECT term, count(*) AS n FROM annot GROUP BY term)"


def _freq(s, d):
    return ag.frequency(fx.annotations(s, d), ["term"])


@register("a1_term_frequency", sql(ANNOT, body="SELECT term, count(*) AS n FROM annot GROUP BY term"))
def a1_term_frequency(s, d):
    return _freq(s, d)


@register("a20_aspect_term_stats", sql(ANNOT, body="""
SELECT aspect, count(DISTINCT term) AS n_terms, count(*) AS n_rows FROM annot GROUP BY aspect"""))
def a20_aspect_term_stats(s, d):
    a = fx.annotations(s, d)
    return a.groupBy("aspect").agg(F.countDistinct("term").alias("n_terms"), F.count("*").alias("n_rows"))


@register("a3_species_stats", sql(ANNOT, TAXONOMY, body="""
SELECT t.taxon, count(DISTINCT a.entry) AS n_entry, count(*) AS n_rows
FROM annot a JOIN taxonomy t ON a.entry = t.entry GROUP BY t.taxon"""))
def a3_species_stats(s, d):
    j = fx.annotations(s, d).join(fx.taxonomy(s, d), "entry")
    return ag.group_stats(j, "taxon", "entry")


@register("a9_per_entity_summary", sql(PRED_A, body="""
SELECT count(*) AS entities, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std,
       min(n) AS min, max(n) AS max, round(quantile_cont(n, 0.5), 6) AS median
FROM (SELECT entry, count(*) AS n FROM pred_a GROUP BY entry)"""))
def a9_per_entity_summary(s, d):
    out = ag.per_entity_summary(fx.predictions_a(s, d))
    return out.select("entities", r6("mean").alias("mean"), r6("std").alias("std"), "min", "max",
                      r6("median").alias("median"))


@register("a10_dominant_terms", sql(EDGE, CLOSURE, RCLOSURE, ANNOT, body="""
, lab AS (SELECT DISTINCT a.entry, r.ancestor AS term FROM annot a JOIN rclosure r ON a.term = r.child)
SELECT term, count(DISTINCT entry) AS n_entities,
       round(count(DISTINCT entry) / (SELECT count(DISTINCT entry) FROM lab), 6) AS share
FROM lab GROUP BY term HAVING count(DISTINCT entry) / (SELECT count(DISTINCT entry) FROM lab) > 0.05"""
   .replace("\n, lab AS", ",\nlab AS", 1)))
def a10_dominant_terms(s, d):
    dims = Dims.of(s, d)
    lab = onto.propagate_labels(fx.annotations(s, d), dims.closure, dims.terms)
    out = ag.dominant_terms(lab, share=0.05)
    return out.select("term", "n_entities", r6("share").alias("share"))


@register("a11_vector_stats", """WITH el AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
rows AS (SELECT vec_id, sqrt(sum(x * x)) AS norm, max(abs(x)) AS absmax FROM el GROUP BY vec_id)
SELECT (SELECT count(*) FROM embeddings) AS vectors, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std,
       round(min(x), 6) AS min, round(max(x), 6) AS max,
       round((SELECT avg(norm) FROM rows), 6) AS mean_norm,
       CAST(max(CASE WHEN isnan(x) THEN 1 ELSE 0 END) AS INTEGER) AS has_nan,
       CAST(max(CASE WHEN isinf(x) THEN 1 ELSE 0 END) AS INTEGER) AS has_inf,
       round((SELECT max(absmax) FROM rows), 6) AS abs_max FROM el""")
def a11_vector_stats(s, d):
    out = ag.vector_stats(fx.embeddings(s, d))
    return out.select("vectors", *[r6(c).alias(c) for c in ("mean", "std", "min", "max", "mean_norm")],
                      "has_nan", "has_inf", r6("abs_max").alias("abs_max"))


@register("a12_correlations", sql(PRED_A, PRED_B, body="""
, j AS (SELECT a.prob AS prob_a, b.prob AS prob_b FROM pred_a a JOIN pred_b b ON a.entry = b.entry AND a.term = b.term),
r AS (SELECT prob_a, prob_b,
        rank() OVER (ORDER BY prob_a) + (count(*) OVER (PARTITION BY prob_a) - 1) / 2.0 AS ra,
        rank() OVER (ORDER BY prob_b) + (count(*) OVER (PARTITION BY prob_b) - 1) / 2.0 AS rb FROM j)
SELECT round(corr(prob_a, prob_b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM r"""
   .replace("\n, j AS", ",\nj AS", 1)))
def a12_correlations(s, d):
    from ..operators import pairs as pr
    j = pr.compare_join(fx.predictions_a(s, d), fx.predictions_b(s, d))
    out = ag.correlations(j, "prob_a", "prob_b")
    return out.select(r6("pearson").alias("pearson"), r6("spearman").alias("spearman"))


@register("a13_histogram", sql(PRED_B, body="""
SELECT CAST(least(floor(prob * 50), 49) AS INTEGER) AS bin, count(*) AS n FROM pred_b
WHERE prob BETWEEN 0 AND 1 GROUP BY 1"""))
def a13_histogram(s, d):
    return ag.histogram(fx.predictions_b(s, d), "prob", 50)


@register("a14_jaccard_per_entity", sql(PRED_A, PRED_B, body="""
, sa AS (SELECT DISTINCT entry, term FROM pred_a WHERE prob >= 0.5),
sb AS (SELECT DISTINCT entry, term FROM pred_b WHERE prob >= 0.5),
na AS (SELECT entry, count(*) AS n_a FROM sa GROUP BY entry),
nb AS (SELECT entry, count(*) AS n_b FROM sb GROUP BY entry),
i AS (SELECT sa.entry, count(*) AS n_both FROM sa JOIN sb ON sa.entry = sb.entry AND sa.term = sb.term GROUP BY sa.entry),
j AS (SELECT coalesce(na.entry, nb.entry) AS entry, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b,
             coalesce(n_both, 0) AS n_both FROM na FULL JOIN nb ON na.entry = nb.entry LEFT JOIN i
             ON i.entry = coalesce(na.entry, nb.entry))
SELECT entry, n_a, n_b, n_both, round(1 - n_both / (n_a + n_b - n_both), 6) AS jaccard_dist FROM j
WHERE 1 - n_both / (n_a + n_b - n_both) > 0.5""".replace("\n, sa AS", ",\nsa AS", 1)))
def a14_jaccard_per_entity(s, d):
    out = ag.jaccard_per_entity(fx.predictions_a(s, d), fx.predictions_b(s, d), min_score=0.5)
    return out.select("entry", "n_a", "n_b", "n_both", r6("jaccard_dist").alias("jaccard_dist"))


@register("a19_entities_in_all_aspects", sql(ANNOT, body="""
SELECT entry FROM annot GROUP BY entry HAVING count(DISTINCT aspect) = 3"""))
def a19_entities_in_all_aspects(s, d):
    return ag.entities_in_all(fx.annotations(s, d))


@register("a21_qa_counters", sql(PRED_RAW, body="""
SELECT count(*) AS rows, count(*) FILTER (WHERE prob IS NULL) AS nulls,
       count(*) FILTER (WHERE isnan(prob)) AS nans,
       (SELECT CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM pred_raw GROUP BY entry, term)) AS duplicates
FROM pred_raw"""))
def a21_qa_counters(s, d):
    out = ag.qa_counters(fx.predictions_raw(s, d), ["entry", "term"], "prob")
    return out.select("rows", "nulls", "nans", F.col("duplicates").cast("bigint").alias("duplicates"))


@register("a22_weight_counters", sql(TERMS, body="""
SELECT count(*) AS terms, round(count(*) FILTER (WHERE ia > 0) / count(*), 6) AS share_positive,
       count(*) FILTER (WHERE ia = 0) AS zero, count(*) FILTER (WHERE isnan(ia)) AS nan FROM terms"""))
def a22_weight_counters(s, d):
    out = ag.weight_counters(fx.terms(s, d))
    return out.select("terms", r6("share_positive").alias("share_positive"), "zero", "nan")


@register("a24_label_count_clipped", sql(ANNOT, body="""
SELECT entry, CAST(least(count(*), 10) AS BIGINT) AS n_labels FROM annot GROUP BY entry"""))
def a24_label_count_clipped(s, d):
    return (fx.annotations(s, d).groupBy("entry")
            .agg(F.least(F.count("*"), F.lit(10)).cast("bigint").alias("n_labels")))


A25_SQL = sql(HITS, body="""
, r AS (SELECT *, CASE WHEN evalue > 0 THEN log10(evalue) ELSE -300 END AS log_evalue,
        row_number() OVER (PARTITION BY query ORDER BY bits DESC, target) AS rn FROM hits)
SELECT query, count(*) AS n_hits, round(max(bits), 6) AS best_bits,
""" + ",\n".join(f"round(avg(CASE WHEN rn <= {k} THEN {m} END), 6) AS {m}_top{k}_mean"
                 for m in ("identity", "alnlen", "log_evalue") for k in (1, 3, 5, 10)) + """
FROM r GROUP BY query""").replace("\n, r AS", ",\nr AS", 1)


@register("a25_first_k_hit_means", A25_SQL)
def a25_first_k_hit_means(s, d):
    h = fx.hits(s, d).withColumn("log_evalue", fn.log10_floor("evalue"))
    out = ag.first_k_means(h, "query", "bits", ["identity", "alnlen", "log_evalue"], tie="target")
    cols = [c for c in out.columns if c not in ("query", "n_hits")]
    return out.select("query", "n_hits", *[r6(c).alias(c) for c in cols])


SOFT = """sf AS (
  SELECT coalesce(p.term, a.term) AS term, CASE WHEN a.term IS NULL THEN 0.0 ELSE 1.0 END AS y,
         coalesce(p.prob, 0) AS p
  FROM pred_a p FULL JOIN annot a ON p.entry = a.entry AND p.term = a.term)"""


@register("a26_soft_f1", sql(PRED_A, ANNOT, SOFT, body="""
SELECT round(avg(2 * tp / (2 * tp + fp + fn + 1e-8)), 6) AS soft_f1, count(*) AS labels FROM (
  SELECT term, sum(y * p) AS tp, sum((1 - y) * p) AS fp, sum(y * (1 - p)) AS fn FROM sf GROUP BY term)"""))
def a26_soft_f1(s, d):
    p = fx.predictions_a(s, d).select("entry", "term", F.col("prob").alias("_p"))
    a = fx.annotations(s, d).select("entry", "term", F.lit(1.0).alias("_y"))
    j = p.join(a, ["entry", "term"], "full").select(
        "term", F.coalesce("_y", F.lit(0.0)).alias("y"), F.coalesce("_p", F.lit(0.0)).alias("p"))
    out = ag.soft_f1(j)
    return out.select(r6("soft_f1").alias("soft_f1"), "labels")


@register("a28_asymmetric_loss", sql(PRED_B, ANNOT, TERMS, body="""
, x AS (SELECT p.entry, p.term, CASE WHEN a.term IS NULL THEN 0.0 ELSE 1.0 END AS y,
        ln(least(greatest(p.prob, 1e-6), 1 - 1e-6) / (1 - least(greatest(p.prob, 1e-6), 1 - 1e-6))) AS logit,
        t.ia AS w
        FROM pred_b p LEFT JOIN annot a ON p.entry = a.entry AND p.term = a.term JOIN terms t ON t.term = p.term),
q AS (SELECT y, w, 1 / (1 + exp(-logit)) AS p FROM x)
SELECT round(sum(-(y * ln(greatest(p, 1e-8)) * w * power(1 - p, 0.0)
             + (1 - y) * ln(greatest(1 - least(p + 0.05, 1.0), 1e-8)) * power(least(p + 0.05, 1.0), 4.0))), 4) AS loss
FROM q""".replace("\n, x AS", ",\nx AS", 1)))
def a28_asymmetric_loss(s, d):
    p = fx.predictions_b(s, d)
    a = fx.annotations(s, d).select("entry", "term", F.lit(1.0).alias("_y"))
    t = fx.terms(s, d).select("term", F.col("ia").alias("w"))
    x = (p.join(a, ["entry", "term"], "left").join(t, "term")
         .select(F.coalesce("_y", F.lit(0.0)).alias("y"), fn.logit("prob").alias("logit"), "w"))
    out = ag.asymmetric_loss(x, "y", "logit", pos_weight="w", gamma_pos=0.0, gamma_neg=4.0, clip=0.05)
    return out.select(F.round("loss", 4).alias("loss"))


@register("a29_cutoff_profile", sql(PRED_B, body="""
, c AS (SELECT unnest([0.2, 0.3, 0.4, 0.5]) AS cutoff),
per AS (SELECT c.cutoff, p.entry, count(*) AS n FROM pred_b p JOIN c ON p.prob >= c.cutoff GROUP BY 1, 2)
SELECT CAST(cutoff AS DOUBLE) AS cutoff, count(*) AS entities, round(avg(n), 6) AS mean_rows,
       round(quantile_cont(n, 0.95), 6) AS p95_rows, max(n) AS max_rows FROM per GROUP BY cutoff"""
   .replace("\n, c AS", ",\nc AS", 1)))
def a29_cutoff_profile(s, d):
    out = ag.cutoff_profile(fx.predictions_b(s, d), [0.2, 0.3, 0.4, 0.5])
    return out.select("cutoff", "entities", r6("mean_rows").alias("mean_rows"), r6("p95_rows").alias("p95_rows"),
                      "max_rows")


@register("a29_score_quantiles", sql(PRED_B, body="SELECT " + ", ".join(
    f"round(quantile_cont(prob, {q}), 6) AS q{int(round(q * 100))}"
    for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95)) + " FROM pred_b"))
def a29_score_quantiles(s, d):
    out = ag.score_quantiles(fx.predictions_b(s, d), [0.1, 0.25, 0.5, 0.75, 0.9, 0.95])
    return out.select(*[r6(c).alias(c) for c in out.columns])


# ------------------------------------------------------------- label selection

@register("l3_top_labels_by_weight", sql(ANNOT, TERMS, TERM_FREQ, body="""
SELECT term, n, round(score, 6) AS score, rank FROM (
  SELECT f.term, f.n, f.n * t.ia AS score, row_number() OVER (ORDER BY f.n * t.ia DESC, f.term) AS rank
  FROM term_freq f JOIN terms t ON f.term = t.term) WHERE rank <= 100"""))
def l3_top_labels_by_weight(s, d):
    f = _freq(s, d).join(fx.terms(s, d).select("term", "ia"), "term").withColumn("score", F.col("n") * F.col("ia"))
    out = rk.select_labels(f, "term", "score", 100)
    return out.select("term", "n", r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register("l4_top_labels_per_aspect", sql(ANNOT, TERMS, TERM_FREQ, body="""
SELECT term, namespace, n, rank FROM (
  SELECT f.term, t.namespace, f.n, row_number() OVER (PARTITION BY t.namespace ORDER BY f.n DESC, f.term) AS rank
  FROM term_freq f JOIN terms t ON f.term = t.term) WHERE rank <= 20"""))
def l4_top_labels_per_aspect(s, d):
    f = _freq(s, d).join(fx.terms(s, d).select("term", "namespace"), "term")
    return rk.select_labels(f, "term", "n", 20, group="namespace").select("term", "namespace", "n", F.col("rank").cast("bigint").alias("rank"))


@register("l5_label_rank_slice", sql(ANNOT, TERM_FREQ, body="""
SELECT term, n, rank FROM (
  SELECT term, n, row_number() OVER (ORDER BY n DESC, term) AS rank FROM term_freq WHERE n >= 3)
WHERE rank > 5 AND rank <= 50"""))
def l5_label_rank_slice(s, d):
    return rk.select_labels(_freq(s, d), "term", "n", 50, min_freq=3, skip_top=5).select("term", "n", F.col("rank").cast("bigint").alias("rank"))


TOP_LABELS = 31_466  # the operator's top-N parameter


@register("l7_sparse_target_matrix", sql(ANNOT, TERM_FREQ, body="""
, labels AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) - 1 AS col_id FROM term_freq WHERE n >= 2 ORDER BY n DESC, term LIMIT 31466),
rows AS (SELECT entry, row_number() OVER (ORDER BY entry) - 1 AS row_id FROM (SELECT DISTINCT entry FROM annot))
SELECT r.row_id, l.col_id FROM annot a JOIN rows r ON a.entry = r.entry JOIN labels l ON a.term = l.term"""
   .replace("\n, labels AS", ",\nlabels AS", 1)))
def l7_sparse_target_matrix(s, d):
    from ..operators import features as fe
    a = fx.annotations(s, d)
    labels = rk.select_labels(_freq(s, d), "term", "n", TOP_LABELS, min_freq=2).select(
        "term", (F.col("rank") - 1).cast("bigint").alias("col_id"))
    rows = fe.dense_ids(a.select("entry").distinct(), "entry", "row_id")
    return a.join(rows, "entry").join(labels, "term").select("row_id", "col_id")


# --------------------------------------------------------------- running windows

@register("w6_running_share", sql(ANNOT, TERM_FREQ, body="""
SELECT term, n, rank, CAST(cum AS BIGINT) AS cum, round(cum * 100.0 / sum(n) OVER (), 6) AS cum_pct, run_min FROM (
  SELECT term, n, row_number() OVER (ORDER BY n DESC, term) AS rank,
         sum(n) OVER (ORDER BY n DESC, term ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
         min(n) OVER (ORDER BY n DESC, term ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_min
  FROM term_freq)"""))
def w6_running_share(s, d):
    out = rk.running_share(_freq(s, d), "n", "term", "n")
    return out.select("term", "n", F.col("rank").cast("bigint").alias("rank"), F.col("cum").cast("bigint").alias("cum"),
                      r6("cum_pct").alias("cum_pct"), "run_min")


@register("w8_moving_average", sql(ANNOT, TERM_FREQ, body="""
SELECT term, rank, round(CASE WHEN rank >= 50 THEN ma END, 6) AS moving_avg FROM (
  SELECT term, row_number() OVER (ORDER BY n DESC, term) AS rank,
         avg(n) OVER (ORDER BY n DESC, term ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS ma FROM term_freq)"""))
def w8_moving_average(s, d):
    out = rk.moving_average(_freq(s, d), "n", "term", "n", 50)
    return out.select("term", F.col("rank").cast("bigint").alias("rank"), r6("moving_avg").alias("moving_avg"))


@register("w9_w10_rare_label_grid", sql(ANNOT, TERM_FREQ, body="""
, r AS (SELECT term, n, row_number() OVER (ORDER BY n DESC, term) AS rank FROM term_freq),
k AS (SELECT unnest([100, 200, 500, 1000]) AS k), f AS (SELECT unnest([1, 2, 5]) AS f)
SELECT k.k, f.f, count(*) FILTER (WHERE r.rank <= k.k AND r.n <= f.f) AS n_rare,
       max(CASE WHEN r.rank = k.k THEN r.n END) AS freq_at_k
FROM k, f, r GROUP BY k.k, f.f""".replace("\n, r AS", ",\nr AS", 1)))
def w9_w10_rare_label_grid(s, d):
    f = _freq(s, d)
    w = Window.orderBy(F.col("n").desc(), F.col("term").asc())
    r = f.withColumn("rank", F.row_number().over(w))
    grid = r.select("rank", "n", F.explode(F.array(*[F.lit(k) for k in (100, 200, 500, 1000)])).alias("k")) \
        .select("*", F.explode(F.array(*[F.lit(x) for x in (1, 2, 5)])).alias("f"))
    return grid.groupBy(F.col("k").cast("int").alias("k"), F.col("f").cast("int").alias("f")).agg(
        F.count_if((F.col("rank") <= F.col("k")) & (F.col("n") <= F.col("f"))).alias("n_rare"),
        F.max(F.when(F.col("rank") == F.col("k"), F.col("n"))).alias("freq_at_k"))


@register("w13_suffix_sum_bins", sql(PRED_B, body="""
SELECT entry, bin, round(w, 6) AS w, round(coalesce(sum(w) OVER (PARTITION BY entry ORDER BY bin DESC
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS above
FROM (SELECT entry, CAST(floor(prob * 1000) AS INTEGER) AS bin, sum(prob) AS w FROM pred_b GROUP BY 1, 2)"""))
def w13_suffix_sum_bins(s, d):
    b = (fx.predictions_b(s, d).groupBy("entry", fn.score_bin("prob").alias("bin"))
         .agg(F.sum("prob").alias("w")))
    out = rk.suffix_sum(b, "entry", "bin", "w", "above")
    return out.select("entry", "bin", r6("w").alias("w"), r6("above").alias("above"))


# ------------------------------------------------------------- more aggregates

@register("a15_term_priors", sql(EDGE, CLOSURE, RCLOSURE, TERMS, ANNOT, body="""
, pos AS (SELECT DISTINCT a.entry, r.ancestor AS term FROM annot a JOIN rclosure r ON a.term = r.child),
roots AS (SELECT p_partkey AS term FROM part WHERE p_partkey NOT IN (SELECT child FROM edge)),
cand AS (SELECT p.entry, e.child AS term FROM pos p JOIN edge e ON e.parent = p.term
         UNION SELECT a.entry, r.term FROM (SELECT DISTINCT entry FROM annot) a, roots r),
lab AS (SELECT c.entry, c.term, t.namespace, CASE WHEN p.term IS NULL THEN 0 ELSE 1 END AS label
        FROM cand c LEFT JOIN pos p ON p.entry = c.entry AND p.term = c.term JOIN terms t ON t.term = c.term),
n AS (SELECT count(DISTINCT entry) AS n FROM annot),
g AS (SELECT term, namespace, sum(label) AS pos, count(*) AS nn FROM lab GROUP BY term, namespace)
SELECT term, namespace, round(CASE WHEN nn > 0 THEN pos / nn ELSE 0 END, 6) AS prior,
       round(1 - nn / (SELECT n FROM n), 6) AS null_rate,
       round(CASE WHEN nn > 0 THEN pos / nn ELSE 0 END * (nn / (SELECT n FROM n)), 6) AS prior_raw FROM g"""
   .replace("\n, pos AS", ",\npos AS", 1)))
def a15_term_priors(s, d):
    dims = Dims.of(s, d)
    ann = fx.annotations(s, d)
    pos = onto.propagate_labels(ann, dims.closure, dims.terms)
    lab = onto.ternary_labels(pos, ann, dims.edges, dims.terms, onto.roots(dims.terms, dims.edges))
    out = ag.priors(lab, ann)
    return out.select("term", "namespace", *[r6(c).alias(c) for c in ("prior", "null_rate", "prior_raw")])


@register("a27_masked_bce", sql(EDGE, CLOSURE, RCLOSURE, TERMS, ANNOT, PRED_B, body="""
, pos AS (SELECT DISTINCT a.entry, r.ancestor AS term FROM annot a JOIN rclosure r ON a.term = r.child),
roots AS (SELECT p_partkey AS term FROM part WHERE p_partkey NOT IN (SELECT child FROM edge)),
cand AS (SELECT p.entry, e.child AS term FROM pos p JOIN edge e ON e.parent = p.term
         UNION SELECT a.entry, r.term FROM (SELECT DISTINCT entry FROM annot) a, roots r),
lab AS (SELECT c.entry, c.term, CASE WHEN p.term IS NULL THEN 0 ELSE 1 END AS y
        FROM cand c LEFT JOIN pos p ON p.entry = c.entry AND p.term = c.term),
x AS (SELECT l.y, least(greatest(coalesce(b.prob, 0), 1e-7), 1 - 1e-7) AS p
      FROM lab l LEFT JOIN pred_b b ON b.entry = l.entry AND b.term = l.term)
SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS bce, count(*) AS cells,
       round(avg(y), 6) AS base_rate, round(ln(avg(y) / (1 - avg(y))), 6) AS base_logit FROM x"""
   .replace("\n, pos AS", ",\npos AS", 1)))
def a27_masked_bce(s, d):
    dims = Dims.of(s, d)
    ann = fx.annotations(s, d)
    pos = onto.propagate_labels(ann, dims.closure, dims.terms)
    lab = onto.ternary_labels(pos, ann, dims.edges, dims.terms, onto.roots(dims.terms, dims.edges), fx.predictions_b(s, d))
    x = lab.select(F.col("label").alias("y"), F.coalesce("prob", F.lit(0.0)).alias("prob"))
    out = ag.masked_bce(x, y="y", p="prob")
    return out.select(r6("bce").alias("bce"), "cells", r6("base_rate").alias("base_rate"),
                      r6("base_logit").alias("base_logit"))


@register("a16_fold_merge", sql(PRED_A, body="""
, f AS (SELECT entry, term, prob, (entry * 48271 + 7) % 2147483647 % 3 AS fold FROM pred_a)
SELECT entry, term, round(sum(prob), 6) AS oof, round(sum(prob * 0.5) / 3, 6) AS test FROM f GROUP BY entry, term"""
   .replace("\n, f AS", ",\nf AS", 1)))
def a16_fold_merge(s, d):
    from ..operators import features as fe
    from ..operators import pairs as pr
    a = write_table(fx.predictions_a(s, d).withColumn("fold", F.pmod(fe.int_hash("entry", 7), F.lit(3))))
    parts = parts_of(s, a.count())
    oof_parts = [a.where(F.col("fold") == k) for k in range(3)]
    test_parts = [a.withColumn("prob", F.col("prob") * 0.5).where(F.col("fold") == k) for k in range(3)]
    oof = pr.fold_merge(oof_parts, "oof", parts=parts).withColumnRenamed("prob", "oof")
    test = pr.fold_merge(test_parts, "test", parts=parts).withColumnRenamed("prob", "test")
    return oof.join(test, ["entry", "term"]).select("entry", "term", r6("oof").alias("oof"), r6("test").alias("test"))


@register("w2_w16_top_k_then_tau", sql(PRED_B, body="""
SELECT entry, term, round(prob, 6) AS prob, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY entry ORDER BY prob DESC, term) AS rank FROM pred_b)
WHERE rank <= 3 AND prob > 0.3"""))
def w2_w16_top_k_then_tau(s, d):
    out = rk.top_k(fx.predictions_b(s, d), "entry", "prob", 3, tie="term").where(F.col("prob") > 0.3)
    return out.select("entry", "term", r6("prob").alias("prob"), F.col("rank").cast("bigint").alias("rank"))


@register("w3_aspect_quota_top_k", sql(PRED_B, body="""
, r AS (SELECT entry, term, term % 3 AS aspect, prob,
        row_number() OVER (PARTITION BY entry, term % 3 ORDER BY prob DESC, term) AS rn FROM pred_b),
q AS (SELECT * FROM r WHERE rn <= CASE aspect WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 3 END)
SELECT entry, term, aspect, round(prob, 6) AS prob,
       row_number() OVER (PARTITION BY entry ORDER BY prob DESC, term) AS rank FROM q""".replace("\n, r AS", ",\nr AS", 1)))
def w3_aspect_quota_top_k(s, d):
    p = fx.predictions_b(s, d).withColumn("aspect", F.col("term") % 3)
    out = rk.ranked_quota(p, "entry", "aspect", "prob", {0: 2, 1: 1}, default_k=3, tie="term")
    return out.select("entry", "term", "aspect", r6("prob").alias("prob"), F.col("rank").cast("bigint").alias("rank"))


@register("l8_seeded_sample", sql(ANNOT, body=f"SELECT * FROM annot ORDER BY {key_hash_sql('entry', 'term')}, entry, term LIMIT 100"))
def l8_seeded_sample(s, d):
    return rk.seeded_sample(fx.annotations(s, d), ["entry", "term"], 100)


@register("l9_hash_fraction_sample", sql(ANNOT, body=f"SELECT * FROM annot WHERE {key_hash_sql('entry', 'term')} % 1000000 < 100000"))
def l9_hash_fraction_sample(s, d):
    return rk.hash_fraction(fx.annotations(s, d), ["entry", "term"], 0.1)


@register("f_numeric_functions", sql(HITS, body="""
SELECT query, target, CAST(floor(identity * 1000) AS INTEGER) AS bin,
       round(CASE WHEN evalue > 0 THEN log10(evalue) ELSE -300 END, 6) AS log_evalue,
       round(1 / (1 + exp(-(bits / 10000.0) / 2.0)), 6) AS sig,
       round(ln(least(greatest(identity * 10, 1e-6), 1 - 1e-6) / (1 - least(greatest(identity * 10, 1e-6), 1 - 1e-6))), 6) AS lgt,
       round(CASE WHEN identity + alnlen / 50.0 > 0 THEN 2 * identity * (alnlen / 50.0) / (identity + alnlen / 50.0) ELSE 0 END, 6) AS f,
       round(sqrt(identity * identity + (alnlen / 50.0) * (alnlen / 50.0)), 6) AS s
FROM hits"""))
def f_numeric_functions(s, d):
    h = fx.hits(s, d)
    rc = F.col("alnlen") / 50.0
    return h.select("query", "target", fn.score_bin("identity").alias("bin"),
                    r6(fn.log10_floor("evalue")).alias("log_evalue"),
                    r6(fn.sigmoid(F.col("bits") / 10000.0, 2.0)).alias("sig"),
                    r6(fn.logit(F.col("identity") * 10)).alias("lgt"),
                    r6(fn.safe_f(F.col("identity"), rc)).alias("f"),
                    r6(fn.s_distance(F.col("identity"), rc)).alias("s"))
