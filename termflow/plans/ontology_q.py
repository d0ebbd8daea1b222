"""Catalogued ontology queries (G*)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import ontology as onto
from ..operators import ranking as rk
from ..session import PAIR_BYTES, TERMS_MAX_BYTES, broadcast_if_small
from ..sources import fixtures as fx
from .common import (ANNOT, CLOSURE, EDGE, NEG, PRED_A, PRED_B, PRED_RAW, RCLOSURE, TERMS, Dims, register, sql)
from .common import r6_double as r6


# G6 -- closure summarised per term: number of ancestors and of descendants
@register("g6_closure_counts", sql(EDGE, CLOSURE, body="""
SELECT term, CAST(sum(is_anc) AS BIGINT) AS n_ancestors, CAST(sum(is_desc) AS BIGINT) AS n_descendants
FROM (SELECT child AS term, 1 AS is_anc, 0 AS is_desc FROM closure
      UNION ALL SELECT ancestor AS term, 0, 1 FROM closure) GROUP BY term"""))
def g6_closure_counts(spark, d):
    c = Dims.of(spark, d).closure.df
    ends = F.array(F.struct(F.col("child").alias("term"), F.lit(1).alias("a"), F.lit(0).alias("b")),
                   F.struct(F.col("ancestor").alias("term"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    return (c.select(F.explode(ends).alias("e")).select("e.*").groupBy("term")  # the closure is made once
            .agg(F.sum("a").cast("bigint").alias("n_ancestors"), F.sum("b").cast("bigint").alias("n_descendants")))


# G6 -- the closure itself
@register("g6_closure", sql(EDGE, CLOSURE, body="SELECT child, ancestor FROM closure"))
def g6_closure(spark, d):
    return Dims.of(spark, d).closure.df


# G8 -- max propagation of model-A scores up the DAG
@register("g8_max_propagation", sql(EDGE, CLOSURE, RCLOSURE, PRED_A, body="""
SELECT p.entry, r.ancestor AS term, round(max(least(greatest(p.prob, 0), 1)), 6) AS prob
FROM pred_a p JOIN rclosure r ON p.term = r.child
GROUP BY p.entry, r.ancestor HAVING max(least(greatest(p.prob, 0), 1)) <> 0"""))
def g8_max_propagation(spark, d):
    dims = Dims.of(spark, d)
    out = onto.propagate_max(fx.predictions_a(spark, d), dims.closure, dims.terms)
    return out.select("entry", "term", r6("prob").alias("prob"))


# G8 + W1 -- the flagship: propagate, then keep dense rank < 500 per (entry, namespace)
@register("g8_w1_propagated_top500", sql(EDGE, CLOSURE, RCLOSURE, TERMS, PRED_B, body="""
SELECT entry, term, namespace, prob, CAST(rnk - 1 AS BIGINT) AS rank FROM (
  SELECT v.*, t.namespace, dense_rank() OVER (PARTITION BY v.entry, t.namespace ORDER BY v.prob DESC) AS rnk
  FROM (SELECT p.entry, r.ancestor AS term, round(max(least(greatest(p.prob, 0), 1)), 6) AS prob
        FROM pred_b p JOIN rclosure r ON p.term = r.child GROUP BY p.entry, r.ancestor) v
  JOIN terms t ON v.term = t.term) WHERE rnk <= 500"""))
def g8_w1_propagated_top500(spark, d):
    dims = Dims.of(spark, d)
    v = onto.propagate_max(_dealt(spark, d), dims.closure, dims.terms, name="namespace", shown=r6)
    n = dims.terms.count()
    # propagated inside entries and named there or by broadcast: an entry's cells still lie together
    together = "entry" if dims.closure.up is not None and n * PAIR_BYTES <= TERMS_MAX_BYTES else None
    return rk.dense_rank_cut(v, ["entry", "namespace"], "prob", 500, together=together).select(
        "entry", "term", "namespace", "prob", F.col("rank").cast("bigint").alias("rank"))


# ------------------------------------------------------------- levels, roots

ROOTS = "roots AS (SELECT p_partkey AS term FROM part WHERE p_partkey NOT IN (SELECT child FROM edge))"
LEAVES = "leaves AS (SELECT p_partkey AS term FROM part WHERE p_partkey NOT IN (SELECT parent FROM edge))"
DEPTH = """depth(term, d) AS (
  SELECT term, 0 FROM roots
  UNION
  SELECT e.child, x.d + 1 FROM depth x JOIN edge e ON e.parent = x.term),
lvl_down AS MATERIALIZED (SELECT term, max(d) AS level FROM depth GROUP BY term)"""
HEIGHT = """height(term, d) AS (
  SELECT term, 0 FROM leaves
  UNION
  SELECT e.parent, x.d + 1 FROM height x JOIN edge e ON e.child = x.term),
lvl_up AS MATERIALIZED (SELECT term, max(d) AS level FROM height GROUP BY term)"""
MAX_SQL_LEVELS = 20  # the fixture DAG is 10 levels deep at sf0.01, 13 at sf0.1


@register("g3_levels", sql(EDGE, ROOTS, LEAVES, DEPTH, HEIGHT, body="""
SELECT d.term, CAST(d.level AS INTEGER) AS depth, CAST(u.level AS INTEGER) AS height
FROM lvl_down d JOIN lvl_up u ON d.term = u.term"""))
def g3_levels(spark, d):
    dims = Dims.of(spark, d)
    down, _ = dims.levels("down")
    up, _ = dims.levels("up")
    return (down.select("term", F.col("level").cast("int").alias("depth"))
            .join(up.select("term", F.col("level").cast("int").alias("height")), "term"))


@register("g5_roots_leaves", sql(EDGE, ROOTS, LEAVES, body="""
SELECT term, 'root' AS kind FROM roots UNION ALL SELECT term, 'leaf' AS kind FROM leaves"""))
def g5_roots_leaves(spark, d):
    dims = Dims.of(spark, d)
    return (onto.roots(dims.terms, dims.edges).withColumn("kind", F.lit("root"))
            .unionByName(onto.leaves(dims.terms, dims.edges).withColumn("kind", F.lit("leaf"))))


@register("g1_restricted_edges", sql(EDGE, TERMS, body="""
SELECT e.child, e.parent FROM edge e JOIN terms c ON e.child = c.term JOIN terms p ON e.parent = p.term
WHERE c.namespace = p.namespace"""))
def g1_restricted_edges(spark, d):
    dims = Dims.of(spark, d)
    return onto.restrict_edges(dims.edges, dims.terms)


@register("g23_edge_list_all_self", sql(EDGE, body="""
SELECT child AS src, parent AS dst FROM edge UNION ALL SELECT parent, child FROM edge
UNION ALL SELECT p_partkey, p_partkey FROM part"""))
def g23_edge_list_all_self(spark, d):
    dims = Dims.of(spark, d)
    return onto.edge_list(dims.edges, "all", self_loops=True, terms=dims.terms)


# ------------------------------------------------------------ closure form

@register("g7_label_propagation", sql(EDGE, CLOSURE, RCLOSURE, TERMS, ANNOT, body="""
SELECT DISTINCT a.entry, r.ancestor AS term, t.namespace AS aspect
FROM annot a JOIN rclosure r ON a.term = r.child JOIN terms t ON t.term = r.ancestor"""))
def g7_label_propagation(spark, d):
    dims = Dims.of(spark, d)
    return onto.propagate_labels(fx.annotations(spark, d), dims.closure, dims.terms)


G9_SQL_CORE = """s AS (SELECT entry, term, least(greatest(prob, 0), 1) AS prob FROM pred_b),
nanc AS (SELECT child AS term, count(*) AS n FROM closure GROUP BY child),
anc AS (SELECT s.entry, s.term, count(*) AS m, min(a.prob) AS minv
        FROM s JOIN closure c ON s.term = c.child JOIN s a ON a.entry = s.entry AND a.term = c.ancestor
        GROUP BY s.entry, s.term),
vmin AS (SELECT s.entry, s.term, s.prob AS sv,
         CASE WHEN coalesce(n.n, 0) = coalesce(anc.m, 0) THEN least(s.prob, coalesce(anc.minv, s.prob)) ELSE 0 END AS v
         FROM s LEFT JOIN anc ON anc.entry = s.entry AND anc.term = s.term LEFT JOIN nanc n ON n.term = s.term)"""


@register("g9_min_propagation", sql(EDGE, CLOSURE, PRED_B, G9_SQL_CORE, body="""
SELECT entry, term, round(v, 6) AS prob FROM vmin WHERE v <> 0"""))
def g9_min_propagation(spark, d):
    dims = Dims.of(spark, d)
    out = onto.propagate_min(fx.predictions_b(spark, d), dims.closure, dims.terms)
    return out.where(F.col("prob") != 0).select("entry", "term", r6("prob").alias("prob"))


@register("g10_min_step_blend", sql(EDGE, CLOSURE, TERMS, PRED_B, G9_SQL_CORE, body="""
SELECT v.entry, v.term, round(0.7 * v.v + 0.3 * v.sv, 6) AS prob, t.namespace AS aspect
FROM vmin v JOIN terms t ON v.term = t.term WHERE 0.7 * v.v + 0.3 * v.sv <> 0"""))
def g10_min_step_blend(spark, d):
    dims = Dims.of(spark, d)
    out = onto.propagate_step(fx.predictions_b(spark, d), dims.closure, dims.terms, direction="min", lr=0.7)
    return out.select("entry", "term", r6("prob").alias("prob"), "aspect")


@register("g10_max_step_blend", sql(EDGE, CLOSURE, RCLOSURE, TERMS, PRED_A, body="""
SELECT coalesce(v.entry, s.entry) AS entry, coalesce(v.term, s.term) AS term,
       round(0.1 * coalesce(v.prob, 0) + 0.9 * coalesce(s.prob, 0), 6) AS prob, t.namespace AS aspect
FROM (SELECT p.entry, r.ancestor AS term, max(least(greatest(p.prob, 0), 1)) AS prob
      FROM pred_a p JOIN rclosure r ON p.term = r.child GROUP BY 1, 2) v
FULL JOIN (SELECT entry, term, least(greatest(prob, 0), 1) AS prob FROM pred_a) s
  ON v.entry = s.entry AND v.term = s.term
JOIN terms t ON t.term = coalesce(v.term, s.term)
WHERE 0.1 * coalesce(v.prob, 0) + 0.9 * coalesce(s.prob, 0) <> 0"""))
def g10_max_step_blend(spark, d):
    dims = Dims.of(spark, d)
    out = onto.propagate_step(fx.predictions_a(spark, d), dims.closure, dims.terms, direction="max", lr=0.1)
    return out.select("entry", "term", r6("prob").alias("prob"), "aspect")


@register("g17_parent_ge_child_two_hops", sql(EDGE, PRED_RAW, body="""
SELECT entry, term, round(max(prob), 6) AS prob FROM (
  SELECT entry, term, prob FROM pred_raw
  UNION ALL SELECT p.entry, e.parent, p.prob FROM pred_raw p JOIN edge e ON p.term = e.child
  UNION ALL SELECT p.entry, e2.parent, p.prob FROM pred_raw p JOIN edge e1 ON p.term = e1.child
            JOIN edge e2 ON e1.parent = e2.child) GROUP BY entry, term"""))
def g17_parent_ge_child_two_hops(spark, d):
    dims = Dims.of(spark, d)
    raw = fx.predictions_raw(spark, d).groupBy("entry", "term").agg(F.max("prob").alias("prob"))
    out = onto.enforce_parent_ge_child(raw, dims.edges, None, dims.terms, max_hops=2)
    return out.select("entry", "term", r6("prob").alias("prob"))


@register("g18_parent_ge_child_fixed_point", sql(EDGE, CLOSURE, RCLOSURE, PRED_RAW, body="""
SELECT p.entry, r.ancestor AS term, round(max(p.prob), 6) AS prob
FROM pred_raw p JOIN rclosure r ON p.term = r.child GROUP BY p.entry, r.ancestor HAVING max(p.prob) <> 0"""))
def g18_parent_ge_child_fixed_point(spark, d):
    dims = Dims.of(spark, d)
    raw = fx.predictions_raw(spark, d).groupBy("entry", "term").agg(F.max("prob").alias("prob"))
    out = onto.enforce_parent_ge_child(raw, dims.edges, dims.closure, dims.terms)
    return out.select("entry", "term", r6("prob").alias("prob"))


@register("g20_negative_propagation", sql(EDGE, CLOSURE, RCLOSURE, PRED_A, NEG, body="""
SELECT p.entry, p.term, round(p.prob, 6) AS prob FROM pred_a p
WHERE NOT EXISTS (SELECT 1 FROM neg n JOIN rclosure r ON r.ancestor = n.term
                  WHERE n.entry = p.entry AND r.child = p.term)"""))
def g20_negative_propagation(spark, d):
    dims = Dims.of(spark, d)
    out = onto.negative_propagation(fx.predictions_a(spark, d), fx.negatives(spark, d), dims.closure, dims.terms)
    return out.select("entry", "term", r6("prob").alias("prob"))


@register("g21_ternary_labels", sql(EDGE, CLOSURE, RCLOSURE, TERMS, ANNOT, ROOTS, body="""
, pos AS (SELECT DISTINCT a.entry, r.ancestor AS term FROM annot a JOIN rclosure r ON a.term = r.child),
cand AS (SELECT p.entry, e.child AS term FROM pos p JOIN edge e ON e.parent = p.term
         UNION SELECT a.entry, r.term FROM (SELECT DISTINCT entry FROM annot) a, roots r)
SELECT c.entry, c.term, t.namespace, CAST(CASE WHEN p.term IS NULL THEN 0 ELSE 1 END AS INTEGER) AS label
FROM cand c LEFT JOIN pos p ON p.entry = c.entry AND p.term = c.term JOIN terms t ON t.term = c.term"""
   .replace("\n, pos AS", ",\npos AS", 1)))
def g21_ternary_labels(spark, d):
    dims = Dims.of(spark, d)
    ann = fx.annotations(spark, d)
    pos = onto.propagate_labels(ann, dims.closure, dims.terms)
    out = onto.ternary_labels(pos, ann, dims.edges, dims.terms, onto.roots(dims.terms, dims.edges))
    return out.select("entry", "term", "namespace", F.col("label").cast("int").alias("label"))


@register("g24_neighbour_mean_max", sql(EDGE, PRED_B, body="""
SELECT p.entry, e.parent AS term, round(avg(p.prob), 6) AS mean_1, round(max(p.prob), 6) AS max_1
FROM pred_b p JOIN edge e ON e.child = p.term GROUP BY p.entry, e.parent"""))
def g24_neighbour_mean_max(spark, d):
    dims = Dims.of(spark, d)
    out = onto.neighbour_aggregate(fx.predictions_b(spark, d), dims.edges, "bwd")
    return out.select("entry", "term", r6("mean_1").alias("mean_1"), r6("max_1").alias("max_1"))


# --------------------------------------------------------------- level form

PROP_B = """prop_b AS MATERIALIZED (
  SELECT p.entry, r.ancestor AS term, max(least(greatest(p.prob, 0), 1)) AS prob
  FROM pred_b p JOIN rclosure r ON p.term = r.child GROUP BY p.entry, r.ancestor)"""


def _unrolled(kind: str, source: str, lvl_name: str) -> str:
    """Per-level SQL for the level-form operators, unrolled MAX_SQL_LEVELS deep."""
    parts = [f"""cells AS MATERIALIZED (SELECT s.entry, s.term, least(greatest(s.prob, 0), 1) AS prob, l.level
  FROM {source} s JOIN {lvl_name} l ON s.term = l.term)""",
             "v0 AS MATERIALIZED (SELECT entry, term, prob FROM cells WHERE level = 0)",
             "npar AS (SELECT child, count(*) AS np FROM edge GROUP BY child)"]
    for k in range(1, MAX_SQL_LEVELS + 1):
        prev = f"v{k - 1}"
        if kind == "fill":
            step = f"""n{k} AS MATERIALIZED (
  SELECT coalesce(c.entry, f.entry) AS entry, coalesce(c.term, f.term) AS term,
         CASE WHEN coalesce(c.prob, 0) <> 0 THEN c.prob ELSE f.fill END AS prob
  FROM (SELECT * FROM cells WHERE level = {k}) c
  FULL JOIN (SELECT v.entry, e.parent AS term, max(v.prob) AS fill FROM {prev} v
             JOIN edge e ON e.child = v.term JOIN {lvl_name} l ON l.term = e.parent AND l.level = {k}
             GROUP BY v.entry, e.parent) f ON c.entry = f.entry AND c.term = f.term)"""
        elif kind == "any":
            step = f"""n{k} AS MATERIALIZED (
  SELECT c.entry, c.term, c.prob * (1 - product(1 - coalesce(v.prob, 0))) AS prob
  FROM cells c JOIN edge e ON e.child = c.term LEFT JOIN {prev} v ON v.entry = c.entry AND v.term = e.parent
  WHERE c.level = {k} GROUP BY c.entry, c.term, c.prob)"""
        elif kind == "all":
            step = f"""n{k} AS MATERIALIZED (
  SELECT c.entry, c.term,
         CASE WHEN count(v.prob) = max(n.np) THEN c.prob * product(coalesce(v.prob, 0)) ELSE 0 END AS prob
  FROM cells c JOIN edge e ON e.child = c.term JOIN npar n ON n.child = c.term
  LEFT JOIN {prev} v ON v.entry = c.entry AND v.term = e.parent
  WHERE c.level = {k} GROUP BY c.entry, c.term, c.prob)"""
        elif kind == "suppress":
            step = f"""n{k} AS MATERIALIZED (
  SELECT c.entry, c.term,
         CASE WHEN max(coalesce(v.prob, 0)) < 0.5 THEN c.prob * max(coalesce(v.prob, 0)) ELSE c.prob END AS prob
  FROM cells c JOIN edge e ON e.child = c.term LEFT JOIN {prev} v ON v.entry = c.entry AND v.term = e.parent
  WHERE c.level = {k} GROUP BY c.entry, c.term, c.prob)"""
        else:
            raise ValueError(kind)
        parts.append(step)
        parts.append(f"v{k} AS MATERIALIZED (SELECT * FROM {prev} UNION ALL "
                     f"SELECT entry, term, prob FROM n{k} WHERE prob <> 0)")
    return ",\n".join(parts)


def _level_sql(kind, direction, propagated=False):
    lv = "lvl_down" if direction == "down" else "lvl_up"
    lvl_cte = (ROOTS + ",\n" + DEPTH) if direction == "down" else (LEAVES + ",\n" + HEIGHT)
    src = [CLOSURE, RCLOSURE, PROP_B] if propagated else []
    return sql(EDGE, PRED_B, *src, lvl_cte, _unrolled(kind, "prop_b" if propagated else "pred_b", lv),
               body=f"SELECT entry, term, round(prob, 6) AS prob FROM v{MAX_SQL_LEVELS} WHERE prob <> 0")


def _dealt(spark, d):
    """Scores dealt once by entry, in partitions that adaptive execution does not join (cells grow many times after it measures them):
    all that follows stays inside an entry and needs no further exchange."""
    return fx.predictions_b(spark, d)


@register("g11_fill_propagation", _level_sql("fill", "up"))
def g11_fill_propagation(spark, d):
    dims = Dims.of(spark, d)
    out = onto.propagate_fill(_dealt(spark, d), dims.edges, dims.terms, levels=dims.levels("up"))
    return out.select("entry", "term", r6("prob").alias("prob"))


@register("g15_conditional_any_parent", _level_sql("any", "down", propagated=True))
def g15_conditional_any_parent(spark, d):
    dims = Dims.of(spark, d)
    s = onto.propagate_max(_dealt(spark, d), dims.closure, dims.terms)
    out = onto.conditional_to_marginal(s, dims.edges, dims.terms, "any", levels=dims.levels("down"))
    return out.select("entry", "term", r6("prob").alias("prob"))


@register("g16_conditional_all_parents", _level_sql("all", "down", propagated=True))
def g16_conditional_all_parents(spark, d):
    dims = Dims.of(spark, d)
    s = onto.propagate_max(_dealt(spark, d), dims.closure, dims.terms)
    out = onto.conditional_to_marginal(s, dims.edges, dims.terms, "all", levels=dims.levels("down"))
    return out.select("entry", "term", r6("prob").alias("prob"))


def _chain(mode: str, kept: bool, name: str) -> str:
    """The unrolled CTEs of a mode under names of their own; with ``kept`` even terms keep their value."""
    text = _unrolled(mode, "prop_b", "lvl_down")
    if kept:
        old = {"any": "c.prob * (1 - product(1 - coalesce(v.prob, 0)))", "all": "CASE WHEN count(v.prob) = max(n.np) THEN c.prob * product(coalesce(v.prob, 0)) ELSE 0 END"}[mode]
        text = text.replace(old, f"CASE WHEN c.term % 2 = 0 THEN c.prob ELSE {old} END")
    return re.sub(r"\b(cells|npar|[vn]\d+)\b", rf"{name}_\1", text)


def _both_sql() -> str:
    one = "SELECT coalesce(x.entry, y.entry) AS entry, coalesce(x.term, y.term) AS term, '{m}' AS model, round(coalesce(x.prob, 0) + 1e-9, 6) AS \"any\", round(coalesce(y.prob, 0) + 1e-9, 6) AS \"all\" FROM (SELECT * FROM {m}any_v{k} WHERE prob <> 0) x FULL JOIN (SELECT * FROM {m}all_v{k} WHERE prob <> 0) y ON x.entry = y.entry AND x.term = y.term"
    chains = [_chain(mode, m == "raw", m + mode) for m in ("cond", "raw") for mode in ("any", "all")]
    return sql(EDGE, PRED_B, CLOSURE, RCLOSURE, PROP_B, ROOTS, DEPTH, *chains, body=" UNION ALL ".join(one.format(m=m, k=MAX_SQL_LEVELS) for m in ("cond", "raw")))


@register("g16_both_marginals", _both_sql())
def g16_both_marginals(spark, d):
    dims = Dims.of(spark, d)
    s = onto.propagate_max(_dealt(spark, d), dims.closure, dims.terms)
    kept = dims.terms.where("term % 2 = 0").select(F.lit("raw").alias("model"), "term")
    out = onto.conditional_both(s, dims.edges, dims.terms, kept, levels=dims.levels("down"), models=("cond", "raw"))
    return out.select("entry", "term", "model", r6(F.col("any") + 1e-9).alias("any"), r6(F.col("all") + 1e-9).alias("all"))  # off exact halves


@register("g19_suppress_children", _level_sql("suppress", "down", propagated=True))
def g19_suppress_children(spark, d):
    dims = Dims.of(spark, d)
    s = onto.propagate_max(_dealt(spark, d), dims.closure, dims.terms)
    out = onto.suppress_children(s, dims.edges, dims.terms, threshold=0.5, levels=dims.levels("down"))
    return out.select("entry", "term", r6("prob").alias("prob"))


@register("g4_terms_of_interest", sql(TERMS, body="SELECT term, namespace FROM terms WHERE ia > 0"))
def g4_terms_of_interest(spark, d):
    return fx.terms(spark, d).where(F.col("ia") > 0).select("term", "namespace")


@register("g22_namespace_mapping", sql(TERMS, body="""
, p AS (SELECT l_orderkey AS entry, l_partkey + l_linenumber * 10 AS term FROM lineitem)
SELECT coalesce(CAST(t.namespace AS VARCHAR), 'unmapped') AS namespace, count(*) AS rows
FROM p LEFT JOIN terms t ON p.term = t.term GROUP BY 1""".replace("\n, p AS", ",\np AS", 1)))
def g22_namespace_mapping(spark, d):
    li = fx.table(spark, d, "lineitem")
    p = li.select(F.col("l_orderkey").alias("entry"), (F.col("l_partkey") + F.col("l_linenumber") * 10).alias("term"))
    t = broadcast_if_small(fx.terms(spark, d).select("term", "namespace"))
    return (p.join(t, "term", "left")
            .groupBy(F.coalesce(F.col("namespace").cast("string"), F.lit("unmapped")).alias("namespace"))
            .agg(F.count("*").alias("rows")))
