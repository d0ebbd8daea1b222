"""Slices, selections and small readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import aggregates as ag
from ..operators import features as fe
from ..operators import ontology as onto
from ..operators import ranking as rk
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as fx
from ..sources import formats as fm
from .common import ANNOT, EDGE, HITS, PRED_A, PRED_B, PRED_RAW, TAXONOMY, TERMS, Dims, key_hash_sql, r6, register, sql


def _folder(s) -> str:
    return f"{ensure_checkpoint_dir(s).rstrip('/')}/tables/files-{uuid.uuid4().hex}"


@register("s14_matrix_slice", sql(ANNOT, body="""
, r AS (SELECT entry, row_number() OVER (ORDER BY entry) - 1 AS row FROM (SELECT DISTINCT entry FROM annot)),
c AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS col FROM (SELECT DISTINCT term FROM annot))
SELECT row, col FROM annot JOIN r USING (entry) JOIN c USING (term) WHERE row < 2000 AND col < 300""".replace("\n, r AS", ",\nr AS", 1)))
def s14_matrix_slice(s, d):
    """The first rows and columns of the sparse target matrix."""
    a = fx.annotations(s, d).select("entry", "term")
    rows, cols = fe.dense_ids(a, "entry", "row").where("row < 2000"), fe.dense_ids(a, "term", "col").where("col < 300")
    return a.join(rows, "entry").join(cols, "term").select("row", "col")


@register("s19_truth_reader", sql(body="""
WITH o AS (SELECT p_partkey % 3 AS place, CAST(p_partkey % 3 AS VARCHAR) AS namespace, 'T' || CAST(p_partkey AS VARCHAR) AS id, 'T' || CAST(p_partkey AS VARCHAR) AS term FROM part
  UNION ALL SELECT p_partkey % 3, CAST(p_partkey % 3 AS VARCHAR), 'A' || CAST(p_partkey // 2 AS VARCHAR), 'T' || CAST(p_partkey AS VARCHAR) FROM part),
own AS (SELECT id, namespace, term FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY place, term) = 1),
g AS (SELECT CAST(l_orderkey AS VARCHAR) AS entry, CASE WHEN l_linenumber % 3 = 0 THEN 'A' WHEN l_linenumber % 7 = 0 THEN 'X' ELSE 'T' END || CAST(l_partkey AS VARCHAR) AS id FROM lineitem WHERE l_returnflag = 'R')
SELECT DISTINCT entry, namespace, term FROM g JOIN own USING (id)"""))
def s19_truth_reader(s, d):
    """A truth file with terms, alternative ids (one of which two terms share) and unknown ids."""
    path, part = _folder(s), fx.table(s, d, "part")
    li = fx.table(s, d, "lineitem").where("l_returnflag = 'R'")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "A").when(F.col("l_linenumber") % 7 == 0, "X").otherwise("T")
    li.select(F.concat(F.col("l_orderkey").cast("string"), F.lit("\t"), kind, F.col("l_partkey").cast("string"), F.lit("  more")).alias("value")).write.text(path)
    t = part.select((F.col("p_partkey") % 3).alias("ns"), F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("term"),
                    F.concat(F.lit("A"), F.expr("p_partkey div 2").cast("string")).alias("alt"))
    ids = t.select(F.struct("ns", "term").alias("place"), F.col("ns").cast("string").alias("namespace"), F.explode(F.array("term", "alt")).alias("term_id"), "term")
    return fm.read_truth(s, path, ids)


@register("s21_alias_lines", sql(body="SELECT 's' || CAST(s_suppkey AS VARCHAR) AS id, 'n' || CAST(s_nationkey AS VARCHAR) AS alias FROM supplier WHERE s_suppkey % 3 = 1"))
def s21_alias_lines(s, d):
    path = _folder(s)
    tag = F.when(F.col("s_suppkey") % 3 == 1, "UniProt_AC").otherwise("Other")
    (fx.table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("a"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("b"), tag.alias("c"))
     .write.option("sep", "\t").option("compression", "gzip").csv(path))
    return fm.read_alias_lines(s, path, "UniProt_AC")


@register("s9c_aspect_codes", sql(body="""
SELECT p_partkey AS term, CASE p_partkey % 5 WHEN 0 THEN 'BPO' WHEN 1 THEN 'MFO' WHEN 2 THEN 'CCO' WHEN 3 THEN 'BPO' ELSE 'UNKNOWN' END AS code FROM part"""))
def s9c_aspect_codes(s, d):
    name = F.element_at(F.array(*[F.lit(x) for x in ("biological_process", "molecular_function", "cellular_component", "P", "external")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return fx.table(s, d, "part").select(F.col("p_partkey").alias("term"), fn.aspect_code(name, "UNKNOWN").alias("code"))


@register("p3_positional_header", "SELECT s_suppkey AS EntryID, s_name AS term, s_nationkey AS col_2, s_acctbal AS col_3 FROM supplier")
def p3_positional_header(s, d):
    return fm.positional_names(fx.table(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), ["EntryID", "term"])


@register("p5_aspect_filter", sql(ANNOT, body="""
SELECT 'ALL' AS asked, aspect, count(*) AS n FROM annot GROUP BY aspect UNION ALL SELECT '1', aspect, count(*) FROM annot WHERE aspect = 1 GROUP BY aspect"""))
def p5_aspect_filter(s, d):
    a = fx.annotations(s, d)
    parts = [onto.aspect_filter(a, x).groupBy("aspect").agg(F.count(F.lit(1)).alias("n")).select(F.lit(str(x)).alias("asked"), "aspect", "n") for x in ("ALL", 1)]
    return parts[0].unionByName(parts[1])


@register("l1_sorted_places", sql(PRED_A, body="SELECT entry, term, round(prob, 6) AS prob, row_number() OVER (ORDER BY entry, prob DESC, term) - 1 AS place FROM pred_a"))
def l1_sorted_places(s, d):
    return rk.sorted_places(fx.predictions_a(s, d), ["entry", "-prob", "term"]).select("entry", "term", r6("prob").alias("prob"), "place")


@register("l9_allow_list", sql(PRED_A, body="SELECT entry, term, round(prob, 6) AS prob FROM pred_a WHERE entry IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"))
def l9_allow_list(s, d):
    allowed = fx.table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("entry"))
    return rk.allow_list(fx.predictions_a(s, d), allowed, ["entry"]).select("entry", "term", r6("prob").alias("prob"))


@register("f21_label_list_differences", sql(PRED_A, PRED_B, body="""
, a AS (SELECT entry, list_sort(list(term)) AS x FROM pred_a WHERE prob >= 0.5 GROUP BY entry),
b AS (SELECT entry, list_sort(list(term)) AS y FROM pred_b WHERE prob >= 0.5 GROUP BY entry)
SELECT entry, array_to_string(list_sort(list_filter(x, lambda t: NOT list_contains(y, t))), ',') AS removed,
  array_to_string(list_sort(list_filter(y, lambda t: NOT list_contains(x, t))), ',') AS added,
  array_to_string(list_sort(list_filter(x, lambda t: list_contains(y, t))), ',') AS common FROM a JOIN b USING (entry)""".replace("\n, a AS", ",\na AS", 1)))
def f21_label_list_differences(s, d):
    """An entity's labels in one prediction but not the other, and in both."""
    lists = [p.where("prob >= 0.5").groupBy("entry").agg(F.array_sort(F.collect_list("term")).alias(n)) for p, n in ((fx.predictions_a(s, d), "x"), (fx.predictions_b(s, d), "y"))]
    j = lists[0].join(lists[1], "entry")
    text = lambda c: F.array_join(F.array_sort(c).cast("array<string>"), ",")
    return j.select("entry", text(F.array_except("x", "y")).alias("removed"), text(F.array_except("y", "x")).alias("added"), text(F.array_intersect("x", "y")).alias("common"))


@register("g4_interest_modes", sql(EDGE, TERMS, body="""
SELECT 'all' AS mode, term FROM terms UNION ALL SELECT 'with_parents', term FROM terms WHERE term IN (SELECT child FROM edge)
UNION ALL SELECT 'weight', term FROM terms WHERE ia > 0"""))
def g4_interest_modes(s, d):
    dims = Dims.of(s, d)
    parts = [onto.terms_of_interest(dims.terms, dims.edges, m).select(F.lit(m).alias("mode"), "term") for m in ("all", "with_parents", "weight")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("g17_vocabulary_edges", sql(EDGE, PRED_RAW, body="""
, ind AS (SELECT child, parent FROM edge WHERE child % 5 <> 0 AND parent % 5 <> 0),
clo(child, ancestor) AS (SELECT child, parent FROM ind UNION SELECT c.child, i.parent FROM clo c JOIN ind i ON c.ancestor = i.child),
p AS (SELECT entry, term, max(prob) AS prob FROM pred_raw WHERE term % 5 <> 0 GROUP BY entry, term)
SELECT entry, term, round(max(prob), 6) AS prob FROM (SELECT * FROM p UNION ALL SELECT p.entry, c.ancestor, p.prob FROM p JOIN clo c ON c.child = p.term)
GROUP BY entry, term HAVING max(prob) <> 0""".replace("\n, ind AS", ",\nind AS", 1)))
def g17_vocabulary_edges(s, d):
    """Parent >= child over the edges among the labels of a vocabulary: a label outside it breaks the chain."""
    dims = Dims.of(s, d)
    vocabulary = dims.terms.where("term % 5 <> 0")
    edges = onto.induced_edges(dims.edges, vocabulary)
    raw = fx.predictions_raw(s, d).where("term % 5 <> 0").groupBy("entry", "term").agg(F.max("prob").alias("prob"))
    out = onto.enforce_parent_ge_child(raw, edges, onto.closure_and_levels(edges, vocabulary)[0], vocabulary)
    return out.select("entry", "term", r6("prob").alias("prob"))


@register("e2_top_species_one_hot", sql(TAXONOMY, body="""
, v AS (SELECT taxon, row_number() OVER (ORDER BY count(*) DESC, taxon) - 1 AS idx FROM taxonomy GROUP BY taxon QUALIFY idx < 10)
SELECT entry, CAST(coalesce(idx, -1) AS INTEGER) AS idx, CASE WHEN idx IS NULL THEN 0 ELSE 1 END AS ones FROM taxonomy LEFT JOIN v USING (taxon)""".replace("\n, v AS", ",\nv AS", 1)))
def e2_top_species_one_hot(s, d):
    out = fe.top_k_one_hot(fx.taxonomy(s, d), "taxon", 10)
    return out.select("entry", F.col("idx").cast("int").alias("idx"), F.aggregate("onehot", F.lit(0), lambda a, x: a + x).alias("ones"))


@register("e10_hit_features_all_ids", sql(HITS, body="""
, h AS (SELECT * FROM hits WHERE alnlen >= 40),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bits DESC, target) AS rn FROM h),
f AS (SELECT query, count(*) AS n_hits, max(bits) AS best_bits, avg(identity) FILTER (WHERE rn <= 1) AS i1, avg(identity) FILTER (WHERE rn <= 3) AS i3 FROM r GROUP BY query)
SELECT o_orderkey AS query, coalesce(n_hits, 0) AS n_hits, round(coalesce(best_bits, 0), 6) AS best_bits, round(coalesce(i1, 0), 6) AS identity_top1_mean,
  round(coalesce(i3, 0), 6) AS identity_top3_mean FROM orders LEFT JOIN f ON f.query = o_orderkey""".replace("\n, h AS", ",\nh AS", 1)))
def e10_hit_features_all_ids(s, d):
    """Hit features for every requested id: zeros for ids without hits."""
    asked = fx.table(s, d, "orders").select(F.col("o_orderkey").alias("query"))
    out = ag.first_k_means(fx.hits(s, d).where("alnlen >= 40"), "query", "bits", ["identity"], ks=(1, 3), tie="target", requested=asked)
    return out.select("query", "n_hits", *[r6(c).alias(c) for c in ("best_bits", "identity_top1_mean", "identity_top3_mean")])


@register("e16_fold_parts", sql(ANNOT, body=f"""
, f AS (SELECT entry, {key_hash_sql('entry')} % 5 AS fold FROM (SELECT DISTINCT entry FROM annot WHERE entry % 9 <> 0))
SELECT 'val' AS part, entry, term FROM annot JOIN f USING (entry) WHERE fold = 1 UNION ALL SELECT 'train', entry, term FROM annot JOIN f USING (entry) WHERE fold <> 1
UNION ALL SELECT 'trainval', entry, term FROM annot JOIN f USING (entry)""".replace("\n, f AS", ",\nf AS", 1)))
def e16_fold_parts(s, d):
    """Train, validation and both, of the entries that have a fold."""
    a = fx.annotations(s, d).select("entry", "term")
    folds = fe.group_folds(a.select("entry").distinct().where("entry % 9 <> 0"), "entry", "entry", 5)
    parts = [fe.fold_split(a, folds, 1, p).select(F.lit(p).alias("part"), "entry", "term") for p in ("val", "train", "trainval")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("e17_regrouped_columns", sql(TERMS, body="""
, old AS (SELECT p_partkey * 2 AS term, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS old FROM part)
SELECT namespace, term, old, row_number() OVER (ORDER BY namespace, term) - 1 AS new FROM old JOIN terms USING (term)""".replace("\n, old AS", ",\nold AS", 1)))
def e17_regrouped_columns(s, d):
    """Label columns regrouped by namespace and term; every other column names no term and goes."""
    part = fx.table(s, d, "part").select(F.col("p_size"), F.col("p_partkey"))
    old = rk.sorted_places(part, ["p_size", "p_partkey"], "old").select((F.col("p_partkey") * 2).alias("term"), "old")
    return fe.regroup_columns(old, fx.terms(s, d))
