"""Catalogued feature, vocabulary, label and fold queries (E*, J13, J14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import features as fe
from ..operators import similar
from ..operators import ontology as onto
from ..operators import ranking as rk
from ..session import broadcast_terms
from ..sources import fixtures as fx
from .ontology_q import ROOTS
from .common import (ANNOT, CLOSURE, EDGE, RCLOSURE, TAXONOMY, TERMS, Dims, key_hash_sql, r6, register, sql)

ANN_TAX = "ann_tax AS (SELECT t.taxon FROM (SELECT DISTINCT entry FROM annot) a JOIN taxonomy t ON a.entry = t.entry)"


def _ann_tax(s, d):
    return fx.annotations(s, d).select("entry").distinct().join(fx.taxonomy(s, d), "entry").select("taxon")


@register("e1_species_vocabulary", sql(ANNOT, TAXONOMY, ANN_TAX, body="""
, c AS (SELECT taxon, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, taxon) AS rk
        FROM ann_tax GROUP BY taxon)
SELECT taxon, count, CAST(CASE WHEN count >= 450 THEN rk - 1
       ELSE (SELECT count(*) FROM c WHERE count >= 450) END AS INTEGER) AS idx FROM c""".replace(
    "\n, c AS", ",\nc AS", 1)))
def e1_species_vocabulary(s, d):
    return fe.vocabulary(_ann_tax(s, d), "taxon", min_count=450)


@register("e4_shifted_top_k_vocabulary", sql(ANNOT, TAXONOMY, ANN_TAX, body="""
, c AS (SELECT taxon, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, taxon) AS rk
        FROM ann_tax GROUP BY taxon)
SELECT taxon, count, CAST(CASE WHEN rk <= 10 THEN rk ELSE 11 END AS INTEGER) AS idx FROM c""".replace(
    "\n, c AS", ",\nc AS", 1)))
def e4_shifted_top_k_vocabulary(s, d):
    return fe.vocabulary(_ann_tax(s, d), "taxon", top_k=10, start=1)


@register("e3_rank_vocabulary", sql(body="""
SELECT 'unknown' AS value, 0 AS idx
UNION ALL SELECT value, CAST(row_number() OVER (ORDER BY value) AS INTEGER) FROM (
  SELECT DISTINCT r_name AS value FROM nation LEFT JOIN region ON n_regionkey = r_regionkey WHERE r_name IS NOT NULL)"""
   .replace("WITH RECURSIVE \n", "")))
def e3_rank_vocabulary(s, d):
    return fe.rank_vocabulary(fx.lineage(s, d), "family")


LABEL_COUNT = """lc AS (SELECT entry, least(count(*), 10) AS stratum FROM annot GROUP BY entry)"""


@register("e12_stratified_folds", sql(ANNOT, LABEL_COUNT, body="""
, h AS (SELECT entry, stratum, (entry * 48271 + 42) % 2147483647 AS hv FROM lc)
SELECT entry, CAST(stratum AS BIGINT) AS stratum,
       CAST((row_number() OVER (PARTITION BY stratum, hv % 16 ORDER BY hv, entry) - 1 + hv % 16) % 5 AS INTEGER) AS fold
FROM h""".replace("\n, h AS", ",\nh AS", 1)))
def e12_stratified_folds(s, d):
    lc = fx.annotations(s, d).groupBy("entry").agg(F.least(F.count("*"), F.lit(10)).cast("bigint").alias("stratum"))
    return fe.salted_folds(lc, "entry", "stratum", k=5)


@register("e15_hash_folds", sql(ANNOT, body="""
SELECT entry, CAST(((entry * 48271 + 7) % 2147483647) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT entry FROM annot)"""))
def e15_hash_folds(s, d):
    e = fx.annotations(s, d).select("entry").distinct()
    return e.select("entry", F.pmod(fe.int_hash("entry", 7), F.lit(5)).cast("int").alias("fold"))


@register("e16_fold_split_train", sql(ANNOT, body="""
SELECT a.entry, a.term FROM annot a
WHERE ((a.entry * 48271 + 7) % 2147483647) % 5 <> 0"""))
def e16_fold_split_train(s, d):
    a = fx.annotations(s, d)
    folds = a.select("entry").distinct().select("entry", F.pmod(fe.int_hash("entry", 7), F.lit(5)).cast("int").alias("fold"))
    return fe.fold_split(a.select("entry", "term"), folds, 0, "train")


@register("e13_grouped_folds", f"""
WITH k AS (SELECT vec_id AS entry, list_reduce(list_prepend(CAST(1 AS BIGINT), list_transform(embedding, lambda x:
    ((CAST(floor(CAST(x AS DOUBLE) * 1000000) AS BIGINT) % 2147483647) + 2147483647) % 2147483647)),
    lambda a, x: (a * 48271 + x) % 2147483647) AS g FROM embeddings)
SELECT entry, CAST({key_hash_sql('g')} % 5 AS INTEGER) AS fold FROM k""")
def e13_grouped_folds(s, d):
    e = fx.embeddings(s, d)
    return fe.group_folds(e.select("entry", "vec"), "entry", fn.vector_key("vec")).select("entry", "fold")


TOP20 = """top20 AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS idx
  FROM annot GROUP BY term QUALIFY row_number() OVER (ORDER BY count(*) DESC, term) <= 20)"""


def _top20(s, d):
    f = fx.annotations(s, d).groupBy("term").agg(F.count("*").alias("n"))
    return rk.select_labels(f, "term", "n", 20).select("term", (F.col("rank") - 1).cast("bigint").alias("idx"))


@register("e8_multilabel_binarize", sql(ANNOT, TOP20, body="""
SELECT a.entry, t.idx FROM annot a JOIN top20 t ON a.term = t.term"""))
def e8_multilabel_binarize(s, d):
    return fx.annotations(s, d).join(_top20(s, d), "term").select("entry", "idx")


@register("e9_class_weights", sql(ANNOT, TERMS, TOP20, body="""
SELECT t.idx, round(w.ia, 6) AS pos_weight FROM top20 t JOIN terms w ON t.term = w.term"""))
def e9_class_weights(s, d):
    return _top20(s, d).join(fx.terms(s, d), "term").select("idx", r6("ia").alias("pos_weight"))


@register("e11_top_terms_targets", sql(EDGE, CLOSURE, RCLOSURE, TERMS, ANNOT, body="""
, pos AS (SELECT DISTINCT a.entry, r.ancestor AS term FROM annot a JOIN rclosure r ON a.term = r.child),
roots AS (SELECT p_partkey AS term FROM part WHERE p_partkey NOT IN (SELECT child FROM edge)),
cand AS (SELECT p.entry, e.child AS term FROM pos p JOIN edge e ON e.parent = p.term
         UNION SELECT a.entry, r.term FROM (SELECT DISTINCT entry FROM annot) a, roots r),
lab AS (SELECT c.entry, c.term, t.namespace, CASE WHEN p.term IS NULL THEN 0 ELSE 1 END AS label
        FROM cand c LEFT JOIN pos p ON p.entry = c.entry AND p.term = c.term JOIN terms t ON t.term = c.term),
top AS (SELECT term FROM (SELECT term, namespace, row_number() OVER (PARTITION BY namespace
        ORDER BY sum(label) DESC, term) AS rk FROM lab GROUP BY term, namespace) WHERE rk <= 30)
SELECT entry, term, namespace, CAST(label AS INTEGER) AS label FROM lab WHERE term IN (SELECT term FROM top)"""
   .replace("\n, pos AS", ",\npos AS", 1)))
def e11_top_terms_targets(s, d):
    dims = Dims.of(s, d)
    ann = fx.annotations(s, d)
    pos = onto.propagate_labels(ann, dims.closure, dims.terms)
    lab = onto.ternary_labels(pos, ann, dims.edges, dims.terms, onto.roots(dims.terms, dims.edges))
    freq = lab.groupBy("term", "namespace").agg(F.sum("label").alias("n"))
    top = rk.select_labels(freq, "term", "n", 30, group="namespace").select("term")
    return lab.join(F.broadcast(top), "term", "left_semi").select("entry", "term", "namespace", F.col("label").cast("int").alias("label"))


@register("e17_label_blocks_per_namespace", sql(ANNOT, TERMS, body="""
SELECT t.namespace, count(*) AS n_labels FROM (SELECT DISTINCT term FROM annot) a JOIN terms t ON a.term = t.term
GROUP BY t.namespace"""))
def e17_label_blocks_per_namespace(s, d):
    v = fx.annotations(s, d).select("term").distinct()
    return v.join(fx.terms(s, d), "term").groupBy("namespace").agg(F.count("*").alias("n_labels"))


@register("e18_root_positive_entries", sql(EDGE, ROOTS, CLOSURE, RCLOSURE, ANNOT, body="""
, pos AS (SELECT DISTINCT a.entry, r.ancestor AS term FROM annot a JOIN rclosure r ON a.term = r.child)
SELECT DISTINCT term % 3 AS namespace, entry FROM pos WHERE term IN (SELECT term FROM roots)""".replace("\n, pos AS", ",\npos AS", 1)))
def e18_root_positive_entries(s, d):
    dims = Dims.of(s, d)
    pos = onto.propagate_labels(fx.annotations(s, d), dims.closure, dims.terms)
    tops = onto.roots(dims.terms, dims.edges).join(dims.terms.select("term", "namespace"), "term")
    return pos.join(broadcast_terms(tops, tops.count()), "term").select("namespace", "entry").distinct()


@register("j14_horizontal_feature_join", sql(body="""
SELECT a.vec_id AS entry, CAST(len(a.embedding) + len(b.embedding) AS INTEGER) AS dim,
       round(sqrt(list_sum(list_transform(list_concat(a.embedding, b.embedding), lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""".replace("WITH RECURSIVE \n", "")))
def j14_horizontal_feature_join(s, d):
    e = fx.embeddings(s, d)
    a = e.select("entry", F.col("vec").alias("_a"))
    b = e.select((F.col("entry") - 1).alias("entry"), F.col("vec").alias("_b"))
    j = a.join(b, "entry").select("entry", F.concat("_a", "_b").alias("vec"))
    return j.select("entry", F.size("vec").cast("int").alias("dim"),
                    F.round(fn.l2_norm(F.transform("vec", lambda x: x.cast("double"))), 4).alias("norm"))


@register("j13_target_densification", sql(ANNOT, body="""
SELECT o.o_orderkey AS entry, coalesce(a.n, 0) AS n_terms FROM orders o
LEFT JOIN (SELECT entry, count(*) AS n FROM annot GROUP BY entry) a ON a.entry = o.o_orderkey"""))
def j13_target_densification(s, d):
    ids = fx.table(s, d, "orders").select(F.col("o_orderkey").alias("entry"))
    n = fx.annotations(s, d).groupBy("entry").agg(F.count("*").alias("_n"))
    return ids.join(n, "entry", "left").select("entry", F.coalesce("_n", F.lit(0)).alias("n_terms"))


@register("e5_species_one_hot", sql(TAXONOMY, body="""
SELECT entry, CAST(coalesce(list_position([0, 3, 7, 11, 19], taxon), 0) AS INTEGER) AS idx FROM taxonomy"""))
def e5_species_one_hot(s, d):
    out = fe.species_one_hot(fx.taxonomy(s, d), "taxon", [0, 3, 7, 11, 19])
    return out.select("entry", F.array_position("species_onehot", F.lit(1.0)).cast("int").alias("_p")).select(
        "entry", (F.col("_p") - 1).cast("int").alias("idx"))


@register("e14_rarest_label_strata", sql(ANNOT, body="""
, f AS (SELECT term, count(*) AS n FROM annot GROUP BY term),
t AS (SELECT term, n FROM f QUALIFY row_number() OVER (ORDER BY n DESC, term) <= 32),
s AS (SELECT a.entry, arg_min(a.term, (t.n, a.term)) AS stratum FROM annot a JOIN t ON a.term = t.term GROUP BY a.entry)
SELECT e.entry, coalesce(s.stratum, -1) AS stratum FROM (SELECT DISTINCT entry FROM annot) e
LEFT JOIN s ON s.entry = e.entry""".replace("\n, f AS", ",\nf AS", 1)))
def e14_rarest_label_strata(s, d):
    return fe.rarest_label_strata(fx.annotations(s, d).select("entry", "term"))


@register("j16_hit_label_transfer", sql(ANNOT, body="""
, h AS (SELECT l_orderkey AS query, l_partkey AS target, l_discount AS identity, power(10.0, -l_quantity) AS evalue,
        l_extendedprice AS bits FROM lineitem),
pt AS (SELECT DISTINCT CAST(l_partkey AS BIGINT) AS target, l_suppkey AS term FROM lineitem WHERE l_returnflag = 'A'),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bits DESC, target) AS rn
        FROM h WHERE evalue <= 0.02) WHERE rn <= 5)
SELECT top.query AS entry, pt.term, round(max(identity), 6) AS prob, count(*) AS n_hits
FROM top JOIN pt ON top.target = pt.target GROUP BY 1, 2""".replace("\n, h AS", ",\nh AS", 1)))
def j16_hit_label_transfer(s, d):
    from ..operators import pairs as pr
    li = fx.table(s, d, "lineitem")
    target_terms = (li.where(F.col("l_returnflag") == "A")
                    .select(F.col("l_partkey").alias("entry"), F.col("l_suppkey").alias("term")))
    out = pr.hit_label_transfer(fx.hits(s, d), target_terms, k=5, max_evalue=0.02)
    return out.select("entry", "term", r6("prob").alias("prob"), "n_hits")


J16_SQL = r"""
WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM documents),
s AS (SELECT DISTINCT id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS g
  FROM (SELECT id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS query, b.id AS target, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id WHERE a.id % 20 = 0 GROUP BY a.id, b.id),
j AS (SELECT query, target, shared, x.n AS n_query, y.n AS n_target FROM p JOIN n x ON x.id = query JOIN n y ON y.id = target
  WHERE shared * 10 >= (x.n + y.n - shared) * 5)
SELECT query, target, CAST(shared AS INTEGER) AS shared, CAST(n_query AS INTEGER) AS n_query, CAST(n_target AS INTEGER) AS n_target,
  round(shared / CAST(n_query + n_target - shared AS DOUBLE), 6) AS similarity,
  CAST(row_number() OVER (PARTITION BY query ORDER BY shared / CAST(n_query + n_target - shared AS DOUBLE) DESC, target) AS INTEGER) AS rank
FROM j QUALIFY rank <= 5"""


@register("j16_similar_sequences", J16_SQL)
def j16_similar_sequences(s, d):
    """Every twentieth document as a query against all, as sequences of words."""
    docs = fx.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+").alias("seq"))
    out = similar.similar_sequences(docs.where("id % 20 = 0"), docs, k=3, least=0.5, top=5)
    return out.select("query", "target", "shared", "n_query", "n_target", r6("similarity").alias("similarity"), "rank")


@register("j11_alignment_join", """
SELECT 'V' || CAST(vec_id AS VARCHAR) AS id, vec_id AS ref_ord, CASE WHEN vec_id % 2 = 0 THEN label END AS label FROM embeddings""")
def j11_alignment_join(s, d):
    e = fx.table(s, d, "embeddings")
    ref = e.select(F.concat(F.lit("sp|V"), F.col("vec_id").cast("string"), F.lit("|X")).alias("id"),
                   F.col("vec_id").alias("ord"))
    src = e.where(F.col("vec_id") % 2 == 0).select(F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("id"),
                                                   (-F.col("vec_id")).alias("ord"), "label")
    return fe.align(src, ref)
