"""Reference-shaped tables derived from the driver's parquet tables.

The annotation model is a long fact table ``(entry, term, value)`` over a term
DAG.  The driver ships TPC-H-like tables, so every input of the library is
derived from them with plain column expressions (the same expressions appear in
the DuckDB oracle SQL in ``termflow.plans.common``):

* term / namespace     ``part``: term = p_partkey, namespace = p_partkey % 3
* DAG edges            child p (i = p div 3 >= 1) has parents
                       3*(i div 2) + p%3 and 3*(i div 3) + p%3
* term weight (IA)     p_retailprice / 1000, roots (i = 0) weigh 0
* annotations          distinct (l_orderkey, l_partkey) with l_returnflag = 'R'
* predictions A / B    max(l_discount*10) / max(l_quantity/50) per pair;
                       raw scores |l_tax|*10 per line item (with repeats)
* negatives            l_linestatus = 'O' and l_linenumber = 1
* snapshots            lineitem shipped before 1999 (old) / in [1996, 2000) (new)
* evidence code        l_returnflag || l_linestatus
* taxonomy             order -> customer nation; lineage nation -> region
* interaction graph    part-supplier links weighted by l_quantity
* id mapping           supplier -> nation
* hit table            lineitem as (query=order, target=part) alignment hits

All readers prune columns at the scan; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import parts_of

# Evidence codes treated as "experimental" on the stand-in
# evidence column (l_returnflag || l_linestatus).
EXPERIMENTAL_CODES = ("RF", "AF")

# The two annotation releases.  The old release holds rows
# shipped before 1999; the new one rows shipped in [1996, 2000) -- it both adds
# recent rows and retracts the oldest ones, so old-minus-new is not empty.
OLD_SNAPSHOT = (None, "1999-01-01")
NEW_SNAPSHOT = ("1996-01-01", "2000-01-01")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------- ontology

def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term BIGINT, namespace BIGINT, ia DOUBLE, name STRING)."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("term"),
        (k % 3).alias("namespace"),
        F.when(F.floor(k / 3) == 0, F.lit(0.0)).otherwise(F.col("p_retailprice") / 1000.0).alias("ia"),
        F.col("p_name").alias("name"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """child -> parent edges (child BIGINT, parent BIGINT).

    Both parents of a child come from the same ``part`` row, so
    ``array_distinct`` removes the duplicate without a shuffle (p_partkey is
    the key of ``part``).
    """
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("child"))
    ns = F.col("child") % 3
    return (
        p.where(F.expr("child div 3") >= 1)
        .select("child", F.explode(F.array_distinct(F.array(
            F.lit(3) * F.expr("(child div 3) div 2") + ns,
            F.lit(3) * F.expr("(child div 3) div 3") + ns,
        ))).alias("parent"))
    )


# ------------------------------------------------------------------ annotations

def _lineitem(spark, sf_dir, *cols):
    return table(spark, sf_dir, "lineitem").select(*cols)


def _by_order(spark, rows):
    """Line items dealt by order into partitions that grow with their number, so that a task holds no more pairs of a larger input."""
    return rows.repartition(parts_of(spark, rows.count(), 1 << 20), "l_orderkey")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive annotations (entry, term, aspect)."""
    li = _by_order(spark, _lineitem(spark, sf_dir, "l_orderkey", "l_partkey", "l_returnflag").where(F.col("l_returnflag") == "R"))
    return (
        li.select(F.col("l_orderkey").alias("entry"), F.col("l_partkey").alias("term"),
                (F.col("l_partkey") % 3).alias("aspect"))
        .distinct()
    )


def predictions_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model A scores (entry, term, prob): max(l_discount*10) per pair."""
    li = _by_order(spark, _lineitem(spark, sf_dir, "l_orderkey", "l_partkey", "l_discount"))
    return (
        li.groupBy(F.col("l_orderkey").alias("entry"), F.col("l_partkey").alias("term"))
        .agg(F.max(F.col("l_discount") * 10).alias("prob"))
    )


def predictions_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model B scores (entry, term, prob): max(l_quantity/50) per pair."""
    li = _by_order(spark, _lineitem(spark, sf_dir, "l_orderkey", "l_partkey", "l_quantity"))
    return (
        li.groupBy(F.col("l_orderkey").alias("entry"), F.col("l_partkey").alias("term"))
        .agg(F.max(F.col("l_quantity") / 50.0).alias("prob"))
    )


def predictions_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Un-aggregated prediction rows with repeats (entry, term, prob, ord):
    one row per line item, prob = |l_tax| * 10, ord = l_linenumber."""
    li = _by_order(spark, _lineitem(spark, sf_dir, "l_orderkey", "l_partkey", "l_tax", "l_linenumber"))
    return li.select(F.col("l_orderkey").alias("entry"), F.col("l_partkey").alias("term"),
                     (F.abs(F.col("l_tax")) * 10).alias("prob"), F.col("l_linenumber").alias("ord"))


def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT-qualified pairs (entry, term)."""
    li = _lineitem(spark, sf_dir, "l_orderkey", "l_partkey", "l_linestatus", "l_linenumber")
    return (
        li.where((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1))
        .select(F.col("l_orderkey").alias("entry"), F.col("l_partkey").alias("term"))
        .distinct()
    )


def snapshot(spark: SparkSession, sf_dir: str, window: tuple) -> DataFrame:
    """Annotation release (entry, term, source) of rows shipped in [start, end)."""
    start, end = window
    li = _lineitem(spark, sf_dir, "l_orderkey", "l_partkey", "l_returnflag", "l_linestatus", "l_shipdate")
    cond = F.col("l_shipdate") < F.lit(end).cast("timestamp")
    if start is not None:
        cond = cond & (F.col("l_shipdate") >= F.lit(start).cast("timestamp"))
    return (
        li.where(cond)
        .select(F.col("l_orderkey").alias("entry"), F.col("l_partkey").alias("term"),
                F.concat("l_returnflag", "l_linestatus").alias("source"))
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation rows with an evidence code (entry, term, aspect, code)."""
    li = _lineitem(spark, sf_dir, "l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    return li.select(F.col("l_orderkey").alias("entry"), F.col("l_partkey").alias("term"),
                     (F.col("l_partkey") % 3).alias("aspect"),
                     F.concat("l_returnflag", "l_linestatus").alias("code"))


# --------------------------------------------------------------------- taxonomy

def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry, taxon): order -> nation of its customer."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .select(F.col("o_orderkey").alias("entry"), F.col("c_nationkey").alias("taxon")))


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(taxon, genus, family): nation name and region name."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (n.join(r, n.n_regionkey == r.r_regionkey, "left")
            .select(F.col("n_nationkey").alias("taxon"), F.col("n_name").alias("genus"),
                    F.col("r_name").alias("family")))


# ------------------------------------------------------------ interaction graph

def interaction_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw weighted links (protein1, protein2, score) with repeats:
    p<part> -- s<supplier>, score = l_quantity."""
    li = _lineitem(spark, sf_dir, "l_partkey", "l_suppkey", "l_quantity")
    return li.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("protein1"),
                     F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("protein2"),
                     F.col("l_quantity").alias("score"))


def id_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): s<supplier> -> n<nation>, many to one."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"),
                    F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment hits (query, target, identity, alnlen, evalue, bits)."""
    li = _lineitem(spark, sf_dir, "l_orderkey", "l_partkey", "l_discount", "l_quantity",
                   "l_extendedprice")
    return li.select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("target"),
                     F.col("l_discount").alias("identity"),
                     F.col("l_quantity").cast("int").alias("alnlen"),
                     F.pow(F.lit(10.0), -F.col("l_quantity")).alias("evalue"),
                     F.col("l_extendedprice").alias("bits"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry, vec ARRAY<FLOAT>, label)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("entry"), F.col("embedding").alias("vec"), "label")
