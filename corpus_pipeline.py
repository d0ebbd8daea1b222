"""The corpus pipeline: stages that each apply one operator of ``termflow.llm``.

Every stage takes (spark, docs, sf_dir) and returns the columns of ``docs``; the
last returns the digests of the encoded documents.  A row without doc_id, or
with one that repeats, is a document of its own, after those whose id stands once.
Null texts are empty and go with the quality rules.  Texts of any length are taken whole.  Ties: of equal or
near documents the one first in key order stays; rows alike in every column are told apart by number alone.
Columns of ``docs`` may have any names.  An empty table passes through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termflow.llm import mixture, near_dedup, quality, suffix, tokens
from termflow.llm.common import fresh, ship, store, table, with_key


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio."""
    ship(spark)
    rules, found = quality.Rules(docs, table(spark, sf_dir, "labels")), fresh("_rules", docs.columns)
    return rules.apply(docs, as_col=found).where(F.col(found)["kept"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies (five-word shingles, similarity 0.8 or more)."""
    ship(spark)
    key = fresh("_row_key", docs.columns)
    rows = with_key(docs, key=key)
    groups = near_dedup.near_groups(rows.select(key, "text"), id_col=key)
    gone = groups.where("not kept").select(F.col("doc_id").alias(key))
    return rows.join(gone, key, "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes that a 100-byte string covers which starts earlier; documents of which nothing is left go."""
    ship(spark)
    key, text = fresh("_row_key", docs.columns), fresh("_text", docs.columns)
    rows = with_key(docs, key=key)
    cut = suffix.dedup_texts(rows.select(key, "text"), id_col=key).select(F.col("doc_id").alias(key), F.col("text").alias(text))
    joined = rows.drop("text").join(cut.where(F.trim(text) != ""), key).withColumn("text", F.col(text))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return joined.select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, whole."""
    ship(spark)
    key, copies, copy = (fresh(n, docs.columns) for n in ("_row_key", "_copies", "_copy"))
    rows = with_key(docs, key=key)
    taken = mixture.mix(rows.select(key, "source", "text"), id_col=key, whole=True).where("copies > 0")
    taken = taken.select(F.col("doc_id").alias(key), F.col("copies").alias(copies))
    return rows.join(taken, key).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text decoded from them."""
    ship(spark)
    return tokens.encode_digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mixed_sources),
    ("BPE encoding and decoding", encoded),
]

#: SQL expresses neither the sketches nor BPE; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``, each stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs)
    return docs
