"""Validation and comparison reports (V7-V10, W14): each returns DataFrames,
never prints or collects fact rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def validate_submission(raw: DataFrame, known_ids: DataFrame, known_terms: DataFrame,
                        ) -> tuple[DataFrame, DataFrame]:
    """V7: ``raw`` has string columns (entry, term, prob).  Returns
    (report, cleaned): the report counts header/non-numeric rows, NaN scores,
    duplicated pairs, scores outside [0,1], unknown ids, known ids without a
    prediction and unknown terms; the cleaned table drops header/NaN rows and
    unknown ids/terms, keeps the max per pair and clips to [0,1]."""
    p = raw.withColumn("_p", F.col("prob").try_cast("double"))
    ids = known_ids.select(F.col("entry").alias("_id")).distinct().withColumn("_known_id", F.lit(True))
    tms = known_terms.select(F.col("term").alias("_tm")).distinct().withColumn("_known_term", F.lit(True))
    j = (p.join(ids, F.col("entry") == F.col("_id"), "left")
         .join(tms, F.col("term") == F.col("_tm"), "left"))
    dup = (p.where(F.col("_p").isNotNull()).groupBy("entry", "term").agg(F.count("*").alias("_c"))
           .agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0))).scalar())
    missing = (known_ids.select("entry").distinct()
               .join(p.select("entry").distinct(), "entry", "left_anti").agg(F.count("*")).scalar())
    report = j.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("_p").isNull()).alias("non_numeric"),
        F.count_if(F.isnan("_p")).alias("nan"),
        F.count_if((F.col("_p") < 0) | (F.col("_p") > 1)).alias("out_of_range"),
        F.count_if(F.col("_known_id").isNull()).alias("unknown_ids"),
        F.count_if(F.col("_known_term").isNull()).alias("unknown_terms"),
        dup.cast("bigint").alias("duplicates"), missing.alias("missing_ids"))
    cleaned = (j.where(F.col("_p").isNotNull() & ~F.isnan("_p") & F.col("_known_id").isNotNull()
                       & F.col("_known_term").isNotNull())
               .groupBy("entry", "term").agg(F.max("_p").alias("prob"))
               .select("entry", "term", F.least(F.greatest("prob", F.lit(0.0)), F.lit(1.0)).alias("prob")))
    return report, cleaned


def weight_consistency(weights: DataFrame, terms: DataFrame, preds: DataFrame) -> DataFrame:
    """V8: one row per class of term -- ontology terms with a positive, zero,
    NaN or missing weight, and the same classes for the predicted terms
    (rows and distinct terms)."""
    w = weights.select("term", F.col("ia").alias("_w"))
    cls = (F.when(F.col("_w").isNull(), "missing").when(F.isnan("_w"), "nan")
           .when(F.col("_w") == 0, "zero").otherwise("positive"))
    onto = terms.select("term").distinct().join(w, "term", "left").groupBy(cls.alias("class")).agg(
        F.count("*").alias("ontology_terms"))
    pr = preds.select("term").join(w, "term", "left").groupBy(cls.alias("class")).agg(
        F.count("*").alias("prediction_rows"), F.countDistinct("term").alias("predicted_terms"))
    return onto.join(pr, "class", "full").select(
        "class", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("ontology_terms", "prediction_rows",
                                                                     "predicted_terms")])


def alignment_check(a: DataFrame, b: DataFrame, id_col: str = "id", ord_col: str = "ord") -> DataFrame:
    """V9: do two id lists have the same length and order?  Joins on the
    position; returns counts and the first differing position (null if none)."""
    x = a.select(F.col(ord_col).alias("pos"), F.col(id_col).alias("_a"))
    y = b.select(F.col(ord_col).alias("pos"), F.col(id_col).alias("_b"))
    j = x.join(y, "pos", "full")
    differs = ~F.equal_null(F.col("_a"), F.col("_b"))
    return j.agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"),
                 F.count_if(differs).alias("n_mismatch"),
                 F.min(F.when(differs, F.col("pos"))).alias("first_mismatch"))


def rank_comparison(a: DataFrame, b: DataFrame, k: int | None = None, entity: str = "entry",
                    term: str = "term", value: str = "prob") -> DataFrame:
    """Both models ranked per entity (score desc, term asc); side by side
    on (entity, rank): flags a different term at the same rank, and the score
    delta when the term is the same."""
    def ranked(df, tag):
        w = Window.partitionBy(entity).orderBy(F.col(value).desc(), F.col(term).asc())
        r = df.select(entity, term, value).withColumn("rank", F.row_number().over(w))
        if k:
            r = r.where(F.col("rank") <= k)
        return r.select(entity, "rank", F.col(term).alias(f"term_{tag}"), F.col(value).alias(f"{value}_{tag}"))
    j = ranked(a, "a").join(ranked(b, "b"), [entity, "rank"], "full")
    same = F.col("term_a") == F.col("term_b")
    return j.select("*", F.coalesce(~same, F.lit(True)).alias("different_term"),
                    F.when(same, F.col(f"{value}_b") - F.col(f"{value}_a")).alias("delta"))
