"""Set algebra and blending on (entry, term) pair tables (J*, O*, A5/A6/A18, P16-P19).

Pairs are keyed by two columns (never a concatenated string key).  n-way
ensembles are a ``unionByName`` + one ``groupBy`` (a single shuffle) rather
than a chain of full outer joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import PRIME, key_hash
from ..session import parts_of

#: Hits of a partition of a label transfer.
TRANSFER_HITS = 1 << 20
KEY = ["entry", "term"]


def _z(c):
    return F.coalesce(F.col(c), F.lit(0.0))


def full_blend(a: DataFrame, b: DataFrame, wa: float = 0.5, wb: float = 0.5,
               value: str = "prob", key: Sequence[str] = KEY) -> DataFrame:
    """J4/J9 two-way: full outer join on the key, missing = 0, wa*a + wb*b."""
    a2 = a.select(*key, F.col(value).alias("_a"))
    b2 = b.select(*key, F.col(value).alias("_b"))
    return (a2.join(b2, list(key), "full")
            .select(*key, (F.lit(wa) * _z("_a") + F.lit(wb) * _z("_b")).alias(value)))


def tagged_union(sources: Sequence[DataFrame], value: str = "prob", key: Sequence[str] = KEY) -> DataFrame:
    """All sources stacked with a ``src`` index (0, 1, ...)."""
    out = None
    for i, s in enumerate(sources):
        t = s.select(*key, F.col(value).cast("double").alias(value), F.lit(i).alias("src"))
        out = t if out is None else out.unionByName(t)
    return out


def mean_present(sources: Sequence[DataFrame], value: str = "prob", key: Sequence[str] = KEY) -> DataFrame:
    """Mean over the sources that contain the pair."""
    return tagged_union(sources, value, key).groupBy(*key).agg(F.avg(value).alias(value))


def mean_all(sources: Sequence[DataFrame], value: str = "prob", key: Sequence[str] = KEY) -> DataFrame:
    """A6/J4 n-way: sum / n -- a missing source counts 0."""
    n = len(sources)
    return tagged_union(sources, value, key).groupBy(*key).agg((F.sum(value) / n).alias(value))


def weighted_sum(sources: Sequence[DataFrame], weights: Sequence[float] | None = None,
                 value: str = "prob", key: Sequence[str] = KEY) -> DataFrame:
    """sum_i w_i * s_i (uniform 1/n weights by default), missing = 0."""
    n = len(sources)
    w = list(weights) if weights is not None else [1.0 / n] * n
    u = tagged_union(sources, value, key)
    wexpr = F.element_at(F.array(*[F.lit(float(x)) for x in w]), F.col("src") + 1)
    return u.groupBy(*key).agg(F.sum(wexpr * F.col(value)).alias(value))


def fold_merge(folds: Sequence[DataFrame], kind: str, value: str = "prob",
               key: Sequence[str] = KEY, parts: int | None = None) -> DataFrame:
    """Out-of-fold predictions are disjoint -> sum; test predictions -> mean over k.  With ``parts``, in so many
    partitions of the key (``session.parts_of`` the rows), so that a task holds no more of a larger input."""
    u = tagged_union(folds, value, key)
    if parts is not None:
        u = u.repartition(parts, *key)
    agg = F.sum(value) if kind == "oof" else F.sum(value) / len(folds)
    return u.groupBy(*key).agg(agg.alias(value))


def first_source(sources: Sequence[DataFrame], value: str = "prob", key: Sequence[str] = KEY) -> DataFrame:
    """Keep the value of the first source (concat order) per key."""
    return (tagged_union(sources, value, key).groupBy(*key)
            .agg(F.min_by(value, "src").alias(value)))


def compare_join(a: DataFrame, b: DataFrame, value: str = "prob", suffixes=("_a", "_b"),
                 key: Sequence[str] = KEY) -> DataFrame:
    """Inner join with suffixed value columns."""
    return (a.select(*key, F.col(value).alias(value + suffixes[0]))
            .join(b.select(*key, F.col(value).alias(value + suffixes[1])), list(key)))


def coalesce_blend(primary: DataFrame, fallback: DataFrame, value: str = "prob",
                   key: Sequence[str] = KEY) -> DataFrame:
    """Primary score where present, else the fallback."""
    p = primary.select(*key, F.col(value).alias("_p"))
    f = fallback.select(*key, F.col(value).alias("_f"))
    return p.join(f, list(key), "full").select(*key, F.coalesce("_p", "_f").alias(value))


def partitioned_blend(a: DataFrame, b: DataFrame, wa: float, wb: float,
                      positives: DataFrame | None = None, positive_score: float = 1.0,
                      value: str = "prob", key: Sequence[str] = KEY) -> DataFrame:
    """Pairs in both -> (a*wa + b*wb)/(wa+wb); A-only and B-only kept as is;
    then constant-score positives override."""
    a2 = a.select(*key, F.col(value).alias("_a"))
    b2 = b.select(*key, F.col(value).alias("_b"))
    j = a2.join(b2, list(key), "full")
    out = j.select(*key, F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(),
                                (F.col("_a") * wa + F.col("_b") * wb) / (wa + wb))
                   .otherwise(F.coalesce("_a", "_b")).alias(value))
    if positives is not None:
        pos = positives.select(*key).distinct().withColumn("_pos", F.lit(positive_score))
        out = (out.join(pos, list(key), "full")
               .select(*key, F.coalesce("_pos", value).alias(value)))
    return out


def consensus_bonus(a: DataFrame, b: DataFrame, wa: float = 0.5, wb: float = 0.5,
                    bonus: float = 0.05, value: str = "prob", key: Sequence[str] = KEY) -> DataFrame:
    """P18 (+J4/P12): weighted full blend; when both scores are > 0 add ``bonus``, cap at 1."""
    a2 = a.select(*key, F.col(value).alias("_a"))
    b2 = b.select(*key, F.col(value).alias("_b"))
    base = F.lit(wa) * _z("_a") + F.lit(wb) * _z("_b")
    return (a2.join(b2, list(key), "full")
            .select(*key, F.when((_z("_a") > 0) & (_z("_b") > 0), F.least(base + bonus, F.lit(1.0)))
                    .otherwise(base).alias(value)))


def tie_noise(df: DataFrame, amplitude: float = 0.0005, seed: int = 42, value: str = "prob",
              key: Sequence[str] = KEY) -> DataFrame:
    """Repeatable uniform noise in [-amplitude, amplitude) from a hash of
    the key, then clip to [0, 1]."""
    u = key_hash(*key, seed=seed) / float(PRIME)
    noisy = F.col(value) + (u * 2 - 1) * amplitude
    return df.withColumn(value, F.least(F.greatest(noisy, F.lit(0.0)), F.lit(1.0)))


def snapshot_diff(old: DataFrame, new: DataFrame, valid_terms: DataFrame | None = None,
                  score: float | None = 0.99, key: Sequence[str] = KEY,
                  direction: str = "old_minus_new") -> DataFrame:
    """Distinct pairs of one release missing from the other (default:
    old minus new), optionally restricted to valid terms, with a constant score."""
    o, n = old.select(*key).distinct(), new.select(*key).distinct()
    if direction != "old_minus_new":
        o, n = n, o
    out = o.join(n, list(key), "left_anti")
    if valid_terms is not None:
        out = out.join(valid_terms.select(F.col("term")).distinct(), "term", "left_semi")
    if score is not None:
        out = out.withColumn("prob", F.lit(score))
    return out


def evidence_split(data: DataFrame, codes: Sequence[str], train_ids: DataFrame, test_ids: DataFrame,
                   code_col: str = "source") -> DataFrame:
    """One pass that labels each distinct annotation with the splits it
    belongs to: ``test_leak`` (experimental code, entry in test only),
    ``train_other`` (non-experimental, entry in train), ``test_other``
    (non-experimental, entry in test).  A row can be in several splits."""
    d = data.distinct()
    tr = train_ids.select(F.col("entry")).distinct().withColumn("_tr", F.lit(True))
    te = test_ids.select(F.col("entry")).distinct().withColumn("_te", F.lit(True))
    j = d.join(tr, "entry", "left").join(te, "entry", "left")
    exp = F.col(code_col).isin(list(codes))
    in_tr, in_te = F.col("_tr").isNotNull(), F.col("_te").isNotNull()
    splits = F.array_compact(F.array(
        F.when(in_te & ~in_tr & exp, F.lit("test_leak")),
        F.when(in_tr & ~exp, F.lit("train_other")),
        F.when(in_te & ~exp, F.lit("test_other"))))
    return (j.select(*[c for c in data.columns], F.explode(splits).alias("split")))


def overlap_classes(a: DataFrame, b: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Counts and shares of pairs only in A, only in B, in both."""
    a2 = a.select(*key).distinct().withColumn("_a", F.lit(1))
    b2 = b.select(*key).distinct().withColumn("_b", F.lit(1))
    j = a2.join(b2, list(key), "full")
    cls = (F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both")
           .when(F.col("_a").isNotNull(), "only_a").otherwise("only_b"))
    counts = j.groupBy(cls.alias("class")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(whole))


def reconcile(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """One-row report of keys only left, only right, and common."""
    a2 = a.select(*key).distinct().withColumn("_a", F.lit(1))
    b2 = b.select(*key).distinct().withColumn("_b", F.lit(1))
    j = a2.join(b2, list(key), "full")
    return j.agg(F.count_if(F.col("_b").isNull()).alias("only_left"),
                 F.count_if(F.col("_a").isNull()).alias("only_right"),
                 F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"))


def weight_diff(old: DataFrame, new: DataFrame, key: str = "term", value: str = "ia",
                tol: float = 1e-6) -> DataFrame:
    """Weights that changed by more than ``tol`` or are zero/missing on one side."""
    o = old.select(key, F.col(value).alias("old"))
    n = new.select(key, F.col(value).alias("new"))
    j = o.join(n, key, "full")
    changed = F.abs(_z("old") - _z("new")) > tol
    zero_one_side = (_z("old") == 0) != (_z("new") == 0)
    return j.where(changed | zero_one_side).select(key, "old", "new", (_z("new") - _z("old")).alias("delta"))


def hit_label_transfer(hits: DataFrame, annotations: DataFrame, k: int = 5, max_evalue: float = 0.02,
                       score: str = "bits") -> DataFrame:
    """J16 (re-aimed similarity join): for each query take its k best hits by
    ``score`` with evalue <= ``max_evalue`` (ties by target), transfer the
    targets' terms, scoring a term by the best hit identity carrying it.
    ``annotations`` are (entry, term) of the targets.

    A target's terms travel to a hit, and from there to its query, as one row; they are unfolded where all hits of a query
    lie.  Partitions grow with the hits."""
    from pyspark.sql import Window
    n = parts_of(hits.sparkSession, hits.count(), TRANSFER_HITS)
    h = hits.where(F.col("evalue") <= max_evalue).select("query", "target", "identity", score)
    w = Window.partitionBy("query").orderBy(F.col(score).desc(), F.col("target").asc())
    top = h.repartition(n, "query").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).select("query", "target", "identity")
    a = annotations.select(F.col("entry").alias("target"), "term").where("target is not null")
    a = a.repartition(n, "target").groupBy("target").agg(F.collect_set("term").alias("_terms"), F.max(F.col("term").isNull()).alias("_none"))  # a set has no null
    a = a.select("target", F.when(F.col("_none"), F.concat("_terms", F.array(F.lit(None)))).otherwise(F.col("_terms")).alias("_terms"))
    met = top.where("target is not null").repartition(n, "target").join(a, "target").select("query", "identity", "_terms").repartition(2 * n, "query")
    return met.select(F.col("query").alias("entry"), "identity", F.explode("_terms").alias("term")).groupBy("entry", "term").agg(
        F.max("identity").alias("prob"), F.count("*").alias("n_hits"))
