"""Aggregations over annotation and score tables (A*).

All are grouped aggregates with map-side partial aggregation; distinct counts
use ``countDistinct`` (exact) with ``approx`` switches where the reference
only needs an estimate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frequency(df: DataFrame, cols: Sequence[str], name: str = "n") -> DataFrame:
    """Value counts."""
    return df.groupBy(*cols).agg(F.count("*").alias(name))


def group_stats(df: DataFrame, group: str, distinct_col: str, approx: bool = False) -> DataFrame:
    """Distinct members and rows per group."""
    dc = F.approx_count_distinct(distinct_col) if approx else F.countDistinct(distinct_col)
    return df.groupBy(group).agg(dc.alias(f"n_{distinct_col}"), F.count("*").alias("n_rows"))


def per_entity_summary(df: DataFrame, entity: str = "entry") -> DataFrame:
    """Rows per entity, then count/mean/std/min/max/quartiles of that count."""
    c = df.groupBy(entity).agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("entities"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"),
                 F.min("n").alias("min"), F.max("n").alias("max"),
                 F.percentile("n", 0.5).alias("median"))


def dominant_terms(df: DataFrame, share: float = 0.5, entity: str = "entry", term: str = "term") -> DataFrame:
    """A10: terms present in more than ``share`` of the entities."""
    cells = getattr(df, "_cells", None)
    if cells is None:
        cells = df.select(entity, term).distinct()
    n_ent = df.agg(F.countDistinct(entity)).scalar()
    per = cells.groupBy(term).agg(F.count(entity).alias("n_entities"))  # counted before the exchange where cells are distinct already
    return (per.select(term, "n_entities", (F.col("n_entities") / n_ent).alias("share"))
            .where(F.col("share") > share))


def vector_stats(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Element mean/std/min/max, mean L2 norm, NaN/Inf flags, abs max over a vector set."""
    norm = F.sqrt(F.aggregate(F.col(vec), F.lit(0.0), lambda acc, x: acc + F.pow(x.cast("double"), 2)))
    per_row = df.select(
        F.aggregate(F.col(vec), F.lit(0.0), lambda a, x: a + x.cast("double")).alias("_s"),
        F.aggregate(F.col(vec), F.lit(0.0), lambda a, x: a + F.pow(x.cast("double"), 2)).alias("_s2"),
        F.size(vec).alias("_n"), F.array_min(vec).alias("_mn"), F.array_max(vec).alias("_mx"),
        norm.alias("_norm"),
        F.exists(vec, lambda x: F.isnan(x)).alias("_nan"),
        F.exists(vec, lambda x: (x == float("inf")) | (x == float("-inf"))).alias("_inf"),
        F.aggregate(F.col(vec), F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double")))).alias("_absmax"))
    agg = per_row.agg(F.sum("_s").alias("s"), F.sum("_s2").alias("s2"), F.sum("_n").alias("n"),
                      F.min("_mn").alias("min"), F.max("_mx").alias("max"), F.avg("_norm").alias("mean_norm"),
                      F.max(F.col("_nan").cast("int")).alias("has_nan"),
                      F.max(F.col("_inf").cast("int")).alias("has_inf"), F.max("_absmax").alias("abs_max"),
                      F.count("*").alias("vectors"))
    mean = F.col("s") / F.col("n")
    return agg.select("vectors", mean.alias("mean"),
                      F.sqrt(F.col("s2") / F.col("n") - mean * mean).alias("std"),
                      F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max"),
                      "mean_norm", "has_nan", "has_inf", "abs_max")


def correlations(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson, and Spearman as Pearson of average (tie-averaged) ranks.

    The pairs are stored once, counted by distinct (a, b).  Ranks come from the *distinct* values of a side with their counts,
    by running counts over range partitions: no task holds more than a range of them."""
    from ..session import broadcast_if_small, write_table
    from .features import running_sum

    cells = write_table(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("_n")))

    def avg_rank(col):
        counts = running_sum(cells.groupBy(col).agg(F.sum("_n").alias("_c")), [col], "_c", "_upto")
        return broadcast_if_small(counts.select(col, (F.col("_upto") - (F.col("_c") - 1) / 2.0).alias(f"_rk_{col}")))

    ranked = cells.join(avg_rank(a), a).join(avg_rank(b), b)

    def corr(x, y):
        n, w = F.sum("_n"), F.col("_n")
        mx, my = F.sum(w * x) / n, F.sum(w * y) / n
        cov = F.sum(w * x * y) / n - mx * my
        return cov / F.sqrt((F.sum(w * x * x) / n - mx * mx) * (F.sum(w * y * y) / n - my * my))

    shift = cells.agg((F.sum("_n") / 2.0).alias("_mid"))  # ranks about their middle, so that no digits are lost in the squares
    ranked = ranked.crossJoin(F.broadcast(shift))  # one row
    return ranked.agg(corr(F.col(a), F.col(b)).alias("pearson"),
                      corr((F.col(f"_rk_{a}") - F.col("_mid")) / F.col("_mid"), (F.col(f"_rk_{b}") - F.col("_mid")) / F.col("_mid")).alias("spearman"))


def histogram(df: DataFrame, col: str, bins: int, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Equal-width histogram, the top edge falls in the last bin."""
    b = F.least(F.floor((F.col(col) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(col).between(lo, hi)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def jaccard_per_entity(a: DataFrame, b: DataFrame, min_score: float = 0.1, keep_above: float = 0.5,
                       entity: str = "entry", term: str = "term", value: str = "prob") -> DataFrame:
    """Jaccard *distance* between the term sets (score >= min_score) of two
    models per entity, from counts (no sets materialised); keep > keep_above."""
    sa = a.where(F.col(value) >= min_score).select(entity, term).distinct()
    sb = b.where(F.col(value) >= min_score).select(entity, term).distinct()
    na = sa.groupBy(entity).agg(F.count("*").alias("n_a"))
    nb = sb.groupBy(entity).agg(F.count("*").alias("n_b"))
    inter = sa.join(sb, [entity, term]).groupBy(entity).agg(F.count("*").alias("n_both"))
    j = (na.join(nb, entity, "full").join(inter, entity, "left")
         .select(entity, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"),
                 F.coalesce("n_both", F.lit(0)).alias("n_both")))
    dist = 1 - F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))
    return j.select("*", dist.alias("jaccard_dist")).where(F.col("jaccard_dist") > keep_above)


def priors(labels: DataFrame, entities: DataFrame, term: str = "term", label: str = "label") -> DataFrame:
    """A15 (D17): per term, prior = positives / non-null cells (0 if none),
    null rate = 1 - non-null / N, prior_raw = prior * (1 - null rate).
    ``labels`` holds only non-null cells; N = distinct ``entities``."""
    n = entities.select("entry").distinct().agg(F.count("*")).scalar()
    g = labels.groupBy(term, "namespace").agg(F.sum(label).alias("_pos"), F.count("*").alias("_nn"))
    prior = F.when(F.col("_nn") > 0, F.col("_pos") / F.col("_nn")).otherwise(F.lit(0.0))
    null_rate = 1 - F.col("_nn") / n
    return g.select(term, "namespace", prior.alias("prior"), null_rate.alias("null_rate"),
                    (prior * (1 - null_rate)).alias("prior_raw"))


def entities_in_all(df: DataFrame, group_col: str = "aspect", n: int = 3, entity: str = "entry") -> DataFrame:
    """Entities annotated in all ``n`` aspects."""
    return df.groupBy(entity).agg(F.countDistinct(group_col).alias("_k")).where(F.col("_k") == n).select(entity)


def qa_counters(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Rows, null / NaN values, duplicated keys (rows beyond the first)."""
    dup = df.groupBy(*key).agg(F.count("*").alias("_c")).agg(F.sum(F.col("_c") - 1)).scalar()
    return df.agg(F.count("*").alias("rows"), F.count_if(F.col(value).isNull()).alias("nulls"),
                  F.count_if(F.isnan(value)).alias("nans"), dup.alias("duplicates"))


def weight_counters(weights: DataFrame, value: str = "ia") -> DataFrame:
    """Share of weights > 0, count of zero and NaN weights."""
    return weights.agg(F.count("*").alias("terms"),
                       (F.count_if(F.col(value) > 0) / F.count("*")).alias("share_positive"),
                       F.count_if(F.col(value) == 0).alias("zero"), F.count_if(F.isnan(value)).alias("nan"))


def first_k_means(hits: DataFrame, group: str, order: str, measures: Sequence[str],
                  ks: Sequence[int] = (1, 3, 5, 10), tie: str | None = None, requested: DataFrame | None = None) -> DataFrame:
    """Per group, rank hits by ``order`` desc and average each measure
    over the first k hits for each k; plus the best hit's value and the hit count.

    Only the first hits are ranked (tasks pass on no more than the largest k of a group); counts are summed apart.
    With ``requested`` (a table of group ids) every id has a row, zeros where it has no hit."""
    w = Window.partitionBy(group).orderBy(F.col(order).desc(), *([F.col(tie).asc()] if tie else []))
    first = hits.select(group, order, *([tie] if tie else []), *measures).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max(ks))
    means = first.groupBy(group).agg(*[F.avg(F.when(F.col("_rn") <= k, F.col(m))).alias(f"{m}_top{k}_mean") for m in measures for k in ks])
    counts = hits.groupBy(group).agg(F.count(F.lit(1)).alias("n_hits"), F.max(order).alias(f"best_{order}"))
    out = counts.join(means, group)
    if requested is None:
        return out
    names = [c for c in out.columns if c != group]
    return requested.select(group).distinct().join(out, group, "left").select(group, *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def soft_f1(df: DataFrame, y: str = "y", p: str = "p", term: str = "term", eps: float = 1e-8) -> DataFrame:
    """Label-wise soft F1 = 2tp / (2tp + fp + fn + eps), averaged over labels."""
    per = df.groupBy(term).agg(F.sum(F.col(y) * F.col(p)).alias("tp"),
                               F.sum((1 - F.col(y)) * F.col(p)).alias("fp"),
                               F.sum(F.col(y) * (1 - F.col(p))).alias("fn"))
    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn") + eps)
    return per.agg(F.avg(f1).alias("soft_f1"), F.count("*").alias("labels"))


def masked_bce(df: DataFrame, y: str = "label", p: str = "prob", eps: float = 1e-7) -> DataFrame:
    """Mean BCE over non-null labels, and the null-ignoring base rate as log-odds."""
    pc = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    loss = -(F.col(y) * F.log(pc) + (1 - F.col(y)) * F.log(1 - pc))
    m = F.avg(F.col(y))
    return df.where(F.col(y).isNotNull()).agg(F.avg(loss).alias("bce"), F.count("*").alias("cells"),
                                              m.alias("base_rate"), F.log(m / (1 - m)).alias("base_logit"))


def asymmetric_loss(df: DataFrame, y: str, logit: str, pos_weight: str | None = None,
                    gamma_pos: float = 0.0, gamma_neg: float = 4.0, clip: float = 0.05,
                    eps: float = 1e-8) -> DataFrame:
    """Summed asymmetric loss with optional per-label positive weights.
    gamma = 0 and clip = 0 reduce it to (weighted) binary cross-entropy."""
    p = 1 / (1 + F.exp(-F.col(logit)))
    pm = F.least(p + clip, F.lit(1.0)) if clip > 0 else p
    lp = F.col(y) * F.log(F.greatest(p, F.lit(eps))) * F.pow(1 - p, gamma_pos)
    ln = (1 - F.col(y)) * F.log(F.greatest(1 - pm, F.lit(eps))) * F.pow(pm, gamma_neg)
    if pos_weight:
        lp = lp * F.col(pos_weight)
    return df.agg(F.sum(-(lp + ln)).alias("loss"))


def cutoff_profile(df: DataFrame, cutoffs: Sequence[float], entity: str = "entry", value: str = "prob") -> DataFrame:
    """Per cut-off: entities left, mean / 95th percentile / max rows per entity.

    An entity's rows at all cut-offs are counted in one aggregate; what follows are the few distinct counts of a cut-off."""
    per = df.groupBy(entity).agg(*[F.count_if(F.col(value) >= float(c)).alias(f"_n{i}") for i, c in enumerate(cutoffs)])
    each = F.inline(F.array(*[F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"_n{i}").alias("_n")) for i, c in enumerate(cutoffs)]))
    often = per.select(each).where(F.col("_n") > 0).groupBy("cutoff", "_n").agg(F.count("*").alias("_often"))
    return often.groupBy("cutoff").agg(F.sum("_often").alias("entities"), (F.sum(F.col("_n") * F.col("_often")) / F.sum("_often")).alias("mean_rows"),
                                       F.percentile("_n", 0.95, F.col("_often")).alias("p95_rows"), F.max("_n").alias("max_rows"))


def score_quantiles(df: DataFrame, qs: Sequence[float], value: str = "prob") -> DataFrame:
    """Exact (linear) score quantiles."""
    return df.agg(*[F.percentile(value, q).alias(f"q{int(round(q * 100))}") for q in qs])
