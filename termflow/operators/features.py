"""Feature, vocabulary, label and fold construction (E*, J11-J14).

Vocabularies are small dimension tables (species, ranks, labels); their dense
indexes use a window.  Large id sets (entries) get dense ids, and whole tables
running sums, from range partitions: the value within a range plus the totals of the
ranges before it, so no task holds more than a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from ..functions.scalar import key_hash
from ..session import broadcast_if_small, write_table


def dense_ids(df: DataFrame, col: str, out: str = "idx") -> DataFrame:
    """W15 for large id sets: 0-based dense index in sorted order of ``col``.

    The distinct ids are dealt by range and stored sorted; a row's index is its
    place in its range plus the sizes of the ranges before it, so only one
    small row a range goes through a single task."""
    ids = df.select(col).distinct().repartitionByRange(F.col(col).asc_nulls_first()).sortWithinPartitions(F.col(col).asc_nulls_first())
    ids = write_table(ids.withColumn("_part", F.spark_partition_id()))
    sizes = ids.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(col).asc_nulls_first())) - 1
    return ids.withColumn("_in", inside).join(first, "_part").select(col, (F.col("_first") + F.col("_in")).cast("long").alias(out))


def running_sum(df: DataFrame, order: list[str], value: str, out: str = "upto") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to each, in the order of ``order`` (which must tell rows apart), and its
    place (from 0) as ``out_no``.  Rows are dealt by range and stored; a row's sum is that within its range plus the sums of the
    ranges before it, so only one small row a range goes through a single task."""
    parts = write_table(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    inside = Window.partitionBy("_part").orderBy(*order)
    upto = F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    got = parts.withColumn("_in", upto).withColumn("_nth", F.row_number().over(inside) - 1).join(F.broadcast(first), "_part")
    return got.withColumn(out, F.col("_s0") + F.col("_in")).withColumn(f"{out}_no", F.col("_n0") + F.col("_nth")).drop("_part", "_in", "_nth", "_s0", "_n0")


def vocabulary(values: DataFrame, col: str, min_count: int = 1, top_k: int | None = None,
               rare_bucket: bool = True, start: int = 0) -> DataFrame:
    """Value -> index by descending frequency (ties by value).
    Values below ``min_count`` (or beyond ``top_k``) share one rare index
    (K + start) when ``rare_bucket``, else they are left out (unknown)."""
    c = values.groupBy(col).agg(F.count("*").alias("count"))
    w = Window.orderBy(F.col("count").desc(), F.col(col).asc())
    r = c.withColumn("_rk", F.row_number().over(w))
    keep = F.col("count") >= min_count
    if top_k is not None:
        keep = keep & (F.col("_rk") <= top_k)
    kept = r.where(keep)
    k = kept.agg(F.count("*")).scalar()
    out = kept.select(col, "count", (F.col("_rk") - 1 + start).cast("int").alias("idx"))
    if rare_bucket:
        rare = r.where(~keep).select(col, "count", (k + start).cast("int").alias("idx"))
        out = out.unionByName(rare)
    return out


def rank_vocabulary(lineage: DataFrame, rank_col: str, unknown: str = "unknown") -> DataFrame:
    """Null -> ``unknown`` = 0, the other values sorted from 1."""
    vals = lineage.select(F.col(rank_col).alias("value")).where(F.col("value").isNotNull()).distinct()
    w = Window.orderBy("value")
    known = vals.select("value", F.row_number().over(w).cast("int").alias("idx"))
    unk = lineage.sparkSession.createDataFrame([(unknown, 0)], "value string, idx int")
    return unk.unionByName(known)


def encode(df: DataFrame, col: str, vocab: DataFrame, unknown_idx: int | None = None,
           out: str = "idx") -> DataFrame:
    """Left join the vocabulary (broadcast when small); unknown values
    get ``unknown_idx`` (or stay null)."""
    v = broadcast_if_small(vocab.select(F.col(vocab.columns[0]).alias("_v"), F.col("idx").alias("_idx")))
    j = df.join(v, F.col(col) == F.col("_v"), "left")
    val = F.col("_idx") if unknown_idx is None else F.coalesce("_idx", F.lit(unknown_idx))
    return j.select(*df.columns, val.alias(out))


def stratified_folds(df: DataFrame, key: str, stratum: Sequence[str] | str, k: int = 5,
                     seed: int = 42) -> DataFrame:
    """Within each stratum, order rows by a seeded hash of the key
    and deal them round-robin into k folds (so every stratum is spread evenly).
    A stratum is one window partition, so it is sorted in one task; strata
    should be many and small (e.g. label count x hash bucket), see
    ``salted_strata``."""
    strata = [stratum] if isinstance(stratum, str) else list(stratum)
    h = F.xxhash64(F.col(key), F.lit(seed))
    w = Window.partitionBy(*strata).orderBy(h, F.col(key))
    return df.withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("int"))


def int_hash(key, seed: int = 42):
    """Repeatable integer hash of an integer key (Park-Miller multiplier; the key
    is reduced first, so that any 64-bit key stays exact)."""
    c = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.pmod(c.cast("long"), F.lit(2147483647)) * 48271 + seed, F.lit(2147483647))


#: Rows of a (stratum, hash bucket) that one window sorts, at most, on average.
FOLD_BUCKET_ROWS = 1_000_000


def salted_folds(df: DataFrame, key: str, stratum: str, k: int = 5, buckets: int | None = None,
                 seed: int = 42) -> DataFrame:
    """E12 at scale: each stratum is split into ``buckets`` hash buckets (so no
    window partition holds a whole large stratum; by default 16, or more where the counted rows need them); inside a (stratum, bucket)
    rows are ordered by the hash and dealt round-robin into k folds, starting
    at the bucket number so the buckets do not all favour fold 0."""
    buckets = buckets or max(16, -(-df.count() // FOLD_BUCKET_ROWS))
    h = int_hash(key, seed)
    b = F.pmod(h, F.lit(buckets))
    w = Window.partitionBy(stratum, "_b").orderBy("_h", key)
    return (df.withColumn("_h", h).withColumn("_b", b)
            .withColumn("fold", F.pmod(F.row_number().over(w) - 1 + F.col("_b"), F.lit(k)).cast("int"))
            .drop("_h", "_b"))


def hash_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Plain seeded k-fold by a hash bucket of the key (no shuffle)."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(k)).cast("int"))


def group_folds(df: DataFrame, key: str, group_key, k: int = 5, seed: int = 42) -> DataFrame:
    """Grouped k-fold -- rows with the same group key (e.g. the hash of an
    identical vector) share a fold: the fold is a seeded hash of the group key."""
    return df.withColumn("fold", F.pmod(key_hash(group_key, seed=seed), F.lit(k)).cast("int"))


def fold_split(df: DataFrame, folds: DataFrame, fold: int, part: str, key: str = "entry") -> DataFrame:
    """Train (fold != f), val (fold == f), trainval (all with a fold)."""
    j = df.join(folds.select(key, "fold"), key)
    if part == "train":
        j = j.where(F.col("fold") != fold)
    elif part == "val":
        j = j.where(F.col("fold") == fold)
    return j.drop("fold")


def align(source: DataFrame, reference: DataFrame, ref_id: str = "id", src_id: str = "id",
          ord_col: str = "ord") -> DataFrame:
    """Reorder source rows to the reference id order after cleaning ids;
    duplicate source ids keep the last one (highest source ``ord``)."""
    from ..functions.scalar import clean_id
    src = (source.withColumn("_cid", clean_id(src_id))
           .groupBy("_cid").agg(F.max_by(F.struct(*[c for c in source.columns if c not in (src_id, ord_col)]),
                                         F.col(ord_col)).alias("_v")))
    ref = reference.select(clean_id(ref_id).alias("_cid"), F.col(ord_col).alias("ref_ord"))
    return ref.join(src, "_cid", "left").select(F.col("_cid").alias("id"), "ref_ord", "_v.*")


def rarest_label_strata(labels: DataFrame, top: int = 32, entity: str = "entry", term: str = "term") -> DataFrame:
    """E14 (approximation of iterative multi-label stratification): among the
    ``top`` most frequent labels, each entity's stratum is its rarest label
    (ties by term); entities without one of them form stratum -1."""
    freq = labels.groupBy(term).agg(F.count("*").alias("_f"))
    w = Window.orderBy(F.col("_f").desc(), F.col(term).asc())
    topl = freq.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    j = labels.join(F.broadcast(topl), term)
    s = j.groupBy(entity).agg(F.min_by(term, F.struct("_f", term)).alias("stratum"))
    ents = labels.select(entity).distinct()
    return ents.join(s, entity, "left").select(entity, F.coalesce("stratum", F.lit(-1)).alias("stratum"))


def top_k_one_hot(df: DataFrame, col: str, k: int) -> DataFrame:
    """``df`` with ``idx``, the place of ``col`` among its ``k`` most frequent values (-1 for others), and ``onehot``, its vector of
    ``k`` entries (all zeros for -1)."""
    v = vocabulary(df, col, top_k=k, rare_bucket=False).select(F.col(col).alias("_v"), "idx")
    j = df.join(F.broadcast(v), F.col(col) == F.col("_v"), "left").withColumn("idx", F.coalesce("idx", F.lit(-1)))
    return j.withColumn("onehot", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == F.col("idx")).cast("int"))).drop("_v")


def regroup_columns(labels: DataFrame, terms: DataFrame) -> DataFrame:
    """Columns (term, old) of a label matrix regrouped by (namespace, term): (namespace, term, old, new).  Columns whose
    term is not in ``terms`` go, and the others close up."""
    j = labels.join(terms.select("term", "namespace"), "term").withColumn("_one", F.lit(1))
    return running_sum(j, ["namespace", "term"], "_one", "_upto").select("namespace", "term", "old", F.col("_upto_no").alias("new"))


def species_one_hot(df: DataFrame, taxon: str, species: list, out: str = "species_onehot") -> DataFrame:
    """E5: a fixed species list -> one-hot of width len+1; position 0 = other."""
    from ..functions.scalar import one_hot
    idx = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in species]), F.col(taxon)).cast("int"), F.lit(0))
    return df.withColumn(out, one_hot(idx, len(species) + 1))
