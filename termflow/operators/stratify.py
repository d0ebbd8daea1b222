"""Multi-label stratified folds (E14): iterative stratification in rounds.

Each round takes the open label with the fewest entities left and deals all of
them at once, in hash order, by what the folds still lack of that label.  The
driver holds a count a fold and label (``top`` x ``k`` numbers); entities stay
in a table that is stored once a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import key_hash
from ..session import drop_table, write_table


def shares(n: int, total: int, got: list[int], sizes: list[int]) -> list[int]:
    """How many of ``n`` entities each fold takes: in proportion to what it lacks of an even share of ``total``, of which it
    has ``got``; remainders go to the largest fractions, then the smaller fold (``sizes``), then the lower number."""
    k = len(got)
    lack = [max(total - k * g, 0) for g in got]
    whole = sum(lack)
    if not whole:
        lack, whole = [1] * k, k
    out = [n * w // whole for w in lack]
    order = sorted(range(k), key=lambda f: (-(n * lack[f] % whole), sizes[f], f))
    for f in order[:n - sum(out)]:
        out[f] += 1
    return out


def stratified_label_folds(labels: DataFrame, k: int = 5, top: int = 32, seed: int = 42, entity: str = "entry", term: str = "term") -> DataFrame:
    """(entity, fold) for every entity of ``labels`` (entity, term).

    The ``top`` most frequent labels (ties by term) are balanced; what is left without one of them is dealt last, by the sizes of the folds.
    Entities go in the order of (hash, entity); no group is sorted as a whole: ranks are places in a range of
    the hash order plus the counts of the ranges before it.
    """
    pairs = labels.select(F.col(entity).alias("e"), F.col(term).alias("t")).distinct()
    freq = pairs.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    picked = [r.t for r in freq.orderBy(F.desc("n"), "t").limit(top).collect()]
    number = F.create_map(*[x for i, t in enumerate(picked) for x in (F.lit(t), F.lit(i))]) if picked else F.lit(None).cast("map<string,int>")
    owned = pairs.groupBy("e").agg(F.array_sort(F.array_compact(F.collect_list(F.try_element_at(number, F.col("t"))))).alias("own")) if picked else pairs.select("e").distinct().withColumn("own", F.array().cast("array<int>"))
    order = (F.col("h"), F.col("e"))
    state = write_table(owned.withColumn("h", key_hash("e", seed=seed)).repartitionByRange(*order).sortWithinPartitions(*order)
                        .select("e", "h", "own", F.spark_partition_id().alias("part"), F.lit(None).cast("int").alias("fold")))
    while True:
        counts = state.select("fold", F.explode_outer("own").alias("l")).groupBy("l", "fold").agg(F.count(F.lit(1)).alias("n")).collect()
        sizes = {r.fold: r.n for r in state.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
        if None not in sizes:
            return state.select(F.col("e").alias(entity), "fold")
        now = {(r.l, r.fold): r.n for r in counts}
        open_ = {l: n for (l, f), n in now.items() if f is None and l is not None}
        label = min(open_, key=lambda l: (open_[l], l)) if open_ else None
        n = open_[label] if open_ else sizes[None]
        fold_sizes = [sizes.get(f, 0) for f in range(k)]
        got = [now.get((label, f), 0) for f in range(k)] if open_ else fold_sizes
        ends, upto = [], 0
        for s in shares(n, n + sum(got), got, fold_sizes):
            upto += s
            ends.append(upto)
        turn = F.col("fold").isNull() & (F.array_contains("own", label) if open_ else F.lit(True))
        dealt = state.where(turn)
        before = {}
        upto = 0
        for r in sorted(dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):  # a number a range
            before[r.part], upto = upto, upto + r.n
        first = F.element_at(F.create_map(*[x for p, b in before.items() for x in (F.lit(p), F.lit(b))]), F.col("part"))
        rank = first + F.row_number().over(Window.partitionBy("part").orderBy(*order))
        fold = F.lit(k - 1)
        for f in range(k - 2, -1, -1):
            fold = F.when(F.col("rank") <= ends[f], f).otherwise(fold)
        dealt = dealt.withColumn("rank", rank).withColumn("fold", fold.cast("int")).drop("rank")
        new = write_table(state.where(~turn).unionByName(dealt))
        drop_table(state)
        state = new
