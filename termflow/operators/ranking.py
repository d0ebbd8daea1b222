"""Ranking, top-k, running-window and label-selection operators (W*, L*).

Every ranking orders by the score and then by a unique id column, so ties are
deterministic and equal to the SQL oracles.  ``row_number() <= k`` filters are
planned by Spark with a partial ``WindowGroupLimit`` before the shuffle, so a
hot group sends at most k rows per map task to the final window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import key_hash
from ..session import broadcast_if_small, ship_package


def _cols(c):
    return [c] if isinstance(c, str) else list(c)


def top_k(df: DataFrame, group: str | Sequence[str], order: str, k: int,
          tie: str | Sequence[str] = (), rank_col: str = "rank", descending: bool = True) -> DataFrame:
    """The first ``k`` rows per group by ``order`` (then ``tie``),
    with a 1-based ``rank_col``."""
    o = F.col(order).desc() if descending else F.col(order).asc()
    w = Window.partitionBy(*_cols(group)).orderBy(o, *[F.col(t).asc() for t in _cols(tie)])
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def dense_rank_cut(df: DataFrame, group: str | Sequence[str], order: str, k: int,
                   rank_col: str = "rank", distinct_values: bool = False, together: str | None = None) -> DataFrame:
    """Keep rows whose 0-based dense rank (by ``order`` descending) is < k.

    Default: ``dense_rank() <= k`` -- Spark plans a partial WindowGroupLimit
    before the shuffle, so each map task forwards only the rows holding the
    top-k distinct values of each group.

    ``distinct_values=True`` (for groups with huge runs of tied values): the dense rank of a row is the position of its value among
    the *distinct* values of its group.  Distinct values are found first
    (partial aggregation), the first k of them per group are ranked (window
    group limit bounds what reaches one task), and rows are matched back with
    an equi-join on (group, value).  No group is ever sorted whole.

    ``together``: one of the group's columns, all rows of whose every value lie side by side in one
    partition (as a propagation leaves the cells of an entry): they are ranked there and cross no exchange.  What comes straight from
    ``propagate_max`` with the names of its terms is ranked in the task that propagates it.
    """
    g = _cols(group)
    inside = getattr(df, "_ranked", None)
    if together is not None and inside is not None and (got := inside(g, order, k, rank_col)) is not None:
        return got
    if together is not None:
        ship_package(df.sparkSession)
        return df.mapInArrow(lambda batches: _ranked(batches, together, g, order, k, rank_col),
                             ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{rank_col}` int")
    if not distinct_values:
        w = Window.partitionBy(*g).orderBy(F.col(order).desc())
        return (df.withColumn(rank_col, F.dense_rank().over(w)).where(F.col(rank_col) <= k)
                .withColumn(rank_col, F.col(rank_col) - 1))
    vals = df.select(*g, order).distinct()
    w = Window.partitionBy(*g).orderBy(F.col(order).desc())
    top = vals.withColumn(rank_col, F.row_number().over(w) - 1).where(F.col(rank_col) < k)
    return df.join(top, [*g, order])


#: Rows that a task ranks at a time, whole values of ``together``.
CHUNK_ROWS = 1 << 16


def _codes(column) -> np.ndarray:
    return pc.dictionary_encode(column.combine_chunks(), null_encoding="encode").indices.to_numpy().astype(np.int64)


def _runs(column) -> np.ndarray:
    """The number of the run of equal neighbours that each row lies in."""
    column = column.combine_chunks()
    same = pc.equal(column.slice(1), column.slice(0, max(len(column) - 1, 0))).fill_null(False).to_numpy(zero_copy_only=False)
    if column.null_count:
        null = column.is_null().to_numpy(zero_copy_only=False)
        same = same | null[1:] & null[:-1]
    return np.cumsum(np.r_[False, ~same][:len(column)])


def dense_ranks(key: np.ndarray, x: np.ndarray, null: np.ndarray | None = None) -> np.ndarray:
    """The 0-based dense rank of every row among those of its key, by falling ``x`` (NaN first, null last)."""
    nan = np.isnan(x)
    values, place = np.unique(np.where(nan, 0.0, x) if nan.any() else x, return_inverse=True)
    place = np.where(nan, 0, len(values) - place)
    if null is not None:
        place[null] = len(values) + 1
    if int(key.max(initial=0)) + 1 > (1 << 62) // (len(values) + 2):
        key = np.unique(key, return_inverse=True)[1]
    cell = key * (len(values) + 2) + place
    at = np.argsort(cell)
    cell, key = cell[at], key[at]
    step = np.cumsum(np.r_[True, cell[1:] != cell[:-1]][:len(cell)])
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
    rank = np.empty(len(at), np.int32)
    rank[at] = step - np.repeat(step[first], np.diff(np.r_[first, len(key)]))
    return rank


def _ranked(batches, together: str, group: list[str], order: str, k: int, rank_col: str):
    """The rows of rank below k with their dense rank by falling ``order`` (NaN first, null last)."""
    def ranked(t: pa.Table) -> pa.Table:
        key = _runs(t[together])
        for c in group:
            if c != together:
                code = _codes(t[c])
                key = key * (int(code.max(initial=0)) + 1) + code
        x = t[order].cast(pa.float64()).to_numpy()
        rank = dense_ranks(key, x, t[order].is_null().to_numpy())
        return t.append_column(rank_col, pa.array(rank)).filter(pa.array(rank < k)) if (rank >= k).any() else t.append_column(rank_col, pa.array(rank))

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK_ROWS:
            t = pa.Table.from_batches(held).combine_chunks()
            last = int(np.searchsorted(run := _runs(t[together]), run[-1]))  # the value that may go on
            if last:
                yield from ranked(t.slice(0, last)).to_batches()
            held, n = t.slice(last).to_batches(), t.num_rows - last
    if n:
        yield from ranked(pa.Table.from_batches(held)).to_batches()


def ranked_quota(df: DataFrame, entity: str, aspect: str, order: str, quotas: dict,
                 default_k: int, tie: str) -> DataFrame:
    """Top-k per (entity, aspect) with a per-aspect quota (default for the
    others), merged per entity and ranked by score."""
    spark = df.sparkSession
    q = spark.createDataFrame([(a, int(k)) for a, k in quotas.items()], f"{aspect} long, _quota int")
    w = Window.partitionBy(entity, aspect).orderBy(F.col(order).desc(), F.col(tie).asc())
    ranked = (df.join(F.broadcast(q), aspect, "left")
              .withColumn("_rn", F.row_number().over(w))
              .where(F.col("_rn") <= F.coalesce("_quota", F.lit(default_k))))
    w2 = Window.partitionBy(entity).orderBy(F.col(order).desc(), F.col(tie).asc())
    return ranked.drop("_quota", "_rn").withColumn("rank", F.row_number().over(w2))


def keep_max(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Highest value per key (aggregate form, map-side combined)."""
    return df.groupBy(*keys).agg(F.max(value).alias(value))


def keep_first(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """The value of the first row per key by ``order`` (``min_by``)."""
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def running_share(df: DataFrame, order: str, tie: str, value: str) -> DataFrame:
    """1-based rank, running sum, running share and running min of
    ``value`` over a global order (``df`` is an already aggregated, small
    per-label table).

    Spark evaluates an un-partitioned window in one task; the input here is a
    per-label frequency table (one row per label), not fact data.
    """
    w = Window.orderBy(F.col(order).desc(), F.col(tie).asc())
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (df.withColumn("_tot", F.sum(value).over(whole))
            .withColumn("rank", F.row_number().over(w))
            .withColumn("cum", F.sum(value).over(run))
            .withColumn("cum_pct", F.col("cum") * 100.0 / F.col("_tot"))
            .withColumn("run_min", F.min(value).over(run))
            .drop("_tot"))


def moving_average(df: DataFrame, order: str, tie: str, value: str, width: int) -> DataFrame:
    """Trailing mean over ``width`` rows, null until the window is full."""
    w = Window.orderBy(F.col(order).desc(), F.col(tie).asc())
    return (df.withColumn("rank", F.row_number().over(w))
            .withColumn("moving_avg", F.when(F.col("rank") >= width,
                                             F.avg(value).over(w.rowsBetween(-(width - 1), 0)))))


def select_labels(freq: DataFrame, term: str, score: str, k: int | None, group: str | None = None,
                  min_freq: int | None = None, freq_col: str = "n", skip_top: int = 0) -> DataFrame:
    """Label selection -- optional min-frequency filter, then ranks
    ``skip_top+1 .. k`` (None: to the last) by ``score`` (ties by term), globally or per ``group``."""
    f = freq if min_freq is None else freq.where(F.col(freq_col) >= min_freq)
    w = (Window.partitionBy(group) if group else Window).orderBy(F.col(score).desc(), F.col(term).asc())
    return (f.withColumn("rank", F.row_number().over(w))
            .where((F.col("rank") > skip_top) & (F.lit(True) if k is None else F.col("rank") <= k)))


def suffix_sum(df: DataFrame, group: str | Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Total minus running sum -- the sum over strictly larger ``order``."""
    w = Window.partitionBy(*_cols(group)).orderBy(F.col(order).desc())
    return df.withColumn(out, F.coalesce(F.sum(value).over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def dense_index(df: DataFrame, col: str, order: str = "value", freq_col: str | None = None,
                out: str = "idx", start: int = 0) -> DataFrame:
    """Dense index of the distinct values of a *vocabulary-sized* column,
    in sorted order (``order='value'``) or by descending frequency (ties by
    value).  Returns (value, idx)."""
    if order == "value":
        vals = df.select(col).distinct()
        w = Window.orderBy(F.col(col).asc())
    else:
        vals = df.groupBy(col).agg(F.count("*").alias("_n"))
        w = Window.orderBy(F.col("_n").desc(), F.col(col).asc())
    return vals.select(col, (F.row_number().over(w) - 1 + start).alias(out))


def seeded_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of n rows: smallest hash of the integer keys."""
    return df.orderBy(key_hash(*key, seed=seed), *key).limit(n)


def hash_fraction(df: DataFrame, key: Sequence[str], frac: float, seed: int = 42) -> DataFrame:
    """Repeatable x % subsample by a hash bucket of the key."""
    h = F.pmod(key_hash(*key, seed=seed), F.lit(1_000_000))
    return df.where(h < int(frac * 1_000_000))


def allow_list(df: DataFrame, allowed: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows whose key stands on an allow-list."""
    return df.join(allowed.select(*key), list(key), "left_semi")


def sorted_places(df: DataFrame, order: Sequence[str], out: str = "place") -> DataFrame:
    """L1: every row's place (from 0) in a multi-key order that tells rows apart (``-col`` falls), by range partitions:
    the global order without a single task that holds it."""
    from .features import running_sum
    keys = {f"_k{i}": (-F.col(c[1:]) if c.startswith("-") else F.col(c)) for i, c in enumerate(order)}
    return running_sum(df.withColumns(keys).withColumn("_one", F.lit(1)), list(keys), "_one", "_upto").withColumnRenamed("_upto_no", out).select(*df.columns, out)
