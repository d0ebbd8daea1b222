"""Ontology (term DAG) operators over long sparse score tables.

Inputs are always long tables: scores ``(entry, term, <value>)`` where a missing
row means 0, and the DAG as ``edges(child, parent)``.  Nothing is densified.

Two execution forms are used:

* **level form** -- cells are dealt by entry once and values travel level by
  level along a broadcast graph inside a task (``levelwise``); where the graph is
  too large to broadcast, one join a level.
* **closure form** -- join with the (reflexive) transitive closure, then one
  aggregate.  Max- and min-propagation, labels, negative propagation and
  parent >= child over a graph that cannot be broadcast or has cycles.

What follows a max-propagation inside an entry (blend, marginals, suppression,
ternary labels) starts from the unpropagated cells (``Lifted``) and is worked out
in the task that propagates them.

Loop-control counts are the only values that reach the driver.  Lineage is cut
with reliable checkpoints in the session's checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_MAX_BYTES, PAIR_BYTES, broadcast_if_small, broadcast_terms, cut_lineage, parts_of, write_buckets, write_table
from .levelwise import Graph, run_levels, send

ENTRY, TERM = "entry", "term"

#: Cells of a partition where they meet edges.
STEP_CELLS = 1 << 20


# ------------------------------------------------------------------ graph build

def restrict_edges(edges: DataFrame, terms: DataFrame, alt_ids: DataFrame | None = None) -> DataFrame:
    """G1: keep child->parent edges whose child and parent are known terms of the
    same namespace (an edge leaving the namespace is dropped).  With
    ``alt_ids(alt_id, term)`` ends that are alternative ids stand for their terms."""
    if alt_ids is not None:
        edges = resolve_aliases(edges, alias_map(terms, alt_ids), "child", "parent").distinct()
    t = terms.select(F.col(TERM).alias("_t"), F.col("namespace").alias("_ns"))
    tc = t.select(F.col("_t").alias("child"), F.col("_ns").alias("_cns"))
    tp = t.select(F.col("_t").alias("parent"), F.col("_ns").alias("_pns"))
    return (edges.join(tc, "child").join(tp, "parent")
            .where(F.col("_cns") == F.col("_pns"))
            .select("child", "parent"))


def alias_map(terms: DataFrame, alt_ids: DataFrame | None = None) -> DataFrame:
    """G1: (term_id, term) -- every id and alternative id mapped to its term."""
    base = terms.select(F.col(TERM).alias("term_id"), F.col(TERM))
    if alt_ids is None:
        return base
    return base.unionByName(alt_ids.select(F.col("alt_id").alias("term_id"), F.col(TERM))).distinct()


def resolve_aliases(df: DataFrame, aliases: DataFrame, *columns: str) -> DataFrame:
    """Replace alternative ids in ``columns`` by their terms; rows whose
    id is unknown to ``aliases(term_id, term)`` go."""
    for c in columns:
        a = aliases.select(F.col("term_id").alias("_id"), F.col(TERM).alias("_to"))
        df = df.join(a, F.col(c) == F.col("_id")).withColumn(c, F.col("_to")).drop("_id", "_to")
    return df


def induced_edges(edges: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The edges with both ends in a label vocabulary (``term``)."""
    v = vocabulary.select(TERM).distinct()
    return (edges.join(v.withColumnRenamed(TERM, "child"), "child", "left_semi").join(v.withColumnRenamed(TERM, "parent"), "parent", "left_semi")
            .select("child", "parent"))


def terms_of_interest(terms: DataFrame, edges: DataFrame | None = None, mode: str = "weight") -> DataFrame:
    """``all`` terms, those ``with_parents``, or those of positive ``weight``.  Where weights are known they are
    usually what decides; the mode says which holds."""
    if mode == "all":
        return terms
    if mode == "with_parents":
        return terms.join(edges.select(F.col("child").alias(TERM)).distinct(), TERM, "left_semi")
    if mode == "weight":
        return terms.where(F.col("ia") > 0)
    raise ValueError(mode)


def aspect_filter(df: DataFrame, aspect, col: str = "aspect") -> DataFrame:
    """P5: rows of one aspect; ``ALL`` keeps every row."""
    return df if aspect == "ALL" else df.where(F.col(col) == aspect)


def roots(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """Terms without a parent edge."""
    return terms.select(TERM).join(edges.select(F.col("child").alias(TERM)), TERM, "left_anti")


def leaves(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """Terms that are nobody's parent."""
    return terms.select(TERM).join(edges.select(F.col("parent").alias(TERM)), TERM, "left_anti")


def edge_list(edges: DataFrame, direction: str = "fwd", self_loops: bool = False,
              terms: DataFrame | None = None) -> DataFrame:
    """(src, dst) edges; fwd = child->parent, bwd = parent->child, all = both."""
    fwd = edges.select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    bwd = edges.select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    out = {"fwd": fwd, "bwd": bwd, "all": fwd.unionByName(bwd)}[direction]
    if self_loops:
        if terms is None:
            raise ValueError("self_loops needs the term table")
        out = out.unionByName(terms.select(F.col(TERM).alias("src"), F.col(TERM).alias("dst")))
    return out


# ---------------------------------------------------------------------- closure

class Closure:
    """Transitive closure ``(child, ancestor)`` (self excluded) and its size; made where they are asked for.

    With ``nodes`` (term, depth, height, known), the levels of all terms and ends of edges, propagation goes along the
    edges and needs no closure table."""

    def __init__(self, edges: DataFrame, rounds: int, nodes: DataFrame | None = None, df: DataFrame | None = None, rows: int | None = None):
        self.edges, self.rounds, self.nodes = edges, rounds, nodes
        if df is not None:
            self.df = df
        if rows is not None:
            self.rows = rows

    @cached_property
    def up(self) -> Graph | None:
        """The graph from child to parent, levels = heights; None where it has no levels or is too large to broadcast."""
        return self.nodes and send(self.edges.sparkSession, self.nodes.withColumnRenamed("height", "level"), self.edges, up=True)

    @cached_property
    def down(self) -> Graph | None:
        """The graph from parent to child, levels = depths."""
        return self.nodes and send(self.edges.sparkSession, self.nodes.withColumnRenamed("depth", "level"), self.edges, up=False)

    @cached_property
    def df(self) -> DataFrame:
        if self.up is None:
            return closure(self.edges).df
        each = self.edges.where("parent is not null").select(F.col("child").alias(ENTRY), F.col("child").alias(TERM), F.lit(1.0).alias("_v")).distinct()
        got = run_levels(each, None, None, {"_v": "max"}, "_v", graph=self.up)
        return got.where(F.col(ENTRY) != F.col(TERM)).select(F.col(ENTRY).alias("child"), F.col(TERM).alias("ancestor"))

    @cached_property
    def rows(self) -> int:
        return self.df.count()

    def reflexive(self, terms: DataFrame) -> DataFrame:
        """Closure with (t, t) added for every term."""
        return self.df.unionByName(terms.select(F.col(TERM).alias("child"), F.col(TERM).alias("ancestor")))

    def for_join(self, terms: DataFrame, reflexive: bool = True) -> DataFrame:
        """Closure ready to join with a fact table: broadcast when its size is
        proven small, otherwise left to a shuffle join."""
        if not reflexive:
            return broadcast_if_small(self.df, rows=self.rows)
        return broadcast_if_small(self.reflexive(terms), rows=self.rows + terms.count())


@dataclass
class Lifted:
    """What a max-propagated table was made from: cells (entry, term, value), max-propagated along ``graph``."""
    cells: DataFrame
    graph: Graph

    @staticmethod
    def of(df: DataFrame) -> "Lifted | None":
        return getattr(df, "_lifted", None)


def closure(edges: DataFrame, checkpoint_every: int = 1) -> Closure:
    """Transitive closure of child->parent edges by a semi-naive loop.

    ``delta`` holds the pairs first found in the previous round; each round
    extends them by one edge, removes known pairs, and stops when nothing new
    appears.  Rounds = longest path length.  A cycle would never stop adding
    longer paths but *does* stop adding new pairs, so the loop always ends with
    the whole closure.
    """
    e = edges.select("child", "parent").distinct()
    e_rows = e.count()
    e_join = broadcast_if_small(e.select(F.col("child").alias("_c"), F.col("parent").alias("_p")), rows=e_rows)
    known = cut_lineage(e.select("child", F.col("parent").alias("ancestor")))
    delta = known
    total, rounds = e_rows, 0
    while True:
        rounds += 1
        step = (delta.join(e_join, delta.ancestor == e_join._c)
                .select("child", F.col("_p").alias("ancestor")).distinct()
                .join(known, ["child", "ancestor"], "left_anti"))
        step = cut_lineage(step)
        n = step.count()
        if n == 0:
            break
        total += n
        known = known.unionByName(step)
        if rounds % checkpoint_every == 0:
            known = cut_lineage(known)
        delta = step
    return Closure(edges, rounds, df=known, rows=total)


def closure_and_levels(edges: DataFrame, terms: DataFrame, checkpoint_every: int = 4):
    """G6 + G2/G3 in one loop: round r holds the terms at the end of a path of
    exactly r edges, upwards and downwards.

    * depth(t) = last round in which a path from above ends at t (longest path to a root; 0 for roots)
    * height(a)= last round in which a path from below ends at a (longest path to a leaf)

    A round has at most two rows a term.  The loop ends when a round is empty,
    i.e. after (longest path + 1) rounds; a cycle would never end, so more rounds
    than terms raises.  Returns ``(Closure, (depth_df, max_depth), (height_df, max_height))``.
    """
    e = edges.select("child", "parent").distinct().where("child is not null and parent is not null")
    e = e.select(F.explode(F.array(F.struct(F.lit(True).alias("_up"), F.col("child").alias("_s"), F.col("parent").alias("_d")),
                                   F.struct(F.lit(False).alias("_up"), F.col("parent").alias("_s"), F.col("child").alias("_d")))).alias("_e")).select("_e.*").persist()
    step, n_terms = e.select(F.col("_up").alias("_way"), "_s", F.col("_d").alias("_to")), terms.count()
    if (rows := e.count()) * PAIR_BYTES > BROADCAST_MAX_BYTES:  # dealt once: a round deals its layer alone
        step = write_buckets(step, ["_way", "_s"], rows)
    layer, layers, cached, r = e.select("_up", F.col("_d").alias(TERM)).distinct().persist(), [], [], 1
    while True:
        if layer.isEmpty():
            break
        if r > n_terms + 1:
            raise ValueError("the term graph has a cycle")
        layers.append(layer.withColumn("_r", F.lit(r)))
        cached.append(layer)
        nxt = (layer.join(step, (F.col("_up") == F.col("_way")) & (F.col(TERM) == F.col("_s")))
               .select("_up", F.col("_to").alias(TERM)).distinct())
        layer = cut_lineage(nxt) if r % checkpoint_every == 0 else nxt.persist()
        r += 1
    every = layer.withColumn("_r", F.lit(0))
    for x in layers:
        every = every.unionByName(x)
    last = every.groupBy(TERM).agg(F.max(F.when(~F.col("_up"), F.col("_r"))).alias("depth"), F.max(F.when(F.col("_up"), F.col("_r"))).alias("height"))
    given = terms.select(TERM).distinct().withColumn("known", F.lit(True))
    nodes = (given.join(last, TERM, "full").select(TERM, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("depth", "height")), F.coalesce("known", F.lit(False)).alias("known")))
    nodes = write_table(nodes)
    for x in (e, *cached):
        x.unpersist()
    t, max_len = terms.select(TERM), r - 1
    depth, height = (t.join(nodes.select(TERM, F.col(c).alias("level")), TERM, "left").select(TERM, F.coalesce("level", F.lit(0)).alias("level")).persist()
                     for c in ("depth", "height"))
    return Closure(edges.select("child", "parent").distinct(), max_len, nodes), (depth, max_len), (height, max_len)


def descendants(clo: Closure) -> DataFrame:
    """(term, descendant) -- the closure read downwards."""
    return clo.df.select(F.col("ancestor").alias(TERM), F.col("child").alias("descendant"))


def ancestors(clo: Closure) -> DataFrame:
    """(term, ancestor)."""
    return clo.df.select(F.col("child").alias(TERM), "ancestor")


# ------------------------------------------------------------------------ levels

def term_levels(terms: DataFrame, edges: DataFrame, direction: str = "down") -> tuple[DataFrame, int]:
    """(term, level) with level = longest path from a root
    (``direction='down'``, roots are 0) or to a leaf (``'up'``, leaves are 0).

    Longest-path relaxation: each round only the terms whose level changed push
    ``level + 1`` to their neighbours.  A cycle keeps changing forever, so a
    frontier that is still non-empty after #terms rounds raises.
    Returns the level table and the maximum level.
    """
    src, dst = ("parent", "child") if direction == "down" else ("child", "parent")
    e = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).distinct()
    e = broadcast_if_small(e)
    lv = cut_lineage(terms.select(TERM, F.lit(0).alias("level")))
    changed = lv
    n_terms = lv.count()
    rounds = 0
    while True:
        rounds += 1
        if rounds > n_terms + 1:
            raise ValueError("the term graph has a cycle")
        cand = (changed.join(e, F.col(TERM) == F.col("_s"))
                .groupBy(F.col("_d").alias(TERM)).agg((F.max("level") + 1).alias("_cand")))
        joined = lv.join(cand, TERM, "left")
        upd = cut_lineage(joined.select(TERM, F.greatest("level", F.coalesce("_cand", F.lit(0))).alias("level"),
                                        (F.col("_cand") > F.col("level")).alias("_chg")))
        changed = upd.where("_chg").select(TERM, "level")
        lv = upd.select(TERM, "level")
        if changed.count() == 0:
            break
    max_level = lv.agg(F.max("level")).first()[0] or 0
    return lv, int(max_level)


# ---------------------------------------------------------------- propagation

def clip_scores(scores: DataFrame, value: str = "prob") -> DataFrame:
    """Sum repeated (entry, term) rows, clip to [0, 1]."""
    return (scores.groupBy(ENTRY, TERM)
            .agg(F.least(F.greatest(F.sum(value), F.lit(0.0)), F.lit(1.0)).alias(value)))


def propagate_max(scores: DataFrame, clo: Closure, terms: DataFrame, value: str = "prob",
                  clip: bool = True, name: str | None = None, shown: Callable[[str], Column] | None = None) -> DataFrame:
    """G8 (G13 with ``clip=False``): v(t) = max over t and its descendants.

    With ``name`` the cells of ``terms`` alone, with that column of theirs; with ``shown`` their values so written (a rounding, or what
    else never falls as the value rises).

    Input repeats are summed and clipped first (``clip``).  Values climb inside
    an entry, level by level; without a graph that can be broadcast the reflexive
    closure is joined and the max is taken per (entry, ancestor).
    """
    s = clip_scores(scores, value) if clip else scores.select(ENTRY, TERM, value)
    if clo.up is not None:
        s = s.where(F.col(value).isNotNull())
        if name is None and shown is None:
            out = run_levels(s, None, None, {value: "max"}, value, graph=clo.up).where(F.col(value) != 0)
            out._lifted = Lifted(s, clo.up)
            return out

        def named(cut=None):
            return run_levels(s, None, None, {value: "max"}, value, graph=clo.up, named=name and (terms, name, name),
                              shown=F.col(value) if shown is None else shown(value), cut=cut)

        def ranked(group, order, k, rank_col):
            if name is None or order != value or sorted(group) != sorted([ENTRY, name]) or not out._by_code:
                return None
            return named((k, rank_col))

        out = named()
        out._ranked = ranked
        return out
    c = clo.for_join(terms)
    out = (s.join(c, F.col(TERM) == F.col("child"))
           .groupBy(ENTRY, F.col("ancestor").alias(TERM))
           .agg(F.max(value).alias(value))
           .where(F.col(value) != 0))
    if shown is not None:
        out = out.withColumn(value, shown(value))
    if name is not None:
        t = broadcast_terms(terms.select(F.col(TERM).alias("_t"), name), terms.count())
        out = out.join(t, F.col(TERM) == F.col("_t")).drop("_t")
    return out


def propagate_labels(positives: DataFrame, clo: Closure, terms: DataFrame) -> DataFrame:
    """Binary labels -- (entry, term, aspect) is positive iff the term or a
    descendant is annotated; the aspect is the term's namespace."""
    p = positives.select(ENTRY, TERM).distinct()
    if clo.up is not None:
        p = p.withColumn("_v", F.lit(1.0))
        cells = run_levels(p, None, None, {"_v": "max"}, "_v", graph=clo.up, named=(terms, "namespace", "aspect"))
        out = cells.select(ENTRY, TERM, "aspect")
        out._lifted = Lifted(p, clo.up)
        # one row a cell, whatever repeats among the terms
        out._cells = out.select(ENTRY, TERM) if cells._by_code else run_levels(p, None, None, {"_v": "max"}, "_v", graph=clo.up).join(terms.select(TERM), TERM, "left_semi").select(ENTRY, TERM)
        return out
    t = broadcast_terms(terms.select(F.col(TERM).alias("_t"), F.col("namespace").alias("aspect")), terms.count())
    c = clo.for_join(terms)
    return (p.join(c, F.col(TERM) == F.col("child")).select(ENTRY, F.col("ancestor").alias(TERM)).distinct()
            .join(t, F.col(TERM) == t._t).select(ENTRY, TERM, "aspect"))


def propagate_min(scores: DataFrame, clo: Closure, terms: DataFrame, value: str = "prob",
                  clip: bool = True) -> DataFrame:
    """v(t) = min over t and its ancestors, a missing ancestor counts 0.

    Only present cells can be non-zero: v = min when every ancestor is present,
    else 0.  Values go down inside an entry, level by level.  Zero results are not
    emitted.  Cells without an entry have no ancestors present but may be roots;
    ids outside the graph have no ancestors.
    """
    s = clip_scores(scores, value) if clip else scores.select(ENTRY, TERM, value)
    if clo.down is not None:
        own, none = s.where(F.col(ENTRY).isNotNull()), s.where(F.col(ENTRY).isNull())
        roots_only = none.join(clo.edges.select(F.col("child").alias(TERM)), TERM, "left_anti").select(ENTRY, TERM, value)
        outside = own.join(clo.down.named(), TERM, "left_anti").select(ENTRY, TERM, value)
        return (run_levels(own, None, None, {value: "min"}, value, graph=clo.down)
                .unionByName(roots_only).unionByName(outside).where(F.col(value) != 0))
    n_anc = clo.df.groupBy(F.col("child").alias("_t")).agg(F.count("*").alias("_n"))
    up = clo.for_join(terms, reflexive=False)
    a = s.select(F.col(ENTRY).alias("_e"), F.col(TERM).alias("_a"), F.col(value).alias("_v"))
    anc_vals = (s.join(up, F.col(TERM) == F.col("child"))
                .join(a, (F.col(ENTRY) == a._e) & (F.col("ancestor") == a._a))
                .groupBy(ENTRY, TERM).agg(F.count("*").alias("_m"), F.min("_v").alias("_minv")))
    out = (s.join(anc_vals, [ENTRY, TERM], "left")
           .join(n_anc, F.col(TERM) == F.col("_t"), "left")
           .select(ENTRY, TERM, F.when(F.coalesce("_n", F.lit(0)) == F.coalesce("_m", F.lit(0)),
                                       F.least(F.col(value), F.coalesce("_minv", F.col(value))))
                   .otherwise(F.lit(0.0)).alias(value)).where(F.col(value) != 0))
    return out


def blend(propagated: DataFrame, original: DataFrame, lr: float, value: str = "prob",
          clip: bool = True) -> DataFrame:
    """Lr * v + (1 - lr) * s over the union of both supports, non-zero only."""
    s = clip_scores(original, value) if clip else original.select(ENTRY, TERM, value)
    v = propagated.select(ENTRY, TERM, F.col(value).alias("_v"))
    return _blended(v.join(s.select(ENTRY, TERM, F.col(value).alias("_s")), [ENTRY, TERM], "full"), lr, value)


def _blended(both: DataFrame, lr: float, value: str, *more: str) -> DataFrame:
    return (both.select(ENTRY, TERM, (F.lit(lr) * F.coalesce("_v", F.lit(0.0))
                                      + F.lit(1.0 - lr) * F.coalesce("_s", F.lit(0.0))).alias(value), *more)
            .where(F.col(value) != 0))


def propagate_step(scores: DataFrame, clo: Closure, terms: DataFrame, direction: str = "max",
                   lr: float = 0.1, value: str = "prob") -> DataFrame:
    """The post-processing step: clip, propagate (max up or min down), blend
    with the input at rate ``lr``; emits non-zero cells with the aspect.  Both
    values of a cell come out of the same task; cells without an entry are
    matched with nothing."""
    s = clip_scores(scores, value)
    move = {"max": propagate_max, "min": propagate_min}.get(direction)
    if move is None:
        raise ValueError(direction)
    graph = clo.up if direction == "max" else clo.down
    t = terms.select(F.col(TERM).alias("_t"), F.col("namespace").alias("aspect"))
    if graph is not None:
        both = run_levels(s.where(F.col(ENTRY).isNotNull()), None, None, {"_v": direction, "_s": "own"}, value, graph=graph, named=(terms, "namespace", "aspect"))
        none = s.where(F.col(ENTRY).isNull())
        alone = blend(move(none, clo, terms, value, clip=False), none, lr, value, clip=False)
        return _blended(both, lr, value, "aspect").unionByName(alone.join(t, F.col(TERM) == t._t).select(ENTRY, TERM, value, "aspect"))
    out = blend(move(s, clo, terms, value, clip=False), s, lr, value, clip=False)
    return out.join(broadcast_terms(t, terms.count()), F.col(TERM) == t._t).select(ENTRY, TERM, value, "aspect")


def enforce_parent_ge_child(scores: DataFrame, edges: DataFrame, clo: Closure | None,
                            terms: DataFrame, value: str = "prob",
                            max_hops: int | None = None) -> DataFrame:
    """Parent >= child.  With ``max_hops=None`` the fixed point, i.e.
    the max over all descendants (no clipping).  With
    ``max_hops=k``: k synchronous passes, i.e. max over descendants at most k
    edges below."""
    if max_hops is None:
        return propagate_max(scores, clo, terms, value, clip=False)
    cur = write_table(scores.select(ENTRY, TERM, value))
    e = edges.select(F.col("child").alias("_c"), F.col("parent").alias("_p"))
    for _ in range(max_hops):
        up, n = _beside_edges(cur, e, "_c")
        up = up.select(ENTRY, F.col("_p").alias(TERM), value)
        cur = write_table(cur.unionByName(up).repartition(n, ENTRY, TERM).groupBy(ENTRY, TERM).agg(F.max(value).alias(value)))
    return cur


def _beside_edges(cells: DataFrame, edges: DataFrame, end: str) -> tuple[DataFrame, int]:
    """Stored ``cells`` joined with the edges that have their term at ``end``, and in how many partitions the outcome is to be dealt:
    both grow with the cells, so that a task holds no more of a larger input."""
    rows = cells.count()
    cells, edges = cells.where(F.col(TERM).isNotNull()), edges.where(F.col(end).isNotNull())
    n, links = parts_of(cells.sparkSession, rows, STEP_CELLS), edges.count()
    if links * PAIR_BYTES <= BROADCAST_MAX_BYTES:
        joined = cells.join(F.broadcast(edges), F.col(TERM) == F.col(end))
    else:
        joined = cells.repartition(n, TERM).join(edges.repartition(n, end), F.col(TERM) == F.col(end))
    return joined, 2 * n


def negative_propagation(preds: DataFrame, negatives: DataFrame, clo: Closure,
                         terms: DataFrame) -> DataFrame:
    """A NOT pair (entry, t) removes t and all its descendants for that
    entry from ``preds``.  What a NOT pair reaches is looked for from below, from
    the predicted cells of its entry."""
    n = negatives.select(ENTRY, F.col(TERM).alias("_neg"))
    if clo.up is not None:
        cells = (preds.select(ENTRY, TERM, F.lit(0.0).alias("_v")).distinct()
                 .unionByName(negatives.select(ENTRY, TERM, F.lit(1.0).alias("_v")).distinct()))
        blocked = run_levels(cells, None, None, {"_b": "under"}, "_v", graph=clo.up).select(ENTRY, TERM)
    else:
        c = clo.for_join(terms)
        blocked = (n.join(c, n._neg == c.ancestor)
                   .select(ENTRY, F.col("child").alias(TERM)).distinct())
    return preds.join(blocked, [ENTRY, TERM], "left_anti")


def matched(truth: DataFrame, preds: DataFrame, terms: DataFrame, value: str = "prob") -> DataFrame:
    """Truth (entry, term) and predictions (entry, term, value) side by side: (entry, term, value, gt, counts).  ``value`` is null on
    rows of no prediction; ``gt``: whether the pair is true; ``counts``: on one row of every true pair.  Cells without an entry
    match nothing.

    Tables that come straight from ``propagate_labels`` and ``propagate_max`` on one graph are worked out again, both
    inside the same entry, so that their propagated cells are not joined; for terms that come twice they are joined."""
    a, b = Lifted.of(truth), Lifted.of(preds)
    if a is not None and b is not None and a.graph is b.graph and pc.count_distinct(a.graph.ids).as_py() == len(a.graph.ids):
        v, none = next(c for c in b.cells.columns if c not in (ENTRY, TERM)), F.lit(None).cast("double")
        cells = (a.cells.select(ENTRY, TERM, F.lit(1.0).alias("_gt"), none.alias("_p"))
                 .unionByName(b.cells.where(F.col(ENTRY).isNotNull()).select(ENTRY, TERM, none.alias("_gt"), F.col(v).cast("double").alias("_p"))))
        both = run_levels(cells, None, None, {"_gt": "max", "_p": "max"}, "_gt", graph=a.graph, values={"_gt": "_gt", "_p": "_p"})
        true = F.col("_gt") != 0
        return (both.where(true | (F.col("_p") != 0))
                .select(ENTRY, TERM, F.when(F.col("_p") != 0, F.col("_p")).alias(value), true.alias("gt"), true.alias("counts")))
    t = truth.select(ENTRY, TERM).distinct()
    yes, no = F.lit(True), F.lit(False)
    return (preds.select(ENTRY, TERM, value).join(t.withColumn("_gt", yes), [ENTRY, TERM], "left")
            .select(ENTRY, TERM, value, F.coalesce("_gt", no).alias("gt"), no.alias("counts"))
            .unionByName(t.select(ENTRY, TERM, F.lit(None).cast(preds.schema[value].dataType).alias(value), yes.alias("gt"), yes.alias("counts"))))


def ternary_labels(positives: DataFrame, entries: DataFrame, edges: DataFrame,
                   terms: DataFrame, root_terms: DataFrame, scores: DataFrame | None = None, value: str = "prob") -> DataFrame:
    """Conditional targets, only non-null cells stored.

    A cell (entry, t) is non-null when t is a root of its namespace, or when a
    parent of t is positive; its label is 1 if (entry, t) is positive else 0.
    ``positives`` should already be propagated (G7) for the usual targets.  With ``scores`` (entry, term, value; one row a pair) a cell
    also has its score, or null.
    """
    more, names = [] if scores is None else [value], (terms, "namespace", "namespace")
    lifted = Lifted.of(positives)
    graph = lifted and send(positives.sparkSession, terms.select(TERM, F.lit(0).alias("level")).distinct(), edges, up=True)
    if graph is not None:
        asked = entries.select(ENTRY).distinct().withColumn(TERM, F.lit(None).cast(graph.kind)).withColumn("_v", F.lit(0.0))
        cells = lifted.cells.select(ENTRY, TERM, F.lit(1.0).alias("_v")).unionByName(asked)
        if scores is None:
            cells = run_levels(cells, None, None, {"_pos": "ternary"}, "_v", graph=graph, lift=lifted.graph, roots=root_terms, named=names)
        else:  # the scores of an entry lie beside its positives
            own = (scores.where(F.col(value).isNotNull()).join(entries.select(ENTRY).distinct(), ENTRY, "left_semi")
                   .select(ENTRY, TERM, F.lit(None).cast("double").alias("_v"), F.col(value).cast("double").alias("_s"), F.lit(1.0).alias("_has")))
            none = F.lit(None).cast("double")
            cells = run_levels(cells.select("*", none.alias("_s"), none.alias("_has")).unionByName(own), None, None, {"_pos": "ternary", "_s": "own", "_has": "own"}, "_v",
                               graph=graph, lift=lifted.graph, roots=root_terms, values={"_s": "_s", "_has": "_has"}, beside=("_s", "_has"), named=names)
            cells = cells.withColumn(value, F.when(F.col("_has") != 0, F.col("_s")))
        return cells.select(ENTRY, TERM, "namespace", F.col("_pos").cast("tinyint").alias("label"), *more)
    if scores is not None:
        return ternary_labels(positives, entries, edges, terms, root_terms).join(scores.select(ENTRY, TERM, value), [ENTRY, TERM], "left")
    t = broadcast_terms(terms.select(F.col(TERM).alias("_t"), F.col("namespace")), terms.count())
    p = positives.select(ENTRY, TERM)
    e = broadcast_if_small(edges.select(F.col("child").alias("_c"), F.col("parent").alias("_p")))
    cand_children = p.join(e, F.col(TERM) == F.col("_p")).select(ENTRY, F.col("_c").alias(TERM))
    # every entry meets every root: the roots travel as one row that holds their list
    root_list = root_terms.select(TERM).distinct().groupBy(F.lit(1).alias("_one")).agg(F.collect_list(TERM).alias("_roots"))
    cand_roots = (entries.select(ENTRY).distinct().withColumn("_one", F.lit(1)).join(F.broadcast(root_list), "_one")
                  .select(ENTRY, F.explode("_roots").alias(TERM)))
    # candidates and positives meet in a single aggregate (one shuffle on the
    # cell key) instead of a distinct followed by a join
    flags = (cand_children.unionByName(cand_roots).select(ENTRY, TERM, F.lit(1).alias("_cand"), F.lit(0).alias("_pos"))
             .unionByName(p.select(ENTRY, TERM, F.lit(0).alias("_cand"), F.lit(1).alias("_pos"))))
    cells = (flags.groupBy(ENTRY, TERM).agg(F.max("_cand").alias("_cand"), F.max("_pos").alias("_pos"))
             .where(F.col("_cand") == 1))
    return (cells.join(t, F.col(TERM) == t._t)
            .select(ENTRY, TERM, "namespace", F.col("_pos").cast("tinyint").alias("label")))


# ---------------------------------------------------------------- level form

def _message_loop(cells: DataFrame, levels: DataFrame, max_level: int, route: DataFrame, combine,
                  value: str) -> DataFrame:
    """Level-synchronous message passing over the DAG.

    ``cells`` (entry, term, value) are tagged with their term's level.  Level 0
    keeps its values.  After a level is computed, each value is sent once
    along ``route`` (src -> dst edges, dst on a higher level) as a message
    (entry, term=dst, _mv) tagged with the receiver's level.  Level L then
    combines its own cells with exactly the messages addressed to it:
    ``combine(cur, msgs) -> (entry, term, value)``.  So every value crosses the
    network once, instead of the whole result being re-joined at every level.
    """
    lv = broadcast_if_small(levels.select(F.col(TERM).alias("_t"), F.col("level").alias("_lv")))
    # written once, partitioned by level: each level reads only its own slice
    tagged = write_table(cells.join(lv, F.col(TERM) == F.col("_t")).select(ENTRY, TERM, value, "_lv"),
                         partition_by="_lv")
    r = route.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"))
    r = r.join(levels.select(F.col(TERM).alias("_dst"), F.col("level").alias("_dlv")), "_dst")
    r = broadcast_if_small(r)

    def send(vals):
        return (vals.join(r, F.col(TERM) == F.col("_src"))
                .select(ENTRY, F.col("_dst").alias(TERM), F.col(value).alias("_mv"), "_dlv"))

    current = tagged.where(F.col("_lv") == 0).select(ENTRY, TERM, value)
    parts, batches = [current], [write_table(send(current), partition_by="_dlv")]
    for level in range(1, max_level + 1):
        cur = tagged.where(F.col("_lv") == level).select(ENTRY, TERM, value)
        msgs = None
        for b in batches:
            x = b.where(F.col("_dlv") == level).select(ENTRY, TERM, "_mv")
            msgs = x if msgs is None else msgs.unionByName(x)
        # every level is cut to a checkpointed leaf: later levels reference it
        # many times, and an uncut plan would grow with each level
        new = write_table(combine(cur, msgs))
        parts.append(new)
        if level < max_level:
            batches.append(write_table(send(new), partition_by="_dlv"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def propagate_fill(scores: DataFrame, edges: DataFrame, terms: DataFrame, value: str = "prob",
                   levels: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Children first; a cell with s = 0 receives the max of its children's
    already filled values, a non-zero cell keeps its own value (blocks).
    Levels are heights (leaves 0); filled values travel child -> parent."""
    s = clip_scores(scores, value)
    lv, max_level = levels or term_levels(terms, edges, direction="up")
    done = run_levels(s, lv, edges, {value: "fill"}, value, up=True)
    if done is not None:
        return done
    route = edges.select(F.col("child").alias("src"), F.col("parent").alias("dst"))

    def combine(cur, msgs):
        m = msgs.groupBy(ENTRY, TERM).agg(F.max("_mv").alias("_fill"))
        j = cur.join(m, [ENTRY, TERM], "full")
        return (j.select(ENTRY, TERM, F.when(F.coalesce(F.col(value), F.lit(0.0)) != 0, F.col(value))
                         .otherwise(F.col("_fill")).alias(value))
                .where(F.col(value) != 0))

    return _message_loop(s, lv, max_level, route, combine, value)


def conditional_to_marginal(scores: DataFrame, edges: DataFrame, terms: DataFrame,
                            mode: str = "any", value: str = "prob",
                            levels: tuple[DataFrame, int] | None = None,
                            only_terms: DataFrame | None = None) -> DataFrame:
    """Turn conditional scores P(t | parents) into marginals, top-down.

    ``mode='any'``: v(t) = s(t) * (1 - prod_parents(1 - v(p)))
    ``mode='all'``: v(t) = s(t) * prod_parents v(p)   (a missing parent gives 0)
    Roots keep their value.  ``only_terms`` restricts the conversion to a term
    subset (other terms keep s).  Zero results are not emitted.
    """
    s = scores.select(ENTRY, TERM, value)
    if mode not in ("any", "all"):
        raise ValueError(mode)
    lv, max_level = levels or term_levels(terms, edges, direction="down")
    cells, convert = s, None
    if only_terms is not None:
        k = broadcast_if_small(only_terms.select(F.col(TERM).alias("_k")).distinct())
        cells, convert = s.join(k, F.col(TERM) == F.col("_k"), "left"), F.col("_k").isNotNull()
    lifted = Lifted.of(scores)
    if lifted is not None and only_terms is None:
        done = run_levels(lifted.cells, lv, edges, {value: mode}, value, lift=lifted.graph)
    else:
        done = run_levels(cells, lv, edges, {value: mode}, value, convert=convert)
    if done is not None:
        return done
    route = edges.select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    n_par = broadcast_if_small(edges.groupBy(F.col("child").alias("_c2")).agg(F.count("*").alias("_np")))
    keep = None if only_terms is None else broadcast_if_small(only_terms.select(F.col(TERM).alias("_k")).distinct())

    def combine(cur, msgs):
        j = cur.join(msgs, [ENTRY, TERM], "left")
        if mode == "any":
            agg = j.groupBy(ENTRY, TERM, value).agg(F.product(1 - F.coalesce("_mv", F.lit(0.0))).alias("_q"))
            new = agg.select(ENTRY, TERM, (F.col(value) * (1 - F.col("_q"))).alias("_new"), F.col(value).alias("_old"))
        else:
            agg = (j.groupBy(ENTRY, TERM, value)
                   .agg(F.product(F.coalesce("_mv", F.lit(0.0))).alias("_q"), F.count("_mv").alias("_m"))
                   .join(n_par, F.col(TERM) == F.col("_c2")))
            new = agg.select(ENTRY, TERM, F.when(F.col("_m") == F.col("_np"), F.col(value) * F.col("_q"))
                             .otherwise(F.lit(0.0)).alias("_new"), F.col(value).alias("_old"))
        if keep is not None:
            new = new.join(keep, F.col(TERM) == F.col("_k"), "left").select(
                ENTRY, TERM, F.when(F.col("_k").isNotNull(), F.col("_new")).otherwise(F.col("_old")).alias("_new"),
                "_old")
        return new.select(ENTRY, TERM, F.col("_new").alias(value)).where(F.col(value) != 0)

    return _message_loop(s, lv, max_level, route, combine, value)


def suppress_children(scores: DataFrame, edges: DataFrame, terms: DataFrame,
                      threshold: float = 0.0, value: str = "prob",
                      levels: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Top-down; when the max over a term's parents (already processed,
    missing = 0) is below ``threshold``, the term's score is multiplied by that
    max.  ``threshold = 0`` changes nothing.  Terms without parents keep s."""
    s = scores.select(ENTRY, TERM, value)
    if threshold <= 0:
        return s
    lv, max_level = levels or term_levels(terms, edges, direction="down")
    lifted = Lifted.of(scores)
    done = run_levels(lifted.cells if lifted else s, lv, edges, {value: "suppress"}, value, threshold=threshold, lift=lifted and lifted.graph)
    if done is not None:
        return done
    route = edges.select(F.col("parent").alias("src"), F.col("child").alias("dst"))

    def combine(cur, msgs):
        j = (cur.join(msgs, [ENTRY, TERM], "left")
             .groupBy(ENTRY, TERM, value).agg(F.max(F.coalesce("_mv", F.lit(0.0))).alias("_mp")))
        return j.select(ENTRY, TERM, F.when(F.col("_mp") < threshold, F.col(value) * F.col("_mp"))
                        .otherwise(F.col(value)).alias(value)).where(F.col(value) != 0)

    return _message_loop(s, lv, max_level, route, combine, value)


def conditional_both(scores: DataFrame, edges: DataFrame, terms: DataFrame, kept: DataFrame | None = None, value: str = "prob",
                     levels: tuple[DataFrame, int] | None = None, models: tuple[str, ...] = ()) -> DataFrame:
    """Both marginals of many models in one pass: (entry, term, model, any, all), rows where one is not 0.

    ``scores``: (entry, term, model, value), or (entry, term, value) that all ``models`` have.  ``kept``: (model, term) cells that hold marginals already (the terms a
    raw model predicts); they keep their value and pass it on.
    """
    lv, max_level = levels or term_levels(terms, edges, direction="down")
    lifted = Lifted.of(scores)
    if models and lifted is not None:
        rows = [] if kept is None else kept.select("model", TERM).where(F.col("model").isin(*models)).distinct().toArrow().group_by("model").aggregate([(TERM, "list")]).to_pylist()
        own = {r["model"]: pa.array(r[f"{TERM}_list"], lifted.graph.ids.type) for r in rows}
        done = run_levels(lifted.cells, lv, edges, {"any": "any", "all": "all"}, value, lift=lifted.graph,
                          kept={m: own.get(m, lifted.graph.ids[:0]) for m in models})
        if done is not None:
            return done
    if models:
        scores = scores.withColumn("model", F.explode(F.array(*map(F.lit, models))))
    cells, convert = scores.select(ENTRY, TERM, "model", value), None
    if kept is not None:
        k = kept.select(F.col("model").alias("_m"), F.col(TERM).alias("_k")).distinct()
        cells = cells.join(k, (F.col("model") == F.col("_m")) & (F.col(TERM) == F.col("_k")), "left")
        convert = F.col("_k").isNull()
    done = run_levels(cells, lv, edges, {"any": "any", "all": "all"}, value, groups=(ENTRY, "model"), convert=convert)
    if done is not None:
        return done
    out = None
    for mode in ("any", "all"):  # a graph too large to broadcast: one join a level, each model's entries as entries of their own
        one = cells.select(F.struct(ENTRY, "model").alias(ENTRY), TERM, value)
        if kept is not None:
            raise ValueError("cells that keep their value need a term graph that can be broadcast")
        got = conditional_to_marginal(one, edges, terms, mode, value, (lv, max_level)).select(ENTRY, TERM, F.col(value).alias(mode))
        out = got if out is None else out.join(got, [ENTRY, TERM], "full")
    return out.select(F.col(ENTRY)[ENTRY].alias(ENTRY), TERM, F.col(ENTRY)["model"].alias("model"),
                      F.coalesce("any", F.lit(0.0)).alias("any"), F.coalesce("all", F.lit(0.0)).alias("all"))


def neighbour_aggregate(features: DataFrame, edges: DataFrame, direction: str = "bwd",
                        value: str = "prob", layers: int = 1) -> DataFrame:
    """Per layer, mean and max of the neighbours' values along a direction
    (bwd: a term gathers its children, fwd: its parents).  Returns
    (entry, term, mean_<k>, max_<k>) for k = 1..layers, the mean of layer k
    feeding layer k + 1."""
    el = edge_list(edges, "fwd" if direction == "fwd" else "bwd")
    cur = write_table(features.select(ENTRY, TERM, value))
    out = None
    for k in range(1, layers + 1):
        met, n = _beside_edges(cur, el, "dst")
        agg = (met.select(ENTRY, F.col("src").alias(TERM), value).repartition(n, ENTRY, TERM).groupBy(ENTRY, TERM)
               .agg(F.avg(value).alias(f"mean_{k}"), F.max(value).alias(f"max_{k}")))
        agg = write_table(agg)
        out = agg if out is None else out.join(agg, [ENTRY, TERM], "full")
        cur = agg.select(ENTRY, TERM, F.col(f"mean_{k}").alias(value))
    return out
