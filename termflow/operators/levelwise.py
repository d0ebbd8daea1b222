"""Level-form propagation with one exchange.

Every interaction of the level-form operators stays inside one entry.  Cells are
dealt once by entry; a task holds some whole entries at a time (an entry has at
most one cell a term) and sends values along the edges level by level in numpy.
What follows a propagation (a blend, marginals, labels) is worked out in the same
task, so that the many propagated cells never cross an exchange.
The term graph travels as a broadcast whose size is counted first; above
``TOPOLOGY_BYTES`` the callers fall back on joins."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, broadcast_terms, ship_package
from .ranking import dense_ranks

#: Bytes of edges and terms (16 each, an upper bound) up to which the graph is broadcast.
TOPOLOGY_BYTES = 384 << 20
#: Cells that a task evaluates at a time, whole entries together.
CHUNK_CELLS = 1 << 18
#: The same where a cell grows into its ancestors.
LIFT_CELLS = 1 << 14


class Topology:
    """Terms by number: their id, their level, the edges a value travels, how many end at a term, and whether it is ``known``
    (an end of an edge need not be a term)."""

    def __init__(self, level: np.ndarray, src: np.ndarray, dst: np.ndarray, ids: pa.Array | None = None, known: np.ndarray | None = None):
        order = np.argsort(src, kind="stable")
        self.level, self.dst = level.astype(np.int32), dst[order].astype(np.int32)
        self.first = np.r_[0, np.cumsum(np.bincount(src, minlength=len(level)))].astype(np.int32)
        self.n_in = np.bincount(dst, minlength=len(level)).astype(np.int32)
        self.n_levels = int(self.level.max(initial=0)) + 1
        self.ids, self.known = ids, known

    @cached_property
    def back(self) -> tuple[np.ndarray, np.ndarray]:
        """The edges that enter a term, by the level and number of the other end; made where they are asked for."""
        src = np.repeat(np.arange(len(self.level), dtype=np.int32), np.diff(self.first))
        by_level = np.argsort(self.level[src], kind="stable")
        return np.r_[0, np.cumsum(self.n_in)].astype(np.int32), src[by_level][np.argsort(self.dst[by_level], kind="stable")]

    def along(self, term: np.ndarray, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``term``, term reached) for every edge that leaves ``term`` (with ``back``: that enters it)."""
        first, to = self.back if back else (self.first, self.dst)
        start = first[term]
        n = first[term + 1] - start
        at = np.repeat(np.arange(len(term)), n)
        inside = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        return at, to[start[at] + inside]


def topology(spark, levels: DataFrame, edges: DataFrame, up: bool) -> tuple[Topology, DataFrame] | None:
    """The graph by term numbers, and the numbers (term, _no), or None where it is too large to broadcast.
    Values travel from child to parent (``up``) or from parent to child.  ``levels``: (term, level), with ``known`` where
    it holds ends of edges that are no terms.  A term that comes twice has two numbers, one of which has its edges."""
    if (levels.count() + edges.count()) * 16 > TOPOLOGY_BYTES:
        return None
    at = levels.where("term is not null").select("term", F.col("level").cast("int").alias("level"), (F.col("known") if "known" in levels.columns else F.lit(True)).alias("known")).toArrow()
    at = at.sort_by("term").combine_chunks()
    ids = at["term"].combine_chunks()
    ends = edges.select("child", "parent").toArrow()
    child, parent = (pc.index_in(ends[k].combine_chunks().cast(ids.type), value_set=ids) for k in ("child", "parent"))
    both = pc.and_(child.is_valid(), parent.is_valid())
    child, parent = (x.filter(both).to_numpy(zero_copy_only=False) for x in (child, parent))
    names = spark.createDataFrame(pa.table({"term": ids, "_no": pa.array(np.arange(len(ids), dtype=np.int32))}))
    known = at["known"].to_numpy(zero_copy_only=False).astype(bool)
    return Topology(at["level"].to_numpy(), *((child, parent) if up else (parent, child)), ids, None if known.all() else known), names


@dataclass
class Graph:
    """A topology that the tasks have, and the numbers (term, _no) of its ``terms`` terms."""
    sent: Broadcast
    names: DataFrame
    terms: int
    ids: pa.Array
    kind: str

    def named(self) -> DataFrame:
        return broadcast_if_small(self.names, self.terms)


def send(spark, levels: DataFrame, edges: DataFrame, up: bool) -> Graph | None:
    found = topology(spark, levels, edges, up)
    if found is None:
        return None
    ship_package(spark)
    return Graph(spark.sparkContext.broadcast(found[0]), found[1], len(found[0].ids), found[0].ids, levels.schema["term"].dataType.simpleString())


def term_codes(graph: Graph, terms: DataFrame, column: str) -> tuple[np.ndarray, pa.Array] | None:
    """(code of ``column`` for every number of the graph, the values of the codes); numbers that are no terms have the code after the last.
    None where a term comes twice.  A byte or two a number go to the tasks, where a hash table of the terms has some forty."""
    t = terms.select("term", column).toArrow().combine_chunks()
    at = pc.index_in(t["term"].combine_chunks().cast(graph.ids.type), value_set=graph.ids) if t.num_rows else pa.array([], pa.int32())
    there = at.is_valid().to_numpy(zero_copy_only=False)
    at = at.drop_null().to_numpy()
    if len(at) and np.bincount(at).max() > 1:
        return None
    found = pc.dictionary_encode(t[column].combine_chunks(), null_encoding="encode") if t.num_rows else pa.array([], t.schema.field(column).type).dictionary_encode()
    code = np.full(len(graph.ids), len(found.dictionary), np.min_scalar_type(len(found.dictionary)))
    code[at] = found.indices.to_numpy()[there]
    return code, found.dictionary


def sums_of(key: np.ndarray, value: np.ndarray, how) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, ``how`` over the values of each, how many)."""
    order = np.argsort(key, kind="stable" if how is np.multiply else None)  # a product depends on the order
    key, value = key[order], value[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
    return key[start], how.reduceat(value, start) if len(start) else value[:0], np.diff(np.r_[start, len(key)])


def evaluate(topo: Topology, key: np.ndarray, value: np.ndarray, mode: str, convert: np.ndarray | None = None,
             threshold: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Keys (entry * terms + term) and values after propagation; zero values are left out, but for ``max`` and ``min``.

    ``fill``: a zero takes the largest value sent to it.  ``any``: s * (1 - prod(1 - v)); ``all``: s * prod(v), where an
    edge without a value gives 0; ``suppress``: s * max(v) where max(v) < threshold.  Cells with ``convert`` false keep s.
    ``max``: the largest of its own value and those sent to it; an id that is not ``known`` passes its own value on without
    having it.  ``min``: the least of them, left out where an edge has no value.  NaN counts as the largest number."""
    n = len(topo.level)
    order = np.argsort(key)
    key, value = key[order], value[order]
    convert = np.ones(len(key), bool) if convert is None else convert[order]
    level = topo.level[key % n]
    by_level = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[by_level], np.arange(topo.n_levels + 1))
    inbox: list[list] = [[] for _ in range(len(cuts))]
    out = []
    for lv in range(len(cuts) - 1):
        at = by_level[cuts[lv]:cuts[lv + 1]]
        k, x = key[at], value[at]
        mk, mv = (np.concatenate(p) for p in zip(*inbox[lv])) if inbox[lv] else (k[:0], x[:0])
        inbox[lv] = []
        if mode == "max":
            own = np.ones(len(k), bool) if topo.known is None else topo.known[k % n]
            got = sums_of(np.r_[k[own], mk], np.r_[x[own], mv], np.maximum)[:2]
            out.append(got)
            k, x = got if own.all() else sums_of(np.r_[k, mk], np.r_[x, mv], np.maximum)[:2]
        elif mode == "min":
            if lv:
                mk, mv, got = sums_of(mk, mv, np.fmin)
                spot = np.minimum(np.searchsorted(mk, k), max(len(mk) - 1, 0))
                whole = (mk[spot] == k) & (got[spot] == topo.n_in[k % n]) if len(mk) else np.zeros(len(k), bool)
                k, x = k[whole], np.fmin(x[whole], mv[spot[whole]])
            out.append((k, x))
        else:
            k, x = _combine(topo, mode, lv, k, x, mk, mv, convert[at], threshold)
            out.append((k, x))
        place, to = topo.along(k % n)
        ml = topo.level[to].astype(np.int16 if topo.n_levels < 1 << 15 else np.int32)
        order = np.argsort(ml, kind="stable")
        edge = np.searchsorted(ml[order], np.arange(topo.n_levels + 1))
        base = k - k % n
        for to_level in np.flatnonzero(np.diff(edge)):
            some = order[edge[to_level]:edge[to_level + 1]]
            inbox[to_level].append((base[place[some]] + to[some], x[place[some]]))
    return np.concatenate([k for k, _ in out]), np.concatenate([x for _, x in out])


def _combine(topo: Topology, mode: str, lv: int, k, x, mk, mv, convert, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """A level's cells with the values sent to them."""
    n = len(topo.level)
    if mode == "fill":
        mk, mv, _ = sums_of(np.r_[k[x == 0], mk], np.r_[x[x == 0], mv], np.maximum)
        own = np.isin(mk, k[x != 0], assume_unique=True)
        k, x = np.r_[k[x != 0], mk[~own]], np.r_[x[x != 0], mv[~own]]
    elif lv:
        mk, mv, got = sums_of(mk, 1 - mv if mode == "any" else mv, np.maximum if mode == "suppress" else np.multiply)
        spot = np.minimum(np.searchsorted(mk, k), max(len(mk) - 1, 0))
        has = mk[spot] == k if len(mk) else np.zeros(len(k), bool)
        q, c = (mv[spot], got[spot]) if len(mk) else (np.zeros(len(k)), np.zeros(len(k), np.int64))
        if mode == "any":
            new = np.where(has, x * (1 - q), 0.0)
        elif mode == "all":
            new = np.where(has & (c == topo.n_in[k % n]), x * q, 0.0)
        else:
            q = np.where(has, q, 0.0)
            new = np.where(q < threshold, x * q, x)
        x = np.where(convert & (topo.n_in[k % n] > 0), new, x)
    return k[x != 0], x[x != 0]


def climb(topo: Topology, key: np.ndarray, value: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """``evaluate`` for ``max`` and ``fill``, keys sorted.  A cell travels as one whole number (entry, term, rank of its value), so
    that a plain sort brings the messages of a cell together, the largest last."""
    n = len(topo.level)
    values, rank = np.unique(value, return_inverse=True)
    group, term = np.divmod(key, n)
    rank_bits, term_bits = int(len(values)).bit_length() + 1, int(n).bit_length()
    if topo.known is not None and mode == "max" or rank_bits + term_bits + int(group.max(initial=0)).bit_length() > 62:
        got = evaluate(topo, key, value, mode)
        order = np.argsort(got[0])
        return got[0][order], got[1][order]
    own, ranks, terms = 1 << rank_bits - 1, (1 << rank_bits - 1) - 1, ((1 << term_bits) - 1) << rank_bits
    cells = (group << term_bits | term) << rank_bits | rank
    zero = np.searchsorted(values, 0.0) if mode == "fill" else -1
    if mode == "fill":
        cells[value != 0] |= own  # above all that is sent to it
    inbox: list[list] = [[] for _ in range(topo.n_levels)]

    def sort_out(cells, level):
        order = np.argsort(level, kind="stable")
        edge = np.searchsorted(level[order], np.arange(topo.n_levels + 1))
        cells = cells[order]
        for at in np.flatnonzero(np.diff(edge)):
            inbox[at].append(cells[edge[at]:edge[at + 1]])

    levels = topo.level.astype(np.int16) if topo.n_levels < 1 << 15 else topo.level
    sort_out(cells, levels[term])
    out = [cells[:0]]
    for lv in range(topo.n_levels):
        if not inbox[lv]:
            continue
        cells = np.concatenate(inbox[lv])
        inbox[lv] = []
        cells.sort()
        cell = cells >> rank_bits
        cells = cells[np.r_[cell[1:] != cell[:-1], True]]
        if mode == "fill":
            cells &= ~own
            if zero < len(values) and values[zero] == 0:
                cells = cells[cells & ranks != zero]
        out.append(cells)
        term = (cells & terms) >> rank_bits
        start = topo.first[term]
        many = topo.first[term + 1] - start
        ends = np.cumsum(many)
        to = topo.dst[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - many), many)]
        sort_out(np.repeat(cells & ~terms, many) | to.astype(np.int64) << rank_bits, levels[to])
    cells = np.concatenate(out)
    cells.sort()
    return (cells >> rank_bits + term_bits) * n + ((cells & terms) >> rank_bits), values[cells & ranks]


class Met:
    """Cells, one a key, and where in them lie the ends of the edges that enter each: found once, whatever is worked out from them."""

    def __init__(self, topo: Topology, key: np.ndarray):
        """``key``: sorted."""
        n = len(topo.level)
        term, self.key, self.n_levels = key % n, key, topo.n_levels
        self.order = np.argsort(topo.level[term].astype(np.int16 if topo.n_levels < 1 << 15 else np.int32), kind="stable")
        term = term[self.order]
        self.cuts = np.searchsorted(topo.level[term], np.arange(topo.n_levels + 1))
        place, end = topo.along(term, back=True)
        wanted = (key[self.order] - term)[place] + end
        at = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
        self.at = np.where(key[at] == wanted, at, len(key)) if len(key) else at
        self.many = topo.n_in[term]
        self.starts = np.r_[0, np.cumsum(self.many)]

    def settled(self, value: np.ndarray, mode: str, convert: np.ndarray | None, threshold: float) -> np.ndarray:
        """The value of every cell after ``any``, ``all`` or ``suppress``, zeros included."""
        x = np.r_[value, 0.0]
        for lv in range(1, self.n_levels):
            a, b = self.cuts[lv], self.cuts[lv + 1]
            cells, many, starts = self.order[a:b], self.many[a:b], self.starts[a:b]
            if not many.all():
                cells, starts, many = cells[many > 0], starts[many > 0], many[many > 0]
            if not len(cells):
                continue
            v = x[self.at[starts[0]:starts[-1] + many[-1]]]
            starts, sent, old = starts - starts[0], v != 0, x[cells]
            has = np.logical_or.reduceat(sent, starts)
            if mode == "any":
                new = np.where(has, old * (1 - np.multiply.reduceat(np.where(sent, 1 - v, 1.0), starts)), 0.0)
            elif mode == "all":
                new = np.where(np.logical_and.reduceat(sent, starts), old * np.multiply.reduceat(np.where(sent, v, 1.0), starts), 0.0)
            else:
                q = np.where(has, np.maximum.reduceat(np.where(sent, v, -np.inf), starts), 0.0)
                new = np.where(q < threshold, old * q, old)
            x[cells] = new if convert is None else np.where(convert[cells], new, old)
        return x[:-1]


def under(topo: Topology, key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the cells of value 0 those below, or at, one of value 1 (edges lead up): their keys, and ones.  An id that is
    not ``known`` hits what is below it, not itself."""
    n = len(topo.level)
    asked, hit = np.unique(key[value == 0]), np.unique(key[value != 0])
    every = np.unique(evaluate(topo, asked, np.ones(len(asked)), "max")[0] if topo.known is None else np.r_[asked, evaluate(topo, asked, np.ones(len(asked)), "max")[0]])
    own = np.isin(every, hit, assume_unique=True)
    above = np.zeros(len(every), bool)
    level = topo.level[every % n]
    for lv in np.unique(level)[::-1]:
        at = np.flatnonzero(level == lv)
        k = every[at]
        place, to = topo.along(k % n)
        parent = np.searchsorted(every, (k - k % n)[place] + to)
        np.logical_or.at(above, at[place], own[parent] | above[parent])
    found = above | (own if topo.known is None else own & topo.known[every % n])
    found &= np.isin(every, asked, assume_unique=True)
    return every[found], np.ones(int(found.sum()))


def distinct(key: np.ndarray) -> np.ndarray:
    """Sorted distinct keys."""
    key = np.sort(key)
    return key[np.r_[True, key[1:] != key[:-1]][:len(key)]]


def ternary(topo: Topology, key: np.ndarray, groups: int, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of the roots in every group and of the children of positive cells (edges lead up), and whether they are positive."""
    n = len(topo.level)
    key = distinct(key)
    place, child = topo.along(key % n, back=True)
    asked = distinct(np.r_[(key - key % n)[place] + child, (np.arange(groups)[:, None] * n + roots[None]).ravel()])
    if not len(key):
        return asked, np.zeros(len(asked))
    return asked, (key[np.minimum(np.searchsorted(key, asked), len(key) - 1)] == asked).astype(float)


def by_entry(cells: DataFrame, groups: list[str], names: DataFrame, columns: dict[str, Column], keep: bool = False) -> DataFrame:
    """Cells with their term's number, sorted by entry, all cells of an entry in one partition: an
    exchange only where they do not lie so already.  Cells of unknown terms go, or have no number (``keep``)."""
    numbered = cells.join(names, "term", "left" if keep else "inner")
    w = Window.partitionBy(*groups).orderBy("_no")
    return numbered.select(*groups, F.row_number().over(w).alias("_nth"), "_no", *[c.alias(n) for n, c in columns.items()])


def whole_entries(batches, most: int | None = None):
    """Batches as tables of whole entries, of about ``most`` (``CHUNK_CELLS``) rows or one entry."""
    held, n, last, most = [], 0, 0, most or CHUNK_CELLS
    for whole in batches:
        for at in range(0, whole.num_rows, most):
            b = whole.slice(at, most)
            begun = np.flatnonzero(b.column("_nth").to_numpy() == 1)
            if len(begun):
                last = n + int(begun[-1])  # the entry that may go on
            held.append(b)
            n += b.num_rows
            if n >= most and last:  # an entry is joined once, however many batches it has
                t = pa.Table.from_batches(held).combine_chunks()
                yield t.slice(0, last)
                held = t.slice(last).to_batches()
                n, last = n - last, 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def run_levels(cells: DataFrame, levels: DataFrame | None, edges: DataFrame | None, modes: dict[str, str], value: str = "prob",
               groups: tuple[str, ...] = ("entry",), up: bool = False, convert: Column | None = None, threshold: float = 0.0,
               graph: Graph | None = None, lift: Graph | None = None, kept: dict | None = None, roots: DataFrame | None = None,
               values: dict[str, str] | None = None, beside: tuple[str, ...] = (), named: tuple[DataFrame, str, str] | None = None,
               shown: Column | None = None, cut: tuple[int, str] | None = None) -> DataFrame | None:
    """Propagate ``value`` of cells (groups.., term, value) inside each group, once for each of ``modes``
    (output column -> mode): (groups.., term, output columns), rows where one is not 0 (``max``, ``min``: where one is).  None
    where the graph is too large to broadcast.

    ``graph``: the graph, where it was sent before.  ``lift``: the cells are first max-propagated along this graph.
    ``kept``: (model -> terms that keep their value): every entry is evaluated once a model, in a column ``model``.
    ``values``: output columns that are made from another column than ``value``; a cell takes part where that is not null.  The output
    columns ``beside`` are looked up at the cells that the others have.
    ``named``: (terms, column, as): the cells of these terms alone, with this column of theirs.
    ``shown`` (``max`` alone): what stands for a value, never falling as it rises; cells of value 0 go.  ``cut`` (k, column), with these:
    of every group and name the cells of dense rank below k by falling shown value, and the rank.  Where a term comes twice it has no effect.
    Modes beside those of ``evaluate``: ``own`` (the cells as they are), ``under``, ``ternary`` (with ``roots``; cells of
    no term stand for entries without a positive cell)."""
    spark = cells.sparkSession
    graph = graph or send(spark, levels, edges, up)
    if graph is None:
        return None
    groups, start = list(groups), lift or graph
    terms, column, label = named or (None, None, None)
    read = {"_v": value, **{f"_v_{m}": c for m, c in (values or {}).items()}}
    if shown is not None:
        cells, read["_shown"] = cells.withColumn("_shown", shown), "_shown"
    rows = by_entry(cells, groups, start.named(), {**{n: F.col(c).cast("double") for n, c in read.items()}, "_convert": F.lit(True) if convert is None else convert}, keep=roots is not None)
    sent, lifting = graph.sent, lift and lift.sent
    across = None
    if lift is not None:  # the numbers in ``graph`` of a number in ``lift``, in one list
        at = pc.index_in(graph.ids, value_set=lift.ids).fill_null(lift.terms).to_numpy()
        across = np.r_[0, np.cumsum(np.bincount(at, minlength=lift.terms + 1))], np.argsort(at, kind="stable").astype(np.int32)
    own = {m: pc.is_in(graph.ids, value_set=t).to_numpy(zero_copy_only=False) for m, t in (kept or {}).items()}
    tops = None if roots is None else pc.index_in(roots.select("term").distinct().toArrow()["term"].combine_chunks(), value_set=graph.ids).drop_null().to_numpy()
    codes = named and term_codes(graph, terms, column)
    more = spark.sparkContext.broadcast((across, own, tops, codes))
    grows = lift is not None or not {"max", "under", "ternary"}.isdisjoint(modes.values())
    most = min(CHUNK_CELLS, LIFT_CELLS) if grows else CHUNK_CELLS
    shows = shown is not None
    source = {m: f"_v_{m}" if m in (values or {}) else "_v" for m in modes}

    def translated(number, across):  # (place, number in ``graph``) of numbers in ``lift``
        many = across[0][number + 1] - across[0][number]
        at = np.repeat(np.arange(len(number)), many)
        return at, across[1][across[0][number[at]] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)]

    def run(batches):
        topo, (across, stay, tops, codes) = sent.value, more.value
        n = len(topo.level)
        for t in whole_entries(batches, most):
            first = t["_nth"].to_numpy() == 1
            every = np.cumsum(first) - 1
            numbers = t["_no"].fill_null(-1).to_numpy().astype(np.int64)
            cells = {}
            for read_as in dict.fromkeys(source.values()):
                here = numbers >= 0 if values is None else (numbers >= 0) & t[read_as].is_valid().to_numpy(zero_copy_only=False)
                group, number, changes, value = every[here], numbers[here], t["_convert"].to_numpy(zero_copy_only=False)[here], t[read_as].to_numpy()[here]
                if lifting is None:
                    key = group * n + number
                else:
                    if read_as == "_v":
                        high = lifting.value
                        key, value = climb(high, group * len(high.level) + number, value, "max")
                        key, value = key[value != 0], value[value != 0]
                        group, number = np.divmod(key, len(high.level))
                    at, number = translated(number, across)
                    key, value, changes = group[at] * n + number, value[at], None
                cells[read_as] = key, value, changes
            met: dict = {}  # cells in order and their ends, by column; None where a key repeats

            def beneath(column):
                if column not in met:
                    key, value, changes = cells[column]
                    order = np.argsort(key, kind="stable")
                    key = key[order]
                    met[column] = None if (key[1:] == key[:-1]).any() else (Met(topo, key), value[order], None if changes is None else changes[order])
                return met[column]

            def outcome(mode, column, model):
                key, value, changes = cells[column]
                if mode == "own":
                    return key, value
                if mode == "under":
                    return under(topo, key, value)
                if mode == "ternary":
                    return ternary(topo, key, int(first.sum()), tops)
                if mode in ("max", "fill"):
                    return climb(topo, key, value, mode)
                if mode != "min" and (found := beneath(column)) is not None:
                    at, value, changes = found
                    got = at.settled(value, mode, changes if model is None else ~stay[model][at.key % n], threshold)
                    return at.key[got != 0], got[got != 0]
                return evaluate(topo, key, value, mode, changes if model is None else ~stay[model][key % n], threshold)

            for model in stay or (None,):
                results = [outcome(mode, source[out], model) for out, mode in modes.items()]
                if len(results) == 1:
                    keys, values_of = results[0]
                    columns = [pa.array(values_of)]
                if len(results) > 1 or (keys[1:] <= keys[:-1]).any():
                    keys = distinct(np.concatenate([k for out, (k, _) in zip(modes, results) if out not in beside]))
                    results = [(k, v) if out not in beside else (k[found := np.isin(k, keys)], v[found]) for out, (k, v) in zip(modes, results)]
                    columns = []
                    for k, v in results:
                        whole = np.zeros(len(keys))
                        whole[np.searchsorted(keys, k)] = v
                        columns.append(pa.array(whole))
                if shows:
                    raw, at = np.unique(t["_v"].to_numpy(), return_index=True)
                    some = (x := columns[0].to_numpy()) != 0
                    keys, columns = keys[some], [pa.array(t["_shown"].to_numpy()[at][np.searchsorted(raw, x[some])])]
                if codes:
                    code = codes[0][keys % n]
                    if not (have := code < len(codes[1])).all():
                        keys, code, columns = keys[have], code[have], [c.filter(pa.array(have)) for c in columns]
                    if cut:
                        rank = dense_ranks(keys // n * len(codes[1]) + code, columns[0].to_numpy())
                        if not (have := rank < cut[0]).all():
                            keys, code, rank, columns = keys[have], code[have], rank[have], [c.filter(pa.array(have)) for c in columns]
                    columns.append(codes[1].take(pa.array(code)))
                    columns.extend([pa.array(rank)] if cut else [])
                row = pa.array(np.flatnonzero(first)[keys // n])
                which = [] if model is None else [pa.repeat(pa.scalar(model), len(keys))]
                yield from pa.table([*(t[g].take(row) for g in groups), *which, topo.ids.take(pa.array(keys % n)), *columns],
                                    [*groups, *(["model"] if which else []), "term", *modes, *([label] if codes else []), *([cut[1]] if codes and cut else [])]).to_batches(100_000)

    kinds = ", ".join([*(f"{g} {cells.schema[g].dataType.simpleString()}" for g in groups), *(["model string"] if kept else []),
                       f"term {graph.kind}", *(f"{m} double" for m in modes),
                       *([f"{label} {terms.schema[column].dataType.simpleString()}"] if codes else []), *([f"{cut[1]} int"] if codes and cut else [])])
    done = rows.mapInArrow(run, kinds)
    done._by_code = bool(codes)
    if named is None or codes:
        return done
    t = broadcast_terms(terms.select(F.col("term").alias("_t"), F.col(column).alias(label)), terms.count())
    out = done.join(t, F.col("term") == F.col("_t")).drop("_t")
    out._by_code = False
    return out
