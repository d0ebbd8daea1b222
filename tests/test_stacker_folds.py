"""Stacker base and delta against dense arrays; label folds against the same rounds on plain lists."""

import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from termflow.functions.scalar import key_hash
from termflow.operators import levelwise, stacker, stratify
from termflow.operators import ontology as onto


def dense(parents, preds, conditional, own, raw, cond, n):
    """Slots (known, raw, all, any) of one entry and model over all terms."""
    known, first = np.ones(n), (cond if conditional else raw).copy()
    start = cond.copy()
    for t in own:
        known[t], first[t], start[t] = 0, preds.get(t, 0.0), preds.get(t, 0.0)
    both, any_ = start.copy(), start.copy()
    for t in range(n):
        if parents[t] and (conditional or t not in own):
            any_[t] *= 1 - np.prod([1 - any_[p] for p in parents[t]])
            both[t] *= np.prod([both[p] for p in parents[t]])
    return np.array([known, first, both, any_])


def test_stacker_equals_dense_arrays(spark, monkeypatch):
    rng, n = random.Random(4), 25
    parents = {t: sorted(rng.sample(range(t), min(t, rng.choice([1, 1, 2, 3])))) if t > 1 else [] for t in range(n)}
    edges = spark.createDataFrame([(c, p) for c, ps in parents.items() for p in ps], "child long, parent long")
    terms = spark.createDataFrame([(t,) for t in range(n)], "term long")
    own = {"c": set(range(0, n, 2)), "r": set(range(n)) - {3, 8, 9, 20}}
    raw, cond = np.array([rng.random() for _ in range(n)]), np.array([rng.choice([0.0, 0.3, 0.7]) for _ in range(n)])
    preds = {(e, m): {t: rng.choice([0.25, 0.5, 1.0]) for t in rng.sample(sorted(own[m]), rng.randrange(6))} for e in range(30) for m in own}
    rows = [(e, t, m, x) for (e, m), p in preds.items() for t, x in p.items()] + [(0, 1, "c", 0.9), (1, 0, "c", 0.0)]  # not a term of c; a zero
    preds[1, "c"].pop(0, None)
    rows = [r for r in rows if not (r[0] == 1 and r[2] == "c" and r[1] == 0 and r[3] > 0)]
    frames = (spark.createDataFrame(rows, "entry long, term long, model string, prob double"), spark.createDataFrame([("c", True), ("r", False)], "model string, conditional boolean"),
              spark.createDataFrame([(m, t) for m, ts in own.items() for t in ts], "model string, term long"),
              spark.createDataFrame([(t, float(raw[t]), float(cond[t])) for t in range(n)], "term long, prior_raw double, prior_cond double"))
    monkeypatch.setattr(levelwise, "CHUNK_CELLS", 20)
    base, delta = stacker.stack(*frames, edges, onto.term_levels(terms, edges, direction="down")[0])
    asked = spark.createDataFrame([(e, m, t) for e in range(30) for m in own for t in range(n)], "entry long, model string, term long")
    got = {(r.entry, r.model, r.term): (r.known, r.raw, r["all"], r["any"]) for r in stacker.stack_view(base, delta, asked).collect()}
    assert len(got) == 30 * 2 * n
    differ = 0
    empty = {m: dense(parents, {}, m == "c", own[m], raw, cond, n) for m in own}
    for e in range(30):
        for m in own:
            want = dense(parents, preds[e, m], m == "c", own[m], raw, cond, n)
            differ += int((np.abs(want - empty[m]) > 1e-9).any(axis=0).sum())
            for t in range(n):
                assert np.abs(np.array(got[e, m, t]) - want[:, t]).max() < 1e-9, (e, m, t)
    assert delta.count() == differ  # no cell is stored that the base has


def test_a_large_entry_is_joined_once(monkeypatch):
    """Its rows are copied once, not with every batch that comes."""
    copied = []

    class Counting:
        @staticmethod
        def from_batches(held):
            copied.append(sum(b.num_rows for b in held))
            return pa.Table.from_batches(held)
    monkeypatch.setattr(levelwise, "pa", SimpleNamespace(Table=Counting))
    nth = [1, 2, 1, *range(1, 1001), *range(1, 4), 1]
    rows = pa.table({"_nth": nth, "x": range(len(nth))})
    got = list(levelwise.whole_entries(rows.to_batches(max_chunksize=10), most=10))
    assert pa.concat_tables(got).equals(rows) and all(t["_nth"][0].as_py() == 1 for t in got) and len(got) >= 3
    assert sum(copied) <= 3 * len(nth)


def test_stacker_sends_one_graph(spark, monkeypatch):
    """The graph is made once for base and delta, and base rows reach the driver without their names."""
    made, plain = [], levelwise.topology
    for module in (levelwise, stacker):
        monkeypatch.setattr(module, "topology", lambda *a, **k: made.append(1) or plain(*a, **k), raising=False)
    edges = spark.createDataFrame([(1, 0), (2, 1)], "child long, parent long")
    frames = (spark.createDataFrame([("e", 1, "c", 0.5)], "entry string, term long, model string, prob double"), spark.createDataFrame([("c", True)], "model string, conditional boolean"),
              spark.createDataFrame([("c", 1)], "model string, term long"), spark.createDataFrame([(t, 0.1, 0.2) for t in range(3)], "term long, prior_raw double, prior_cond double"))
    base, delta = stacker.stack(*frames, edges, onto.term_levels(spark.range(3).toDF("term"), edges, direction="down")[0])
    assert len(made) == 1 and base.count() == 3
    got = {r.term: (r.known, round(r["all"], 9), round(r["any"], 9)) for r in delta.collect()}
    assert got == {1: (0, 0.1, 0.1), 2: (1, 0.02, 0.02)}


def plain_rounds(pairs, k, top, hashes):
    own, freq = {}, Counter(t for _, t in pairs)
    picked = sorted(freq, key=lambda t: (-freq[t], t))[:top]
    for e, t in pairs:
        own.setdefault(e, set()).update({picked.index(t)} if t in picked else set())
    fold = {}
    while len(fold) < len(own):
        left = Counter(x for e, ls in own.items() if e not in fold for x in ls)
        label = min(left, key=lambda x: (left[x], x)) if left else None
        turn = sorted((e for e in own if e not in fold and (label is None or label in own[e])), key=lambda e: (hashes[e], e))
        sizes = [list(fold.values()).count(f) for f in range(k)]
        got = sizes if label is None else [sum(fold.get(e) == f for e, ls in own.items() if label in ls) for f in range(k)]
        for f, n in enumerate(stratify.shares(len(turn), len(turn) + sum(got), got, sizes)):
            for e in turn[:n]:
                fold[e] = f
            turn = turn[n:]
    return fold, own


def test_label_folds(spark):
    rng = random.Random(1)
    pairs = sorted({(e, min(int(rng.paretovariate(.8)), 40)) for e in range(400) for _ in range(rng.randrange(1, 5))})
    labels = spark.createDataFrame(pairs + pairs[:9], "entry long, term long")
    hashes = {r.entry: r.h for r in labels.select("entry", key_hash("entry").alias("h")).distinct().collect()}
    got = {r.entry: r.fold for r in stratify.stratified_label_folds(labels, 4, 6).collect()}
    want, own = plain_rounds(pairs, 4, 6, hashes)
    assert got == want
    again = {r.entry: r.fold for r in stratify.stratified_label_folds(labels.repartition(5), 4, 6).collect()}
    assert again == got
    rarest = max((x for ls in own.values() for x in ls))  # dealt first: within one of an even share
    n = Counter(got[e] for e, ls in own.items() if rarest in ls)
    assert max(n.values()) - min(n.get(f, 0) for f in range(4)) <= 1
    assert max(Counter(got.values()).values()) - min(Counter(got.values()).values()) <= 12


def test_shares():
    assert stratify.shares(10, 10, [0, 0, 0], [0, 0, 0]) == [4, 3, 3]
    assert stratify.shares(3, 12, [4, 4, 1], [9, 9, 9]) == [0, 0, 3]
    assert stratify.shares(2, 9, [6, 1, 0], [0, 5, 4]) == [0, 1, 1] and stratify.shares(0, 0, [0, 0], [0, 0]) == [0, 0]
