"""Propagation along the edges inside an entry against the closure joins, on rows with nulls, repeats and unknown ids."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termflow.operators import ontology as onto

SCORES = "entry long, term long, prob double"


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(5)
    parents = {t: sorted(rng.sample(range(t), min(t, rng.choice([1, 2, 3])))) for t in range(1, 25) if t % 7}
    edges = spark.createDataFrame([(c, p) for c, ps in parents.items() for p in ps], "child long, parent long")
    terms = spark.createDataFrame([(t, t % 2) for t in range(25) if t not in (0, 9)] + [(4, 0)], "term long, namespace long")  # 0, 9 are no terms, 4 comes twice
    return edges, terms, onto.closure_and_levels(edges, terms)[0], onto.closure(edges)


def _scores(spark, seed):
    rng = random.Random(seed)
    rows = [(e, t, rng.choice([0.0, 0.25, 0.5, 0.9, 1.5, -0.5])) for e in [None, *range(12)] for t in rng.sample(range(27), rng.choice([3, 8, 24]))]
    return spark.createDataFrame(rows + [(1, None, 0.5), (2, 3, None), (3, 5, 0.25), (3, 5, 0.5)], SCORES)


def _rows(df):
    return sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())


def test_propagation_equals_the_closure_joins_and_makes_no_closure(spark, graph):
    edges, terms, clo, joined = graph
    s, neg = _scores(spark, 1), _scores(spark, 2).where("prob > 0.4").select("entry", "term")
    pos, roots = s.where("prob > 0.4").select("entry", "term"), onto.roots(terms, edges)
    whole = onto.clip_scores(s)
    forms = {"max": lambda c: onto.propagate_max(s, c, terms), "raw max": lambda c: onto.enforce_parent_ge_child(s, edges, c, terms),
             "min": lambda c: onto.propagate_min(s, c, terms), "labels": lambda c: onto.propagate_labels(pos, c, terms),
             "step up": lambda c: onto.propagate_step(s, c, terms, "max", 0.1), "step down": lambda c: onto.propagate_step(s, c, terms, "min", 0.7),
             "not": lambda c: onto.negative_propagation(whole, neg, c, terms),
             "ternary": lambda c: onto.ternary_labels(onto.propagate_labels(pos, c, terms), s, edges, terms, roots)}
    for name, form in forms.items():
        assert _rows(form(clo)) == _rows(form(joined)), name
    assert "df" not in vars(clo), "a propagation made the closure table"


def test_steps_of_a_large_graph_lie_in_buckets(spark, graph, monkeypatch):
    """The edges are dealt once, not in every round, and the levels are the same."""
    edges, terms = graph[:2]
    want = [sorted(map(tuple, x[0].collect())) for x in onto.closure_and_levels(edges, terms)[1:]]
    made, plain = [], onto.write_buckets
    monkeypatch.setattr(onto, "BROADCAST_MAX_BYTES", 0)
    monkeypatch.setattr(onto, "write_buckets", lambda df, key, rows: made.append(rows) or plain(df, key, rows))
    got = [sorted(map(tuple, x[0].collect())) for x in onto.closure_and_levels(edges, terms)[1:]]
    assert got == want and made == [2 * edges.distinct().count()]


def test_closure_and_levels_of_ends_that_are_no_terms(spark, graph):
    edges, terms, clo, joined = graph
    assert _rows(clo.df) == _rows(joined.df)
    clo, (depth, most), _ = onto.closure_and_levels(edges.limit(0), terms)
    assert clo.rows == 0 and most == 0 and depth.agg(F.max("level")).first()[0] == 0
    with pytest.raises(ValueError):
        onto.closure_and_levels(spark.createDataFrame([(1, 2), (2, 1)], "child long, parent long"), terms.limit(3))


def test_ranks_inside_a_partition_equal_the_window(spark, monkeypatch):
    from termflow.operators import ranking as rk
    monkeypatch.setattr(rk, "CHUNK_ROWS", 16)
    rng = random.Random(9)
    rows = [(e, rng.choice([0, 1, None]), rng.choice([0.1, 0.2, 0.2, 0.7, None, float("nan")])) for e in [None, *range(30)] for _ in range(rng.choice([1, 5, 20]))]
    df = spark.createDataFrame(rows, "entry long, namespace long, prob double").repartition(3, "entry").sortWithinPartitions("entry")
    here = rk.dense_rank_cut(df, ["entry", "namespace"], "prob", 2, together="entry")
    assert "Window" not in here._jdf.queryExecution().toString()
    assert _rows(here) == _rows(rk.dense_rank_cut(df, ["entry", "namespace"], "prob", 2))


def test_dominant_terms_of_propagated_cells_count_before_the_exchange(spark, graph):
    from termflow.operators import aggregates as ag
    edges, terms, clo, joined = graph
    pos = _scores(spark, 4).where("prob > 0.4").select("entry", "term")
    here, plain = (ag.dominant_terms(onto.propagate_labels(pos, c, terms), 0.1) for c in (clo, joined))
    assert _rows(here) == _rows(plain)


def test_truth_and_predictions_meet_inside_an_entry(spark):
    """Propagated truth and predictions are not joined cell by cell, and give what the join gives; so do labels and their scores."""
    from termflow.operators import metrics as mt
    rng = np.random.default_rng(4)
    parents = {c: sorted({(c // 2), (c // 3)} - {c}) for c in range(1, 40)}
    edges = spark.createDataFrame([(c, p) for c, ps in parents.items() for p in ps], "child long, parent long")
    for copies in (1, 2):
        terms = spark.createDataFrame([(t, t % 2, t / 8) for t in range(40) for _ in range(copies)], "term long, namespace long, ia double")
        ann = spark.createDataFrame([(int(e), int(t)) for e, t in rng.integers((0, 0), (30, 40), (60, 2))] + [(None, 3)], "entry long, term long")
        scores = spark.createDataFrame([(int(e), int(t), float(p)) for (e, t), p in zip(rng.integers((5, 0), (40, 40), (90, 2)), rng.random(90))] + [(None, 5, .5)],
                                       "entry long, term long, prob double")
        clo = onto.closure_and_levels(edges, terms)[0]
        truth, preds = onto.propagate_labels(ann, clo, terms), onto.propagate_max(scores, clo, terms)
        plain = truth.select("*"), preds.select("*")
        if copies == 1:
            plan = onto.matched(truth, preds, terms)._jdf.queryExecution().optimizedPlan().toString()
            assert "LeftOuter" not in plan and "FullOuter" not in plan
        for f in (lambda a, b: mt.weighted_fmax(a, b, terms), lambda a, b: mt.threshold_table(a, b, terms, [.2, .5, .7], "pred")):
            show = lambda df: sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()])
            assert show(f(truth, preds)) == show(f(*plain))
        if copies == 1:
            roots = onto.roots(terms, edges)
            one = scores.groupBy("entry", "term").agg(F.max("prob").alias("prob"))
            got = onto.ternary_labels(truth, ann, edges, terms, roots, one)
            joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in x]
            assert not any("entry#" in x for x in joins)
            want = onto.ternary_labels(plain[0], ann, edges, terms, roots, one)
            key = lambda df: sorted(map(str, (r.asDict() for r in df.select("entry", "term", "label", "prob").collect())))
            assert key(got) == key(want)
