"""Hand-worked DAG goldens: A->R, B->R, C->A, C->B, D->C (child->parent)."""

import pytest
from pyspark.sql import functions as F

from termflow.operators import ontology as onto

IDS = {"R": 0, "A": 1, "B": 2, "C": 3, "D": 4}
NAME = {v: k for k, v in IDS.items()}
EDGES = [("A", "R"), ("B", "R"), ("C", "A"), ("C", "B"), ("D", "C")]


@pytest.fixture(scope="module")
def dag(spark):
    terms = spark.createDataFrame([(i, 0, 1.0) for i in IDS.values()], "term long, namespace long, ia double")
    edges = spark.createDataFrame([(IDS[c], IDS[p]) for c, p in EDGES], "child long, parent long")
    clo, down, up = onto.closure_and_levels(edges, terms)
    return terms, edges, clo, down, up


def scores(spark, d):
    return spark.createDataFrame([(1, IDS[k], float(v)) for k, v in d.items()], "entry long, term long, prob double")


def as_dict(df, col="prob"):
    return {NAME[r["term"]]: round(r[col], 6) for r in df.collect()}


SAME = {"D": .9, "C": 0, "A": .3, "B": 0, "R": .1}


def test_closure(dag):
    clo = dag[2]
    pairs = {(NAME[r.child], NAME[r.ancestor]) for r in clo.df.collect()}
    assert pairs == {("A", "R"), ("B", "R"), ("C", "A"), ("C", "B"), ("C", "R"),
                     ("D", "C"), ("D", "A"), ("D", "B"), ("D", "R")}
    assert clo.rows == 9


def test_levels(dag):
    down = dag[3][0]
    assert {NAME[r.term]: r.level for r in down.collect()} == {"R": 0, "A": 1, "B": 1, "C": 2, "D": 3}
    assert dag[3][1] == 3


def test_max(spark, dag):
    terms, edges, clo, _, _ = dag
    out = as_dict(onto.propagate_max(scores(spark, SAME), clo, terms))
    assert out == {k: .9 for k in IDS}


def test_fill(spark, dag):
    terms, edges, clo, _, up = dag
    out = as_dict(onto.propagate_fill(scores(spark, SAME), edges, terms, levels=up))
    assert out == {"D": .9, "C": .9, "A": .3, "B": .9, "R": .1}


def test_min(spark, dag):
    terms, edges, clo, _, _ = dag
    out = {k: v for k, v in as_dict(onto.propagate_min(scores(spark, SAME), clo, terms)).items() if v}
    assert out == {"R": .1, "A": .1}


def test_min_blend(spark, dag):
    terms, edges, clo, _, _ = dag
    out = as_dict(onto.propagate_step(scores(spark, SAME), clo, terms, direction="min", lr=.7))
    assert out == {"D": .27, "A": .16, "R": .1}


COND = {"R": 1, "A": .5, "B": .4, "C": .8, "D": .9}


def test_conditional_any(spark, dag):
    terms, edges, clo, down, _ = dag
    out = as_dict(onto.conditional_to_marginal(scores(spark, COND), edges, terms, "any", levels=down))
    assert out == {"R": 1, "A": .5, "B": .4, "C": .56, "D": .504}


def test_conditional_all(spark, dag):
    terms, edges, clo, down, _ = dag
    out = as_dict(onto.conditional_to_marginal(scores(spark, COND), edges, terms, "all", levels=down))
    assert out == {"R": 1, "A": .5, "B": .4, "C": .16, "D": .144}


def test_negative(spark, dag):
    terms, edges, clo, _, _ = dag
    preds = scores(spark, {k: .5 for k in IDS})
    neg = spark.createDataFrame([(1, IDS["C"])], "entry long, term long")
    out = as_dict(onto.negative_propagation(preds, neg, clo, terms))
    assert set(out) == {"R", "A", "B"}


def test_ternary(spark, dag):
    terms, edges, clo, _, _ = dag
    roots = onto.roots(terms, edges)
    pos = spark.createDataFrame([(1, IDS[k]) for k in "RAC"], "entry long, term long")
    out = as_dict(onto.ternary_labels(pos, pos, edges, terms, roots), "label")
    assert out == {"R": 1, "A": 1, "B": 0, "C": 1, "D": 0}
    pos = spark.createDataFrame([(1, IDS["D"])], "entry long, term long")
    out = as_dict(onto.ternary_labels(pos, pos, edges, terms, roots), "label")
    assert out == {"R": 0}


def test_max_idempotent_and_monotone(spark, dag):
    terms, edges, clo, _, _ = dag
    s = scores(spark, {"D": .2, "A": .7, "B": .1})
    v1 = onto.propagate_max(s, clo, terms)
    v2 = onto.propagate_max(v1, clo, terms)
    assert as_dict(v1) == as_dict(v2)
    d1 = as_dict(v1)
    for child, parent in EDGES:
        assert d1.get(parent, 0) >= d1.get(child, 0)


def test_alternative_ids_stand_for_their_terms(spark, tmp_path):
    """Edges, truth and predictions may name a term by an alternative id."""
    from termflow.operators import ontology as onto
    from termflow.sources import formats
    terms = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "term long, namespace long")
    alt = spark.createDataFrame([(20, 2), (30, 3)], "alt_id long, term long")
    edges = spark.createDataFrame([(20, 1), (2, 1), (30, 1), (99, 1)], "child long, parent long")
    assert sorted(map(tuple, onto.restrict_edges(edges, terms, alt).collect())) == [(2, 1)]
    scores = spark.createDataFrame([(7, 20, 0.5), (7, 1, 0.2), (7, 98, 0.9)], "entry long, term long, prob double")
    got = onto.resolve_aliases(scores, onto.alias_map(terms, alt), "term")
    assert sorted(map(tuple, got.select("entry", "term", "prob").collect())) == [(7, 1, 0.2), (7, 2, 0.5)]
    (tmp_path / "x.obo").write_text("format-version: 1.2\n\n[Term]\nid: T:1\nname: root\nnamespace: a\nalt_id: T:9\n\n"
                                    "[Term]\nid: T:2\nname: leaf\nnamespace: a\nis_a: T:9 ! old name\n\n")
    _, e = formats.read_obo(spark, str(tmp_path / "x.obo"))
    assert [tuple(r) for r in e.select("child", "parent").collect()] == [("T:2", "T:1")]


def test_min_propagation_emits_no_zeros(spark):
    from termflow.operators import ontology as onto
    terms = spark.createDataFrame([(1, 0), (2, 0)], "term long, namespace long")
    clo = onto.closure(spark.createDataFrame([(2, 1)], "child long, parent long"))
    scores = spark.createDataFrame([(5, 2, 0.5), (6, 2, 0.5), (6, 1, 0.4)], "entry long, term long, prob double")
    got = sorted(map(tuple, onto.propagate_min(scores, clo, terms).collect()))
    assert got == [(6, 1, 0.4), (6, 2, 0.4)]


def _dense(parents, order, s, mode, keep=(), threshold=0.0):
    """One entry, term by term in the order of levels, on plain dictionaries."""
    v = {}
    for t in order:
        x = s.get(t, 0.0)
        ps = [v[p] for p in parents[t]]
        if ps and t not in keep:
            if mode == "any":
                q = 1.0
                for p in ps:
                    q *= 1 - p
                x *= 1 - q
            elif mode == "all":
                for p in ps:
                    x *= p
            elif max(ps) < threshold:
                x *= max(ps)
        v[t] = x
    return {t: x for t, x in v.items() if x}


def test_level_modes_equal_a_dense_walk_and_the_join_form(spark, monkeypatch):
    import random

    from termflow.operators import levelwise
    from termflow.operators import ontology as onto
    rng = random.Random(3)
    parents = {t: sorted(rng.sample(range(t), min(t, rng.choice([1, 1, 2, 3])))) if t > 2 else [] for t in range(30)}
    edges = spark.createDataFrame([(c, p) for c, ps in parents.items() for p in ps], "child long, parent long")
    terms = spark.createDataFrame([(t,) for t in range(30)], "term long")
    scores = {e: {t: rng.choice([0.25, 0.5, 1.0, 0.9]) for t in rng.sample(range(30), rng.randrange(1, 30))} for e in range(40)}
    cells = spark.createDataFrame([(e, t, x) for e, s in scores.items() for t, x in s.items()], "entry long, term long, prob double")
    even = terms.where("term % 2 = 0")
    runs = {"any": lambda: onto.conditional_to_marginal(cells, edges, terms, "any"), "all": lambda: onto.conditional_to_marginal(cells, edges, terms, "all"),
            "kept": lambda: onto.conditional_to_marginal(cells, edges, terms, "any", only_terms=terms.where("term % 2 = 1")),
            "suppress": lambda: onto.suppress_children(cells, edges, terms, 0.6), "fill": lambda: onto.propagate_fill(cells, edges, terms)}
    want = {"any": {}, "all": {}, "kept": {}, "suppress": {}}
    for e, s in scores.items():
        for name, mode, keep in (("any", "any", ()), ("all", "all", ()), ("kept", "any", range(0, 30, 2)), ("suppress", "suppress", ())):
            want[name] |= {(e, t): x for t, x in _dense(parents, range(30), s, mode, keep, 0.6).items()}
    monkeypatch.setattr(levelwise, "CHUNK_CELLS", 64)
    local = {k: {(r.entry, r.term): r.prob for r in f().collect()} for k, f in runs.items()}
    for name, w in want.items():
        assert local[name].keys() == w.keys() and all(abs(local[name][k] - x) < 1e-12 for k, x in w.items()), name
    models = cells.selectExpr("entry", "term", "explode(array('c', 'r')) as model", "prob")
    both = onto.conditional_both(models, edges, terms, even.selectExpr("'r' as model", "term")).collect()
    assert {(r.entry, r.term): r["any"] for r in both if r.model == "r" and r["any"]}.keys() == want["kept"].keys()
    for r in both:
        if r.model == "c":
            assert abs(r["any"] - want["any"].get((r.entry, r.term), 0)) < 1e-12 and abs(r["all"] - want["all"].get((r.entry, r.term), 0)) < 1e-12
    monkeypatch.setattr(levelwise, "TOPOLOGY_BYTES", 0)  # the form for a graph that cannot be broadcast
    for name, f in runs.items():
        joined = {(r.entry, r.term): r.prob for r in f().collect()}
        assert joined.keys() == local[name].keys() and all(abs(joined[k] - x) < 1e-12 for k, x in local[name].items()), name
