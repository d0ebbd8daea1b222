import numpy as np
import pytest

from termflow.operators import levelwise as lw


def made(n, seed, up, edges=2.0):
    rng = np.random.default_rng(seed)
    child = rng.integers(1, n, int(edges * n))
    parent = (child * rng.random(len(child))).astype(int)
    child, parent = np.unique(np.c_[child, parent], axis=0).T
    level = np.zeros(n, int)
    for c, p in sorted(zip(child, parent)) if not up else sorted(zip(child, parent), reverse=True):
        a, b = (p, c) if not up else (c, p)
        level[b] = max(level[b], level[a] + 1)
    return lw.Topology(level, *((child, parent) if up else (parent, child))), rng


def as_table(got):
    order = np.argsort(got[0])
    return got[0][order], got[1][order]


@pytest.mark.parametrize("seed", range(6))
def test_climb_and_met_equal_evaluate(seed):
    """The packed climb and the shared ends give what the level loop gives, bit by bit."""
    up, rng = made(60, seed, True)
    key = rng.choice(7 * 60, 120, replace=False)
    value = rng.choice([0.0, 0.1, 0.30000000000000004, 0.7, 1.0, np.nan] if seed % 2 else [0.0, 0.25, -0.5, 3.0], 120)
    for mode in ("max", "fill"):
        want, got = as_table(lw.evaluate(up, key, value, mode)), lw.climb(up, key, value, mode)
        assert (want[0] == got[0]).all() and np.array_equal(want[1], got[1], equal_nan=True)
    down, _ = made(60, seed, False)
    for keys in (key, lw.climb(up, key, value, "max")[0]):  # any cells, and all above them
        keys = np.sort(keys)
        value, convert = rng.random(len(keys)), rng.random(len(keys)) < 0.7
        value[rng.random(len(keys)) < 0.1] = 0.0
        met = lw.Met(down, keys)
        for mode in ("any", "all", "suppress"):
            for stay in (None, convert):
                want, got = as_table(lw.evaluate(down, keys, value, mode, stay, 0.5)), met.settled(value, mode, stay, 0.5)
                assert (keys[got != 0] == want[0]).all() and (got[got != 0] == want[1]).all()


def test_ternary_cells_without_positives():
    up, _ = made(20, 1, True)
    key, label = lw.ternary(up, np.zeros(0, np.int64), 2, np.array([0]))
    assert key.tolist() == [0, 20] and not label.any()


def test_rounding_of_doubles_is_that_of_spark(spark):
    from termflow.plans.common import r6, r6_double
    rng = np.random.default_rng(4)
    x = np.r_[rng.random(3000), rng.integers(0, 10**7, 3000) / 1e6 + 5e-7, rng.integers(-10**8, 10**8, 2000) / 2e6, rng.normal(size=500) * 10.0 ** rng.integers(-9, 16, 500),
              0.0, -0.0, -1e-9, 4.9999e-7, 5e-7, 1e6, np.nan, np.inf, -np.inf, 0.1 + 0.2, 1 - 1e-7]
    rows = [(float(v),) for v in x] + [(None,)]
    df = spark.createDataFrame(rows, "x double")
    assert df.where(~r6_double("x").eqNullSafe(r6("x"))).count() == 0
    assert df.where(r6_double("x").cast("string") != r6("x").cast("string")).count() == 0


def test_names_of_terms_travel_with_the_graph(spark):
    """No hash table of the terms is made, on the driver or in the tasks, unless a term comes twice; null names and ends that are no terms."""
    from termflow.operators import ontology as onto
    terms = spark.createDataFrame([(0, 7), (1, None), (2, 9), (None, 5)], "term long, namespace long")
    edges = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (2, 5)], "child long, parent long")
    ann = spark.createDataFrame([(10, 2), (11, 3), (None, 1)], "entry long, term long")
    clo = onto.closure_and_levels(edges, terms)[0]
    want = [(None, 0, 7), (None, 1, None), (10, 0, 7), (10, 1, None), (10, 2, 9), (11, 0, 7), (11, 1, None)]
    got = onto.propagate_labels(ann, clo, terms)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(got) == sorted(want, key=str) and rows(got._cells) == sorted([w[:2] for w in want], key=str)
    twice = terms.union(terms.where("term = 2"))
    again = onto.propagate_labels(ann, onto.closure_and_levels(edges, twice)[0], twice)
    assert rows(again) == sorted([*want, (10, 2, 9)], key=str) and rows(again._cells) == sorted([w[:2] for w in want], key=str)
    wide = spark.range(30_000).selectExpr("id as term", "id % 3 as namespace")
    plan = onto.propagate_labels(ann, onto.closure_and_levels(edges, wide)[0], wide)._jdf.queryExecution().executedPlan().toString()
    assert "namespace" not in plan


def test_ranks_in_the_task_that_propagates(spark):
    from termflow.operators import ontology as onto
    from termflow.operators import ranking as rk
    from termflow.plans.common import r6, r6_double
    rng = np.random.default_rng(8)
    terms = spark.createDataFrame([(i, i % 2) for i in range(40)], "term long, namespace long")
    edges = spark.createDataFrame(sorted({(i, int(i * x)) for i in range(1, 40) for x in rng.random(2)}), "child long, parent long")
    cells = [(int(e), int(t), float(v)) for e, t, v in zip(rng.integers(0, 30, 200), rng.integers(0, 40, 200), rng.choice([0.0, 1e-7, 2e-7, 0.1, 0.1000001, 0.5, 0.9], 200))]
    s = spark.createDataFrame([*{c[:2]: c for c in cells}.values(), (None, 3, 0.4)], "entry long, term long, prob double")
    for of in (terms, terms.union(terms.where("term = 2"))):
        clo = onto.closure_and_levels(edges, of)[0]
        v = onto.propagate_max(s, clo, of, name="namespace", shown=r6_double)
        got = rk.dense_rank_cut(v, ["entry", "namespace"], "prob", 2, together="entry")
        plain = onto.propagate_max(s, clo, of).select("entry", "term", r6("prob").alias("prob")).join(of.select("term", "namespace"), "term")
        want = rk.dense_rank_cut(plain, ["entry", "namespace"], "prob", 2)
        names = ["entry", "term", "namespace", "prob", "rank"]
        key = lambda df: sorted(map(str, df.select(names).collect()))
        assert key(got) == key(want) and key(v.withColumn("rank", v.prob)) == key(plain.withColumn("rank", plain.prob))


def test_annotations_are_dealt_by_a_number(spark, tmp_path):
    """Adaptive execution does not join these partitions, however few bytes they hold; pairs are distinct."""
    from termflow.sources import fixtures as fx
    rows = [(o, p, f) for o in range(50) for p in (1, 2, 2) for f in "RN"] + [(None, 3, "R"), (None, 3, "R")]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = fx.annotations(spark, str(tmp_path))
    assert got.count() == 101 and "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
