"""Column functions on hand-made rows."""

import math

from pyspark.sql import functions as F

from termflow.functions import scalar as fn


def test_clean_id_and_header_fields(spark):
    df = spark.createDataFrame([("b'sp|P12345|ABC_HUMAN'",), ("Q9XYZ1 some text",), ("  A0A0 ",)], "raw string")
    got = [r.c for r in df.select(fn.clean_id("raw").alias("c")).collect()]
    assert got == ["P12345", "Q9XYZ1", "A0A0"]
    h = spark.createDataFrame([("sp|P1|G_HUMAN Kinase 2 OS=Homo sapiens OX=9606 GN=G1 PE=1 SV=3",)], "h string")
    r = h.select(*[fn.header_field("h", k).alias(k) for k in ("OS", "OX", "GN", "PE", "SV")]).first()
    assert (r.OS, r.OX, r.GN, r.PE, r.SV) == ("Homo sapiens", "9606", "G1", "1", "3")


def test_sequence_helpers(spark):
    df = spark.createDataFrame([("MUZOBK",)], "s string")
    r = df.select(fn.mask_rare_residues("s").alias("m"), fn.truncate_seq("s", 3).alias("t")).first()
    assert r.m == "M X X X X K" and r.t == "MUZ"


def test_parse_int_list_and_weights(spark):
    df = spark.createDataFrame([("10, 3,1,,x,3",), ("",), (None,)], "s string")
    got = [r.v for r in df.select(fn.parse_int_list("s", [1, 3, 5, 10]).alias("v")).collect()]
    assert got == [[1, 3, 10], [1, 3, 5, 10], [1, 3, 5, 10]]
    w = spark.createDataFrame([(1.5,), (float("nan"),), (None,), (float("inf"),)], "w double")
    assert [r.v for r in w.select(fn.weight_or_zero("w").alias("v")).collect()] == [1.5, 0.0, 0.0, 0.0]


def test_qualifier_aspect_and_math(spark):
    df = spark.createDataFrame([("", "F"), (" ", "P"), ("NOT|enables", "F"), (None, "X")], "q string, a string")
    got = [r.v for r in df.select(fn.default_qualifier("q", "a").alias("v")).collect()]
    assert got == ["enables", "involved_in", "NOT|enables", "other"]
    a = spark.createDataFrame([("biological_process",), ("C",), ("other",)], "n string")
    assert [r.v for r in a.select(fn.aspect_code("n").alias("v")).collect()] == ["BPO", "CCO", "other"]
    m = spark.createDataFrame([(0.5, 0.0)], "p double, z double").select(
        fn.logit("p").alias("l"), fn.sigmoid("z").alias("s"), fn.safe_f(F.lit(0.0), F.lit(0.0)).alias("f"),
        fn.s_distance(F.lit(3.0), F.lit(4.0)).alias("d"), fn.contains_or_false(F.lit(None).cast("string"), "NOT").alias("c"),
        fn.one_hot(F.lit(2), 4).alias("o"), fn.one_hot(F.lit(-1), 3).alias("o0")).first()
    assert abs(m.l) < 1e-12 and m.s == 0.5 and m.f == 0.0 and m.d == 5.0 and m.c is False
    assert m.o == [0.0, 0.0, 1.0, 0.0] and m.o0 == [0.0, 0.0, 0.0]
    pool = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])],
                                 "t array<array<double>>, m array<int>")
    assert pool.select(fn.masked_mean_pool("t", "m").alias("p")).first().p == [2.0, 3.0]
    assert math.isclose(spark.range(1).select(fn.l2_norm(F.array(F.lit(3.0), F.lit(4.0))).alias("n")).first().n, 5.0)


def test_cutoff_profile_counts_an_entity_once(spark):
    """All cut-offs come from one row an entity: no row is multiplied by the number of cut-offs."""
    import numpy as np
    from termflow.operators import aggregates as ag
    rng = np.random.default_rng(1)
    rows = [(int(e), float(p)) for e, p in zip(rng.integers(0, 40, 300), rng.random(300).round(2))] + [(None, .9), (None, .1), (7, None)]
    out = ag.cutoff_profile(spark.createDataFrame(rows, "entry long, prob double"), [.2, .5, .95])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("inline(") < plan.index("Aggregate [entry#")
    for r in out.collect():
        per = {}
        for e, p in rows:
            if p is not None and p >= r.cutoff:
                per[e] = per.get(e, 0) + 1
        n = list(per.values())
        assert (r.entities, r.max_rows) == (len(n), max(n)) and abs(r.mean_rows - np.mean(n)) < 1e-12 and abs(r.p95_rows - np.percentile(n, 95)) < 1e-12


def test_fold_merge_in_more_partitions(spark):
    """The partitions grow with the rows, and the sums do not change."""
    from termflow.operators import pairs as pr
    from termflow.session import parts_of
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts_of(spark, 1) == few and parts_of(spark, 100 * (few << 21)) == 100 * few
    folds = [spark.createDataFrame([(e, t, (e + t) / 4) for e in range(9) if e % 3 == k for t in range(5)], "entry long, term long, prob double") for k in range(3)]
    got = pr.fold_merge(folds, "test", parts=5 * few)
    assert got.rdd.getNumPartitions() == 5 * few
    assert sorted(map(tuple, got.collect())) == sorted((e, t, (e + t) / 4 / 3) for e in range(9) for t in range(5))
