"""Steps whose tasks must not hold more of a larger input."""

from __future__ import annotations

import gzip
import itertools
import random

from pyspark.sql import functions as F

from termflow.operators import graph as gr
from termflow.operators import newton
from termflow.operators import ontology as onto
from termflow.operators import pairs as pr
from termflow.operators import similar
from termflow.sources import fixtures as fx
from termflow.sources import formats as fm


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dialects_are_found_without_a_sort_of_the_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("protein1,protein2,combined_score\nx,y,7\n")
    with gzip.open(tmp_path / "b.gz", "wt") as f:
        f.write("combined_score protein2 protein1\n9 u  v\n3 w z\n")
    got = fm.read_links(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == [("v", "u", 9.0), ("x", "y", 7.0), ("z", "w", 3.0)]
    assert "Sort" not in plan(got)


def test_two_hops_and_neighbours_grow_partitions(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(onto, "STEP_CELLS", 1)
    edges = spark.createDataFrame([(3, 1), (3, 2), (2, 1), (1, 0), (4, None), (None, 0)], "child long, parent long")
    cells = spark.createDataFrame([(7, 3, 0.5), (7, 2, 0.9), (None, 3, 0.4), (8, 9, 0.1), (8, None, 0.3)], "entry long, term long, prob double")
    for limit in (onto.BROADCAST_MAX_BYTES, 0):
        monkeypatch.setattr(onto, "BROADCAST_MAX_BYTES", limit)
        got = onto.enforce_parent_ge_child(cells, edges, None, None, max_hops=2)
        want = {(7, 3): 0.5, (7, 2): 0.9, (7, 1): 0.9, (7, 0): 0.9, (None, 3): 0.4, (None, 2): 0.4, (None, 1): 0.4, (None, 0): 0.4, (8, 9): 0.1, (8, None): 0.3}
        assert {(r.entry, r.term): r.prob for r in got.collect()} == want
        near = onto.neighbour_aggregate(cells, edges, "bwd")
        assert {(r.entry, r.term): (round(r.mean_1, 6), r.max_1) for r in near.collect()} == {
            (7, 1): (0.7, 0.9), (7, 2): (0.5, 0.5), (None, 1): (0.4, 0.4), (None, 2): (0.4, 0.4)}
    met, n = onto._beside_edges(cells, edges, "child")
    assert n >= 2 * cells.count() and met.rdd.getNumPartitions() >= cells.count()
    spark.range(40).select(F.col("id").alias("l_orderkey"), F.col("id").alias("l_partkey"), F.lit(0.1).alias("l_tax"), F.lit(1).alias("l_linenumber")).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(fx, "parts_of", lambda s, rows, each: rows)
    assert fx.predictions_raw(spark, str(tmp_path)).rdd.getNumPartitions() == 40


def test_terms_of_a_hit_travel_as_one_row(spark):
    hits = spark.createDataFrame([(1, 10, 0.5, 1e-9, 9.0), (1, 11, 0.8, 1e-9, 8.0), (1, 12, 0.9, 1e-9, 7.0), (2, 10, 0.4, 1.0, 9.0), (None, 11, 0.3, 0.0, 1.0), (3, None, 0.3, 0.0, 1.0)],
                                 "query long, target long, identity double, evalue double, bits double")
    terms = spark.createDataFrame([(10, 1), (10, 1), (10, 2), (11, 2), (11, None), (12, 3), (None, 4)], "entry long, term long")
    got = pr.hit_label_transfer(hits, terms, k=2)
    assert {(r.entry, r.term): (r.prob, r.n_hits) for r in got.collect()} == {
        (1, 1): (0.5, 1), (1, 2): (0.8, 2), (1, None): (0.8, 1), (None, 2): (0.3, 1), (None, None): (0.3, 1)}
    text = plan(got)
    assert text.index("Generate explode") < text.index("Exchange")  # unfolded behind the last exchange


def test_steps_of_walks_deal_only_walkers(spark):
    edges = spark.createDataFrame([("a", f"n{i:02}", float(i % 3 + 1)) for i in range(20)], "src string, dst string, weight double")
    for fan in (4, 256):
        _, levels = gr.walk_index(edges, fan)
        for k, level in enumerate(levels):
            state = level.select("node", "block").distinct().withColumn("x", F.lit(0.0))
            joined = level.join(state.hint("shuffle_hash"), ["node", "block"] if k else "node")
            assert "Bucketed: true" in joined._jdf.queryExecution().explainString(joined._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    one, other = ({tuple(r) for r in gr.random_walks(edges, 2, 4, fan=f).collect()} for f in (4, 256))
    assert one == other and len(one) == 21 * 2 * 4


def test_chunks_hold_runs_of_rows(spark, monkeypatch):
    rng = random.Random(1)
    feats = spark.createDataFrame([(i, [rng.random(), rng.random()]) for i in range(50)] + [(None, [0.0, 0.0])], "entry long, vec array<double>")
    cells = spark.createDataFrame([(i, j, float(rng.random() < 0.5)) for i in range(50) for j in range(3)] + [(None, 1, 1.0), (0, 0, None)], "entry long, label_id long, y double")
    monkeypatch.setattr(newton, "CHUNK_ROWS", 8)
    monkeypatch.setattr(newton, "CELLS_EACH", 40)
    chunks, labels = newton.pack(feats, cells, 2, 2, "vec")
    rows = chunks.collect()
    assert labels.count() == 3 and {r.block for r in rows} == {0, 1}
    assert sum(len(r.x) // 16 for r in rows) == 100 and all(len(r.x) <= 8 * 16 and len(r.y) * 2 == len(r.x) for r in rows)


def test_similar_sequences_agree_with_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    base = [[rng.choice("abcde") for _ in range(30)] for _ in range(6)]
    seqs = []
    for i in range(60):
        s = list(base[i % 6])
        for _ in range(i % 5):
            s[rng.randrange(len(s))] = rng.choice("abcde")
        seqs.append((i, "".join(s)))
    monkeypatch.setattr(similar, "BUCKETS", 7)
    monkeypatch.setattr(similar, "SETS_EACH", 3)
    df = spark.createDataFrame(seqs + [(60, ""), (61, None), (62, "ab"), (63, "ab")], "id long, seq string")
    got = {}
    for r in similar.similar_sequences(df, df, k=3, least=0.5, top=5).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["target"], r["shared"]))
    sets = {i: {s[j:j + 3] for j in range(28)} for i, s in seqs} | {62: {"ab"}, 63: {"ab"}}
    want = {}
    for a, b in itertools.permutations(sets, 2):
        both = len(sets[a] & sets[b])
        if 2 * both >= len(sets[a] | sets[b]):
            want.setdefault(a, []).append((-both / len(sets[a] | sets[b]), b, both))
    want = {a: [(i + 1, b, n) for i, (_, b, n) in enumerate(sorted(v)[:5])] for a, v in want.items()}
    assert {a: sorted(v) for a, v in got.items()} == want


def test_similar_sequences_deal_no_k_mers(spark):
    df = spark.createDataFrame([(1, "abcdef"), (2, "abcdeg")], "id long, seq string")
    sets = similar.kmer_sets(df, 3).select("id", "kmers")
    both = sets.select(F.col("id").alias("no"), F.lit(True).alias("asks"), F.lit(True).alias("answers"), F.size("kmers").alias("n"), F.transform("kmers", lambda g: F.xxhash64(g)).alias("grams"))
    got = similar._prefixes(both, 500_000)
    assert "Exchange" not in plan(got) and got.groupBy("no").count().where("count <> 3").isEmpty()
