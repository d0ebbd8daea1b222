"""Similar sequences, weighted walks, running ranks, array files and mixed-separator scans against plain Python."""

import gzip
import json
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from termflow.functions.scalar import PRIME
from termflow.operators import aggregates as ag
from termflow.operators import graph as gr
from termflow.operators import similar
from termflow.sources import arrays
from termflow.sources import formats as fm


def test_similar_sequences(spark):
    rng = random.Random(2)
    base = [[rng.choice("ACGT") for _ in range(rng.randrange(5, 60))] for _ in range(12)]
    rows = []
    for i in range(120):
        s = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            s[rng.randrange(len(s))] = rng.choice("ACGT")
        rows.append((i, "".join(s)))
    rows += [(200 + i, "".join(base[0])) for i in range(30)] + [(300, "AC"), (301, "AC"), (302, ""), (303, None), (304, "A" * 50), (305, "A" * 9)]
    sets = {i: {s[j:j + 4] for j in range(len(s) - 3)} if len(s) >= 4 else {s} for i, s in rows if s}
    df = spark.createDataFrame(rows, "id long, seq string")
    got = {}
    for r in similar.similar_sequences(df.where("id % 5 = 0"), df, k=4, least=0.6, top=5).collect():
        got.setdefault(r.query, {})[r["rank"]] = (r.target, r.shared)
    for q in [i for i in sets if i % 5 == 0]:
        sims = sorted((-len(sets[q] & t) / len(sets[q] | t), i) for i, t in sets.items() if i != q and 10 * len(sets[q] & t) >= 6 * len(sets[q] | t))[:5]
        assert got.get(q, {}) == {k + 1: (i, len(sets[q] & sets[i])) for k, (_, i) in enumerate(sims)}, q


@pytest.mark.parametrize("fan", [3, 256])
def test_walks(spark, fan):
    """Walkers follow the cumulative weights draw by draw; blocks of three make an index of several levels."""
    rng = random.Random(5)
    edges = {(f"n{a:02}", f"n{b:02}"): float(rng.randrange(1, 9)) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(90)) if a < b}
    edges |= {("hub", f"n{a:02}"): 2.0 for a in range(30)}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, weight double")
    adj = {}
    for (a, b), w in edges.items():
        adj.setdefault(a, {})[b] = w
        adj.setdefault(b, {})[a] = w
    names = sorted(adj)
    got = {(r.walk_id, r.step): r.node for r in gr.random_walks(df, walks_per_node=3, length=4, fan=fan).collect()}
    assert len(got) == len(names) * 3 * 4

    def draw(*keys, seed=7):
        x = seed
        for k in keys:
            x = (x * 48271 + k % PRIME) % PRIME
            x = (x * x + k % PRIME) % PRIME
        return (x + 0.5) / PRIME

    for no, name in enumerate(names):
        for rep in range(3):
            node = name
            for step in range(1, 4):
                x, at = draw(no, rep, step) * sum(adj[node].values()), 0.0
                for nb in sorted(adj[node]):
                    if at <= x:
                        nxt = nb
                    at += adj[node][nb]
                node = nxt
                assert got[f"{name}#{rep}", step] == node


def test_walk_frequencies_follow_the_weights(spark):
    df = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 3.0), ("a", "d", 6.0)], "src string, dst string, weight double")
    first = Counter(r.node for r in gr.random_walks(df, walks_per_node=4000, length=2, fan=2).where("step = 1 and walk_id like 'a#%'").collect())
    for node, share in (("b", .1), ("c", .3), ("d", .6)):
        assert abs(first[node] / 4000 - share) < 0.03


def test_correlations_with_ties(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 20, 500) / 4
    b = np.round(a + rng.standard_normal(500), 1)
    import pandas as pd
    want = pd.DataFrame({"a": a, "b": b})
    df = spark.createDataFrame(want).union(spark.createDataFrame([(None, 1.0)], "a double, b double"))
    got = ag.correlations(df, "a", "b").first()
    assert got.pearson == pytest.approx(want.corr().iloc[0, 1], abs=1e-9)
    assert got.spearman == pytest.approx(want.rank().corr().iloc[0, 1], abs=1e-9)


def test_array_file_with_sidecar(spark, tmp_path):
    v = np.arange(1000 * 7, dtype=np.float16).reshape(1000, 7) % 513
    np.save(tmp_path / "x_embeds.npy", v)
    np.save(tmp_path / "x_ids.npy", np.array([f"P{i}" for i in range(1000)]))
    df = arrays.read_vectors(spark, str(tmp_path / "x_embeds.npy"), str(tmp_path / "x_ids.npy"), split_bytes=1000)
    assert df.rdd.getNumPartitions() == -(-1000 // (1000 // 14))
    got = {r.id: r.vector for r in df.collect()}
    assert len(got) == 1000 and all(got[f"P{i}"] == v[i].astype(float).tolist() for i in range(0, 1000, 37))
    np.save(tmp_path / "y_ids.npy", np.arange(999))
    with pytest.raises(Exception, match="1000 rows"):
        arrays.read_vectors(spark, str(tmp_path / "x_embeds.npy"), str(tmp_path / "y_ids.npy")).count()


def test_bundle_and_failed_task(spark, tmp_path):
    df = spark.range(500).selectExpr("id", "transform(sequence(1, 5), x -> cast(x * id as float)) as vector").repartition(6)
    good = str(tmp_path / "good")
    arrays.write_vectors(df, good, feature_names=list("abcde"))
    meta = json.load(open(f"{good}/meta.json"))
    assert meta["rows"] == 500 and meta["width"] == 5 and meta["features"] == list("abcde") and len(meta["parts"]) == 6
    assert sorted((int(r.id), r.vector) for r in arrays.read_vectors(spark, good).collect()) == sorted((r.id, r.vector) for r in df.collect())
    bad = str(tmp_path / "bad")
    with pytest.raises(Exception):
        arrays.write_vectors(df.withColumn("id", F.when(F.col("id") != 77, F.col("id"))), bad)
    assert not os.path.exists(f"{bad}/meta.json")
    with pytest.raises(Exception):
        arrays.read_vectors(spark, bad).count()
    with pytest.raises(Exception, match="entries"):
        arrays.write_vectors(df, str(tmp_path / "names"), feature_names=["a"])
    assert not os.path.exists(tmp_path / "names" / "meta.json") and not os.listdir(tmp_path / "names")


def test_links_of_mixed_separators(spark, tmp_path):
    (tmp_path / "a.txt").write_text("protein1\tprotein2\tcombined_score\na\tb\t10\nc\td\tx\n\n")
    (tmp_path / "b.csv").write_text("combined_score,protein2,protein1\n5,f,e\n")
    (tmp_path / "c.txt").write_text("protein1 protein2 other combined_score\ng  h 1   7\n")
    with gzip.open(tmp_path / "d.txt.gz", "wt") as f:
        f.write("Protein2\tcombined_score\tprotein1\nj\t8\ti\n")
    got = {(r.protein1, r.protein2, r.score, os.path.basename(r.f)) for r in fm.read_links(spark, str(tmp_path), file_col="f").collect()}
    assert got == {("a", "b", 10.0, "a.txt"), ("c", "d", None, "a.txt"), ("e", "f", 5.0, "b.csv"), ("g", "h", 7.0, "c.txt"), ("i", "j", 8.0, "d.txt.gz")}
    assert fm.read_links(spark, str(tmp_path), min_score=8).count() == 2
    (tmp_path / "e.txt").write_text("protein1\tscore\na\t1\n")
    with pytest.raises(Exception, match="no column"):
        fm.read_links(spark, str(tmp_path)).collect()
