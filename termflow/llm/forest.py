"""Embedding near-dedup with a random-projection tree forest.

Trees split the space again and again by random directions at the median of a
bounded sample; vectors near a split go to both sides.  Every vector is dropped
through all trees; within a leaf (of equal labels) all vectors are compared, in
blocks, by exact cosine.  Equal vectors are one class, so copies cost nothing."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mix64, query, runs_of, sorted_runs, store, table

TREES = 4
LEAF = 128  # vectors of a label in a leaf, about
SAMPLE = 16_384  # vectors the splits are fitted on, at most
LEAST_SAMPLE_LEAF = 8  # a split needs twice as many sampled vectors
SPILL = 0.75  # half width of the overlap, in deviations of a limit pair's difference along a direction
BLOCK = 256


def usable(v) -> np.ndarray | None:
    """A vector as float64, or None where it links with nothing."""
    if v is None:
        return None
    try:
        x = np.asarray(v, np.float64)
    except TypeError:
        return None
    return x if x.ndim == 1 and len(x) and np.isfinite(x).all() and x.any() else None


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=-1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


class Forest:
    """Trees over unit vectors of one length; ``splits[t]`` maps a node's path to its threshold."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, cosine: float, seed: int = 10):
        self.dim = sample.shape[1]
        self.depth, self.trees, self.seed = depth, trees, seed
        self.margin = SPILL * math.sqrt((2 - 2 * cosine) / self.dim)
        self.splits: list[dict[int, float]] = []
        for t in range(trees):
            cuts: dict[int, float] = {}
            todo = [(1, np.arange(len(sample)))]
            while todo:
                path, rows = todo.pop()
                if path.bit_length() > depth or len(rows) < 2 * LEAST_SAMPLE_LEAF:
                    continue
                p = sample[rows] @ self.direction(t, path)
                cut = float(np.median(p))
                cuts[path] = cut
                todo += [(2 * path, rows[p < cut + self.margin]), (2 * path + 1, rows[p >= cut - self.margin])]
            self.splits.append(cuts)

    def direction(self, tree: int, path: int) -> np.ndarray:
        d = np.random.default_rng((self.seed, tree, path)).normal(size=self.dim)
        return d / np.linalg.norm(d)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, tree, path) of every leaf that a row falls into."""
        out = []
        for t, cuts in enumerate(self.splits):
            todo = [(1, np.arange(len(x)))]
            while todo:
                path, rows = todo.pop()
                if not len(rows):
                    continue
                if path not in cuts:
                    out.append((rows, np.full(len(rows), t), np.full(len(rows), path)))
                    continue
                p = x[rows] @ self.direction(t, path)
                todo += [(2 * path, rows[p < cuts[path] + self.margin]), (2 * path + 1, rows[p >= cuts[path] - self.margin])]
        return tuple(np.concatenate(c) for c in zip(*out))


def keyed_rows(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, key, label, vec): key is a 128-bit hash of label and vector, null where a row links with nothing."""
    def run(frames):
        for f in frames:
            rows = []
            for v, label in zip(f["vec"], f["label"]):
                x = usable(v) if label is not None else None
                raw = None if x is None else (x + 0.0).tobytes()
                rows.append((None, None) if raw is None else (hashlib.blake2b(label.encode() + b"\0" + raw, digest_size=16).digest(), raw))
            got = pd.DataFrame(rows, columns=["key", "vec"])
            got["label"] = f["label"]
            got.insert(0, "vec_id", f["vec_id"].astype("Int64"))
            yield got

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"), F.col(label_col).cast("string").alias("label"))
    return rows.mapInPandas(run, "vec_id long, key binary, vec binary, label string")


def fit(classes: DataFrame, cosine: float, leaf: int, trees: int, sample: int) -> dict[int, Forest]:
    """A forest for every vector length, from at most ``sample`` vectors; the depth follows the largest label."""
    out = {}
    sizes = classes.groupBy("label", "bytes").count().groupBy("bytes").agg(F.max("count").alias("most"), F.sum("count").alias("all"))
    for row in sizes.collect():  # one row a vector length
        share = min(1.0, sample / row["all"])
        part = classes.where(F.col("bytes") == row["bytes"])
        picked = part.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("vec").orderBy(F.xxhash64("vec")).limit(sample)
        x = unit(np.stack([np.frombuffer(r["vec"], np.float64) for r in picked.collect()] or [np.ones(row["bytes"] // 8)]))
        out[row["bytes"]] = Forest(x, max(0, math.ceil(math.log2(max(1, row["most"] / leaf)))), trees, cosine)
    return out


def placed(classes: DataFrame, forests) -> DataFrame:
    """(leaf, node, leaves): a row for each leaf of a class; ``leaves`` lists all of them in order."""
    def run(frames):
        for f in frames:
            for size, g in f.groupby("bytes"):
                x = unit(np.frombuffer(b"".join(g["vec"]), np.float64).reshape(len(g), -1))
                row, tree, path = forests.value[size].leaves(x)
                names, code = np.unique(g["label"].to_numpy(str), return_inverse=True)
                salt = np.array([int.from_bytes(hashlib.blake2b(f"{n}\0{size}".encode(), digest_size=8).digest(), "little") for n in names], np.uint64)
                leaf = mix64(mix64(path.astype(np.uint64) * np.uint64(64) + tree.astype(np.uint64)) ^ salt[code[row]]).view(np.int64)
                order = np.lexsort((leaf, row))
                row, leaf = row[order], leaf[order]
                start, end = runs_of(row)
                lists = [leaf[a:b].tobytes() for a, b in zip(start, end)]
                yield pd.DataFrame({"leaf": leaf, "node": g["node"].to_numpy()[row], "leaves": np.array(lists, object)[np.repeat(np.arange(len(start)), end - start)]})

    return classes.select("node", "label", "bytes", "vec").mapInPandas(run, "leaf long, node long, leaves binary")


def first_shared(a: list[bytes], b: list[bytes], leaf: int) -> np.ndarray:
    """For pairs of sorted leaf lists, whether ``leaf`` is the first they share."""
    width = max(len(x) for x in [*a, *b]) // 8
    grid = lambda lists, fill: np.stack([np.pad(v := np.frombuffer(x, np.int64), (0, width - len(v)), constant_values=fill) for x in lists])
    kinds_a, at_a = np.unique(np.array(a, object), return_inverse=True)
    kinds_b, at_b = np.unique(np.array(b, object), return_inverse=True)
    ga, gb = grid(kinds_a, leaf), grid(kinds_b, leaf)  # filling up with this leaf changes nothing
    out = np.empty(len(a), bool)
    for s in range(0, len(a), 8192):
        x, y = ga[at_a[s:s + 8192]], gb[at_b[s:s + 8192]]
        same = (x[:, :, None] == y[:, None, :]).any(2)
        out[s:s + 8192] = np.where(same, x, np.iinfo(np.int64).max).min(1) == leaf
    return out


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    out, new = [], linked.any(1)
    while new.any():
        root = int(np.argmax(new))
        new[root] = False
        wave = [root]
        while wave:
            x = wave.pop()
            reach = np.flatnonzero(linked[x] & new)
            new[reach] = False
            out += [(x, int(y)) for y in reach]
            wave += reach.tolist()
    return out


def block_result(f: pd.DataFrame, cosine: float) -> tuple[list, list]:
    """Edges (a, b) of a spanning forest and (node, linked vectors) first met in this leaf, of one block pair."""
    x = unit(np.frombuffer(b"".join(f["vec"]), np.float64).reshape(len(f), -1))
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    block = f["block"].to_numpy()
    if f["bi"].iat[0] != f["bj"].iat[0]:
        linked &= block[:, None] != block[None, :]
    i, j = np.nonzero(np.triu(linked))
    if not len(i):
        return [], []
    node, weight, leaves = f["node"].to_numpy(), f["weight"].to_numpy(np.int64), f["leaves"].to_numpy()
    edges = [(int(node[a]), int(node[b])) for a, b in spanning(linked)]
    n = np.zeros(len(f), np.int64)
    mine = np.concatenate([first_shared(leaves[i[s:s + 65536]].tolist(), leaves[j[s:s + 65536]].tolist(), int(f["leaf"].iat[0])) for s in range(0, len(i), 65536)])
    np.add.at(n, i[mine], weight[j[mine]])
    np.add.at(n, j[mine], weight[i[mine]])
    at = np.flatnonzero(n)
    return edges, list(zip(node[at].tolist(), n[at].tolist()))


def compare_leaves(leaf_rows: DataFrame, classes: DataFrame, cosine: float, block: int) -> DataFrame:
    """(a, b, n): edges have b, link counts have n.  A leaf of more than ``block`` vectors
    (a dense cluster no split parts) is dealt to blocks, each pair of blocks a group."""
    sizes = store(leaf_rows.groupBy("leaf").agg(F.count("*").alias("size")).where("size > 1"))
    rows = leaf_rows.join(sizes, "leaf").withColumn("nb", F.ceil(F.col("size") / block).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    rows = rows.select("leaf", "node", "leaves", "block", lo.alias("bi"), hi.alias("bj"), F.xxhash64("leaf", lo, hi).alias("place"))

    def run(frames):
        for f in sorted_runs(frames, "place"):
            edges, counts = [], []
            for a, b in zip(*runs_of(f["place"].to_numpy())):
                if b - a > 1:
                    e, c = block_result(f.iloc[a:b], cosine)
                    edges += e
                    counts += c
            both = [(a, b, None) for a, b in edges] + [(a, None, n) for a, n in counts]
            yield pd.DataFrame(both, columns=["a", "b", "n"]).astype("Int64")

    full = rows.join(classes.select("node", "weight", "vec"), "node")
    return full.repartition("place").sortWithinPartitions("place").mapInPandas(run, "a long, b long, n long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.93,
                 trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors of equal labels and lengths link at a cosine of ``cosine`` or more, found
    through the forest.  A null label or vector, a vector that is zero or empty, or holds null or
    non-finite components links with nothing: no links, its own component, kept.  Rows that
    repeat a vector link with each other.  A row without vec_id takes its group's component_id
    and is kept only where the group has none.  An empty table gives no rows.
    """
    rows = store(keyed_rows(vectors, id_col, vec_col, label_col))
    classes = (rows.where("key is not null").groupBy("key")
               .agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("vec").alias("vec"), F.first("label").alias("label"))
               .withColumn("bytes", F.length("vec")).withColumn("node", F.monotonically_increasing_id()))
    classes = store(classes)
    forests = vectors.sparkSession.sparkContext.broadcast(fit(classes, cosine, leaf, trees, sample))
    leaf_rows = store(placed(classes, forests))
    found = store(compare_leaves(leaf_rows, classes, cosine, block))
    links = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    labels = components(found.where("b is not null").select("a", "b"))
    least = labels.join(classes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("least"))
    answer = (classes.select("node", "key", "rep", "weight").join(links, "node", "left").join(labels, "node", "left").join(least, "root", "left")
              .select("key", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component")))
    out = rows.select("vec_id", "key").join(store(answer), "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93 ELSE false END),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN least_of m ON e.vec_id = m.a LEFT JOIN counted c ON e.vec_id = c.a"""


@query("op10_embedding_near_dedup", ORACLE)
def op10(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
