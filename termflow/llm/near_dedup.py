"""MinHash near-dedup with SetSketch registers.

Every document's set of word shingles gives exponentially spaced, truncated
minima.  Equal sets form one class.  Bands of registers bring classes together;
pairs are judged by a joint likelihood over their registers and confirmed on
the whole sets.  First each class meets the class that most of its bands point
to, which joins most of a group in one linear pass; then every band bucket that
still holds classes of several components is compared whole, in blocks."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mix64, query, runs_of, sorted_runs, store, table, text_of, tidied

REGISTERS = 128
BAND = 4  # registers a band; 32 bands miss a pair at similarity 0.8 with probability 5e-8
BASE = 1.02  # b of the register scale
RATE = 20.0  # a of the exponential distribution
PERCENT = 80
#: A pair is confirmed on the whole sets if its likelihood rises at this similarity (over 5 deviations below 0.8).
CANDIDATE = 0.6
BLOCK = 256
_rng = np.random.default_rng(8)
_ODD = (_rng.integers(0, 1 << 32, REGISTERS, np.uint64) | np.uint64(1)).astype(np.uint32)
_FLIP = _rng.integers(0, 1 << 32, REGISTERS, np.uint64).astype(np.uint32)
_BAND_SALT = mix64(np.arange(1, REGISTERS // BAND + 1, dtype=np.uint64))
_K = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, width: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct ``width``-word shingles: A-Z lowered;
    fewer words make one shingle of all of them, no words none."""
    ws = text.encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    if len(known) > 300_000:
        known.clear()
    get = known.get
    h = np.fromiter([get(w) or known.setdefault(w, xxhash.xxh3_64_intdigest(w) or 1) for w in ws], np.uint64, len(ws))
    n = min(width, len(h))
    g = h[:len(h) - n + 1].copy()
    for k in range(1, n):
        g = g * _K + h[k:len(h) - n + 1 + k]
    return np.unique(mix64(g + np.uint64(n)))


def registers(s: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set: floor(1 - log_b of the least of exponential values), per register."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    short = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 2048):
        h = (short[i:i + 2048, None] ^ _FLIP) * _ODD
        h ^= h >> np.uint32(15)
        low = np.minimum(low, (h * np.uint32(0x2C1B3C6D)).min(axis=0))
    least = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / math.log(BASE)), 0, 32767).astype(np.int16)


def rising(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, at: float = CANDIDATE) -> np.ndarray:
    """Whether the joint log-likelihood of similarity still rises at ``at``, so that its
    maximum lies at or above it.  ``above``, ``below``: registers in which a's, b's is larger."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    c = (BASE - 1) / BASE
    x, y = np.maximum(u - v * at, 1e-12), np.maximum(v - u * at, 1e-12)
    p, q = -np.log1p(-x * c) / math.log(BASE), -np.log1p(-y * c) / math.log(BASE)
    dp, dq = -v * c / (1 - x * c) / math.log(BASE), -u * c / (1 - y * c) / math.log(BASE)
    same = REGISTERS - above - below
    slope = above * dp / p + below * dq / q - same * (dp + dq) / np.maximum(1 - p - q, 1e-12)
    return slope >= 0


def similar(common: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (n_a + n_b - common)


def sketch_rows(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, n, fp, sketch): set size, 128-bit fingerprint of the set, registers."""
    def run(frames):
        known: dict[bytes, int] = {}
        for f in frames:
            rows = []
            for text in f["text"]:
                s = shingles(text, width, known)
                rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), registers(s).tobytes()) if len(s) else (0, None, None))
            got = pd.DataFrame(rows, columns=["n", "fp", "sketch"])
            got.insert(0, "doc_id", f["doc_id"].astype("Int64"))
            yield got

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInPandas(tidied(run), "doc_id long, n long, fp binary, sketch binary")


def band_rows(classes: DataFrame) -> DataFrame:
    """(bucket, node) of every band of every class."""
    def run(frames):
        for f in frames:
            if not len(f):
                continue
            k = np.frombuffer(b"".join(f["sketch"]), np.int16).astype(np.uint64).reshape(len(f), -1, BAND)
            h = np.zeros(k.shape[:2], np.uint64)
            for i in range(BAND):
                h = (h + k[:, :, i] + np.uint64(1)) * _K
            h = mix64(h ^ _BAND_SALT)
            yield pd.DataFrame({"bucket": h.view(np.int64).ravel(), "node": np.repeat(f["node"].to_numpy(), k.shape[1])})

    return classes.select("node", "sketch").mapInPandas(tidied(run), "bucket long, node long")


def whole_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, n, set, sketch) of the classes ``wanted(node, rep, fp)``, from the text of a representative."""
    def run(frames):
        known: dict[bytes, int] = {}
        for f in frames:
            rows = []
            for node, fp, text in zip(f["node"], f["fp"], f["text"]):
                s = shingles(text, width, known)
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == fp:  # an id may stand on other texts too
                    rows.append((node, len(s), s.tobytes(), registers(s).tobytes()))
            yield pd.DataFrame(rows, columns=["node", "n", "set", "sketch"])

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), text_of(text_col).alias("text"))
    found = texts.join(wanted, texts["rep"].eqNullSafe(wanted["rep"])).select("node", "fp", "text")
    return found.mapInPandas(tidied(run), "node long, n long, set binary, sketch binary")


def confirm_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of ``pairs(a, b)``: registers first, then the whole sets."""
    def run(frames):
        for f in frames:
            if not len(f):
                continue
            ka = np.frombuffer(b"".join(f["ka"]), np.int16).reshape(len(f), -1)
            kb = np.frombuffer(b"".join(f["kb"]), np.int16).reshape(len(f), -1)
            na, nb = f["na"].to_numpy(np.int64), f["nb"].to_numpy(np.int64)
            likely = rising((ka > kb).sum(1), (ka < kb).sum(1), na, nb) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            keep = []
            for i in np.flatnonzero(likely):
                both = np.intersect1d(np.frombuffer(f["sa"].iat[i], np.uint64), np.frombuffer(f["sb"].iat[i], np.uint64), assume_unique=True).size
                if similar(both, na[i], nb[i], percent):
                    keep.append(i)
            yield f[["a", "b"]].iloc[keep]

    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("set").alias("sa"), F.col("sketch").alias("ka"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("set").alias("sb"), F.col("sketch").alias("kb"))
    return pairs.join(left, "a").join(right, "b").mapInPandas(tidied(run), "a long, b long")


class Roots:
    """Union-find over the labels of one block."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a block, by a matrix product over the shared elements."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    out = np.zeros((len(sets), len(sets)), np.float32)
    shared = count > 1
    if not shared.any():
        return out.astype(np.int64)
    column = np.cumsum(shared) - 1
    use = shared[number]
    number, owner = column[number[use]], owner[use]
    for start in range(0, int(column[-1]) + 1, 8192):
        part = (number >= start) & (number < start + 8192)
        m = np.zeros((len(sets), 8192), np.float32)
        m[owner[part], number[part] - start] = 1
        out += m @ m.T
    return np.rint(out).astype(np.int64)


def block_links(f: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links that join components within one block pair: at most one a class."""
    f = f.sort_values("node")
    n, root, node = f["n"].to_numpy(np.int64), f["root"].to_numpy(np.int64), f["node"].to_numpy(np.int64)
    k = np.frombuffer(b"".join(f["sketch"]), np.int16).reshape(len(f), -1)
    block = f["block"].to_numpy()
    i, j = np.triu_indices(len(f), 1)
    ok = (root[i] != root[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
    if f["bi"].iat[0] != f["bj"].iat[0]:
        ok &= block[i] != block[j]
    i, j = i[ok], j[ok]
    if not len(i):
        return []
    likely = np.zeros(len(i), bool)
    for s in range(0, len(i), 16384):
        a, b = k[i[s:s + 16384]], k[j[s:s + 16384]]
        likely[s:s + 16384] = rising((a > b).sum(1), (a < b).sum(1), n[i[s:s + 16384]], n[j[s:s + 16384]])
    i, j = i[likely], j[likely]
    if not len(i):
        return []
    sets = [np.frombuffer(x, np.uint64) for x in f["set"]]
    if len(i) > 64:
        both = common_counts(sets)[i, j]
    else:
        both = np.array([np.intersect1d(sets[a], sets[b], assume_unique=True).size for a, b in zip(i, j)])
    linked = similar(both, n[i], n[j], percent)
    roots, out = Roots(), []
    for a, b in zip(i[linked].tolist(), j[linked].tolist()):
        x, y = roots.find(root[a]), roots.find(root[b])
        if x != y:
            roots.up[max(x, y)] = min(x, y)
            out.append((int(node[a]), int(node[b])))
    return out


def compare_buckets(open_rows: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links across components within buckets, ``open_rows(bucket, node, root, size)``.

    A bucket of more than ``block`` classes is dealt to blocks by a hash, and every
    pair of blocks is a group of its own, so no task holds a whole bucket."""
    nb = F.ceil(F.col("size") / block).cast("int")
    rows = open_rows.withColumn("nb", nb).withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("node", "root", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"),
                       F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("place"))

    def run(frames):
        for f in sorted_runs(frames, "place"):
            out = []
            start, end = runs_of(f["place"].to_numpy())
            for a, b in zip(start, end):
                if b - a > 1:
                    out += block_links(f.iloc[a:b], percent)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    full = rows.join(sets, "node")
    return full.repartition("place").sortWithinPartitions("place").mapInPandas(tidied(run), "a long, b long")


def gathered(open_rows: DataFrame, block: int) -> DataFrame:
    """``open_rows`` with large buckets that overlap put together where that is cheaper.

    One large group of near copies fills a large bucket in every band.  Compared once
    as a whole it costs the square of its size, bucket by bucket the sum of the
    buckets' squares; each cluster of overlapping buckets takes the cheaper way."""
    large = open_rows.where(F.col("size") > block)
    if large.isEmpty():
        return open_rows
    per = large.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("n"))
    large = store(large.join(store(per), "bucket"))
    cluster = store(components(large.select(F.col("first").alias("a"), F.col("node").alias("b"))))
    of = cluster.select(F.col("node").alias("first"), F.col("root").alias("cluster"))
    apart = large.select("bucket", "first", "n").distinct().join(of, "first").groupBy("cluster").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("apart"))
    whole = cluster.groupBy(F.col("root").alias("cluster")).agg(F.count("*").alias("size"))
    plan = store(whole.join(apart, "cluster").where(F.col("size").cast("double") * F.col("size") < F.col("apart")).select("cluster", "size"))
    at_once = (cluster.withColumnRenamed("root", "cluster").join(plan, "cluster")
               .join(large.groupBy("node").agg(F.first("root").alias("root")), "node")
               .select(F.xxhash64("cluster", F.lit("cluster")).alias("bucket"), "node", "size", "root"))
    done = large.select("bucket", "first").distinct().join(of, "first").join(plan, "cluster").select("bucket")
    return open_rows.join(done, "bucket", "left_anti").unionByName(at_once)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Links are pairs of sets of ``width``-word shingles with a similarity of
    ``percent`` or more; component_id is the smallest doc_id reachable.  Texts
    that are null or without words link with nothing.  Rows that repeat a set are
    one class, so copies cost no pairs.  A row without an id takes its group's
    component_id and is kept only where the group has no id.  An empty table gives no rows.
    """
    rows = store(sketch_rows(docs, id_col, text_col, width))
    classes = (rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
               .withColumn("node", F.monotonically_increasing_id()))
    classes = store(classes)  # from here on the node numbers are fixed

    bands = band_rows(classes)
    pivots = store(bands.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("size")).where("size > 1"))
    members = store(bands.join(pivots, "bucket"))
    wanted = classes.join(members.select("node").distinct(), "node").select("node", "rep", "fp")
    sets = store(whole_sets(docs, wanted, id_col, text_col, width).dropDuplicates(["node"]))

    votes = members.where("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("bands"))
    chosen = votes.groupBy("node").agg(F.max(F.struct("bands", (-F.col("pivot")).alias("low"))).alias("best"))
    pairs = store(chosen.select(F.col("node").alias("a"), (-F.col("best.low")).alias("b")))
    links = store(confirm_pairs(pairs, sets, percent))
    labels = components(links)

    # buckets in which several components still meet
    at = members.join(labels, "node", "left").select("bucket", "node", "size", F.coalesce("root", "node").alias("root"))
    state = at.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c"),
                                     F.sum(F.xxhash64("node").cast("decimal(30,0)")).alias("who"))
    still = store(state.where("lo <> hi").groupBy("c", "who").agg(F.min("bucket").alias("bucket")).select("bucket"))
    at = store(at.join(still, "bucket", "left_semi"))
    more = compare_buckets(gathered(at, block), sets, percent, block)
    labels = components(links.unionByName(store(more)))

    rep = classes.select("node", "fp", "rep")
    least = labels.join(rep, "node").groupBy("root").agg(F.min("rep").alias("least"))
    answer = store(rep.join(labels, "node", "left").join(least, "root", "left").select("fp", F.coalesce("least", "rep").alias("component")))
    out = rows.drop("sketch").join(answer, "fp", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(doc_id, seen) AS (SELECT a, b FROM link UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.seen),
least_ AS (SELECT doc_id, min(seen) AS low FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id, least(w.doc_id, coalesce(low, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_ USING (doc_id)"""


@query("op8_minhash_near_dedup", ORACLE)
def op8(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"), width=4)
