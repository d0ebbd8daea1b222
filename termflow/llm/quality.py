"""Quality rules: counts of words, symbols and repetition, and a log-likelihood
ratio of hashed n-grams between a trusted and a raw multinomial."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import mix64, query, store, table, text_of, tidied, words

#: Least number of hash buckets an order; there are as many as trusted n-grams, rounded up to a power of two.
BUCKETS = 1 << 16
ORDERS = (1, 2)  # words and pairs of words
#: Every trusted row is learnt from whole.  Bounds that may be set, None for none: rows (those with the smallest hash of the id),
#: words of the rows together, words of a row.
TRUSTED_ROWS = TRUSTED_WORDS = LONGEST_TRUSTED = None
#: The most hash buckets an order, however many n-grams they count: the ratios of both orders are a broadcast of 64 MB at most.
MOST_BUCKETS = 1 << 23
#: A document passes with a mean log ratio (natural units a word, over the orders) of at least
#: this, where too few labelled rows can be held out to set the threshold from them.
THRESHOLD = -0.5
#: Labelled rows of each side that it takes to hold a fifth of them out.
LEAST_LABELLED = 100
#: N-grams of prior belief a bucket.
PRIOR = 1.0
_SYMBOLS = b"#*$%&|<>"
#: N-grams that a task gathers before it adds them to its table, and that it adds up before it empties the table.
HELD_GRAMS, MOST_GRAMS = 1 << 19, 1 << 31
#: Partial counts of so many neighbouring tasks are added up first.
TASKS = 64


def n_grams(text: str, buckets: int, cache: dict) -> list[np.ndarray]:
    """For each order the buckets of the n-grams of a text's lower-cased words."""
    ws = words(text.lower())
    h = np.fromiter((cache.get(w) or cache.setdefault(w, zlib.crc32(w) + 1) for w in ws), np.uint64, len(ws))
    if len(cache) > 300_000:
        cache.clear()
    out = []
    for n in ORDERS:
        if len(h) < n:
            out.append(np.zeros(0, np.int64))
            continue
        g = h[:len(h) - n + 1].copy()
        for k in range(1, n):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - n + 1 + k]
        out.append((mix64(g) % np.uint64(buckets)).astype(np.int64))
    return out


def packed(counts: np.ndarray) -> bytes:
    """The counts of a block of slots: gaps between used slots and counts less one, byte planes, compressed."""
    at = np.flatnonzero(counts)
    gaps, extra = np.diff(at, prepend=-1) - 1, counts[at] - 1
    planes = [gaps & 255, gaps >> 8, *(extra >> np.uint64(8 * k) & np.uint64(255) for k in range(8))]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.astype(np.uint8).tobytes() for p in planes))


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts) of ``packed`` counts."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(10, -1)
    at = np.cumsum(planes[0].astype(np.int64) + (planes[1].astype(np.int64) << 8) + 1) - 1
    return at, sum(planes[2 + k].astype(np.uint64) << np.uint64(8 * k) for k in range(8)) + np.uint64(1)


BLOCKS = "block int, side int, part long, counts binary"


def bucket_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """(block, side, part, counts): n-gram counts of rows (side, text), packed by blocks of 65,536 slots; slot =
    order * buckets + bucket.  Each task adds up its own in one table; a task's rows are of one side."""
    def run(batches):
        from pyspark import TaskContext
        part, cache = TaskContext.get().partitionId(), {}
        total, held, n_held, n_in, at_side = np.zeros(len(ORDERS) * buckets, np.uint32), [], 0, 0, 0

        def add():
            if held:
                at, n = np.unique(np.concatenate(held), return_counts=True)
                total[at] += n.astype(np.uint32)
                held.clear()

        def out():
            add()
            for block in range(len(total) // BUCKETS):
                counts = total[block * BUCKETS:(block + 1) * BUCKETS]
                if counts.any():
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([at_side], pa.int32()), pa.array([part], pa.int64()),
                                                      pa.array([packed(counts.astype(np.uint64))], pa.binary())], ["block", "side", "part", "counts"])
            total[:] = 0

        for b in batches:
            for side, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if side != at_side or n_in >= MOST_GRAMS:
                    yield from out()
                    at_side, n_in, n_held = side, 0, 0
                for k, g in enumerate(n_grams(text, buckets, cache)):
                    held.append(g + k * buckets)
                    n_held += len(g)
                    n_in += len(g)
                if n_held >= HELD_GRAMS:
                    add()
                    n_held = 0
        yield from out()

    return rows.select("side", "text").mapInArrow(tidied(run), BLOCKS)


def added_up(counts: DataFrame, whole: bool) -> DataFrame:
    """Packed counts added up by block and side over groups of tasks, or over all (``whole``): sorted rows stream through a table of one block."""
    def run(batches):
        key, total = None, np.zeros(BUCKETS, np.uint64)

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([key[2]], pa.int64()),
                                               pa.array([packed(total)], pa.binary())], ["block", "side", "part", "counts"])

        for b in batches:
            for block, side, part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if key != (block, side, part):
                    if key is not None:
                        yield row()
                    key = (block, side, part)
                    total[:] = 0
                at, n = unpacked(data.as_buffer())
                total[at] += n
        if key is not None:
            yield row()

    group = F.lit(0).cast("long") if whole else F.expr(f"part div {TASKS}")
    dealt = counts.withColumn("part", group)
    return dealt.repartition("block", "part").sortWithinPartitions("block", "side", "part").mapInArrow(tidied(run), BLOCKS)


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int | None = None) -> DataFrame:
    """(part, text): 'trusted' texts of all documents labelled good and not toxic (of ``most`` where that or a bound of the module is set).

    With ``LEAST_LABELLED`` documents or more labelled good and labelled bad, a fifth of
    either (by a hash) is held out as 'good' and 'bad'."""
    most = most or TRUSTED_ROWS
    sides = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
             .agg(F.max(F.expr("coalesce(quality = 1 and coalesce(toxic, 0) = 0, false)")).alias("good"), F.max(F.expr("coalesce(quality = 0, false)")).alias("bad")))
    sides = store(docs.select(F.col("doc_id").alias("id")).distinct().join(sides, "id"))
    *enough, rows = sides.agg(F.count_if("good"), F.count_if(F.expr("bad and not good")), F.count(F.lit(1))).first()
    held = (F.pmod(F.xxhash64("id", F.lit("held")), F.lit(5)) == 0) & F.lit(min(enough) >= LEAST_LABELLED)
    part = F.when(F.col("good"), F.when(held, "good").otherwise("trusted")).when(F.col("bad") & held, "bad")
    picked = sides.select("id", part.alias("part")).where("part is not null")
    if most or TRUSTED_WORDS or LONGEST_TRUSTED:
        trusted = _bounded(docs, picked.where("part = 'trusted'"), most, TRUSTED_WORDS, LONGEST_TRUSTED)
        picked = trusted.union(picked.where("part <> 'trusted'"))
    return docs.join(broadcast_if_small(picked, rows), F.col("doc_id") == F.col("id")).select("part", "text")


def _bounded(docs: DataFrame, trusted: DataFrame, rows: int | None, of_words: int | None, longest: int | None) -> DataFrame:
    """Of ``trusted`` (id, part) those within the bounds, in the order of the hash of the id."""
    if rows:
        trusted = trusted.orderBy(F.xxhash64("id"), "id").limit(rows)
    if not of_words and not longest:
        return trusted
    sizes = docs.join(trusted, F.col("doc_id") == F.col("id")).groupBy("id", "part").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n"))
    if longest:
        sizes = sizes.where(F.col("n") <= longest)
    if of_words:
        upto = F.sum("n").over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        sizes = sizes.withColumn("upto", upto).where(F.col("upto") <= of_words)
    return sizes.select("id", "part")


def buckets_for(trusted: DataFrame) -> int:
    """Power of two that is at least the number of trusted n-grams, up to ``MOST_BUCKETS``: what other n-grams of a bucket
    add to ``expected`` is then below ``PRIOR`` on average, however large the corpus is.  More trusted n-grams than that share
    the buckets; all of them are counted."""
    def run(frames):
        for f in frames:
            yield pd.DataFrame({"n": [sum(len(words(t)) for t in f["text"])]})

    n = trusted.mapInPandas(tidied(run), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return min(MOST_BUCKETS, max(BUCKETS, 1 << max(n - 1, 0).bit_length()))


def ratios_of(trusted: DataFrame, raw: DataFrame, buckets: int) -> np.ndarray:
    """The array (order, bucket) of log p(bucket | trusted) - log p(bucket | raw), 4 bytes each.

    Both sides are smoothed by ``PRIOR`` n-grams spread as in the raw corpus: the ratio is
    log((seen + PRIOR) / (expected + PRIOR)), expected = trusted n-grams * raw share, so an
    n-gram too rare to be expected in the trusted rows says nothing against a document."""
    sides = trusted.select(F.lit(1).alias("side"), "text").unionByName(raw.select(F.lit(0).alias("side"), "text"))
    counts = store(added_up(added_up(bucket_counts(sides, buckets), False), True))
    out, seen = np.zeros(len(ORDERS) * buckets, np.float32), np.zeros(len(ORDERS) * buckets, np.float32)
    sums = np.zeros((2, len(ORDERS)))
    for r in counts.toLocalIterator():
        at, n = unpacked(bytes(r.counts))
        at += r.block * BUCKETS
        sums[r.side, r.block * BUCKETS // buckets] += float(n.sum())
        (seen if r.side else out)[at] = n  # counts above 2^24 keep 24 bits
    for at in range(0, len(out), BUCKETS):
        k, part = at // buckets, slice(at, at + BUCKETS)
        expected = out[part].astype(np.float64) * (sums[1, k] / max(sums[0, k], 1.0))
        out[part] = np.where(out[part] > 0, np.log((seen[part] + PRIOR) / (expected + PRIOR)), 0.0)
    return out.reshape(len(ORDERS), buckets)


def repeated_window_words(ws: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(ws) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, len(ws))
    key, size = ids[:n].copy(), len(number)
    for k in range(1, width):
        if size > (1 << 62) // len(number):  # number the prefixes anew before they overflow
            _, key = np.unique(key, return_inverse=True)
            size = int(key.max()) + 1
        key = key * len(number) + ids[k:k + n]
        size *= len(number)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    step = np.zeros(len(ws) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def measure(text: str) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    ws = raw.split()
    blanks = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(ws), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated_window_words(ws)


def llr(grams: list[np.ndarray], ratios: np.ndarray) -> float:
    """Mean log ratio an n-gram, averaged over the orders that the text has."""
    means = [float(ratios[k][g].mean(dtype=np.float64)) for k, g in enumerate(grams) if len(g)]
    return round(sum(means) / len(means), 9) if means else 0.0


RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, llr double, kept boolean")
MEASURED = RESULT.split(", llr")[0]


def measured(texts: pd.Series) -> pd.DataFrame:
    """The counts and base rules of texts."""
    rows = [(*m, m[0] < 10 or 100 * m[4] > 20 * m[0]) for m in map(measure, texts)]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in MEASURED.split(", ")])


class Rules:
    """The rules learnt from a corpus and its labels: ``apply`` puts them on any texts."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None):
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
        known = store(labelled_rows(rows, labels))
        trusted = known.where("part = 'trusted'").select("text")
        self.buckets = buckets_for(trusted)
        self.shared = docs.sparkSession.sparkContext.broadcast(ratios_of(trusted, rows.select("text"), self.buckets))
        self.threshold = THRESHOLD if threshold is None else threshold
        if threshold is None:
            held = self.apply(known.where("part <> 'trusted'")).where("not __rules.base_failed").select(F.expr("part = 'good'").alias("good"), "__rules.llr").toArrow()
            good, score = (held[c].to_numpy() for c in ("good", "llr"))  # nine bytes a held-out row
            self.threshold = best_threshold(score[good], score[~good])

    def apply(self, docs: DataFrame, text_col: str = "text", as_col: str = "__rules") -> DataFrame:
        """``docs`` with the struct ``as_col``, fields as in ``RESULT``."""
        shared = self.shared

        def judge(texts: pd.Series) -> pd.DataFrame:
            cache: dict = {}
            got = measured(texts)
            got["llr"] = [llr(n_grams(t, shared.value.shape[1], cache), shared.value) for t in texts]
            return got

        # marked so that a filter on the verdict does not make the plan judge every text twice
        rules = F.pandas_udf(judge, MEASURED + ", llr double").asNondeterministic()
        out = docs.withColumn(as_col, rules(text_of(text_col)))
        kept = ~F.col(as_col)["base_failed"] & (F.col(as_col)["llr"] >= self.threshold)
        return out.withColumn(as_col, F.col(as_col).withField("kept", kept))


def best_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The middle of the widest gap between held-out scores at which the share of good rows kept
    less the share of bad rows kept is largest; ``THRESHOLD`` with fewer than ten rows of a side."""
    if min(len(good), len(bad)) < 10:
        return THRESHOLD
    at = np.unique(np.r_[good, bad])
    if len(at) < 2:
        return THRESHOLD
    low, high = at[:-1], at[1:]
    gain = (len(good) - np.searchsorted(np.sort(good), high)) / len(good) - (len(bad) - np.searchsorted(np.sort(bad), high)) / len(bad)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    k = best[np.argmax((high - low)[best])]
    return float((low[k] + high[k]) / 2)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, llr and kept.

    A null text has no words and fails.  Null ids and repeated rows are judged on
    their own.  Without labels the ratio is near 0 for every document and only
    the base rules decide.  Corpus counts cover all documents; the trusted side
    is learnt from all documents labelled good that are not held out.  Without ``threshold`` it is set from labelled rows that are held out where
    at least ``LEAST_LABELLED`` of either side are labelled and ten of either side are held; with fewer it is ``THRESHOLD``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    judged = Rules(docs, labels, id_col, text_col, threshold).apply(rows)
    return judged.select("doc_id", "__rules.*")


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
