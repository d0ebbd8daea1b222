"""Phrase collocations by best-first branch and bound.

A phrase grows word by word from its prefix.  The count of the prefix bounds the
score of all that grows from it: a phrase of count a is cut into parts of counts
l, r >= a, so its lowest-scoring cut scores at most a / f(first word), and a is at
most the prefix's count.  The frontier of a language is expanded best bound first,
a band of bounds at a time, until its last wanted surviving score is settled."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, query, ship, store, table
from .decontaminate import pieces

#: Least count of a phrase, and phrases wanted a language.
LEAST, TOP = 10, 2000
#: The first band holds the bounds down to the score of about so many two-word phrases for each wanted one; each further band of an open language is so many times as deep.
FIRST_BAND, DEEPER = 2, 8
#: Bits a key of the broadcast filter, and the most bits it has (32 MB): what it lets through too much is counted in vain, never lost.
KEY_BITS, MOST_BITS = 16, 1 << 28
#: Bytes of text that a task holds as words at a time, words and phrases that it adds up before it passes them on.
SLICE_BYTES, MOST_WORDS, MOST_PHRASES = 1 << 21, 1 << 20, 1 << 20
_BITS, _MASK = 21, (1 << 21) - 1  # of a word's number in a phrase key: three fit a long
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Lower-cases A-Z; tab becomes a blank, piece ends [.,;:!?\x0A-\x0D] become a full stop.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 46 if chr(c) in ".,;:!?" or 10 <= c <= 13 else c for c in range(256))
FREQUENT, GROWS, SETTLES = range(3)


def folded(text: str | None) -> bytes:
    """Words between blanks, with a full stop of its own between pieces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).replace(b".", b" . ")


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * _STEP + b)


# ---- a filter of keys, built from blocks of bits ----

class Filter:
    """A Bloom filter with three probes; ``role`` tells apart what a key stands for."""

    def __init__(self, bits: np.ndarray, n_bits: int):
        self.bits, self.n_bits = bits, n_bits

    @staticmethod
    def probes(keys: np.ndarray, role: int, n_bits: int) -> list[np.ndarray]:
        h = mix64(keys + np.uint64((role + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        step = (h >> np.uint64(33)) | np.uint64(1)
        return [(h + np.uint64(j) * step) & np.uint64(n_bits - 1) for j in range(3)]

    def has(self, keys: np.ndarray, role: int) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for p in self.probes(keys, role, self.n_bits):
            out &= (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 != 0
        return out


def phrase_hashes(langs: list, phrases: list) -> np.ndarray:
    """Hash of a word or pair of words (space-joined)."""
    def one(lang, phrase):
        a, _, b = phrase.encode("utf-8", "surrogatepass").partition(b" ")
        return word_hash(lang, a), word_hash(lang, b) if b else 0

    both = np.array([one(x, p) for x, p in zip(langs, phrases)], np.uint64).reshape(-1, 2)
    return np.where(both[:, 1] == 0, both[:, 0], pair_hash(both[:, 0], both[:, 1]))


def filter_of(rows: DataFrame, n_rows: int) -> Filter:
    """The filter of rows (lang, phrase, role).  Executors make blocks of 2^16 bits; the driver holds the bits of the filter alone."""
    n_bits = 1 << max(16, min(MOST_BITS.bit_length() - 1, (KEY_BITS * max(1, n_rows)).bit_length()))

    def places(batches):
        for b in batches:
            keys = phrase_hashes(b.column(0).to_pylist(), b.column(1).to_pylist())
            roles = b.column(2).to_numpy(zero_copy_only=False)
            at = [p for r in range(3) for p in Filter.probes(keys[roles == r], r, n_bits)]
            at = np.unique(np.concatenate(at))
            block = (at >> np.uint64(16)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])[:len(block)]
            parts = np.split((at & np.uint64(0xFFFF)).astype("<u2"), cuts[1:])
            yield pa.RecordBatch.from_arrays([pa.array(block[cuts]), pa.array([p.tobytes() for p in parts[:len(cuts)]], pa.binary())], ["block", "places"])

    def whole(t):
        bits = np.zeros(1 << 16, np.uint8)
        for p in t["places"]:
            bits[np.frombuffer(p.as_buffer(), "<u2")] = 1
        return pa.table({"block": [t["block"][0].as_py()], "bits": [np.packbits(bits, bitorder="little").tobytes()]},
                        schema=pa.schema([("block", pa.int64()), ("bits", pa.binary())]))

    made = rows.mapInArrow(places, "block long, places binary").groupBy("block").applyInArrow(whole, "block long, bits binary")
    bits = np.zeros(n_bits >> 3, np.uint8)
    for r in made.toLocalIterator():
        bits[r.block << 13:(r.block + 1) << 13] = np.frombuffer(bytes(r.bits), np.uint8)
    return Filter(bits, n_bits)


# ---- counting phrases ----

class _Numbers(dict):
    """Numbers of the words of a language; a new word gets the next one."""

    def __init__(self, counter, lang):
        super().__init__({b".": 0})
        self.counter, self.lang = counter, lang

    def __missing__(self, word):
        c = self.counter
        self[word] = n = len(c.words)
        c.words.append(word)
        c.langs.append(self.lang)
        return n


class Counter:
    """Counts the phrases of ``m`` words of a task; passes them on when many have come together."""

    def __init__(self, m: int, keep: Filter | None):
        self.m, self.keep = m, keep
        self.clear()

    def clear(self):
        self.words, self.langs, self.of_lang = [b"."], [""], {}
        self.hashes, self.good = np.zeros(1, np.uint64), np.zeros(1, bool)
        self.keys, self.counts, self.held, self.total = [], [], 0, {}

    def add(self, lang: str, ws: list[bytes], fresh: int) -> None:
        """``ws``: words and full stops; the first ``len(ws) - fresh`` of them were there before."""
        numbers = self.of_lang.get(lang) or self.of_lang.setdefault(lang, _Numbers(self, lang))
        ids = np.fromiter(map(numbers.__getitem__, ws), np.int64, len(ws))
        if self.m == 1:
            keys = ids[ids > 0]
            self.total[lang] = self.total.get(lang, 0) + len(keys)
        else:
            keys = self._grams(ids)
        if len(keys):
            keys, counts = np.unique(keys, return_counts=True)
            self.keys.append(keys)
            self.counts.append(counts)
            self.held += len(keys)
        if self.held > 2 * MOST_PHRASES:
            self._merge()

    def _grams(self, ids: np.ndarray) -> np.ndarray:
        new = len(self.words) - len(self.hashes)
        if new and self.keep is not None:
            h = np.fromiter((word_hash(self.langs[i], self.words[i]) for i in range(len(self.hashes), len(self.words))), np.uint64, new)
            self.hashes = np.r_[self.hashes, h]
            if self.m == 2:
                self.good = np.r_[self.good, self.keep.has(h, FREQUENT)]
        n = len(ids) - self.m + 1
        if n <= 0:
            return ids[:0]
        if self.keep is None:
            sure = functools.reduce(np.logical_and, [ids[k:k + n] > 0 for k in range(self.m)])
        elif self.m == 2:
            word = self.good[ids]
            sure = word[:-1] & word[1:]
        else:
            pair = (ids[:-1] > 0) & (ids[1:] > 0)
            at = np.flatnonzero(pair)
            h = pair_hash(self.hashes[ids[at]], self.hashes[ids[at + 1]])
            found = self.keep.has(h, FREQUENT)
            at, h = at[found], h[found]
            roles = np.zeros((3, len(pair)), bool)
            roles[FREQUENT, at] = True
            roles[GROWS, at] = self.keep.has(h, GROWS)
            roles[SETTLES, at] = self.keep.has(h, SETTLES)
            sure = roles[FREQUENT, :-1] & roles[FREQUENT, 1:] & (roles[GROWS, :-1] | roles[SETTLES, 1:])
        at = np.flatnonzero(sure)
        return functools.reduce(lambda key, k: key << _BITS | ids[at + k], range(1, self.m), ids[at])

    def _merge(self):
        keys, inverse = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate(self.counts)).astype(np.int64)
        self.keys, self.counts, self.held = [keys], [counts], len(keys)

    def full(self) -> bool:
        return self.held > MOST_PHRASES or len(self.words) > MOST_WORDS

    def rows(self):
        """(lang, phrase, n) batches of what is held, for single words also (lang, null, words), and an empty counter."""
        if self.keys:
            self._merge()
            keys, counts = self.keys[0], self.counts[0]
            for at in range(0, len(keys), 100_000):
                ks = keys[at:at + 100_000]
                parts = [((ks >> (_BITS * (self.m - 1 - k))) & _MASK).tolist() for k in range(self.m)]
                phrases = [b" ".join([self.words[i] for i in p]) for p in zip(*parts)]
                yield _batch([self.langs[i] for i in parts[0]], phrases, counts[at:at + 100_000])
        if self.total:
            yield _batch(list(self.total), [None] * len(self.total), list(self.total.values()))
        self.clear()


def _batch(langs, phrases, counts):
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()), pa.array(counts, pa.int64())], ["lang", "phrase", "n"])


def phrase_counts(docs: DataFrame, m: int, keep: Filter | None = None) -> DataFrame:
    """(lang, phrase, n) over rows (lang, text): counts of all phrases of ``m`` words that ``keep`` lets through."""
    sent = docs.sparkSession.sparkContext.broadcast(keep) if keep is not None else None

    def run(batches):
        counter = Counter(m, sent.value if sent is not None else None)
        for b in batches:
            of: dict[str, list[str]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                of.setdefault(lang, []).append(text)
            for lang, texts in of.items():
                for part in _joined(texts):
                    seen = 0
                    for first, ws in pieces(part, SLICE_BYTES, m - 1):
                        counter.add(lang, ws, first + len(ws) - seen)
                        seen = first + len(ws)
                        if counter.full():
                            yield from counter.rows()
        yield from counter.rows()

    got = docs.select("lang", "text").mapInArrow(run, "lang string, phrase binary, n long")
    return got.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("n"))


def _joined(texts: list[str]):
    """Texts as pieces of about a slice, short ones together."""
    held, size = [], 0
    for t in texts:
        held.append(folded(t))
        size += len(held[-1])
        if size >= SLICE_BYTES:
            yield b" . ".join(held)
            held, size = [], 0
    if held:
        yield b" . ".join(held)


# ---- scores and growth ----

def _score(a: str, left: str, right: str):
    """floor(1000000 a a / (l r)), exactly (counts up to 10^15)."""
    d = "decimal(15,0)"
    return F.expr(f"(cast({a} as {d}) * cast({a} as {d}) * cast(1000000 as decimal(7,0))) div (cast({left} as {d}) * cast({right} as {d}))").cast("long")


def _word(k: int, of: str = "phrase"):
    return F.split(of, " ")[k]


def _with_count(rows: DataFrame, counts: DataFrame, phrase, name: str) -> DataFrame:
    """``rows`` with the count of ``phrase`` in their language as ``name``."""
    c = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("n").alias(name))
    return rows.withColumn("_key", phrase).join(c, (F.col("lang") == F.col("_lang")) & (F.col("_key") == F.col("_phrase"))).drop("_key", "_lang", "_phrase")


def pairs_scored(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score, bound): two-word candidates, and the bound of what grows from them."""
    rows = pairs.select("lang", "phrase", F.col("n").alias("a"))
    rows = _with_count(_with_count(rows, words, _word(0), "l"), words, _word(1), "r")
    return rows.withColumn("score", _score("a", "l", "r")).withColumn("bound", F.expr("(cast(a as decimal(15,0)) * cast(1000000 as decimal(7,0))) div cast(l as decimal(15,0))").cast("long"))


def triples_scored(words: DataFrame, pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score, head, tail): three-word candidates by their lowest-scoring cut, the first of equals."""
    rows = triples.select("lang", "phrase", F.col("n").alias("a")).withColumn("head", F.concat_ws(" ", _word(0), _word(1))).withColumn("tail", F.concat_ws(" ", _word(1), _word(2)))
    for counts, phrase, name in ((words, _word(0), "l1"), (pairs, F.col("tail"), "r1"), (pairs, F.col("head"), "l2"), (words, _word(2), "r2")):
        rows = _with_count(rows, counts, phrase, name)
    rows = rows.withColumn("s1", _score("a", "l1", "r1")).withColumn("s2", _score("a", "l2", "r2"))
    second = F.col("s2") < F.col("s1")
    return rows.select("lang", "phrase", "a", F.when(second, F.col("l2")).otherwise(F.col("l1")).alias("l"),
                       F.when(second, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.least("s1", "s2").alias("score"), "head", "tail")


def thresholds(pairs: DataFrame, wanted: int) -> DataFrame:
    """(lang, least): the lowest score of the first band of scores (16 to a doubling) that, with those above it, holds ``wanted`` two-word phrases; 0 if all hold fewer."""
    bands = pairs.groupBy("lang", F.floor(F.log2(F.col("score") + F.lit(1.0)) * 16).alias("band")).agg(F.count(F.lit(1)).alias("k"), F.min("score").alias("low"))
    upto = F.sum("k").over(Window.partitionBy("lang").orderBy(F.desc("band")))
    deep = F.max(F.when(F.col("upto") >= wanted, F.col("low")))
    return bands.withColumn("upto", upto).groupBy("lang").agg(F.coalesce(deep, F.lit(0).cast("long")).alias("least"))


RESULT = ["lang", "phrase", "a", "l", "r", "score"]


def expand(docs: DataFrame, words: DataFrame, pairs: DataFrame, scored: DataFrame, least: DataFrame, count: int) -> DataFrame:
    """All surviving candidates of the languages of ``least`` that score at least ``least``: one pass over the texts
    counts the phrases that grow from a prefix whose bound reaches it, and those that may make a pair that reaches it drop out."""
    open_ = scored.join(least, "lang")
    role = F.array(F.lit(FREQUENT), F.when(F.col("bound") >= F.col("least"), GROWS), F.when(F.col("score") >= F.col("least"), SETTLES))
    keys = open_.select("lang", "phrase", F.explode(F.array_compact(role)).alias("role"))
    triples = store(triples_scored(words, pairs, phrase_counts(docs, 3, filter_of(keys, keys.count())).where(F.col("n") >= count)))
    longer = (triples.select("lang", F.explode(F.array("head", "tail")).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("longest")))
    left = (open_.where("score >= least").join(longer, ["lang", "phrase"], "left")
            .where("longest is null or 100 * cast(longest as decimal(20,0)) < 50 * cast(a as decimal(20,0))"))
    return left.select(*RESULT, "least").unionByName(triples.join(least, "lang").where("score >= least").select(*RESULT, "least"))


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of every language: lang, rank, phrase, a, l, r, n, score.

    Order: score and a falling, phrase in byte order.  A null language is ``und``; null and empty texts hold
    no words; texts of any length are read whole; repeated rows count as often as they stand.  Ids and other columns are not
    read.  A language without candidates gives no row, as does an empty table.

    Every counting pass is one shuffle of counts that tasks have added up.  A pass counts only phrases whose
    parts are frequent, by a broadcast filter of bounded size.  A language is done when at least ``top``
    survivors score no less than the bound down to which it was expanded: ties at the last place are then settled too.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counted = store(phrase_counts(docs, 1).where((F.col("n") >= least) | F.col("phrase").isNull()))
    words, totals = counted.where("phrase is not null"), counted.where("phrase is null").select("lang", "n")
    keys = words.select("lang", "phrase", F.lit(FREQUENT).alias("role"))
    pairs = store(phrase_counts(docs, 2, filter_of(keys, keys.count())).where(F.col("n") >= least))
    scored = store(pairs_scored(words, pairs))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    done, open_, wanted = [], scored, FIRST_BAND * top
    while True:
        reach = store(thresholds(open_, wanted))
        if reach.isEmpty():
            break
        found = store(expand(docs, words, pairs, scored, reach, least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
        settled = store(reach.join(found.groupBy("lang").agg(F.max("rank").alias("last")), "lang", "left")
                        .where((F.col("least") == 0) | (F.col("last") >= top)).select("lang"))
        done.append(found.join(settled, "lang", "left_semi"))
        open_, wanted = open_.join(settled, "lang", "left_anti"), wanted * DEEPER
    empty = scored.limit(0).withColumn("rank", F.lit(0))
    rows = functools.reduce(DataFrame.unionByName, [d.select(*RESULT, "rank") for d in done], empty.select(*RESULT, "rank"))
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, unnest(ps) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM
  (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, CAST(count(*) AS HUGEINT) AS n FROM g GROUP BY ALL),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND n >= 10),
cut AS (SELECT c.lang, c.phrase, c.n AS a, j, x.n AS l, y.n AS r, (1000000 * c.n * c.n) // (x.n * y.n) AS score
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(n) AS longest FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE k = 3) GROUP BY ALL),
left_ AS (SELECT b.* FROM best b LEFT JOIN inner_ i USING (lang, phrase) WHERE i.longest IS NULL OR 100 * i.longest < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM left_)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, total.n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""


@query("op13_collocations", ORACLE)
def op13(spark, sf_dir):
    return mine(table(spark, sf_dir, "documents"))
