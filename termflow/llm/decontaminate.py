"""Benchmark decontamination: a broadcast hash set of normalised test n-grams is
scanned against the word windows of every document; hits are verified word by
word; spans or whole documents are removed."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, mix64, query, ship, store, table

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Bytes of normalised benchmark text in one broadcast (about five times this with its index); a larger benchmark is scanned in blocks.
BLOCK_BYTES = 8 << 20
#: An item longer than this is indexed in pieces that overlap by a window less a word.
PIECE_BYTES = 1 << 16
#: Bytes of text that a task holds as words at a time.
SLICE_BYTES = 1 << 21
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Lower-cases A-Z; all other ASCII but digits and letters becomes a blank.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal(text: str | None) -> bytes:
    """The words of a text between blanks."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL)


def pieces(text: bytes, size: int, overlap: int) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first word, words) of runs of about ``size`` bytes; each but the first repeats the last ``overlap`` words before it."""
    at, first, tail = 0, 0, []
    while True:
        end = text.find(b" ", at + size) if at + size < len(text) else -1
        fresh = (text[at:] if end < 0 else text[at:end]).split()
        ws = tail + fresh
        if fresh or not at:
            yield first - len(tail), ws
        if end < 0:
            return
        first += len(fresh)
        tail = ws[-overlap:] if overlap else []
        at = end


def window_hashes(ws: list[bytes], sizes: list[int], cache: dict) -> dict[int, np.ndarray]:
    """For each size in ``sizes`` the hashes of all windows of so many words, by first word."""
    h = np.fromiter((cache.get(w) or cache.setdefault(w, zlib.crc32(w) + 1) for w in ws), np.uint64, len(ws))
    if len(cache) > 300_000:
        cache.clear()
    out, g = {}, np.zeros(len(h), np.uint64)
    for n in range(1, max(sizes, default=0) + 1):
        if n > len(h):
            break
        g = g[:len(h) - n + 1] * _STEP + h[n - 1:]
        if n in sizes:
            out[n] = mix64(g + np.uint64(n))
    return out


class Windows:
    """The windows of one block of items as plain arrays: sorted hashes, places of
    the windows in the joined text, and for each the list of its items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], size: int):
        found: dict[bytes, set] = {}
        for item, ws in items:
            n = min(size, len(ws))
            for i in range(len(ws) - n + 1 if n else 0):
                found.setdefault(b" ".join(ws[i:i + n]), set()).add(item)
        texts = list(found)
        groups: dict[frozenset, int] = {}
        group = [groups.setdefault(frozenset(found[t]), len(groups)) for t in texts]
        counts = np.array([t.count(b" ") + 1 for t in texts], np.int64)
        cache: dict = {}
        h = np.array([window_hashes(t.split(b" "), [n], cache)[n][0] for t, n in zip(texts, counts.tolist())], np.uint64)
        order = np.argsort(h, kind="stable")
        ends = np.cumsum([len(t) for t in texts])
        self.sizes = sorted(set(counts.tolist()))
        self.hashes, self.group = h[order], np.array(group, np.int32)[order]
        self.ends, self.lengths = ends[order], np.array([len(t) for t in texts], np.int64)[order]
        self.text = b"".join(texts)
        self.items = [sorted(x for x in g if x is not None) for g in groups]

    def filter(self) -> np.ndarray:
        """A bit per high part of a hash, so that nearly all windows are settled by one look."""
        self.shift = np.uint64(64 - max(16, min(24, 4 + int(len(self.hashes)).bit_length())))
        bits = np.zeros(1 << (64 - int(self.shift)), bool)
        bits[self.hashes >> self.shift] = True
        return bits

    def same(self, k: int, window: bytes) -> bool:
        end = int(self.ends[k])
        return self.text[end - int(self.lengths[k]):end] == window


class Scanner:
    """Finds the windows of a block in texts, a bounded slice of words at a time."""

    def __init__(self, block: Windows, size: int):
        self.block, self.size, self.bits, self.cache = block, size, block.filter(), {}

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
        """For each text its number of words, places (first word, word after) of verified windows, and groups of items."""
        out = [[0, [], set()] for _ in texts]
        held, n_bytes = [], 0
        for row, text in enumerate(texts):
            raw = normal(text)
            for first, ws in pieces(raw, SLICE_BYTES, self.size - 1):
                out[row][0] = first + len(ws)
                held.append((row, first, ws))
                n_bytes += min(len(raw), SLICE_BYTES)
                if n_bytes >= SLICE_BYTES:
                    self._match(held, out)
                    held, n_bytes = [], 0
        self._match(held, out)
        return out

    def _match(self, held, out):
        ws = [w for *_, part in held for w in part]
        if not ws or not self.block.sizes:
            return
        sizes = np.array([len(part) for *_, part in held])
        ends = np.cumsum(sizes)
        room = np.repeat(ends, sizes) - np.arange(len(ws))  # words from here to the end of the text
        hashes = self.block.hashes
        for n, h in window_hashes(ws, self.block.sizes, self.cache).items():
            at = np.flatnonzero(self.bits[h >> self.block.shift] & (room[:len(h)] >= n))
            low, high = np.searchsorted(hashes, h[at]), np.searchsorted(hashes, h[at], "right")
            hit = np.flatnonzero(high > low)
            part = np.searchsorted(ends, at[hit], "right")
            for i, p, k, stop in zip(at[hit].tolist(), part.tolist(), low[hit].tolist(), high[hit].tolist()):
                window = b" ".join(ws[i:i + n])
                for k in range(k, stop):
                    if self.block.same(k, window):
                        row, first, words = held[p]
                        start = first + i - int(ends[p] - len(words))
                        out[row][1].append((start, start + n))
                        out[row][2].add(int(self.block.group[k]))
                        break


def merged(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered words."""
    runs: list[list[int]] = []
    for start, end in sorted(places):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(end, runs[-1][1])
        else:
            runs.append([start, end])
    return [(s, e) for s, e in runs]


def without(text: str, runs: list[tuple[int, int]]) -> str:
    """``text`` less the words of ``runs`` and what stands between the words of a run."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for start, end in runs:
        out.append(text[at:words[start][0]])
        at = words[end - 1][1]
    return "".join([*out, text[at:]])


def item_pieces(bench: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(item, words, n_bytes): normalised items, the long ones in overlapping pieces."""
    def run(frames):
        for f in frames:
            rows = [(item, b" ".join(ws)) for item, text in zip(f["item"].to_pylist(), f["text"].to_pylist())
                    for _, ws in pieces(normal(text), PIECE_BYTES, size - 1) if ws]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()),
                                              pa.array([len(r[1]) + 1 for r in rows], pa.int64())], ["item", "words", "n_bytes"])

    rows = bench.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "item string, words binary, n_bytes long").distinct()


def blocks(bench: DataFrame, id_col: str, text_col: str, size: int, most: int) -> Iterator[Windows]:
    """The benchmark as blocks of windows, each of about ``most`` bytes of text at most."""
    rows = store(item_pieces(bench, id_col, text_col, size))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    n = 1 if total <= most else -(-2 * total // most)  # several blocks are half full on average
    block = F.pmod(F.xxhash64("words"), F.lit(n))
    for k in range(n):
        part = rows if n == 1 else rows.where(block == k)
        yield Windows([(r.item, bytes(r.words).split(b" ")) for r in part.collect()], size)


FOUND = "struct<n_words: bigint, runs: array<struct<first: bigint, after: bigint>>, items: array<string>>"


def find(docs: DataFrame, bench: DataFrame, id_col: str = "item_id", text_col: str = "text", bench_text: str = "text",
         window: int = WINDOW, most: int = BLOCK_BYTES, as_col: str = "found") -> DataFrame:
    """``docs`` with a column ``as_col``: n_words, the maximal runs of hit words
    (first word, word after), and the sorted ids of the items whose windows occur.

    Windows are runs of ``window`` words of an item, or a whole item of fewer.  A null
    or empty text has no words, in documents and items alike, and no hit.  Items with
    equal ids are one item; windows of an item without id hit, but name no item.
    Repeated documents, null and repeated ids are scanned row by row: no key and no
    shuffle.  Texts of any length are scanned whole, in slices of bounded size.  Other
    columns of ``docs`` are kept as they are; ``as_col`` must not be one of them.  An
    empty benchmark hits nothing.

    A benchmark of up to ``most`` bytes is one broadcast; a larger one is scanned in
    blocks, one pass over the documents for each, with the hits stored in between.
    """
    ship(docs.sparkSession)
    if as_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"a column {as_col} stands already")
    sc, k = docs.sparkSession.sparkContext, 0
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(as_col, T.StructType.fromDDL(f"f {FOUND}")["f"].dataType)])
    for block in blocks(bench, id_col, bench_text, window, most):
        if k:
            docs = store(docs)
        docs = docs.mapInArrow(functools.partial(_scan_batches, handle=sc.broadcast(block), at=at, size=window, name=as_col, again=k > 0), schema)
        k += 1
    return docs


def _scan_batches(batches, handle, at, size, name, again):
    scanner = Scanner(handle.value, size)
    names: dict[frozenset, list[str]] = {}
    kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))), ("items", pa.list_(pa.string()))])
    for batch in batches:
        before = batch.column(batch.num_columns - 1).to_pylist() if again else [None] * batch.num_rows
        rows = []
        for (n, places, groups), old in zip(scanner.scan(batch.column(at).to_pylist()), before):
            g = frozenset(groups)
            if g not in names:
                names[g] = sorted({x for i in g for x in scanner.block.items[i]})
            items = names[g]
            if old and old["runs"]:
                places = places + [(r["first"], r["after"]) for r in old["runs"]]
                items = sorted({*items, *old["items"]})
            rows.append({"n_words": n, "runs": [{"first": s, "after": e} for s, e in merged(places)], "items": items})
        kept = [batch.column(c) for c in range(batch.num_columns - again)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, kind)], [*batch.schema.names[:len(kept)], name])


def n_hit(found: str = "found"):
    return F.aggregate(f"{found}.runs", F.lit(0).cast("long"), lambda s, r: s + r["after"] - r["first"])


def decontaminate(docs: DataFrame, bench: DataFrame, remove: str = "spans", id_col: str = "item_id", text_col: str = "text",
                  bench_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without benchmark passages: with ``remove='spans'`` the hit words, and what stands between
    the words of a run, go from the texts; with ``remove='documents'`` documents with a hit go.

    Nulls, empty texts, repeated rows and empty tables as in ``find``; documents without a hit are not touched.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    col = fresh("found", docs.columns)
    got = find(docs, bench, id_col, text_col, bench_text, window, as_col=col)
    if remove == "documents":
        return got.where(F.size(F.col(col)["runs"]) == 0).select(*docs.columns)
    at = docs.columns.index(text_col)

    def cut(batches):
        for batch in batches:
            texts, found = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            new = [without(t, [(r["first"], r["after"]) for r in f["runs"]]) if f["runs"] else t for t, f in zip(texts, found)]
            columns = [batch.column(c) for c in range(batch.num_columns - 1)]
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return got.mapInArrow(cut, docs.schema)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM bs),
ns AS (SELECT DISTINCT n FROM bw),
ds AS (SELECT k, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, ns WHERE len(w) >= n),
dw AS (SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM ds),
hit AS (SELECT DISTINCT k, n, i, item_id FROM dw JOIN bw USING (n, win)),
word AS (SELECT DISTINCT k, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT k, n, i FROM hit)),
nh AS (SELECT k, count(*) AS n_hit FROM word GROUP BY k),
ni AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (k) LEFT JOIN ni USING (k)"""


@query("op11_decontaminate", ORACLE)
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("found.n_words").alias("n_words"), n_hit().alias("n_hit"),
                        F.size("found.items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.size("found.runs") > 0).alias("contaminated"))
