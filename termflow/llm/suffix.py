"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier.

A text falls into pieces: the windows of 100 bytes in a row that share their
minimizer (the least hash of a 32-byte string in the window).  Equal windows
have equal minimizers, so pieces whose minimizer stands nowhere else hold no
repeat, and the others are routed by it into shards.  Each shard builds a
suffix array by Larsson-Sadakane refinement, takes common prefixes after Kasai,
and finds in every class of equal windows the earliest.  The pieces of a
minimizer with very many different pieces are dealt to several shards, whose
sorted window lists are then merged by binary search."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termflow.session import drop_table

from .common import mix64, query, runs_of, sorted_runs, store, table, text_of, tidied

LENGTH = 100  # bytes of a repeated string
GRAM = 32  # bytes of a minimizer
SHARD_BYTES = 1 << 18
#: Bytes and number of neighbouring texts that are cut into pieces together, and pieces whose text a task knows it has passed on.
CUT_BYTES, CUT_TEXTS, SEEN_PIECES = 1 << 15, 1 << 14, 200_000
#: Minimizers with more different pieces than this are dealt to several shards.
SPLIT_PIECES = 2000
#: Documents (by a hash of the id) in which frequent grams are looked for, and how many grams
#: are kept.  Frequent grams come last as minimizers; that moves work, and no result depends on it.
SAMPLE_DOCS = 16_384
MAX_FREQUENT = 1 << 18
WITNESS = -1
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_K = [np.uint64(int(x) | 1) for x in mix64(np.arange(7, 13, dtype=np.uint64))]
_TOP = np.uint64(1 << 63)
_PLACE = np.uint64((1 << 16) - 1)
_HASH = ~(_TOP | _PLACE)  # 47 bits of a gram's hash


def grams(b: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from every place, by doubling."""
    h = _BYTE[b]
    step = 1
    for k in _K[:5]:  # 2, 4, 8, 16, 32 bytes
        h = h[:-step] * k + h[step:]
        step *= 2
    return mix64(h)


def window_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    if span < width:
        h = np.minimum(h[:len(h) - (width - span)], h[width - span:])
    return h


class Cutter:
    """Cuts texts into pieces; ``frequent`` grams are taken as minimizers only where nothing else is there."""

    def __init__(self, frequent: np.ndarray, length: int = LENGTH):
        self.length = length
        self.frequent = np.sort(frequent)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[((self.frequent >> np.uint64(20)) & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def pieces(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``pieces_of`` one text, without the number of the text."""
        return self.pieces_of([raw])[1:]

    def pieces_of(self, raws: list[bytes]) -> tuple[np.ndarray, ...]:
        """(text, minimizer, start, end, twice) of the runs of windows of some texts: end is the last window's end,
        twice tells whether a piece holds its minimizer more than once (it may repeat itself)."""
        b = np.frombuffer(b"".join(raws), np.uint8)
        if len(b) < self.length:
            return (np.zeros(0, np.int64),) * 5
        sizes = np.array([len(r) for r in raws], np.int64)
        h = grams(b) & _HASH
        if len(self.frequent):
            at = np.flatnonzero(self.maybe[((h >> np.uint64(20)) & np.uint64((1 << 22) - 1)).astype(np.int64)])
            if len(at):
                place = np.searchsorted(self.frequent, h[at])
                place[place == len(self.frequent)] = 0
                at = at[self.frequent[place] == h[at]]
                h[at] |= _TOP
        # the low 16 bits tell places apart, so that a window's least is its first least gram
        h |= np.arange(len(h), dtype=np.uint64) & _PLACE
        least = window_least(h, self.length - GRAM + 1)
        # windows that lie in one text, text after text
        n = np.maximum(sizes - self.length + 1, 0)
        first = np.cumsum(sizes) - sizes
        before = np.cumsum(n) - n
        if len(raws) > 1:
            least = least[np.repeat(first - before, n) + np.arange(n.sum())]
        if not len(least):
            return (np.zeros(0, np.int64),) * 5
        moved = np.r_[False, least[1:] != least[:-1]]
        value = least >> np.uint64(16)
        new = np.r_[True, value[1:] != value[:-1]]
        new[before[n > 0]] = True
        start = np.flatnonzero(new)
        moved[start] = False
        twice = np.add.reduceat(moved.astype(np.int64), start)
        text = np.searchsorted(before + n, start, "right")
        end = np.r_[start[1:], len(least)] - before[text] + self.length - 1
        return text, value[start].view(np.int64), start - before[text], end, (twice > 0).astype(np.int64)


def batches_of(raws, most: int = CUT_BYTES):
    """Numbers (from, to) of neighbouring texts of about ``most`` bytes together."""
    at, size = 0, 0
    for k, r in enumerate(raws):
        size += len(r)
        if size >= most or k + 1 - at >= CUT_TEXTS:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(raws):
        yield at, len(raws)


def frequent_grams(texts: DataFrame, sample: int, most: int) -> np.ndarray:
    """Grams that stand in several documents of a bounded sample.  At most ``most`` numbers reach the driver."""
    total = texts.count()
    if not total:
        return np.zeros(0, np.uint64)
    share = min(1.0, sample / total)
    picked = texts.where(F.pmod(F.xxhash64("doc"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("text")

    def run(frames):
        for f in frames:
            found = [np.unique(grams(np.frombuffer(r, np.uint8)) & _HASH) for t in f["text"] if len(r := t.encode("utf-8", "surrogatepass")) >= LENGTH]
            if found:
                g, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"g": g[n > 2].view(np.int64), "n": n[n > 2]})

    parts = max(1, -(-min(sample, total) // 2048))
    counts = picked.repartition(parts).mapInPandas(tidied(run), "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "g").limit(most).select("g").toPandas()
    return top["g"].to_numpy(np.int64).view(np.uint64)


def shared_minimizers(texts: DataFrame, frequent, length: int) -> DataFrame:
    """(doc, m): minimizers of a document that stand on two pieces or more anywhere.

    A minimizer that a batch meets again is known to be shared: its documents go
    on at random places and one witness stands in for them, so no minimizer
    brings more rows to one place than there are batches."""
    def emit(frames):
        cutter = Cutter(frequent.value, length)
        for f in frames:
            ms, docs, ids = [], [], f["doc"].to_numpy(np.int64)
            raws = [t.encode("utf-8", "surrogatepass") for t in f["text"]]
            for a, b in batches_of(raws):
                text, m, _, _, twice = cutter.pieces_of(raws[a:b])
                again = twice > 0
                ms.append(np.r_[m, m[again]])
                docs.append(ids[a:b][np.r_[text, text[again]]])
            if not ms:
                continue
            m, doc = np.concatenate(ms), np.concatenate(docs)
            if not len(m):
                continue
            kinds, which, n = np.unique(m, return_inverse=True, return_counts=True)
            known = n[which] > 1
            km, kd = m[known], doc[known]
            order = np.lexsort((km, kd))
            km, kd = km[order], kd[order]
            once = np.r_[True, (km[1:] != km[:-1]) | (kd[1:] != kd[:-1])] if len(km) else np.zeros(0, bool)
            km, kd = km[once], kd[once]
            witness = kinds[n > 1]
            spread = mix64(km.view(np.uint64) ^ mix64(kd.view(np.uint64))).view(np.int64)
            # few bits a row: m is 0 but where the key is a random place, and WITNESS marks witnesses there
            yield pd.DataFrame({"key": np.r_[m[~known], witness, spread],
                                "m": np.r_[np.zeros((~known).sum(), np.int64), np.full(len(witness), WITNESS), km + 1],
                                "doc": np.r_[doc[~known], np.zeros(len(witness), np.int64), kd]})

    def keep(frames):
        for f in sorted_runs(frames, "key"):
            key, m, doc = f["key"].to_numpy(), f["m"].to_numpy(), f["doc"].to_numpy()
            free = m > 0  # known already
            yield pd.DataFrame({"doc": doc[free], "m": m[free] - 1})
            key, doc, seen = key[~free], doc[~free], m[~free] == WITNESS
            start, end = runs_of(key)
            if len(start):
                ok = (end - start > 1) | np.logical_or.reduceat(seen, start)
                ok = np.repeat(ok, end - start) & ~seen
                yield pd.DataFrame({"doc": doc[ok], "m": key[ok]})

    rows = texts.mapInPandas(tidied(emit), "key long, m long, doc long")
    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(tidied(keep), "doc long, m long")


def packed(texts: DataFrame) -> DataFrame:
    """(doc, packed): texts as compressed UTF-8, for the shuffles."""
    def run(frames):
        press = zstandard.ZstdCompressor(level=3)
        for f in frames:
            yield pd.DataFrame({"doc": f["doc"], "packed": [press.compress(t.encode("utf-8", "surrogatepass")) for t in f["text"]]})

    return texts.mapInPandas(tidied(run), "doc long, packed binary")


def shared_pieces(texts: DataFrame, wanted: DataFrame, frequent, length: int) -> DataFrame:
    """(piece, m, doc, start, size, text): the pieces with shared minimizers; piece is a
    128-bit hash, the text stands on the first row of a piece that a task meets."""
    def run(frames):
        cutter, press, seen = Cutter(frequent.value, length), zstandard.ZstdDecompressor(), set()
        columns = ["piece", "m", "doc", "start", "size", "text"]
        for f in frames:
            rows, docs, asked = [], f["doc"].to_numpy(np.int64), f["ms"].tolist()
            raws = [press.decompress(data) for data in f["packed"]]
            for a, b in batches_of(raws):
                of, m, start, end, _ = cutter.pieces_of(raws[a:b])
                # a minimizer has 48 bits; the number of its text in the batch goes above them
                ms = np.concatenate([np.asarray(asked[k], np.int64) | (k - a) << 48 for k in range(a, b)])
                for k in np.flatnonzero(np.isin(m | of << 48, ms)).tolist():
                    text = raws[a + of[k]][start[k]:end[k]]
                    name = hashlib.blake2b(text, digest_size=16).digest()
                    if len(seen) > SEEN_PIECES:
                        seen.clear()
                    rows.append((name, m[k], docs[a + of[k]], start[k], end[k] - start[k], None if name in seen else text))
                    seen.add(name)
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    asked = wanted.groupBy("doc").agg(F.collect_list("m").alias("ms"))
    return packed(texts).join(asked, "doc").mapInPandas(tidied(run), "piece binary, m long, doc long, start long, size long, text binary")


def eight_bytes(b: np.ndarray) -> np.ndarray:
    """The eight bytes from every place as one number, first byte highest; zeros follow the end."""
    wide = np.r_[b, np.zeros(8, np.uint8)].astype(np.uint64)
    key = np.zeros(len(b), np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | wide[k:k + len(b)]
    return key


def suffix_array(b: np.ndarray) -> np.ndarray:
    """All suffixes in order (Larsson-Sadakane: each round sorts only the groups that are
    still together, by the rank h places on, and doubles h).

    Group, next rank and place share one 64-bit number where they fit, so that a plain sort of numbers does."""
    n = len(b)
    n_bits = n.bit_length()
    kind = np.int32 if n_bits < 31 else np.int64
    used = np.flatnonzero(np.bincount(b, minlength=256))
    code = np.zeros(256, np.uint64)
    code[used] = np.arange(1, len(used) + 1)
    bits = len(used).bit_length()
    h = (64 - n_bits) // bits  # symbols that the first sort sees
    wide = np.r_[code[b], np.zeros(h, np.uint64)]
    key = np.zeros(n, np.uint64)
    for k in range(h):
        key = (key << np.uint64(bits)) | wide[k:k + n]
    packed = (key << np.uint64(n_bits)) | np.arange(n, dtype=np.uint64)
    del wide, key
    packed.sort()
    sa = (packed & np.uint64((1 << n_bits) - 1)).astype(kind)
    packed >>= np.uint64(n_bits)
    head = np.r_[True, packed[1:] != packed[:-1]]
    rank = np.empty(n + 1, kind)
    rank[n] = -1
    at = np.arange(n, dtype=kind)
    s = sa
    while True:
        first = np.flatnonzero(head)
        rank[s] = np.repeat(at[first], np.diff(np.r_[first, len(at)]))
        open_ = np.flatnonzero(~(head & np.r_[head[1:], True]))
        if not len(open_):
            return sa
        at, s, head = at[open_], s[open_], head[open_]
        m_bits = len(at).bit_length()
        group = np.cumsum(head) 
        nxt = rank[np.minimum(s + kind(min(h, n)), n)] + 1
        if int(group[-1]).bit_length() + n_bits + m_bits <= 64:
            packed = ((group.astype(np.uint64) << np.uint64(n_bits) | nxt.astype(np.uint64)) << np.uint64(m_bits)) | np.arange(len(at), dtype=np.uint64)
            packed.sort()
            order = (packed & np.uint64((1 << m_bits) - 1)).astype(np.int64)
            packed >>= np.uint64(m_bits)
        else:
            packed = group * (n + 1) + nxt.astype(np.int64)
            order = np.argsort(packed, kind="stable")
            packed = packed[order]
        s = s[order]
        sa[at] = s
        head = np.r_[True, packed[1:] != packed[:-1]]
        h *= 2


def common_prefixes(b: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefix of every suffix with its left neighbour in the array.

    Kasai's order in arrays: going through the text, a common prefix is one shorter than the
    one before it unless the preceding bytes differ; only there bytes are compared."""
    n = len(b)
    kind = sa.dtype.type
    left = np.empty(n, kind)
    left[sa[0]] = -1
    left[sa[1:]] = sa[:-1]
    before = np.maximum(left - kind(1), kind(0))
    same = b[before[1:]] == b[:-1]
    same &= left[1:] > 0
    start = np.flatnonzero(np.r_[True, ~same]).astype(kind)
    base = left[start]
    have = np.zeros(len(start), kind)
    live = np.flatnonzero(base >= 0)
    eight = eight_bytes(b)
    while len(live):  # eight bytes at a time; what lies behind the end is cut off below
        i, j = start[live] + have[live], base[live] + have[live]
        ok = np.maximum(i, j) < n
        live, i, j = live[ok], i[ok], j[ok]
        other = eight[i] ^ eight[j]
        whole = other == 0
        have[live[whole]] += kind(8)
        at = np.flatnonzero(~whole)
        x = other[at]
        have[live[at]] += sum((x < np.uint64(1 << 64 - 8 * k)).astype(kind) for k in range(1, 8))
        live = live[whole]
    have = np.minimum(have, n - np.maximum(start, base))
    lengths = np.diff(np.r_[start, n])
    inside = np.arange(n, dtype=kind) - np.repeat(start, lengths)
    plcp = np.maximum(np.repeat(have, lengths) - inside, kind(0))
    return plcp[sa]


def window_classes(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a shard in sorted order: (text, offset, class); equal windows share a class."""
    size = np.array([len(t) for t in texts], np.int64)
    b = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    first = np.cumsum(size + 1) - (size + 1)
    sa = suffix_array(b)
    lcp = common_prefixes(b, sa)
    own = np.repeat(np.arange(len(texts)), size + 1)
    offset = np.arange(len(b)) - first[own]
    whole = offset + length <= size[own]  # suffixes that hold a window; equal windows are neighbours among them
    pick = whole[sa]
    cls = np.cumsum(lcp < length)[pick]
    s = sa[pick]
    return own[s], offset[s], cls


def later_windows(doc: np.ndarray, place: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Which windows are not the earliest of their class (classes stand together)."""
    if not len(cls):
        return np.zeros(0, bool)
    order = np.lexsort((place, doc))
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.arange(len(doc))
    start, end = runs_of(cls)
    least = np.minimum.reduceat(rank, start)
    return rank > np.repeat(least, end - start)


def as_runs(doc: np.ndarray, place: np.ndarray, length: int) -> pd.DataFrame:
    """Window starts as byte ranges (doc, lo, hi)."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    if not len(doc):
        return pd.DataFrame({"doc": doc, "lo": place, "hi": place}, dtype="int64")
    new = np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)]
    at = np.flatnonzero(new)
    last = np.r_[at[1:] - 1, len(doc) - 1]
    return pd.DataFrame({"doc": doc[at], "lo": place[at], "hi": place[last] + length})


def shard_frames(frames, key: str, most: int = SHARD_BYTES):
    """Runs of whole keys, about ``most`` bytes of text a shard."""
    held, size = [], 0
    for f in sorted_runs(frames, key):
        values = f[key].to_numpy()
        start, end = runs_of(values)
        n = f["text"].str.len().to_numpy(np.int64) + 1
        bytes_ = np.add.reduceat(n, start)
        a = 0
        for k in range(len(start)):
            size += bytes_[k]
            if size >= most:
                held.append(f.iloc[a:end[k]])
                yield pd.concat(held, ignore_index=True)
                held, size, a = [], 0, end[k]
        if a < len(f):
            held.append(f.iloc[a:])
    if held:
        yield pd.concat(held, ignore_index=True)


def repeats_in_shards(pieces: DataFrame, length: int) -> DataFrame:
    """(doc, lo, hi) of later windows; the pieces of a minimizer lie in one shard."""
    def run(frames):
        for f in shard_frames(frames, "m"):
            own, offset, cls = window_classes(f["text"].tolist(), length)
            doc, place = f["doc"].to_numpy()[own], f["start"].to_numpy()[own] + offset
            later = later_windows(doc, place, cls)
            yield as_runs(doc[later], place[later], length)

    return pieces.repartition("m").sortWithinPartitions("m").mapInPandas(tidied(run), "doc long, lo long, hi long")


def sorted_windows(pieces: DataFrame, length: int) -> DataFrame:
    """(shard, window, doc, place, first): each shard's windows; first marks the earliest of a class in it."""
    def run(frames):
        for f in shard_frames(frames, "shard"):
            for shard, g in f.groupby("shard"):
                own, offset, cls = window_classes(g["text"].tolist(), length)
                doc, place = g["doc"].to_numpy()[own], g["start"].to_numpy()[own] + offset
                later = later_windows(doc, place, cls)
                texts = g["text"].tolist()
                yield pd.DataFrame({"shard": shard, "window": [None if x else texts[o][s:s + length] for x, o, s in zip(later, own, offset)],
                                    "doc": doc, "place": place, "first": ~later})

    return pieces.repartition("shard").sortWithinPartitions("shard").mapInPandas(tidied(run), "shard long, window binary, doc long, place long, first boolean")


def merge_sorted(lists: list[np.ndarray]) -> np.ndarray:
    """Numbers of equal windows over several sorted lists without repeats: each list is
    looked up in what is merged so far by binary search."""
    known = lists[0]
    for x in lists[1:]:
        at = np.searchsorted(known, x)
        there = np.zeros(len(x), bool)
        inside = at < len(known)
        there[inside] = known[at[inside]] == x[inside]
        known = np.insert(known, at[~there], x[~there])
    return np.concatenate([np.searchsorted(known, x) for x in lists])


def merge_shards(windows: DataFrame, length: int) -> DataFrame:
    """(doc, lo, hi) of windows that another shard holds earlier, and of those a shard found itself."""
    def run(frames):
        for f in sorted_runs(frames, "window"):
            f = f.sort_values(["shard", "window"], kind="stable")
            # UTF-8 has no byte over 0xF4: one more a byte keeps the order and no byte is 0
            raw = np.frombuffer(b"".join(f["window"]), np.uint8) + np.uint8(1)
            w = np.frombuffer(raw.tobytes(), f"S{length}")
            start, end = runs_of(f["shard"].to_numpy())
            cls = merge_sorted([w[a:b] for a, b in zip(start, end)])
            order = np.argsort(cls, kind="stable")
            doc, place = f["doc"].to_numpy()[order], f["place"].to_numpy()[order]
            later = later_windows(doc, place, cls[order])
            yield as_runs(doc[later], place[later], length)

    def own(frames):
        for f in frames:
            yield as_runs(f["doc"].to_numpy(), f["place"].to_numpy(), length)

    found = windows.where("not first").select("doc", "place").mapInPandas(own, "doc long, lo long, hi long")
    lists = windows.where("first").repartitionByRange("window").sortWithinPartitions("window")
    return lists.mapInPandas(tidied(run), "doc long, lo long, hi long").unionByName(found)


def removed_ranges(texts: DataFrame, length: int = LENGTH, split: int = SPLIT_PIECES, sample: int = SAMPLE_DOCS) -> DataFrame:
    """(doc, ranges): byte ranges [lo, hi) of ``texts(doc, text)``, doc unique, that a
    ``length``-byte string covers which also starts earlier.  Ranges may overlap."""
    frequent = texts.sparkSession.sparkContext.broadcast(frequent_grams(texts, sample, MAX_FREQUENT))
    wanted = shared_minimizers(texts, frequent, length)
    found = store(shared_pieces(texts, wanted, frequent, length))
    kinds = store(found.groupBy("piece").agg(F.min(F.struct("doc", "start")).alias("at"), F.max("text").alias("text"), F.first("m").alias("m"))
                  .select("piece", "m", F.col("at.doc").alias("doc"), F.col("at.start").alias("start"), "text"))
    # every place of a piece but the earliest repeats it whole
    own = kinds.select("piece", F.col("doc").alias("d"), F.col("start").alias("s"))
    copies = store(found.drop("text").join(own, "piece").where("doc > d or doc = d and start > s")
                   .select("doc", F.col("start").alias("lo"), (F.col("start") + F.col("size")).alias("hi")))
    drop_table(found)  # from here on every text stands once
    big = store(kinds.groupBy("m").agg(F.count("*").alias("n")).where(F.col("n") > split))
    usual = kinds.join(big, "m", "left_anti")
    parts = F.ceil(F.col("n") / split)
    dealt = kinds.join(big, "m").withColumn("shard", F.xxhash64("m", F.pmod(F.xxhash64("piece"), parts))).drop("n", "m")
    used = [kinds, copies, big]
    ranges = copies.unionByName(repeats_in_shards(usual, length))
    if not big.isEmpty():
        used.append(store(sorted_windows(dealt, length)))
        ranges = ranges.unionByName(merge_shards(used[-1], length))
    out = store(ranges.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("ranges")))
    for t in used:
        drop_table(t)
    frequent.unpersist()
    return out


def union_of(ranges) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of sorted ranges; ranges that touch are one run."""
    if ranges is None or not len(ranges):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo = np.array([r["lo"] for r in ranges], np.int64)
    hi = np.maximum.accumulate(np.array([r["hi"] for r in ranges], np.int64))
    new = np.r_[True, lo[1:] > hi[:-1]]
    at = np.flatnonzero(new)
    return lo[at], hi[np.r_[at[1:] - 1, len(lo) - 1]]


def cut(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> bytes:
    return b"".join(raw[a:b] for a, b in zip(np.r_[0, hi].tolist(), np.r_[lo, len(raw)].tolist()))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, bool]:
    """(texts(doc, text), rows(doc_id, text), ids are unique).  If ids repeat or are
    missing, different (id, text) rows are numbered in order, null first."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    n, known, kinds = rows.select("doc_id").agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == known == kinds:
        return rows.select(F.col("doc_id").alias("doc"), "text"), rows, True
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    texts = rows.distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    texts = store(texts.withColumn("doc", F.monotonically_increasing_id()))
    return texts.select("doc", "text"), rows.join(texts, rows["doc_id"].eqNullSafe(texts["doc_id"]) & (rows["text"] == texts["text"])).select(rows["doc_id"], "doc", rows["text"]), False


def with_ranges(docs: DataFrame, id_col: str, text_col: str, length: int, split: int = SPLIT_PIECES) -> DataFrame:
    """(doc_id, packed, ranges) of every row."""
    texts, rows, unique = numbered(docs, id_col, text_col)
    ranges = removed_ranges(texts, length, split)
    if unique:
        return packed(texts).join(ranges, "doc", "left").withColumnRenamed("doc", "doc_id")
    again = rows.select("doc_id", "doc").withColumnRenamed("doc", "doc_")
    return packed(texts).join(ranges, "doc", "left").join(again, F.col("doc") == F.col("doc_")).drop("doc", "doc_")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, split: int = SPLIT_PIECES) -> DataFrame:
    """One row per row of ``docs``: bytes, bytes removed, maximal removed runs, digest of what remains.

    A null text has no bytes.  Rows that repeat an id with the same text count as one document and
    give the same result each; an id on several texts, or no id, makes documents of their own in the
    order of (id, a hash of the text), null first.  An empty table gives no rows.
    """
    def run(frames):
        press = zstandard.ZstdDecompressor()
        for f in frames:
            rows = []
            for data, ranges in zip(f["packed"], f["ranges"]):
                raw = press.decompress(data)
                lo, hi = union_of(ranges)
                rows.append((len(raw), int((hi - lo).sum()), len(lo), hashlib.sha256(cut(raw, lo, hi)).hexdigest()))
            got = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            got.insert(0, "doc_id", f["doc_id"].astype("Int64"))
            yield got

    return with_ranges(docs, id_col, text_col, length, split).select("doc_id", "packed", "ranges").mapInPandas(tidied(run), RESULT)


def dedup_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, text, n_removed): texts without their repeated bytes; a character that is cut goes."""
    def run(frames):
        press = zstandard.ZstdDecompressor()
        for f in frames:
            rows = []
            for data, ranges in zip(f["packed"], f["ranges"]):
                raw = press.decompress(data)
                lo, hi = union_of(ranges)
                rows.append((cut(raw, lo, hi).decode("utf-8", "ignore"), int((hi - lo).sum())))
            got = pd.DataFrame(rows, columns=["text", "n_removed"])
            got.insert(0, "doc_id", f["doc_id"].astype("Int64"))
            yield got

    return with_ranges(docs, id_col, text_col, length).select("doc_id", "packed", "ranges").mapInPandas(tidied(run), "doc_id long, text string, n_removed long")


@query("op9_suffix_dedup")
def op9(spark, sf_dir):
    return dedup_spans(table(spark, sf_dir, "documents"))
