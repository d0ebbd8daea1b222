"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash cuts texts into chunks at places that depend on the content
alone, so passages that documents share give the same chunks; the body of a
chunk is encoded once.  The joins between bodies are repaired by encoding a
window over the join again, and the window grows until both its ends agree
with what a whole-text encoding gives there."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import mix64, query, table, text_of, tidied

#: Entries and bytes up to which a worker keeps encoded pieces and chunk bodies.
MAX_PIECES = 600_000
MAX_CHUNK_BYTES = 8 << 20
CHUNK_BITS = 9  # a chunk has 2^9 characters on average
SLICE_BYTES = 4 << 20  # text taken through the arrays at once
LONG_PIECE = 64  # pieces of more bytes are not kept

def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_values() -> dict[str, int]:
    """Byte-level BPE writes every byte as a printable character: printable Latin-1
    bytes as themselves, the others from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLANK, _LETTER, _POINT = (np.isin(np.arange(256), [*x]) for x in (b" \t\n\x0b\x0c\r", range(65, 91), b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
_LETTER |= np.isin(np.arange(256), range(97, 123))
_CLOSES = _POINT & (np.arange(256) != ord("'"))
_BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64))
_POWERS = np.cumprod(np.full(LONG_PIECE, _MIX, np.uint64))


def _gathered(ids: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs of ``count`` ids from ``at`` on, one after another."""
    ends = np.cumsum(count)
    return ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - count), count)]


class Codec:
    """Encodes as the tokenizers library does; one per Python worker and vocabulary.

    A pre-token always starts where white space follows something else, where
    a sign follows a letter, and where a letter follows a sign other than the
    apostrophe, so a text falls into pieces that are encoded apart with the same ids.  Arrays find the different pieces of many
    texts at once; each is encoded once and its ids are gathered for every place.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        values = byte_values()
        self.letters = {v: c for c, v in values.items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.special = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        strings = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            strings[i] = token.encode() if token in self.special else bytes(values[c] for c in token)
        self.lengths = np.array([len(x) for x in strings], np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)
        self.written = str.maketrans({chr(v): c for v, c in self.letters.items()})
        self.space = self.letters[ord(" ")]
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of the kept pieces, sorted; the arrays beside go with them
        self.at = np.zeros(0, np.uint32)
        self.count = np.zeros(0, np.uint16)
        self.again = np.zeros(0, bool)  # met after the slice that brought it
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _trim(self, room: int) -> None:
        """Keeps the pieces that were met again, if ``room`` more fit beside them."""
        kept = self.again
        if np.count_nonzero(kept) + room > MAX_PIECES:
            return self.clear()
        at, count = self.at[kept], self.count[kept].astype(np.int64)
        ids = _gathered(self.ids, at, count)
        self.known, self.count, self.again = self.known[kept], self.count[kept], np.zeros(len(at), bool)
        self.at, self.ids, self.used = (np.cumsum(count) - count).astype(np.uint32), np.r_[ids, np.zeros(1 << 16, np.uint32)], len(ids)

    def _word(self, piece: bytes) -> list[int]:
        """Ids of one piece: a plain word is one pre-token and goes to the model of the
        tokenizers library as it stands, any other piece through its whole encoder."""
        bare = piece[1:] if piece[:1] == b" " else piece
        if bare.isalpha() or bare.isdigit() or piece in (b".", b","):  # of bytes: ASCII alone
            return [t.id for t in self.model.tokenize(piece.decode().replace(" ", self.space))]
        text = piece.decode("utf-8", "surrogatepass")
        word = text[1:] if text[:1] == " " else text
        if word.isalpha() and max(word) < "\u0250":
            return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.written))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        held, size = [], 0
        for k, text in enumerate(texts):
            if any(x in text for x in self.special):  # a special token splits a text before all else
                out[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            raw = text.encode("utf-8", "surrogatepass")
            if raw:
                held.append((k, raw))
                size += len(raw)
            if size >= SLICE_BYTES:
                self._slice(held, out)
                held, size = [], 0
        if held:
            self._slice(held, out)
        return out

    def _slice(self, held: list[tuple[int, bytes]], out: list[np.ndarray]) -> None:
        raw = b"".join(x for _, x in held)
        b = np.frombuffer(raw, np.uint8)
        first = np.cumsum([0, *[len(x) for _, x in held]])
        blank = _BLANK[b]
        cut = np.empty(len(b), bool)
        cut[0] = True
        # beyond ASCII only two-byte characters are known to be no white space here (C2 may be)
        lead = np.zeros(len(b), bool)
        lead[2:] = (b[:-2] >= 0xC3) & (b[:-2] <= 0xDF)
        solid = (b < 0x80) & (b > 0x20) & (b != 0x7F) | (b >= 0x80) & np.r_[lead[1:], False]
        cut[1:] = blank[1:] & solid[:-1] | _POINT[b[1:]] & _LETTER[b[:-1]] | _LETTER[b[1:]] & _CLOSES[b[:-1]]
        cut[first[:-1]] = True
        start = np.flatnonzero(cut)
        end = np.r_[start[1:], len(b)]
        n = end - start
        place = np.arange(len(b), dtype=np.int32)
        place -= np.repeat(start.astype(np.int32), n)
        h = _BYTE_HASH[b]
        h *= _POWERS[np.minimum(place, LONG_PIECE - 1, out=place)]
        h = np.add.reduceat(h, start)
        h = mix64(h + n.astype(np.uint64))
        h[n > LONG_PIECE] = mix64(np.flatnonzero(n > LONG_PIECE).astype(np.uint64)) | np.uint64(1)  # on its own
        kinds, where, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(kinds) > MAX_PIECES:
            self._trim(len(kinds))
        long = n[where] > LONG_PIECE
        spot = np.searchsorted(self.known, kinds)
        met = np.zeros(len(kinds), bool)
        met[spot < len(self.known)] = self.known[spot[spot < len(self.known)]] == kinds[spot < len(self.known)]
        met &= ~long
        at, count = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
        at[met], count[met] = self.at[spot[met]], self.count[spot[met]]
        self.again[spot[met]] = True
        new, passing = np.flatnonzero(~met & ~long), np.flatnonzero(long)  # those that pass are not kept
        todo = np.r_[new, passing]
        if len(todo):
            got = [self._word(raw[i:j]) for i, j in zip(start[where[todo]].tolist(), end[where[todo]].tolist())]
            flat = np.fromiter((i for g in got for i in g), np.uint32)
            count[todo] = np.fromiter(map(len, got), np.int64, len(got))
            at[todo] = self.used + np.cumsum(count[todo]) - count[todo]
            if self.used + len(flat) > len(self.ids):
                self.ids = np.r_[self.ids[:self.used], np.zeros((self.used >> 1) + len(flat), np.uint32)]
            self.ids[self.used:self.used + len(flat)] = flat
            self.known, self.at, self.count, self.again = (np.insert(kept, spot[new], x) for kept, x in (
                (self.known, kinds[new]), (self.at, at[new]), (self.count, count[new]), (self.again, False)))
            self.used += int(count[new].sum())
        count = count[which]
        ids = _gathered(self.ids, at[which], count)
        bounds = np.r_[0, np.cumsum(count)][np.searchsorted(start, first)]
        for (k, _), i, j in zip(held, bounds, bounds[1:]):
            out[k] = ids[i:j]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        out = []
        for i in range(0, len(ids), 1 << 16):
            part = ids[i:i + (1 << 16)].astype(np.int64)
            n = self.lengths[part]
            ends = np.cumsum(n)
            place = np.arange(ends[-1]) + np.repeat(self.starts[part] - (ends - n), n)
            out.append(self.bytes[place].tobytes())
        return b"".join(out).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def chunk_cuts(text: str, bits: int = CHUNK_BITS) -> list[int]:
    """Places (in characters) after which a rolling hash of the last 16 characters has ``bits`` zero bits."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if len(points) <= 16:
        return []
    h = (points.astype(np.uint64) + np.uint64(1)) * _MIX
    for step, turn in ((1, 5), (2, 11), (4, 19), (8, 31)):  # doubling: hashes of 2, 4, 8 and 16 characters
        left, right = h[:-step], h[step:]
        h = ((left << np.uint64(turn)) | (left >> np.uint64(64 - turn))) * _MIX + right
    at = np.flatnonzero((h >> np.uint64(64 - bits)) == 0) + 16
    return at[at < len(points)].tolist()


#: Where a pre-token must start, as in the codec: a body lies between two such places.
AGREED = re.compile(r"(?<=[!-~]) ")


class ChunkEncoder:
    """Encodes texts chunk by chunk; bodies of chunks are kept and shared by the documents of a worker."""

    def __init__(self, codec_: Codec, bits: int = CHUNK_BITS):
        self.codec, self.bits = codec_, bits
        self.bodies: dict[str, tuple[int, int, np.ndarray]] = {}
        self.held = 0
        self.reused = 0

    @staticmethod
    def body_of(chunk: str) -> tuple[int, int] | None:
        """(start, end) of what lies between the first and the last agreed place of a chunk."""
        first = AGREED.search(chunk)
        if not first:
            return None
        last = chunk.rfind(" ")
        while last > first.start() and not "!" <= chunk[last - 1] <= "~":
            last = chunk.rfind(" ", 0, last)
        return (first.start(), last) if last > first.start() else None

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text: bodies of chunks that were met before are looked up, the new
        ones and the windows over the joins are encoded together."""
        if self.held > MAX_CHUNK_BYTES:
            self.bodies.clear()
            self.held = 0
        todo: list[str] = []
        fresh: dict[str, tuple[int, int, int]] = {}  # chunk -> its body's place, number in todo
        plans = []
        for text in texts:
            plan: list = []
            if any(x in text for x in self.codec.special):  # special tokens split a text first: one window
                plan.append(len(todo))
                todo.append(text)
                plans.append(plan)
                continue
            cuts = [0, *chunk_cuts(text, self.bits), len(text)]
            done = 0  # text[:done] is planned
            for start, end in zip(cuts, cuts[1:]):
                chunk = text[start:end]
                body = self.bodies.get(chunk) or fresh.get(chunk)
                if body is None:
                    span = self.body_of(chunk)
                    if span is None:  # no agreed place: the window over the join grows
                        continue
                    body = fresh[chunk] = (*span, len(todo))
                    todo.append(chunk[span[0]:span[1]])
                else:
                    self.reused += 1
                first, last, ids = body
                if start + first > done:
                    plan.append(len(todo))
                    todo.append(text[done:start + first])  # the join, encoded again
                plan.append(ids)
                done = start + last
            if done < len(text):
                plan.append(len(todo))
                todo.append(text[done:])
            plans.append(plan)
        got = self.codec.encode_many(todo)
        for chunk, (first, last, k) in fresh.items():
            self.bodies[chunk] = (first, last, got[k].copy())
            self.held += 2 * len(chunk) + got[k].nbytes + 200
        return [np.concatenate([got[x] if isinstance(x, int) else x for x in p]) if p else np.zeros(0, np.uint32) for p in plans]


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per row of ``docs``: number of ids, digests of the ids and of the text decoded from them.

    A null text counts as empty: no ids, digests of nothing.  Null ids and
    repeated rows pass through.  No shuffle; a worker's tables of pieces and
    chunk bodies are bounded by ``MAX_PIECES`` and ``MAX_CHUNK_BYTES``.
    """
    path = vocabulary or default_vocabulary()

    def run(frames):
        c = codec(path)
        chunks = ChunkEncoder(c)
        for f in frames:
            rows = []
            for ids in chunks.encode_many(f["text"].tolist()):
                back = c.decode(ids)
                rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
            got = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            got.insert(0, "doc_id", f["doc_id"].astype("Int64"))
            yield got

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInPandas(tidied(run), RESULT)


def encode_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids themselves, as an array; nulls as in ``encode_digests``."""
    path = vocabulary or default_vocabulary()

    def run(frames):
        chunks = ChunkEncoder(codec(path))
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"),
                                "ids": [x.astype(np.int32) for x in chunks.encode_many(f["text"].tolist())]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInPandas(tidied(run), "doc_id long, ids array<int>")


@query("op4_bpe_round_trip")
def op4(spark, sf_dir):
    return encode_digests(table(spark, sf_dir, "documents"))
