import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from termflow.llm import shards, tokens

TEXTS = ["  a  b \n c<|endoftext|> x <|endoftext|>\n  y", "", None, "  x  y", " lead", "trail ", "a\x1c b'll 's  'x é" * 40, "a" * 5000, " " * 3000 + "x",
         "\n \n \t x" * 500, "Ouré, que. The word's end… 日本語 テスト １２   x\u0085 y", "the same passage of words again and again. " * 60, "the same passage of words again and again. " * 60]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(tokens.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(t, text):
    return np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_round_trip_against_the_library(make_docs, reference):
    got = {r.doc_id: r for r in tokens.encode_digests(make_docs([*enumerate(TEXTS), (None, "x"), (None, "x")])).collect() if r.doc_id is not None}
    for i, t in enumerate(TEXTS):
        ids = ids_of(reference, t)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest(), t
        assert got[i].decoded_sha256 == hashlib.sha256(reference.decode(ids.tolist(), skip_special_tokens=False).encode()).hexdigest()
    assert tokens.encode_digests(make_docs([])).count() == 0
    assert [list(r.ids) for r in tokens.encode_ids(make_docs([(1, "a b")])).collect()] == [ids_of(reference, "a b").tolist()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab'slé.,!1 　日<|>endoftx", max_size=80), max_size=6))
def test_any_texts(texts):
    c = tokens.codec(tokens.default_vocabulary())
    want = [np.array(c.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
    for got in (c.encode_many(texts), tokens.ChunkEncoder(c, bits=2).encode_many(texts)):
        assert all(np.array_equal(a, b) for a, b in zip(got, want))
    assert [c.decode(w) for w in want] == [c.tokenizer.decode(w.tolist(), skip_special_tokens=False) for w in want]


def test_chunks_are_shared():
    c = tokens.codec(tokens.default_vocabulary())
    e = tokens.ChunkEncoder(c)
    passage = " ".join(f"word{i} and" for i in range(3000))
    e.encode_many(["first start " + passage, "another longer beginning of it " + passage])
    assert e.reused > 20


def test_bounded_tables(monkeypatch):
    c = tokens.Codec(tokens.default_vocabulary())
    monkeypatch.setattr(tokens, "MAX_PIECES", 50)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 300)
    texts = [" ".join(f"x{i * k}y" for i in range(40)) for k in range(30)]
    for got, t in zip(c.encode_many(texts), texts):
        assert np.array_equal(got, ids_of(c.tokenizer, t))


def test_pieces_met_again_are_kept(monkeypatch):
    """Rare pieces make room, common ones are encoded once; signs are cut off words."""
    c = tokens.Codec(tokens.default_vocabulary())
    monkeypatch.setattr(tokens, "MAX_PIECES", 120)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 300)
    asked, plain = [], c._word
    monkeypatch.setattr(c, "_word", lambda piece: asked.append(piece) or plain(piece))
    texts = ["the common (words) of all-texts*** it's " + " ".join(f"rare{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}{i}" for i in range(40)) for k in range(30)]
    for got, t in zip(c.encode_many(texts), texts):
        assert np.array_equal(got, ids_of(c.tokenizer, t))
    common = [x if isinstance(x, bytes) else x.encode() for x in asked]
    assert common.count(b" common") == common.count(b" of") == common.count(b"words") == common.count(b"***") == 1
    assert len(c.known) <= 240


@pytest.mark.parametrize("bits", [False, True])
def test_files(make_docs, reference, bits):
    rows = [(i * 3 % 41, TEXTS[i % len(TEXTS)]) for i in range(41)] + [(50, "tie"), (50, "tie"), (None, "none")]
    files = shards.write_files(make_docs(rows), file_ids=500, block=64, bits=bits)
    got = shards.read_files(files).collect()
    want, start = [], 0
    for doc, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.r_[ids_of(reference, t), np.uint32(0)].astype("<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert files.count() > 1
    assert shards.read_files(shards.write_files(make_docs([]))).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_image_random_access(bits):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 1 << 32, 1000, np.uint64).astype("<u4")
    im = shards.Image(shards.write_image([1, None], [400, 600], ids, block=128, bits=bits))
    assert np.array_equal(im.ids(100, 333), ids[100:433]) and len(im.ids(5, 0)) == 0
    assert [(d, s, len(x)) for d, s, x in im.documents()] == [(1, 0, 400), (None, 400, 600)]
    with pytest.raises(ValueError):
        shards.Image(b"x" * 64)
