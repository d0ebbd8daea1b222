import hashlib
import random

import numpy as np
import pytest

from termflow.llm import suffix as S


def brute(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        m = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k:k + length]
            if w in seen:
                m[k:k + length] = b"\1" * length
            seen.add(w)
        spans = sum(m[k] and (k == 0 or not m[k - 1]) for k in range(len(m)))
        out[i] = (i, len(b), sum(m), spans, hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest())
    return out


def text_rows(seed=0, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 9)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(3)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 40)))]
        for p in passages:
            if r.random() < 0.5:
                a = r.randint(0, 150)
                parts += [p[a:a + r.randint(60, 300)], " ".join(word() for _ in range(r.randint(0, 12)))]
        rows.append(" ".join(parts))
    rows += ["ab" * 300, "x" * 99, "x" * 100, "x" * 101, "Again, " * 90, None, "", rows[0], rows[1], "tail " + rows[2]]
    return list(enumerate(rows))


@pytest.mark.parametrize("split", [S.SPLIT_PIECES, 1])
def test_against_brute_force(make_docs, split):
    rows = text_rows()
    want = brute(rows, 100)
    assert sum(w[2] for w in want.values()) > 3000
    got = S.dedup_spans(make_docs(rows), split=split).collect()
    assert {r.doc_id: tuple(r) for r in got} == want and len(got) == len(rows)


def test_repeated_and_missing_ids(make_docs):
    r = random.Random(1)
    t = "".join(r.choice("abcdef") for _ in range(300))
    got = sorted((r.doc_id or 0, r.n_removed) for r in S.dedup_spans(make_docs([(None, t), (4, t), (4, t), (7, t + "!"), (4, "other")])).collect())
    assert got == [(0, 0), (4, 0), (4, 300), (4, 300), (7, 300)]
    assert S.dedup_spans(make_docs([])).count() == 0
    assert S.dedup_texts(make_docs([(1, t), (2, "é" + t + "z")])).where("doc_id = 2").first().text == "éz"


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(0)
    for _ in range(60):
        b = r.integers(97, 99, int(r.integers(1, 80))).astype(np.uint8)
        raw = b.tobytes()
        sa = S.suffix_array(b)
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        lcp = S.common_prefixes(b, sa)
        for k in range(1, len(sa)):
            x, y = raw[sa[k - 1]:], raw[sa[k]:]
            n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert lcp[k] == n


def test_merge_sorted():
    lists = [np.array(sorted(set(x)), "S3") for x in (["a", "b", "d"], ["b", "c"], ["a", "e"])]
    got = S.merge_sorted(lists)
    names = np.concatenate(lists)
    assert len(set(zip(names.tolist(), got.tolist()))) == 5 == len(set(got.tolist()))
