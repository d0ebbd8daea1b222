import random

import numpy as np
import pytest

from termflow.llm import near_dedup as N


def sets_of(text, width):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(ws[i:i + width]) for i in range(len(ws) - width + 1)) if len(ws) >= width else frozenset([tuple(ws)] if ws else [])


def brute(rows, width):
    """component of every row: rows of equal ids are one document"""
    s = [(i, sets_of(t, width)) for i, t in rows]
    up = list(range(len(s)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(s)):
        for b in range(a):
            x, y = s[a][1], s[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[find(a)] = find(b)
    return [min(s[k][0] for k in range(len(s)) if find(k) == find(a)) for a in range(len(s))]


def near_rows(n=60, copies=40, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(1, 90))] for _ in range(n)]
    rows = [" ".join(b) for b in base]
    hot = [r.choice(vocabulary) for _ in range(80)]
    for _ in range(copies):
        c = list(hot)
        for _ in range(r.randint(0, 6)):
            c[r.randrange(len(c))] = r.choice(vocabulary)
        rows.append(" ".join(c))
    rows += rows[:5] + [rows[0].upper(), None, "", " \n", "one", "ONE", "a b c d e f"]
    return list(enumerate(rows))


@pytest.mark.parametrize("width,block", [(4, 256), (5, 8)])
def test_against_brute_force(make_docs, width, block):
    rows = near_rows()
    got = {r.doc_id: r for r in N.near_groups(make_docs(rows), width=width, block=block).collect()}
    assert len(got) == len(rows)
    for (i, t), c in zip(rows, brute(rows, width)):
        assert got[i].component_id == c and got[i].kept == (i == c) and got[i].n_shingles == len(sets_of(t, width)), i


def test_edges(make_docs):
    assert N.near_groups(make_docs([])).count() == 0
    got = [tuple(r) for r in N.near_groups(make_docs([(3, "a b"), (3, "a b"), (None, "a b"), (5, None), (None, None)])).collect()]
    assert sorted(got, key=str) == sorted([(3, 1, 3, True), (3, 1, 3, True), (None, 1, 3, False), (5, 0, 5, True), (None, 0, None, True)], key=str)


def test_likelihood_follows_similarity():
    r = np.random.default_rng(2)
    for j in (0.2, 0.45, 0.8, 0.95):
        common = int(2000 * j)
        rest = (2000 - common) // 2
        right = 0
        for _ in range(40):
            x = r.integers(0, 1 << 63, common + 2 * rest, np.uint64)
            a, b = N.registers(np.unique(x[:common + rest])), N.registers(np.unique(np.r_[x[:common], x[common + rest:]]))
            n = np.array([common + rest])
            right += bool(N.rising(np.array([(a > b).sum()]), np.array([(a < b).sum()]), n, n)[0]) == (j > 0.6)
        assert right >= 39, (j, right)


def test_registers_merge():
    r = np.random.default_rng(4)
    x, y = r.integers(0, 1 << 63, 500, np.uint64), r.integers(0, 1 << 63, 700, np.uint64)
    assert np.array_equal(np.maximum(N.registers(x), N.registers(y)), N.registers(np.r_[x, y]))
