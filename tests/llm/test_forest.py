import math

import numpy as np
import pytest

from termflow.llm.forest import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, key string, n long"


def vectors(n=400, seed=0):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n // 8, 16))
    x = base[r.integers(0, len(base), n)] + r.normal(size=(n, 16)) * r.choice([0.05, 0.3, 1.0], n)[:, None]
    rows = [(i, [float(v) for v in x[i]], int(i % 3), "k", 1) for i in range(n)]
    rows += [(1000, rows[0][1], 0, "k", 1), (1001, rows[0][1], 1, "k", 1), (1002, [0.0] * 16, 0, "", 0), (1003, None, 0, "", 0), (1004, [math.nan] + [1.0] * 15, 0, "", 0),
             (1005, [None] + [1.0] * 15, 0, "", 0), (1006, rows[0][1], None, "", 0), (1007, rows[0][1], None, "", 0), (1008, [1.0, 2.0], 0, "", 0), (1009, [1.0, 2.0], 0, "", 0),
             (1010, [math.inf] * 16, 0, "", 0), (1011, [], 0, "", 0)]
    return rows


def brute(rows):
    ok = [(i, np.array([np.nan if c is None else c for c in v], np.float32).astype(float)) if v and label is not None else (i, None) for i, v, label, *_ in rows]
    ok = [(i, v if v is not None and np.isfinite(v).all() and v.any() else None) for i, v in ok]
    n, up = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    pairs = set()
    for a in range(len(rows)):
        for b in range(a):
            x, y = ok[a][1], ok[b][1]
            if x is not None and y is not None and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                n[a] += 1
                n[b] += 1
                pairs.add((a, b))
                up[find(a)] = find(b)
    return [(rows[a][0], n[a], min(rows[k][0] for k in range(len(rows)) if find(k) == find(a))) for a in range(len(rows))]


@pytest.mark.parametrize("leaf,block", [(16, 256), (64, 8)])
def test_against_brute_force(llm, leaf, block):
    rows = vectors()
    got = {r.vec_id: r for r in near_vectors(llm.createDataFrame(rows, SCHEMA), leaf=leaf, block=block, sample=200).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    found, links = sum(r.n_links for r in got.values()), sum(n for _, n, _ in want)
    assert 0.95 * links <= found <= links
    assert all(got[i].n_links <= n for i, n, _ in want)
    assert sum(got[i].component_id != c for i, _, c in want) <= 0.05 * len(want)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (1002, 1003, 1004, 1005, 1006, 1007, 1010, 1011))
    assert got[1009].component_id == 1008 and not got[1009].kept


def test_edges(llm):
    assert near_vectors(llm.createDataFrame([], SCHEMA)).count() == 0
    v = [1.0, 0.0]
    rows = [(1, v, 1, "", 0), (1, v, 1, "", 0), (None, v, 1, "", 0)]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_vectors(llm.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True)]
