import numpy as np
import pytest

from termflow.llm import whiten as wh


def brute(rows, k=4):
    """(id, component) -> values from numpy's own eigenvalues."""
    keep = [(i, [int(np.floor(256 * np.float64(np.float32(c)))) for c in v]) for i, v in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    lengths = [len(x) for _, x in keep]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n))
    keep = [(i, x) for i, x in keep if len(x) == d]
    fit = np.array(sorted({tuple(x) for _, x in keep}), float)
    n, total = len(fit), fit.sum(axis=0)
    v = np.cov(fit.T, bias=True).reshape(d, d)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, total, e, e / np.trace(v), keep, fit, u


def table_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, component string, whitened double")


def test_equals_numpy(llm):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 6)) * [5, 3, 2, 1, .5, .2]
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + k, rows[7][1]) for k in range(50)] + [(2000, None), (2001, [1.0, None, 2, 3, 4, 5]), (2002, [float("nan")] * 6), (2003, [1.0, 2, 3, 4, 5, float("-inf")]),
             (2004, [1.0, 2.0]), (2005, []), (None, rows[9][1]), (None, rows[9][1])]
    n, total, e, share, keep, fit, u = brute(rows)
    got = wh.whiten(table_of(llm, rows)).toPandas()
    assert len(got) == 4 * len(keep) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].iat[0] < 1e-9
    at = got[got.vec_id.notna()].set_index(["vec_id", "component"])
    for i, x in keep:
        if i is None:
            continue
        dev = sum((n * a - int(s)) ** 2 for a, s in zip(x, total))
        z = (np.array(x) - total / n) @ u / np.sqrt(e)
        for c in range(4):
            r = at.loc[(i, c + 1)]
            assert r["deviation"] == dev and abs(r["whitened"]) == pytest.approx(abs(z[c]), abs=1e-8) and r["explained"] == pytest.approx(share[c], rel=1e-9)
    for c in range(4):  # one sign for all rows
        signs = {np.sign(at.loc[(i, c + 1), "whitened"] * ((np.array(x) - total / n) @ u[:, c])) for i, x in keep if i is not None}
        assert len(signs) == 1


@pytest.mark.parametrize("matrix", [np.eye(5), np.diag([3., 3, 3, 1, 0]), np.kron(np.eye(3), [[2., 1], [1, 2]]), np.array([[4.]]), np.array([[2., 1], [1, 2]]) * 1e-9,
                                    np.diag([1.0, 1.0 + 1e-13, 1 - 1e-13, .5, .5, .1]), np.ones((9, 9)), -np.eye(3)])
def test_eigenpairs(matrix):
    values, vectors = wh.leading_pairs(matrix, 4)
    want = np.linalg.eigvalsh(matrix)[::-1][:4]
    scale = np.abs(matrix).max() * len(matrix)
    assert np.abs(values - want).max() <= 1e-14 * scale
    assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-12
    assert np.abs(matrix @ vectors.T - vectors.T * values).max() <= 1e-12 * scale


def test_eigenpairs_of_random_and_rank_deficient():
    rng = np.random.default_rng(0)
    for n, rank in ((64, 64), (64, 3), (130, 130), (17, 2)):
        m = rng.standard_normal((n, rank))
        a = m @ m.T
        values, vectors = wh.leading_pairs(a, 4)
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:4]).max() < 1e-11 * np.abs(a).max() * n
        assert np.abs(a @ vectors.T - vectors.T * values).max() < 1e-10 * np.abs(a).max() * n
        diagonal, off, _ = wh.tridiagonal(a)
        for x in (values[0] * 1.1, values[0] * 0.99, 1e-3):
            assert wh.sturm_count(diagonal, off, x) == (np.linalg.eigvalsh(a) < x).sum()


def test_edges(llm):
    assert wh.whiten(table_of(llm, [])).count() == 0
    assert wh.whiten(table_of(llm, [(1, None), (2, [float("inf")])])).count() == 0
    assert wh.whiten(table_of(llm, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no spread, no component
    two = wh.whiten(table_of(llm, [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0])])).toPandas()
    assert sorted(two["component"]) == [1, 1, 1] and set(np.round(two["whitened"].abs(), 12)) == {1.0} and set(two["n"]) == {2} and set(two["explained"].round(12)) == {1.0}
    wide = wh.whiten(table_of(llm, [(1, [float(np.finfo(np.float32).max) / 256]), (2, [0.0])])).toPandas()
    assert wide["deviation"].isna().all() and len(wide) == 2
    assert wh.deviation(np.array([[1 << 33], [0]]), 2, [1 << 33]) == [None, None]
    assert wh.deviation(np.array([[1 << 30], [0]]), 2, [1 << 30]) == [1 << 60, 1 << 60]
