"""The block Newton solver against a plain numpy solve."""

import numpy as np
import pytest

from termflow.operators import newton


def solve(x, y, alpha, steps=50):
    known = ~np.isnan(y)
    x = np.hstack([np.ones((len(x), 1)), x])[known]
    y, w = y[known], np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + alpha * np.eye(len(w)), x.T @ (p - y) / len(x) + alpha * w)
    return w


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 3))
    y = (x @ rng.standard_normal((3, 7)) + rng.standard_normal((400, 7)) > 0.5).astype(float)
    y[rng.random(y.shape) < 0.3] = np.nan
    y[:, 6] = np.where(np.isnan(y[:, 6]), np.nan, 1.0)  # a label without negatives stays finite by the penalty
    feats = spark.createDataFrame([(f"e{i}", v.tolist()) for i, v in enumerate(x)] + [("no vec", None)], "entry string, vec array<double>")
    cells = [(f"e{i}", f"t{k}", None if np.isnan(y[i, k]) else int(y[i, k])) for i in range(400) for k in range(7) if i % 5 or not np.isnan(y[i, k])]
    cells += [("e1", "t1", 0), ("stranger", "t0", 1), ("no vec", "t0", 1)]
    y[1, 1] = np.nanmax([y[1, 1], 0])
    return feats, spark.createDataFrame(cells, "entry string, label_id string, y int"), x, y


@pytest.mark.parametrize("labels", [128, 2])
def test_coefficients_equal_a_numpy_solve(case, monkeypatch, labels):
    feats, cells, x, y = case
    monkeypatch.setattr(newton, "BLOCK_LABELS", labels)
    monkeypatch.setattr(newton, "CHUNK_ROWS", 37)
    fitted = newton.fit_newton(feats, cells, alpha=0.01, max_iter=40, tol=1e-18)
    got = {r.label_id: r for r in fitted.collect()}
    assert sorted(got) == [f"t{k}" for k in range(7)] and all(r.done for r in got.values())
    for k in range(7):
        assert got[f"t{k}"].n == (~np.isnan(y[:, k])).sum()
        assert np.abs(np.array(got[f"t{k}"].w) - solve(x, y[:, k], 0.01)).max() < 1e-6
    probs = {(r.entry, r.label_id): r.prob for r in newton.score_newton(fitted, feats, score_bytes=70).collect()}
    assert len(probs) == 400 * 7
    w = np.array(got["t3"].w)
    assert probs["e17", "t3"] == pytest.approx(1 / (1 + np.exp(-(w[0] + x[17] @ w[1:]))))


def test_steps_rate_and_ragged_vectors(case, spark):
    feats, cells, x, y = case
    one = {r.label_id: r for r in newton.fit_newton(feats, cells, alpha=0.01, max_iter=1, lr=0.5).collect()}
    assert not any(r.done for r in one.values()) and all(r.steps == 1 for r in one.values())
    assert np.abs(np.array(one["t2"].w) - 0.5 * solve(x, y[:, 2], 0.01, steps=1)).max() < 1e-9
    with pytest.raises(ValueError):
        newton.fit_newton(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "entry int, vec array<double>"), cells)
    assert newton.fit_newton(feats, cells.limit(0)).count() == 0
