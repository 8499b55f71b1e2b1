"""Fits from cross-moments against least squares on the rows themselves."""

import numpy as np
import pytest

from tracklens.operators import gram


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(7)
    x = r.normal(size=(300, 4)) * [1, 50, 0.01, 1] + [0, 1000, 0, 3]
    y = 3 + x @ [2, 0.1, 40, 0] + r.normal(size=300)
    x[:, 3] = x[:, 0] * 2 - x[:, 1]  # explained by the columns before it
    gaps = r.random((300, 4)) < 0.05
    return [(f"g{k % 7}", k % 3, *[None if g else float(v) for v, g in zip(a, b)], float(t)) for k, (a, b, t) in enumerate(zip(x, gaps, y))]


COLS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "who string, fold int, a double, b double, c double, d double, y double").repartition(4)


def by_hand(rows, subset, need, alpha=0.0, without=None):
    own = [r for r in rows if all(r[2 + COLS.index(c)] is not None for c in need) and r[1] != without]
    x = np.array([[r[2 + COLS.index(c)] for c in subset] for r in own])
    y = np.array([r[-1] for r in own])
    m, s = x.mean(0), x.std(0)
    z = (x - m) / s
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(len(subset)), z.T @ (y - y.mean())) / s
    return y.mean() - beta @ m, beta


@pytest.mark.parametrize("subset,need,alpha,without", [(["a", "b", "c"], ["a", "b", "c"], 0.0, None), (["a", "c"], ["a", "b", "c"], 10.0, None), (["b", "c"], ["b", "c"], 0.5, 1)])
def test_fits(frame, rows, subset, need, alpha, without):
    sets = [["a", "b", "c"], ["b", "c"]]
    fit = gram.Moments(frame, COLS, "y", sets, "fold").fit(subset, need, alpha, without)
    intercept, beta = by_hand(rows, subset, need, alpha, without)
    assert fit.intercept == pytest.approx(intercept, rel=1e-6)
    assert [fit.beta[c] for c in subset] == pytest.approx(beta.tolist(), rel=1e-6)


def test_explained_columns_and_scores(frame, rows):
    m = gram.Moments(frame, COLS, "y", [COLS])
    fits = {"whole": m.fit(COLS), "plain": m.fit(["a", "b", "c"], COLS), "mean": m.fit([], COLS)}
    assert fits["whole"].beta["d"] == 0.0
    got = gram.errors(frame, "y", fits, group="who")
    own = [r for r in rows if None not in r]
    y = np.array([r[-1] for r in own])
    assert got["mean"]["n"] == len(own) and got["mean"]["mae"] == pytest.approx(np.abs(y - y.mean()).mean()) and abs(got["mean"]["r2"]) < 1e-9
    assert got["whole"]["mae"] == pytest.approx(got["plain"]["mae"])
    beta = fits["whole"].beta
    e = y - fits["whole"].intercept - np.array([sum(beta[c] * r[2 + k] for k, c in enumerate(COLS)) for r in own])
    within = sum(((g := y[[r[0] == w for r in own]]) - g.mean()) @ (g - g.mean()) for w in {r[0] for r in own})
    assert got["whole"]["cr2"] == pytest.approx(1 - e @ e / within)


def test_no_rows(frame):
    m = gram.Moments(frame.filter("false"), COLS, "y", [COLS])
    assert m.fit(COLS).beta == {}
    assert gram.errors(frame.filter("false"), "y", {"x": m.fit(COLS)}, group="who")["x"] == {"n": 0, "mae": None, "rmse": None, "r2": None, "cr2": None}
