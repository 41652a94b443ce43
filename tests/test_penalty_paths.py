"""Penalty paths from fold products against fits on the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler

from tablelab.models import penalty_paths as P
from tablelab.models import registry, search
from tablelab.operators import selection

GRIDS = {"LinearRegression": {}, "Ridge": {"alpha": [0.1, 10.0, 100.0]}, "Lasso": {"regParam": [0.01, 0.3]}, "ElasticNet": {"regParam": [0.1], "elasticNetParam": [0.3, 0.9]}}


@pytest.fixture(scope="module")
def data(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(240, 5)) * [1, 10, 0.1, 1, 0] + [0, 50, 1, -3, 7]
    x[:, 3] = x[:, 0] + 0.1 * draw.normal(size=240)
    y = 3 * x[:, 0] - 0.2 * x[:, 1] + 5 * x[:, 2] + draw.normal(size=240) + 100
    pdf = pd.DataFrame(x, columns=list("abcde")).assign(label=y, fold=np.arange(240) % 3)
    return pdf, spark.createDataFrame(pdf)


def test_held_out_scores_and_optimum(data):
    pdf, df = data
    found = P.paths(df, list("abcde"), "label", "fold", GRIDS)
    assert len(found) == 1 + 3 + 2 + 2
    x, y, fold = pdf[list("abcde")].to_numpy(), pdf["label"].to_numpy(), pdf["fold"].to_numpy()
    for r in found:
        for i, score in enumerate(r["scores"]):
            train, held = fold != i, fold == i
            l1, l2 = P.penalties(r["model"], r["params"], train.sum())
            xt, yt = x[train], y[train]
            fit = P.solve((len(yt), np.append(xt.sum(0), yt.sum()), np.c_[xt, yt].T @ np.c_[xt, yt]), l1, l2)
            assert fit.converged
            # The optimum: no coefficient can be moved for the better.
            sd = xt.std(0, ddof=1)
            z = np.where(sd > 0, (xt - xt.mean(0)) / np.where(sd > 0, sd, 1), 0)
            w = fit.weights * sd
            g = z.T @ (yt - yt.mean() - z @ w) / len(yt) - l2 * w
            assert (np.abs(g[np.abs(w) < 1e-9]) <= l1 + 1e-6).all() and np.allclose(g[np.abs(w) >= 1e-9], l1 * np.sign(w[np.abs(w) >= 1e-9]), atol=1e-6)
            e = y[held] - fit.intercept - x[held] @ fit.weights
            assert score == pytest.approx(1 - (e @ e) / ((y[held] - y[held].mean()) ** 2).sum(), abs=1e-8)


def test_one_read(data, monkeypatch):
    _, df = data
    calls, sums = [], P.class_moments
    monkeypatch.setattr(P, "class_moments", lambda *a: calls.append(1) or sums(*a))
    P.paths(df, list("abcde"), "label", "fold", GRIDS)
    assert calls == [1]


def test_mutual_information_as_fallback(spark):
    """A square has no correlation with its root, but all the information."""
    rows = [(float(i % 21 - 10), float((i * 7) % 13), float((i % 21 - 10) ** 2)) for i in range(21 * 13)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    found = selection.mutual_information(df, ["a", "b"], "y", "regression")
    x, y = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    cut = lambda v: np.minimum(np.floor((v - v.min()) / (v.max() - v.min()) * 32), 31)
    joint = pd.crosstab(cut(x), cut(y)).to_numpy() / len(x)
    outer = joint.sum(1, keepdims=True) * joint.sum(0)
    assert found["a"] == pytest.approx((joint[joint > 0] * np.log(joint[joint > 0] / outer[joint > 0])).sum())
    assert found["a"] > 1 > 1e-6 > found["b"]
    missing = spark.createDataFrame([(None, "x"), (1.0, "y"), (None, "x"), (float("nan"), "x"), (2.0, None)], "a double, c string")
    assert selection.mutual_information(missing, ["a"], "c")["a"] == pytest.approx(-(0.75 * np.log(0.75) + 0.25 * np.log(0.25)))
    one = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, 1.0)], "a double, b double, y double")
    assert selection.select_k_best(one, ["a", "b"], "y", "classification")[0] == ["a"]


def test_search_finds_the_same_as_fold_fits(data):
    _, df = data
    df = VectorAssembler(inputCols=list("abcde"), outputCol="features").transform(df)
    for name, grid in (("Ridge", GRIDS["Ridge"]), ("Lasso", GRIDS["Lasso"]), ("ElasticNet", GRIDS["ElasticNet"])):
        c = registry.candidates("regression", 1, 240, names=[name])[0]
        c.grid = grid
        best = search.search(c, df, 3)
        assert np.isclose(np.mean(search.fold_scores(c, best.params, df, 3)), best.mean, atol=1e-6)
