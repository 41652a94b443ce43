"""Exact Shapley values of trees against all subsets of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.functions import array_to_vector, vector_to_array

from tablelab.models import boosting, custom, explain


def worth(tree, row, known, at=0):
    """Score of a row of which only some features are known."""
    f = tree["feature"][at]
    if f < 0:
        return tree["value"][at]
    left, right = tree["left"][at], tree["right"][at]
    if f in known:
        goes = tree["missing_left"][at] if np.isnan(row[f]) else row[f] <= tree["threshold"][at]
        return worth(tree, row, known, left if goes else right)
    return sum(worth(tree, row, known, c) * tree["cover"][c] for c in (left, right)) / tree["cover"][at]


def all_subsets(trees, row):
    d = len(row)
    value = {s: sum(w * worth(t, row, s) for w, t in trees) for r in range(d + 1) for s in combinations(range(d), r)}
    out = np.zeros(d)
    for i in range(d):
        for s in value:
            if i not in s:
                out[i] += factorial(len(s)) * factorial(d - len(s) - 1) / factorial(d) * (value[tuple(sorted((*s, i)))] - value[s])
    return out


@pytest.fixture(scope="module")
def data(spark):
    draw = np.random.default_rng(0)
    x = np.round(draw.normal(size=(150, 8)), 1)
    score = x[:, 0] * x[:, 1] + x[:, 2] + 0.5 * x[:, 3] * (x[:, 4] > 0)
    rows = [(i, [float(v) for v in r], float(s), float(s > 0)) for i, (r, s) in enumerate(zip(x, score))]
    return x, spark.createDataFrame(rows, "id int, x array<double>, label double, side double").withColumn("features", array_to_vector("x"))


NAMES = [f"f{i}" for i in range(8)]


@pytest.mark.parametrize("name", ["boosted", "boosted classes", "forest", "forest classes", "spark boosted", "votes", "tree"])
def test_same_as_all_subsets_and_sums_to_the_score(data, name):
    x, df = data
    classes = {"labelCol": "side"} if name in ("boosted classes", "forest classes", "votes") else {}
    model = {
        "boosted": lambda: boosting.HistBoost(problem="regression", maxIter=4, maxDepth=4), "boosted classes": lambda: boosting.HistBoost(maxIter=3, maxDepth=3),
        "forest": lambda: R.RandomForestRegressor(numTrees=3, maxDepth=4, seed=1), "forest classes": lambda: C.RandomForestClassifier(numTrees=3, maxDepth=4, seed=1),
        "spark boosted": lambda: R.GBTRegressor(maxIter=3, maxDepth=3, seed=1), "votes": lambda: custom.Bagging(rounds=3, maxDepth=3), "tree": lambda: R.DecisionTreeRegressor(maxDepth=5),
    }[name]()
    model._set(**classes)
    fitted = model.fit(df)
    got = {}
    for r in explain.tree_shapley(fitted, df, NAMES, ["id"]).collect():
        got.setdefault(r["id"], np.zeros(8))[NAMES.index(r["feature"])] = r["shapley"]
    trees, _ = explain.trees_of(fitted)
    assert len(got) == len(x)
    for i in range(0, 150, 30):
        assert np.allclose(got[i], all_subsets(trees, x[i]), atol=1e-9)
    out = fitted.transform(df)
    if name == "boosted classes":
        scores = dict(enumerate(fitted.scores(x)[:, 0]))
    elif name == "forest classes":
        scores = {r["id"]: r["p"][1] for r in out.select("id", vector_to_array("probability").alias("p")).collect()}
    elif name == "votes":
        scores = {r["id"]: r["probability_array"][1] for r in out.select("id", "probability_array").collect()}
    else:
        scores = {r["id"]: r["prediction"] for r in out.select("id", "prediction").collect()}
    base = explain.expected_score(fitted)
    assert all(abs(got[i].sum() + base - scores[i]) < 1e-6 for i in got)


def test_missing_values(spark):
    x = np.array([[np.nan, 1.0], [1.0, np.nan], [2.0, 2.0], [3.0, 1.0], [np.nan, 2.0], [2.0, 1.0]] * 5)
    rows = [(i, [float(v) for v in r], float(np.nansum(r))) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, x array<double>, label double").withColumn("features", array_to_vector("x"))
    fitted = boosting.HistBoost(problem="regression", maxIter=3, maxDepth=3).fit(df)
    trees, _ = explain.trees_of(fitted)
    got = {(r["id"], r["feature"]): r["shapley"] for r in explain.tree_shapley(fitted, df, ["a", "b"], ["id"]).collect()}
    for i in range(6):
        assert np.allclose([got[i, "a"], got[i, "b"]], all_subsets(trees, x[i]))
