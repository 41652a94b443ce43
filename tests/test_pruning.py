"""Pruned trees against all subtrees."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler

from tablelab.models import explain, registry
from tablelab.models import pruning as P
from tablelab.models.custom import tree_arrays


@pytest.fixture(scope="module")
def data(spark):
    draw = np.random.default_rng(8)
    pdf = pd.DataFrame(draw.integers(0, 9, (400, 3)).astype(float), columns=list("abc"))
    pdf["label"] = ((pdf["a"] > 4) ^ (draw.uniform(size=400) < 0.2)).astype(float)
    pdf["number"] = 3 * pdf["a"] + draw.normal(size=400) * 4
    pdf["id"] = range(400)
    return pdf, VectorAssembler(inputCols=list("abc"), outputCol="features").transform(spark.createDataFrame(pdf))


def subtrees(tree, i=0):
    """Leaves of every subtree below a node."""
    yield (i,)
    if tree["feature"][i] >= 0:
        for left in subtrees(tree, tree["left"][i]):
            for right in subtrees(tree, tree["right"][i]):
                yield left + right


@pytest.mark.parametrize("problem", ["classification", "regression"])
def test_best_of_all_subtrees_and_path(data, problem):
    pdf, df = data
    label = "label" if problem == "classification" else "number"
    whole = P.PrunedTree(problem=problem, labelCol=label, maxDepth=3).grown(df)
    tree, risk = tree_arrays(whole), P.risks(whole)
    if problem == "regression":
        assert risk[0] == pytest.approx(pdf["number"].var(ddof=0))
    every = list(subtrees(tree))
    path = P.weakest_links(tree, risk)
    alphas = [a for a, _ in path]
    assert alphas == sorted(alphas) and path[-1][1][0]
    for alpha in [*alphas, *[(a + b) / 2 for a, b in zip(alphas, alphas[1:])], alphas[-1] + 1]:
        cut = P.collapsed(tree, risk, alpha)
        leaves = sorted(i for i in P.kept(tree, cut) if cut[i])
        cost = lambda s: sum(risk[i] for i in s) + alpha * len(s)
        least = min(cost(s) for s in every)
        best = min((s for s in every if cost(s) <= least + 1e-9 * risk[0]), key=len)
        assert leaves == sorted(best)
        link = [c for a, c in path if a <= alpha + 1e-12][-1]
        assert leaves == sorted(i for i in P.kept(tree, link) if link[i])


def test_held_out_errors_are_those_of_the_pruned_trees(data):
    pdf, df = data
    train, held = df.filter("id < 250"), df.filter("id >= 250")
    whole = P.PrunedTree(maxDepth=4).grown(train)
    table = P.pruning_path(held, whole).toPandas()
    assert len(table) > 2 and table["leaves"].is_monotonic_decreasing and table["leaves"].iloc[-1] == 1
    for r in table.itertuples():
        model = P.PrunedTree(maxDepth=4, alpha=r.alpha + 1e-9).fit(train)
        out = model.transform(held).toPandas()
        assert (np.array(model.state["tree"]["feature"]) < 0).sum() == r.leaves
        assert (out["label"] != out["prediction"]).mean() == pytest.approx(r.held_error)
        p = np.stack(out["probability_array"])
        assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == out["prediction"]).all()
    assert P.pruning_path(held.limit(0), whole).toPandas()["held_error"].isna().all()


def test_in_the_pool_explained_and_saved(data, tmp_path):
    _, df = data
    c = registry.candidates("classification", 1, 400, names=["DecisionTree"])[0]
    assert {p["alpha"] for p in c.combinations()} == {0.0, 0.001}
    model = c.pipeline({"maxDepth": 4, "alpha": 0.01}).fit(df)
    assert explain.importances(model, list("abc"))[0][0] == "a"
    values = explain.tree_shapley(model, df, list("abc"), ["id"]).groupBy("id").sum("shapley").toPandas()
    assert np.isfinite(values["sum(shapley)"]).all() and len(values) == 400
    last = model.stages[-1]
    last.write().save(f"{tmp_path}/tree")
    again = P.PrunedTreeModel.load(f"{tmp_path}/tree")
    assert last.transform(df).orderBy("id").toPandas()["prediction"].equals(again.transform(df).orderBy("id").toPandas()["prediction"])
