"""Histogram boosting against a plain numpy fit that tries every cut of every node."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tablelab.models import boosting, registry, search
from tablelab.models.boosting import HistBoost, derivatives, first_scores


def rows_of(n, classes, missing=True):
    draw = np.random.default_rng(classes)
    x = np.round(draw.normal(size=(n, 3)), 1)
    score = x[:, 0] * 2 - x[:, 1] * x[:, 2] + draw.normal(size=n) * 0.3
    if missing:
        x[draw.random((n, 3)) < 0.1] = np.nan
    y = np.round(score, 2) if classes == 0 else np.digitize(score, np.quantile(score, np.arange(1, classes) / classes)).astype(float)
    return x, y, draw.integers(1, 4, n).astype(float)


def table(spark, x, y, w):
    rows = [(i, [float(v) for v in r], float(a), float(b)) for i, (r, a, b) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, "id int, x array<double>, label double, w double").withColumn("features", array_to_vector("x"))


def split_of(x, g, h, l2, least):
    """(gain, feature, threshold, missing to the left), the first of the best in order of side of the missing, feature and cut."""
    best = (1e-9, None)
    for left_missing in (False, True):
        for f in range(x.shape[1]):
            for cut in np.unique(x[~np.isnan(x[:, f]), f])[:-1]:
                left = np.where(np.isnan(x[:, f]), left_missing, x[:, f] <= cut)
                if min(left.sum(), (~left).sum()) < least:
                    continue
                part = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)
                gain = part(left) + part(~left) - part(np.ones(len(x), bool))
                if gain > best[0] + 1e-7:
                    best = (gain, (f, cut, left_missing))
    return best


def plain_fit(x, y, w, problem, classes, rounds, depth, rate, l2, leaves=None, symmetric=False):
    """Scores of the training rows."""
    scores = np.repeat(first_scores(y, w, problem, classes)[:, None], len(y), axis=1)
    for _ in range(rounds):
        g, h = derivatives(y, w, scores, problem)
        for k in range(len(scores)):
            nodes, splits = [(np.arange(len(y)), 0)], 0
            final = []
            if symmetric:
                for _ in range(depth):
                    best = (1e-9, None)
                    for left_missing in (False, True):
                        for f in range(x.shape[1]):
                            for cut in np.unique(x[~np.isnan(x[:, f]), f])[:-1]:
                                total, able = 0.0, False
                                for at, _ in nodes:
                                    left = np.where(np.isnan(x[at, f]), left_missing, x[at, f] <= cut)
                                    if left.any() and not left.all():
                                        part = lambda m: g[k, at[m]].sum() ** 2 / (h[k, at[m]].sum() + l2)  # noqa: B023, E731
                                        total, able = total + part(left) + part(~left) - part(np.ones(len(at), bool)), True
                                if able and total > best[0] + 1e-7:
                                    best = (total, (f, cut, left_missing))
                    if best[1] is None:
                        break
                    f, cut, left_missing = best[1]
                    side = lambda at: np.where(np.isnan(x[at, f]), left_missing, x[at, f] <= cut)  # noqa: B023, E731
                    nodes = [(at[m], 0) for at, _ in nodes for m in (side(at), ~side(at))]
                final = nodes
            else:
                found = [(split_of(x[at], g[k, at], h[k, at], l2, 1), at, d) for at, d in nodes]
                while found:
                    (gain, cut), at, d = found.pop(int(np.argmax([f[0][0] if f[0][1] and f[2] < depth else 0 for f in found])))
                    if cut is None or d >= depth or (leaves and splits >= leaves - 1):
                        final.append((at, d))
                        continue
                    splits += 1
                    left = np.where(np.isnan(x[at, cut[0]]), cut[2], x[at, cut[0]] <= cut[1])
                    found += [(split_of(x[s], g[k, s], h[k, s], l2, 1), s, d + 1) for s in (at[left], at[~left])]
            for at, _ in final:
                if len(at):
                    scores[k, at] -= rate * g[k, at].sum() / (h[k, at].sum() + l2)
    return scores


@pytest.mark.parametrize("classes, growth, depth, leaves", [(0, "level", 3, None), (2, "level", 3, None), (3, "level", 2, None), (0, "leaf", 6, 5), (2, "symmetric", 3, None)])
def test_same_as_plain_numpy(spark, classes, growth, depth, leaves):
    x, y, w = rows_of(90, classes)
    problem = "classification" if classes else "regression"
    model = HistBoost(problem=problem, weightCol="w", maxIter=3, stepSize=0.3, maxDepth=depth, maxLeaves=leaves or 31, l2=1.0, growth=growth).fit(table(spark, x, y, w))
    want = plain_fit(x, y, w, problem, classes, 3, depth, 0.3, 1.0, leaves, growth == "symmetric")
    assert np.allclose(model.scores(x).T, want, atol=1e-6)
    for tree in model.state["rounds"][0]:
        assert growth != "leaf" or sum(f < 0 for f in tree["feature"]) <= leaves


def test_probabilities_importance_and_saved_model(spark, tmp_path):
    x, y, w = rows_of(120, 3)
    df = table(spark, x, y, w)
    model = HistBoost(maxIter=12, stepSize=0.3, maxDepth=3, subsamplingRate=0.8).fit(df)  # more rounds than are kept open
    out = model.transform(df).select("id", "label", "prediction", vector_to_array("probability").alias("p")).collect()
    assert np.mean([r.label == r.prediction for r in out]) > 0.9
    assert all(abs(sum(r.p) - 1) < 1e-9 and r.prediction == float(np.argmax(r.p)) for r in out)
    assert abs(model.featureImportances.toArray().sum() - 1) < 1e-9
    model.write().overwrite().save(str(tmp_path / "m"))
    again = boosting.BoostModel.load(str(tmp_path / "m"))
    assert np.allclose(again.scores(x), model.scores(x))


def test_blocks_and_tasks_do_not_matter(spark):
    x, y, w = rows_of(200, 2)
    df = table(spark, x, y, w)
    fit = lambda d: HistBoost(maxIter=10, maxDepth=3).fit(d).scores(x)
    assert np.allclose(fit(df.coalesce(1)), fit(df.repartition(7)), atol=1e-9)


def test_odd_tables(spark):
    one = table(spark, np.array([[1.0, np.nan]] * 5), np.full(5, 2.0), np.ones(5))
    assert HistBoost(problem="regression").fit(one).scores(np.array([[1.0, 2.0]])).tolist() == [[2.0]]
    with pytest.raises(ValueError, match="no rows"):
        HistBoost(problem="regression").fit(one.filter("id < 0"))


@pytest.mark.parametrize("name", ["HistGradientBoosting", "XGBoost", "LightGBM", "CatBoost"])
def test_families_learn_alternating_classes(spark, name):
    """Held-out rows of a checkerboard, where a constant is right for half of them."""
    draw = np.random.default_rng(1)
    x = draw.random((900, 2)) * 4
    y = (np.floor(x).sum(1) % 2).astype(float)
    df = table(spark, x, y, np.ones(900))
    c = registry.candidates("classification", 1, 900, names=[name])[0]
    out = c.pipeline({"maxIter": 20, "stepSize": 0.3}).fit(df.filter("id < 600")).transform(df.filter("id >= 600"))
    assert out.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0] > 0.85


def test_sums_of_one_task_are_not_shuffled(spark, monkeypatch):
    """a level of a tree is one job of one stage where the blocks are read by one task."""
    n = 60
    df = spark.range(n, numPartitions=1).select(array_to_vector(F.array(F.col("id").cast("double"), (F.col("id") % 7).cast("double"))).alias("features"), (F.col("id") % 3).cast("double").alias("label"))
    kind, plans = type(df), []
    real = kind.toPandas
    monkeypatch.setattr(kind, "toPandas", lambda self: plans.append(self._jdf.queryExecution().toString()) or real(self))
    HistBoost(problem="regression", maxIter=2, maxDepth=2).fit(df)
    assert plans and not any("Exchange" in p for p in plans)


def test_a_grid_on_few_rows_is_grown_at_once(spark, monkeypatch):
    """one job grows all models of a fold, in place of one for each level of each tree of each model."""
    x, y, w = rows_of(150, 2)
    df = table(spark, x, y, w).withColumn("fold", (F.col("id") % 2).cast("int")).coalesce(1).cache()
    kind, calls = type(df), []
    real = kind.toPandas
    monkeypatch.setattr(kind, "toPandas", lambda self: calls.append(1) or real(self))
    c = registry.Candidate("XGBoost", "classification", registry.classification_builders(2, 150, ["id"])["XGBoost"], {"maxIter": [4, 7], "maxDepth": [2, 3], "subsamplingRate": [0.8, 1.0]})
    found = search.search(c, df, 2, 2)
    assert len(calls) == 2
    each = [np.mean(search.fold_scores(c, p, df, 2)) for p in c.combinations()]
    assert found.mean == max(each) and found.params == c.combinations()[int(np.argmax(each))]


@pytest.mark.parametrize("classes, share", [(0, 0.7), (2, 1.0), (3, 0.7)])
def test_passes_and_tasks_grow_the_same_trees(spark, monkeypatch, classes, share):
    """models grown in a task are those of a pass for each level, and shorter models begin longer ones."""
    x, y, w = rows_of(160, classes)
    df = table(spark, x, y, w).coalesce(1)
    made = [HistBoost(problem="classification" if classes else "regression", weightCol="w", maxIter=n, maxDepth=3, growth=g, subsamplingRate=share) for n in (10, 3) for g in ("level", "leaf", "symmetric")]
    at_once = [m.state for m in boosting.fit_all(made, df)]
    monkeypatch.setattr(boosting, "PASS_ROWS", 0)
    assert [len(s["rounds"]) for s in at_once] == [10] * 3 + [3] * 3
    for e, s, p in zip(made, at_once, boosting.fit_all(made, df)):
        for a, b in zip(s["rounds"], p.state["rounds"], strict=True):
            for t, u in zip(a, b, strict=True):
                assert all(np.allclose(t[k], u[k], atol=1e-9) for k in boosting.TREE)
    alone = made[3].fit(df).state["rounds"]
    assert all(np.allclose(t["value"], u["value"], atol=1e-9) for a, b in zip(at_once[3]["rounds"], alone, strict=True) for t, u in zip(a, b, strict=True))
