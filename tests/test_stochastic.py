"""Stochastic linear models against the conditions of their optimum and fits on the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler

from tablelab.models import registry
from tablelab.models import stochastic as S


@pytest.fixture(scope="module")
def data(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(300, 4))
    x[:, 3] = 2.0  # no variance
    score = 1.5 * x[:, 0] - x[:, 1] + 0.7 * draw.normal(size=300)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(
        two=(score > 0.8).astype(float), three=np.digitize(score, [-1, 1]).astype(float), number=10 * score + 5, weight=draw.uniform(0.2, 3, 300), id=np.arange(300))
    pdf.loc[:5, "number"] += 500  # outliers
    return pdf, VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(spark.createDataFrame(pdf)).repartition(3)


def optimum(pdf, label, model, loss, l1, l2, weight=None, epsilon=1.35):
    """Largest slope left at a model's weights, by a direct sum over the rows."""
    x = np.c_[pdf[list("abcd")].to_numpy(), np.ones(len(pdf))]
    m = pdf[weight].to_numpy() if weight else np.ones(len(pdf))
    w = np.c_[np.asarray(model.state["weights"]), np.asarray(model.state["intercepts"])]
    y, classes = pdf[label].to_numpy(), model.state["classes"]
    if classes is None:
        mean, sd = y.mean(), y.std()
        w = w / sd
        w[:, -1] -= mean / sd
        targets = ((y - mean) / sd)[:, None]
    else:
        targets = np.where(y[:, None] == np.array(classes)[None, :], 1.0, -1.0)
    z = x @ w.T
    if loss == "log_loss":
        g = -targets / (1 + np.exp(targets * z))
    elif loss == "modified_huber":
        g = np.where(targets * z >= 1, 0, np.where(targets * z >= -1, -2 * targets * (1 - targets * z), -4 * targets))
    else:
        g = z - targets if loss == "squaredError" else np.clip(z - targets, -epsilon, epsilon)
    g = (g * m[:, None]).T @ x / m.sum()
    return S.violation(w, g, l1, l2)


@pytest.mark.parametrize("loss", ["log_loss", "modified_huber"])
@pytest.mark.parametrize("label", ["two", "three"])
@pytest.mark.parametrize("share", [0.0, 1.0])
def test_classes_reach_the_optimum(data, loss, label, share):
    pdf, df = data
    model = S.Stochastic(labelCol=label, loss=loss, regParam=0.02, elasticNetParam=share, weightCol="weight", maxIter=300).fit(df)
    assert optimum(pdf, label, model, loss, 0.02 * share, 0.02 * (1 - share), "weight") <= 2e-5
    out = model.transform(df).select(label, "prediction", "probability_array").toPandas()
    p = np.stack(out["probability_array"])
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    assert (out[label] == out["prediction"]).mean() > 0.75
    if share:
        assert (np.asarray(model.state["weights"])[:, 3] == 0).all()  # the feature without variance


@pytest.mark.parametrize("loss", ["squaredError", "huber"])
@pytest.mark.parametrize("share", [0.0, 1.0])
def test_numbers_reach_the_optimum(data, loss, share):
    pdf, df = data
    model = S.Stochastic(labelCol="number", loss=loss, regParam=0.01, elasticNetParam=share, epsilon=0.3, maxIter=300).fit(df)
    assert optimum(pdf, "number", model, loss, 0.01 * share, 0.01 * (1 - share), epsilon=0.3) <= 2e-5


def test_rows_dealt_otherwise_give_the_same(data):
    _, df = data
    fits = [S.Stochastic(labelCol="two", loss="modified_huber", regParam=0.01, tol=1e-7, maxIter=400).fit(d).state["weights"] for d in (df, df.coalesce(1), df.repartition(7))]
    assert np.allclose(fits[0], fits[1], atol=1e-4) and np.allclose(fits[0], fits[2], atol=1e-4)


def test_steps_on_the_bound_reach_the_same(data, monkeypatch):
    pdf, df = data
    monkeypatch.setattr(S, "MOST_CURVES", 0)
    model = S.Stochastic(labelCol="two", loss="log_loss", regParam=0.1, elasticNetParam=0.5, tol=1e-4).fit(df)
    assert optimum(pdf, "two", model, "log_loss", 0.05, 0.05) <= 1.1e-4


def test_stochastic_steps_alone_learn(data):
    _, df = data
    out = S.Stochastic(labelCol="two", epochs=8, batchRows=8, maxIter=0).fit(df).transform(df).select("two", "prediction").toPandas()
    assert (out["two"] == out["prediction"]).mean() > 0.8


def test_one_class_no_rows_and_no_spread(data):
    pdf, df = data
    one = S.Stochastic(labelCol="d").fit(df)
    assert set(one.transform(df).toPandas()["prediction"]) == {2.0}
    flat = S.Stochastic(labelCol="d", loss="squaredError").fit(df)
    assert np.allclose(flat.transform(df).toPandas()["prediction"], 2.0)
    assert S.Stochastic(labelCol="number", loss="huber").fit(df.limit(0)).transform(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        S.Stochastic(loss="other")


def test_saved_and_in_the_pool(data, tmp_path):
    _, df = data
    for problem, label in (("classification", "two"), ("regression", "number")):
        pool = registry.candidates(problem, 4, 300, 2, ["id"], small=True)
        assert len(pool) == 1 and len(pool[0].to_try()) == 8
        d = df.withColumnRenamed(label, "label")
        model = pool[0].pipeline(pool[0].to_try()[-1]).fit(d)
        model.write().overwrite().save(f"{tmp_path}/{problem}")
        again = PipelineModel.load(f"{tmp_path}/{problem}")
        a, b = (m.transform(d).orderBy("id").toPandas()["prediction"] for m in (model, again))
        assert np.allclose(a, b)
    assert isinstance(pool[0].pipeline({}), Pipeline)
