from threading import Event

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from queries.catalogue import QUERIES
from tablelab import session
from tablelab.models import automl, custom, ensemble, evaluate, explain, registry, search
from tablelab.operators import features, selection, splits, target
from tablelab.operators.moments import class_moments
from tablelab.plans import universal_cleaning


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(5)
    n = 240
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 4)) + np.stack([y * 2.0, -y, y * 0, y * 0.5], axis=1)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(id=range(n), label=y.astype(float))
    df = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(spark.createDataFrame(pdf))
    return pdf, df.cache()


def test_folds_and_splits(classes):
    _, df = classes
    sizes = splits.folds(df, ["id"], 3, ["label"]).groupBy("label", "fold").count().collect()
    for label in (0.0, 1.0, 2.0):
        mine = [r["count"] for r in sizes if r["label"] == label]
        assert max(mine) - min(mine) <= 1
    parts = splits.split(df, ["id"], by=["label"])
    assert parts.count() == 240 and abs(parts.filter("part = 'train'").count() - 192) <= 2
    assert splits.sample(df, ["id"], 17).count() == 17


def test_moments_match_numpy(classes):
    pdf, df = classes
    n, s, cross = class_moments(df, list("abcd"))[None]
    x = pdf[list("abcd")].to_numpy()
    assert n == 240 and np.allclose(s, x.sum(0)) and np.allclose(cross, x.T @ x)


def test_qda_against_numpy(classes):
    pdf, df = classes
    out = custom.Qda().fit(df).transform(df).orderBy("id").toPandas()
    x, scores = pdf[list("abcd")].to_numpy(), []
    for c in (0.0, 1.0, 2.0):
        part = x[pdf.label == c]
        cov, mean = np.cov(part.T), part.mean(0)
        d = x - mean
        scores.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(part) / 240))
    assert (out["prediction"].to_numpy() == np.argmax(scores, axis=0)).all()
    assert np.allclose([sum(p) for p in out["probability_array"]], 1.0)


@pytest.mark.parametrize("block", [10_000, 37])
def test_neighbours_against_brute_force(classes, monkeypatch, block):
    pdf, df = classes
    monkeypatch.setattr(custom, "QUERY_BLOCK", 64)
    out = custom.Neighbours(k=5, key=["id"], blockRows=block).fit(df).transform(df).orderBy("id").toPandas()
    x = pdf[list("abcd")].to_numpy()
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    votes = [np.bincount(pdf.label.to_numpy()[np.argsort(r, kind="stable")[:5]].astype(int), minlength=3).argmax() for r in d]
    assert (out["prediction"].to_numpy() == votes).all()


def test_neighbours_leave_out_far_parts(spark, monkeypatch):
    """Groups far apart, one of them copies of one row: equal to brute force, with a fraction of all pairs compared."""
    draw = np.random.default_rng(2)
    x = np.concatenate([draw.normal(size=(8, 3))[np.arange(600) % 8] * 20 + draw.normal(size=(600, 3)), np.full((300, 3), 50.0)])
    y = np.concatenate([np.arange(600.0), np.arange(300.0)])
    rows = [(f"{i:04d}", [float(v) for v in r], float(b)) for i, (r, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id string, x array<double>, label double").withColumn("features", array_to_vector("x"))
    monkeypatch.setattr(custom, "QUERY_BLOCK", 100)
    model = custom.Neighbours(k=4, problem="regression", blockRows=60).fit(df)
    out = model.transform(df).orderBy("id").toPandas()
    want = [y[np.argsort(np.round(((x - r) ** 2).sum(1), 9), kind="stable")[:4]].mean() for r in x]
    assert np.allclose(out["prediction"], want)
    s = model.state
    d = custom._distances(x, s["pivots"])
    bound = np.array([np.sort(np.sqrt(((x - r) ** 2).sum(1)))[3] for r in x])
    query, part = custom.parts_met(x, s["pivots"], s["radii"], bound)
    own = d.argmin(1)
    for i in range(0, 900, 7):  # nothing near is left out
        met = {own[i], *part[query == i]}
        assert all(own[j] in met for j in np.flatnonzero(((x - x[i]) ** 2).sum(1) <= bound[i] ** 2))
    counts = np.array(s["counts"])
    assert counts[part].sum() + counts[own].sum() < 0.45 * len(x) ** 2


def test_ridge_classifier_and_bayesian_ridge(classes, spark):
    pdf, df = classes
    out = custom.RidgeClassifier(alpha=1.0).fit(df).transform(df).orderBy("id").toPandas()
    x = pdf[list("abcd")].to_numpy()
    xc = x - x.mean(0)
    codes = np.stack([np.where(pdf.label == c, 1.0, -1.0) for c in range(3)], axis=1)
    w = np.linalg.solve(xc.T @ xc + np.eye(4), xc.T @ (codes - codes.mean(0)))
    assert (out["prediction"].to_numpy() == (xc @ w + codes.mean(0)).argmax(1)).all()
    line = df.withColumn("label", F.col("a") * 3 - F.col("b") + 2)
    got = custom.BayesianRidge().fit(line).transform(line)
    assert evaluate.regression_metrics(got).first()["r2"] > 0.999


def test_boosting_and_bagging(classes):
    _, df = classes
    for model in (custom.AdaBoost(rounds=7, maxDepth=2), custom.Bagging(rounds=4, maxDepth=4)):
        out = model.fit(df).transform(df)
        assert evaluate.class_metrics(out).first()["accuracy"] > 0.8
        assert out.filter(F.abs(F.aggregate("probability_array", F.lit(0.0), lambda a, v: a + v) - 1) > 1e-9).count() == 0


def test_lda_separates_and_pca_orders(classes):
    _, df = classes
    moments = class_moments(df, list("abcd"), "label")
    mean, axes = selection.lda_weights(moments, 2)
    out = selection.project(df, list("abcd"), mean, axes, "lda", ["label"])
    centres = out.groupBy("label").agg(F.avg("lda_0").alias("m")).orderBy("label").toPandas()["m"]
    assert abs(centres[2] - centres[0]) > 2
    _, _, ratios = selection.pca_weights(class_moments(df, list("abcd")), 240)
    assert ratios == sorted(ratios, reverse=True)


def test_selection_replays_on_test_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 6))
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(6)]).assign(same=lambda d: d.f0 * 2 + 1, flat=1.0, y=(x[:, 0] > 0).astype(float))
    df = spark.createDataFrame(pdf)
    names = [c for c in pdf.columns if c != "y"]
    plan = selection.FeatureSelection.fit(df, names, "y", "classification")
    assert plan.report["dropped_zero_var"] == ["flat"] and len(plan.report["dropped_correlated"]) == 1
    assert plan.transform(df.limit(5)).columns == plan.output


def test_matrix_keeps_training_columns(spark):
    train = spark.createDataFrame([("a", 1.0, 0), ("b", 2.0, 1), ("c", 3.0, 0)], "s string, v double, y int")
    plan = features.FeatureMatrix.fit(train, "y")
    assert plan.columns == ["v", "s_b", "s_c"]
    new = spark.createDataFrame([("zzz", None)], "s string, v double")
    assert tuple(plan.transform(new).first()) == (0.0, 0.0, 0.0)
    many = features.FeatureMatrix.fit(train, "y", encoding="share")
    assert sorted(r["s"] for r in many.transform(train).collect()) == pytest.approx([1 / 3] * 3)


def test_problem_types(spark):
    kind = lambda rows, t: target.problem_type(spark.createDataFrame([(r,) for r in rows], f"y {t}"), "y")["problem_type"]
    assert kind(["a", "b"], "string") == "classification"
    assert kind([0, 1] * 10, "int") == "classification"
    assert kind([0.5, 1.5, 2.5], "double") == "regression"
    assert kind(list(range(100)), "int") == "regression"
    assert kind([i % 5 for i in range(1000)], "int") == "classification"


def test_auc_and_metrics(spark):
    rows = [(1, 0.9), (1, 0.8), (0, 0.8), (0, 0.1), (1, 0.4), (0, 0.3)]
    df = spark.createDataFrame(rows, "label int, score double").withColumn("prediction", (F.col("score") > 0.5).cast("double"))
    pairs = [(p, n) for l1, p in rows if l1 for l0, n in rows if not l0]
    want = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)
    assert abs(evaluate.roc_auc(df, "score").first()[0] - want) < 1e-12
    assert abs(evaluate.MacroF1()._set(labelCol="label").evaluate(df) - evaluate.class_metrics(df).first()["f1_macro"]) < 1e-12


def test_linear_shapley_adds_up(classes):
    _, df = classes
    line = df.withColumn("label", F.col("a") * 3 - F.col("b"))
    c = registry.candidates("regression", 1, 240, names=["Ridge"])[0]
    model = c.pipeline({"alpha": 1.0}).fit(line)
    w, b = explain.linear_parts(model, list("abcd"))
    values = explain.linear_shapley(line, w, list("abcd"), ["id"]).groupBy("id").agg(F.sum("shapley").alias("s"))
    predicted = model.transform(line)
    base = predicted.agg(F.avg("prediction")).first()[0]
    gap = predicted.join(values, "id").select(F.max(F.abs(F.col("prediction") - base - F.col("s")))).first()[0]
    assert gap < 1e-8


def test_sampled_shapley_adds_up(classes):
    _, df = classes
    c = registry.candidates("regression", 1, 240, names=["Ridge"])[0]
    line = df.withColumn("label", F.col("a") * 3 - F.col("b"))
    model = c.pipeline({"alpha": 0.001}).fit(line)
    got = explain.sampled_shapley(model, line, list("abcd"), ["id"], F.col("prediction"), rows=10, rounds=6)
    assert got.count() == 40
    strong = got.groupBy("feature").agg(F.avg(F.abs("shapley")).alias("s")).orderBy(F.desc("s")).first()["feature"]
    assert strong == "a"


def test_pools_and_grids():
    assert [len(registry.pool_names("classification", t)) for t in (1, 2, 3, 4)] == [16, 7, 5, 2]
    assert registry.pool_names("regression", 1, low_features=True)[:5] == ["LinearRegression", "Ridge", "Lasso", "ElasticNet", "BayesianRidge"]
    pool = {c.name: c for c in registry.candidates("classification", 1, 100, small=True)}
    assert pool["RandomForest"].grid["numTrees"] == [100] and "XGBoost" not in pool
    big = registry.candidates("classification", 3, 10**6, names=["XGBoost"])[0]
    assert len(big.to_try(3)) == 20 and big.to_try(3) == big.to_try(3)
    assert big.final_params({"maxIter": 400}) == {"maxIter": 600}


def test_stack_is_promoted_only_when_better():
    class Fake:
        cv = 0.8

    assert ensemble.promote(Fake(), 0.7) and not ensemble.promote(Fake(), 0.8) and not ensemble.promote(None, 0.1)


def test_end_to_end(spark):
    rng = np.random.default_rng(2)
    n = 260
    a, b = rng.normal(size=n), rng.choice(["red", "green", "blue"], n)
    pdf = pd.DataFrame({"id": range(n), "a": a, "colour": b, "noise": rng.normal(size=n), "more": rng.normal(size=n),
                        "y": np.where(a + (b == "red") > 0.3, "up", "down")})
    grids = {"DecisionTree": {"maxDepth": [4]}, "GaussianNB": {}}
    model, tables = automl.run(spark.createDataFrame(pdf), "y", ["id"], names=list(grids), grids=grids, k=3)
    metrics = tables["metrics"].first()
    assert metrics["accuracy"] > 0.75 and metrics["n"] == tables["predictions"].count()
    assert set(r["predicted"] for r in tables["predictions"].select("predicted").distinct().collect()) == {"up", "down"}
    fresh = model.transform(spark.createDataFrame(pdf.drop(columns="y").head(7)), ["id"])
    assert fresh.count() == 7 and fresh.filter("confidence < 50 or confidence > 100").count() == 0


def test_tree_arrays_give_spark_predictions(classes):
    pdf, df = classes
    from pyspark.ml.classification import DecisionTreeClassifier

    tree = DecisionTreeClassifier(maxDepth=5).fit(df)
    arrays = {k: np.array(v) for k, v in custom.tree_arrays(tree).items()}
    want = tree.transform(df).orderBy("id").toPandas()["prediction"].to_numpy()
    assert (custom.tree_values(arrays, pdf[list("abcd")].to_numpy()) == want).all()


def test_custom_models_can_be_saved(classes, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    _, df = classes
    stages = {
        "qda": custom.Qda(), "knn": custom.Neighbours(key=["id"]), "ada": custom.AdaBoost(rounds=3, maxDepth=2), "bag": custom.Bagging(rounds=2),
        "ridge": custom.RidgeClassifier(), "bayes": custom.BayesianRidge(),
    }
    for name, stage in stages.items():
        model = Pipeline(stages=[stage]).fit(df)
        model.write().overwrite().save(str(tmp_path / name))
        again = PipelineModel.load(str(tmp_path / name))
        a, b = (m.transform(df).orderBy("id").toPandas()["prediction"] for m in (model, again))
        assert np.allclose(a, b), name


def test_bagging_is_repeatable(classes):
    _, df = classes
    a, b = (custom.Bagging(rounds=3).fit(d).state["trees"] for d in (df, df.repartition(5)))
    assert a == b


@pytest.mark.parametrize("problem", ["classification", "regression"])
def test_saved_automl_scores_the_same(spark, tmp_path, problem):
    rng = np.random.default_rng(3)
    n = 200
    pdf = pd.DataFrame({"id": range(n), "a": rng.normal(size=n), "b": rng.choice(["u", "v"], n), "c": rng.normal(size=n), "d": rng.normal(size=n)})
    pdf["y"] = np.where(pdf.a > 0.2, "up", "down") if problem == "classification" else (pdf.a + pdf.c) * 2 + rng.normal(size=n) / 9
    grids = {"MultinomialNB": {}, "RidgeClassifier": {}, "DecisionTree": {"maxDepth": [3]}} if problem == "classification" else {"BayesianRidge": {}, "DecisionTree": {"maxDepth": [3]}}
    df = spark.createDataFrame(pd.concat([pdf, pdf.assign(id=pdf.id + 1000)]))
    model, tables = automl.run(df, "y", ["id"], names=list(grids), grids=grids, encoding="one_hot" if problem == "classification" else "share")
    summary = tables["summary"].first()
    assert summary["test_score"] > 0.7 and summary["confidence_label"] in ("High", "Medium") and not summary["baseline_alert"]
    assert tables["predictions"].count() <= 45  # each row once, although the table holds it twice
    model.save(str(tmp_path / "auto"))
    again = automl.AutoModel.load(str(tmp_path / "auto"))
    a, b = (m.transform(df, ["id"]).orderBy("id").toPandas()["prediction"] for m in (model, again))
    assert np.allclose(a, b)


def test_stability_over_seeds(classes):
    _, df = classes
    pool = registry.candidates("classification", 1, 240, 3, names=["GaussianNB", "DecisionTree"])
    for c in pool:
        c.grid = {}
    trials = search.stability(pool, df, ["id"], ["label"], seeds=(1, 2))
    assert trials.count() == 4
    from tablelab.operators.scoring import stable_winner

    assert stable_winner(trials).first()["seeds"] == 2


def test_split_by_slices_is_the_split_by_ranks(spark):
    rows = [(i % 700 if i % 13 else None, None if i % 5 == 0 else i % 2, 1.0 * i) for i in range(1400)]  # keys and classes repeat and are missing
    d = spark.createDataFrame(rows, "k int, c int, v double")
    shares = (("train", 0.7), ("validation", 0.1), ("test", 0.2))
    for by in ([], ["c"]):
        a, b = (splits.split(d, ["k", "v"], shares, by, rows_per_slice=n) for n in (10_000, 60))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        a, b = (splits.split(d, ["k"], shares, by, rows_per_slice=n).groupBy("c" if by else F.lit(0).alias("c"), "part").count() for n in (10_000, 60))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_split_of_a_large_table_moves_only_the_slices_of_a_cut(spark):
    d = spark.range(5000).select("id", (F.col("id") % 2).alias("c"))
    plan = splits.split(d, ["id"], by=["c"], rows_per_slice=100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    window = plan[plan.index("Window"):plan.index("Exchange hashpartitioning")]
    assert "Exchange" not in window and "_cut" in plan[plan.index("Exchange hashpartitioning"):]


def test_nearest_takes_equal_distances_by_position():
    rng = np.random.default_rng(4)
    x, rows = rng.integers(0, 3, (40, 3)).astype(float), rng.integers(0, 3, (300, 3)).astype(float)
    d2 = np.round(((x[:, None] - rows[None]) ** 2).sum(2), 9)
    want = np.argsort(d2, axis=1, kind="stable")[:, :7]
    for order, dist in (custom._nearest(x, rows, 7), custom._nearest_sliced(x, rows, 7)):
        assert (order == want).all() and np.allclose(dist**2, np.take_along_axis(d2, want, axis=1))


def test_neighbours_in_tiny_blocks_make_few_parts_and_small_frames(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(1500, 3)), rng.integers(0, 3, 1500)
    d = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(1500)], "id long, x array<double>, label double")
    d = d.select("id", array_to_vector("x").alias("features"), "label")
    got = {}
    for rows in (1, 10_000):
        model = custom.Neighbours(k=3, key=["id"], blockRows=rows).fit(d.filter("id % 5 != 0"))
        got[rows] = {r["id"]: r["prediction"] for r in model.transform(d.filter("id % 5 = 0")).collect()}
        if rows == 1:
            assert len(model.state["pivots"]) <= custom.BLOCK_PIVOTS * custom.MOST_BLOCKS + 1
    assert len(got[1]) == 300 and got[1] == got[10_000]


def test_boosting_by_reweighting_evaluates_each_tree_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 2))
    d = spark.createDataFrame([(x[i].tolist(), float(x[i].sum() > 0)) for i in range(300)], "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    read, fit = [], custom.DecisionTreeClassifier.fit
    monkeypatch.setattr(custom.DecisionTreeClassifier, "fit", lambda self, df: (read.append(df._jdf.queryExecution().executedPlan().toString()), fit(self, df))[1])
    model = custom.AdaBoost(rounds=4).fit(d)
    assert len(model.state["trees"]) == len(read) == 4 and not any("UDF" in plan for plan in read)
    hits = model.transform(d).filter("label = prediction").count()
    assert hits > 240


def test_rows_are_dealt_to_enough_parts(spark):
    d = spark.range(0, 1000, 1, 2)
    out = session.dealt(d, 1000, ["id"], 100)
    assert out.rdd.getNumPartitions() == 10 and out.count() == 1000
    assert session.dealt(d, 1000, ["id"], 500).rdd.getNumPartitions() == 2


def test_small_tables_have_few_tasks_and_candidates_run_at_once(spark, classes):
    """one task for a small table, and no candidate waits for another."""
    assert session.gathered(spark.range(100).repartition(8), 100).rdd.getNumPartitions() == 1
    assert session.gathered(spark.range(100).repartition(8), 50_000).rdd.getNumPartitions() == 3
    begun = {"a": Event(), "b": Event()}

    def candidate(me, other):
        def build(params):
            begun[me].set()
            assert begun[other].wait(30)
            return custom.RidgeClassifier(alpha=1.0)

        return registry.Candidate(me, "classification", build)

    board, trials = search.leaderboard([candidate("a", "b"), candidate("b", "a")], classes[1], ["id"], ["label"], k=2)
    assert list(trials) == ["a", "b"] and trials["a"].mean == trials["b"].mean


def test_automl_reads_its_table_once(spark):
    """the target is looked at several times, the table is made once."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": range(120), "a": rng.normal(size=120), "b": rng.normal(size=120)}).assign(y=lambda d: (d.a > 0).astype(int))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    df = spark.createDataFrame(pdf).select("id", "y", "b", counted("a").alias("a"))
    automl.run(df, "y", ["id"], names=["DecisionTree"], grids={"DecisionTree": {"maxDepth": [2]}})
    assert seen.value == 120


def test_numbers_of_texts_are_stored_before_quantiles(spark, monkeypatch):
    """lengths and the like are made once, not for each pass of the quantiles."""
    stored, real = [], universal_cleaning.column_quantiles
    monkeypatch.setattr(universal_cleaning, "column_quantiles", lambda df, *a, **k: stored.append(getattr(df, "_stored_at", None)) or real(df, *a, **k))
    df = spark.createDataFrame([(i, f"this is the text of row {i} and it has {'many ' * (i % 7)}words") for i in range(60)], "n int, t string")
    plan = universal_cleaning.UniversalCleaning.fit(df)
    assert plan.report["steps"]["t"] == "text" and stored[0] is not None


def test_customers_are_searched_over_the_default_grids(spark, folder, monkeypatch):
    """no parameter of the query leaves out families, grid points, folds or rows."""
    seen = {}

    class Searched(Exception):
        pass

    def leaderboard(pool, df, key, by, k, tier, **rest):
        seen.update(grids={c.name: c.grid for c in pool}, tried=sum(len(c.to_try(tier)) for c in pool), k=k, single=rest["single_split"])
        raise Searched

    monkeypatch.setattr(search, "leaderboard", leaderboard)
    with pytest.raises(Searched):
        QUERIES["m25_automl_customers"](spark, folder)
    names = ("LogisticRegression", "LinearSVC", "RandomForest", "HistGradientBoosting", "XGBoost", "LightGBM", "CatBoost")
    assert seen == {"grids": {n: registry.CLASS_GRIDS[n] for n in names}, "tried": 86, "k": 3, "single": False}


def test_forest_of_few_rows_keeps_its_places(classes):
    """the nodes of rows are kept on few rows only, and the trees are the same."""
    few, many = (registry.candidates("classification", 1, n, 3, names=["RandomForest"])[0].pipeline({"numTrees": 4, "maxDepth": 4}) for n in (240, session.PASS_ROWS + 1))
    assert few.getStages()[0].getCacheNodeIds() and not many.getStages()[0].getCacheNodeIds()
    trees = [p.fit(classes[1]).stages[0].toDebugString.split("\n", 1)[1] for p in (few, many)]
    assert trees[0] == trees[1]


def test_bases_of_a_stack_are_fitted_once(spark, monkeypatch):
    """the best model isn't fitted to all rows a second time beside the stack."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": range(150), "a": rng.normal(size=150), "b": rng.normal(size=150)}).assign(y=lambda d: (d.a + d.b > 0).astype(int))
    fitted, real = [], search.final_fit

    def final_fit(c, params, df):
        fitted.append(c.name)
        return real(c, params, df)

    monkeypatch.setattr(search, "final_fit", final_fit)
    monkeypatch.setattr(ensemble, "final_fit", final_fit)
    grids = {"GaussianNB": {}, "DecisionTree": {"maxDepth": [2]}}
    automl.run(spark.createDataFrame(pdf), "y", ["id"], names=list(grids), grids=grids)
    assert sorted(fitted) == ["DecisionTree"] * 4 + ["GaussianNB"] * 4
