"""Candidate models by problem and chosen tier, with their parameter grids."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import Binarizer, MinMaxScaler, StandardScaler
from pyspark.sql import DataFrame

from tablelab.models import boosting, custom
from tablelab.models.pruning import PrunedTree
from tablelab.models.stochastic import Stochastic
from tablelab.session import PASS_ROWS

# --- fixed values: parameter grids ---------------------------------------------------------
CLASS_GRIDS = {
    "RandomForest": {"numTrees": [100, 200, 300], "featureSubsetStrategy": ["sqrt", "log2"], "minInstancesPerNode": [1, 2, 4]},
    "GradientBoosting": {"maxIter": [50, 100], "stepSize": [0.05, 0.1, 0.2], "maxDepth": [3, 4, 5]},
    "HistGradientBoosting": {"maxIter": [100, 200], "stepSize": [0.05, 0.1, 0.2], "maxDepth": [5, 10]},
    "XGBoost": {"maxIter": [100, 200, 300], "stepSize": [0.05, 0.1, 0.2], "maxDepth": [3, 4, 5, 6], "subsamplingRate": [0.8, 1.0]},
    "LightGBM": {"maxIter": [100, 200, 300], "stepSize": [0.05, 0.1, 0.2], "maxLeaves": [15, 31, 63], "minInstancesPerNode": [10, 20]},
    "CatBoost": {"maxIter": [100, 300], "stepSize": [0.05, 0.1], "maxDepth": [4, 6]},
    "LogisticRegression": {"C": [0.01, 0.1, 1.0, 10.0]},
    "LinearSVC": {"C": [0.01, 0.1, 1.0, 10.0]},
    "SGDClassifier": {"loss": ["modified_huber", "log_loss"], "regParam": [0.0001, 0.001], "elasticNetParam": [0.0, 1.0]},
    "AdaBoost": {"rounds": [50, 100, 200], "learningRate": [0.5, 1.0, 2.0]},
    "Bagging": {"rounds": [10, 20, 50], "sampleShare": [0.7, 0.9, 1.0]},
    "KNN": {"k": [3, 5, 7, 10, 15], "weights": ["uniform", "distance"]},
    "DecisionTree": {"maxDepth": [3, 5, 8, 10], "minInstancesPerNode": [2, 4, 8], "impurity": ["gini", "entropy"], "alpha": [0.0, 0.001]},
    "GaussianNB": {"smoothing": [1e-9, 1e-8, 1e-7, 1e-6]},
    "BernoulliNB": {"smoothing": [0.1, 0.5, 1.0, 2.0]},
    "MultinomialNB": {"smoothing": [0.1, 0.5, 1.0, 2.0]},
    "QDA": {"regParam": [0.0, 0.1, 0.5]},
    "RidgeClassifier": {"alpha": [1.0]},
}
REGRESSION_GRIDS = {
    "LinearRegression": {},
    "Ridge": {"alpha": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]},
    "Lasso": {"regParam": [0.001, 0.01, 0.1, 1.0]},
    "ElasticNet": {"regParam": [0.01, 0.1, 1.0], "elasticNetParam": [0.1, 0.3, 0.5, 0.7, 0.9]},
    "BayesianRidge": {"rounds": [100, 300]},
    "SGDRegressor": {"loss": ["squaredError", "huber"], "regParam": [0.0001, 0.001], "elasticNetParam": [0.0, 1.0]},
    "KNN": {"k": [3, 5, 7, 10], "weights": ["uniform", "distance"]},
    "DecisionTree": {"maxDepth": [3, 5, 8, 10], "minInstancesPerNode": [2, 4, 8], "alpha": [0.0, 0.001]},
    "RandomForest": {"numTrees": [100, 200, 300], "maxDepth": [5, 10, 20], "minInstancesPerNode": [1, 2, 4]},
    "GradientBoosting": {"maxIter": [50, 100], "stepSize": [0.05, 0.1, 0.2], "maxDepth": [3, 4, 5]},
    "HistGradientBoosting": {"maxIter": [100, 200], "stepSize": [0.05, 0.1, 0.2], "maxDepth": [5, 10]},
    "XGBoost": {"maxIter": [100, 200, 300], "stepSize": [0.05, 0.1, 0.2], "maxDepth": [3, 4, 5, 6], "subsamplingRate": [0.8, 1.0]},
    "LightGBM": {"maxIter": [100, 200, 300], "stepSize": [0.05, 0.1, 0.2], "maxLeaves": [15, 31, 63]},
    "CatBoost": {"maxIter": [100, 300], "stepSize": [0.05, 0.1], "maxDepth": [4, 6]},
}

# How the families of histogram boosting grow their trees, and the penalties they use unless told otherwise.
HISTOGRAM = {
    "HistGradientBoosting": {"growth": "leaf", "maxLeaves": 31, "maxDepth": 10, "minInstancesPerNode": 20, "l2": 0.0},
    "XGBoost": {"growth": "level", "maxDepth": 6, "l2": 1.0, "minHessian": 1.0},
    "LightGBM": {"growth": "leaf", "maxLeaves": 31, "maxDepth": 12, "minInstancesPerNode": 20, "minHessian": 1e-3, "l2": 0.0},
    "CatBoost": {"growth": "symmetric", "maxDepth": 6, "l2": 3.0},
}
STANDARD_SCALED = (
    "LogisticRegression", "LinearSVC", "LinearRegression", "Ridge", "RidgeClassifier", "Lasso", "ElasticNet", "BayesianRidge",
    "SGDClassifier", "SGDRegressor", "KNN", "BernoulliNB",
)
GRID_LIMIT = 30
RANDOM_DRAWS = 20
MAX_CAPACITY = 600


@dataclass
class Candidate:
    """A model family: how to build it from parameters, and the values to try."""

    name: str
    problem: str
    build: Callable[[dict], Estimator]
    grid: dict[str, list] = field(default_factory=dict)

    def combinations(self) -> list[dict]:
        keys = list(self.grid)
        return [dict(zip(keys, values)) for values in itertools.product(*[self.grid[k] for k in keys])]

    def to_try(self, tier: int = 1, seed: int = 42) -> list[dict]:
        """The whole grid in tiers 1 and 2 if it is small, else a repeatable draw of twenty."""
        every = self.combinations()
        if tier <= 2 and len(every) <= GRID_LIMIT:
            return every
        return random.Random(seed).sample(every, min(RANDOM_DRAWS, len(every)))

    def pipeline(self, params: dict) -> Pipeline:
        """Scaling, where the family needs it, and the model."""
        model, stages = self.build(params), []
        column = "features"
        if self.name == "MultinomialNB":
            stages.append(MinMaxScaler(inputCol=column, outputCol="ranged"))
            stages.append(custom.NonNegative(inputCol="ranged", outputCol="scaled"))
            column = "scaled"
        elif self.name in STANDARD_SCALED:
            stages.append(StandardScaler(inputCol=column, outputCol="scaled", withMean=True, withStd=True))
            column = "scaled"
        if self.name == "BernoulliNB":
            stages.append(Binarizer(threshold=0.0, inputCol=column, outputCol="binary"))
            column = "binary"
        if column != "features":
            _use_features(model, column)
        return Pipeline(stages=[*stages, model])

    def fits(self, grid: Sequence[dict], df: DataFrame) -> Iterator[PipelineModel]:
        """Models of several parameter sets on the same rows, in their order. Histogram boosting fits them together."""
        made = [self.pipeline(params) for params in grid]
        if all(len(m.getStages()) == 1 and isinstance(m.getStages()[0], boosting.HistBoost) for m in made):
            for model in boosting.fit_all([m.getStages()[0] for m in made], df):
                yield PipelineModel([model])
        else:
            for m in made:
                yield m.fit(df)

    def final_params(self, params: dict) -> dict:
        """Doubled capacity for the last fit."""
        out = dict(params)
        for name in ("numTrees", "maxIter", "rounds"):
            if name in out and self.name not in ("BayesianRidge", "LogisticRegression", "LinearSVC"):
                out[name] = min(int(out[name] * 2), MAX_CAPACITY)
        return out


def _use_features(model: Estimator, column: str) -> None:
    model._set(featuresCol=column)
    if isinstance(model, C.OneVsRest):
        model.getClassifier()._set(featuresCol=column)


def _one_vs_rest(base: Estimator, n_classes: int, weight: str | None = None) -> Estimator:
    if n_classes <= 2:
        return base
    out = C.OneVsRest(classifier=base, parallelism=4)
    return out.setWeightCol(weight) if weight else out


def _forest(rows: int) -> dict:
    """On few rows, a forest keeps the node of every row and tree, or each pass sends the trees along and goes down from their roots. The trees are the same."""
    return {"cacheNodeIds": True, "checkpointInterval": -1} if rows <= PASS_ROWS else {}


def _histogram(name: str, problem: str, weight: dict) -> Callable[[dict], Estimator]:
    return lambda p: boosting.HistBoost(problem=problem, **{"maxIter": 20, **HISTOGRAM[name], **p}, **weight)


def _tree(problem: str, whole: Callable, weight: dict) -> Callable[[dict], Estimator]:
    """Spark's tree as it is, or with a price for leaves (``alpha``) the tree cut back by it."""
    def build(p: dict) -> Estimator:
        rest = {k: v for k, v in p.items() if k != "alpha"}
        return PrunedTree(problem=problem, seed=42, **p, **weight) if p.get("alpha") else whole(seed=42, **rest, **weight)

    return build


def classification_builders(n_classes: int, rows: int, key: Sequence[str], weight: str | None = None) -> dict[str, Callable[[dict], Estimator]]:
    w = {"weightCol": weight} if weight else {}

    def logistic(p: dict) -> Estimator:
        return C.LogisticRegression(maxIter=100, tol=1e-4, regParam=1.0 / (p.get("C", 1.0) * max(rows, 1)), **w)

    def stochastic(p: dict) -> Estimator:
        return Stochastic(**{"loss": "log_loss", **p}, **w)

    def svc(p: dict) -> Estimator:
        return _one_vs_rest(C.LinearSVC(maxIter=100, tol=1e-4, regParam=1.0 / (p.get("C", 1.0) * max(rows, 1)), **w), n_classes, weight)

    def boosted(p: dict) -> Estimator:
        return _one_vs_rest(C.GBTClassifier(seed=42, **{"maxIter": 20, **p}, **w), n_classes, weight)

    out = {
        "LogisticRegression": logistic, "LinearSVC": svc, "SGDClassifier": stochastic,
        "RandomForest": lambda p: C.RandomForestClassifier(seed=42, **{"maxDepth": 10, **_forest(rows), **p}, **w),
        "DecisionTree": _tree("classification", C.DecisionTreeClassifier, w),
        "AdaBoost": lambda p: custom.AdaBoost(**p), "Bagging": lambda p: custom.Bagging(**p),
        "KNN": lambda p: custom.Neighbours(problem="classification", key=list(key), **p),
        "GaussianNB": lambda p: C.NaiveBayes(modelType="gaussian", **p, **w),
        "BernoulliNB": lambda p: C.NaiveBayes(modelType="bernoulli", **p, **w),
        "MultinomialNB": lambda p: C.NaiveBayes(modelType="multinomial", **p, **w),
        "QDA": lambda p: custom.Qda(**p), "RidgeClassifier": lambda p: custom.RidgeClassifier(**p),
    }
    return out | {"GradientBoosting": boosted} | {n: _histogram(n, "classification", w) for n in HISTOGRAM}


def _linear(name: str) -> Callable[[dict], Estimator]:
    return lambda p: custom.GramLinear(family=name, **p)


def regression_builders(rows: int, key: Sequence[str]) -> dict[str, Callable[[dict], Estimator]]:
    boosted = lambda p: R.GBTRegressor(seed=42, **{"maxIter": 20, **p})
    out = {
        **{name: _linear(name) for name in ("LinearRegression", "Ridge", "Lasso", "ElasticNet")},
        "BayesianRidge": lambda p: custom.BayesianRidge(**p), "SGDRegressor": lambda p: Stochastic(**{"loss": "squaredError", **p}),
        "KNN": lambda p: custom.Neighbours(problem="regression", key=list(key), **p),
        "DecisionTree": _tree("regression", R.DecisionTreeRegressor, {}),
        "RandomForest": lambda p: R.RandomForestRegressor(seed=42, **{**_forest(rows), **p}),
    }
    return out | {"GradientBoosting": boosted} | {n: _histogram(n, "regression", {}) for n in HISTOGRAM}


def capped_grid(grid: dict[str, list]) -> dict[str, list]:
    """Shallow and small."""
    out = dict(grid)
    if "maxDepth" in out:
        out["maxDepth"] = [d for d in out["maxDepth"] if d <= 5] or [3, 5]
    if "numTrees" in out:
        out["numTrees"] = [n for n in out["numTrees"] if n <= 100] or [50, 100]
    return out


def pool_names(problem: str, tier: int, low_features: bool = False, small: bool = False) -> list[str]:
    """Families that are tried in a tier, 1 (all of them) to 4 (the cheapest); ``small`` leaves out the ones that need many rows."""
    cls = problem == "classification"
    if tier >= 4:
        return ["SGDClassifier" if cls else "SGDRegressor"] + ([] if small else ["LightGBM"])
    names = ["LogisticRegression", "LinearSVC"] if cls else ["LinearRegression", "Ridge"]
    if not cls and low_features:
        names += ["Lasso", "ElasticNet", "BayesianRidge"]
    if tier <= 2:
        names.append("RandomForest")
    if tier == 1:
        names += ["GradientBoosting", "HistGradientBoosting", "KNN", "DecisionTree"]
        if cls:
            names += ["AdaBoost", "Bagging", "GaussianNB", "BernoulliNB", "MultinomialNB", "QDA"]
    if tier == 2:
        names.append("HistGradientBoosting")
    if not small:
        names += (["XGBoost"] if tier <= 3 else []) + ["LightGBM"] + (["CatBoost"] if tier <= 3 else [])
    return names


def candidates(
    problem: str, tier: int, rows: int, n_classes: int = 2, key: Sequence[str] = ("id",), low_features: bool = False,
    small: bool = False, weight: str | None = None, names: Sequence[str] | None = None,
) -> list[Candidate]:
    """The candidate pool for a problem and a tier, or the named families. ``rows`` only scales penalties that are stated per table."""
    grids = CLASS_GRIDS if problem == "classification" else REGRESSION_GRIDS
    builders = classification_builders(n_classes, rows, key, weight) if problem == "classification" else regression_builders(rows, key)
    chosen = list(names) if names is not None else pool_names(problem, tier, low_features, small)
    return [
        Candidate(n, problem, builders[n], capped_grid(grids.get(n, {})) if small else dict(grids.get(n, {}))) for n in chosen
    ]
