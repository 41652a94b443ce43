"""Feature importance and Shapley values."""

from __future__ import annotations

from collections.abc import Sequence

from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelab.functions.columns import col
from tablelab.models.boosting import BoostModel
from tablelab.models.custom import TreeVoteModel, tree_arrays
from tablelab.models.pruning import PrunedTreeModel
from tablelab.operators.splits import sample


def importances(model, features: Sequence[str]) -> list[tuple[str, float]]:
    """Tree importances or absolute coefficients, the largest first."""
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "coefficientMatrix"):
        values = np.abs(last.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(last, "coefficients"):
        values = np.abs(last.coefficients.toArray())
    elif hasattr(last, "state") and "weights" in last.state:
        values = np.abs(last.state["weights"]).mean(axis=0)
    else:
        return []
    return sorted(((f, float(v)) for f, v in zip(features, values)), key=lambda kv: (-kv[1], kv[0]))


def importance_table(df: DataFrame, model, features: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame(importances(model, features), "feature string, importance double")


def linear_parts(model, features: Sequence[str]) -> tuple[np.ndarray, float]:
    """Coefficients and intercept on the unscaled features."""
    stages = model.stages if isinstance(model, PipelineModel) else [model]
    last = stages[-1]
    w = np.array(last.coefficients.toArray(), dtype=float)
    b = float(last.intercept)
    for stage in stages:
        if isinstance(stage, StandardScalerModel):
            std = stage.std.toArray()
            w = np.where(std > 0, w / np.where(std > 0, std, 1.0), 0.0)
            b -= float(w @ stage.mean.toArray())
    return w, b


def linear_shapley(df: DataFrame, coefficients: Sequence[float], features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Exact values of a linear score: coefficient times distance from the mean, one row per row and feature."""
    means = df.agg(*[F.avg(col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)]).first()
    entries = [
        F.struct(F.lit(f).alias("feature"), (F.lit(float(w)) * (col(f).cast("double") - F.lit(means[f"m{i}"]))).alias("shapley"))
        for i, (f, w) in enumerate(zip(features, coefficients))
    ]
    keys = [col(k) for k in key]
    return df.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.feature", "e.shapley")


def sampled_shapley(
    model, df: DataFrame, features: Sequence[str], key: Sequence[str], output: Column, rows: int = 500, rounds: int = 8,
    seed: int = 42, vector: str = "features",
) -> DataFrame:
    """Shapley values of any model on a fixed sample of rows.

    In each round the features of a row replace those of a background row one after the other, in a
    random order; the change of the output belongs to the feature just replaced. The number of model
    calls is rows x rounds x (features + 1).
    """
    d = len(features)
    arrays = df.select(*[col(k) for k in key], vector_to_array(vector).alias("x"))
    explained = sample(arrays, key, rows, seed)
    background = [r["x"] for r in sample(arrays, key, rounds, seed + 1).collect()]  # one row per round
    draw = np.random.default_rng(seed)
    plans = []
    for i in range(rounds):
        order = draw.permutation(d)
        place = np.empty(d, dtype=int)
        place[order] = np.arange(d)
        plans.append(F.struct(
            F.lit(i).alias("round"), F.array(*[F.lit(int(v)) for v in order]).alias("order"),
            F.array(*[F.lit(int(v)) for v in place]).alias("place"),
            F.array(*[F.lit(float(v)) for v in background[i % len(background)]]).alias("base"),
        ))
    steps = explained.select("*", F.explode(F.array(*plans)).alias("p")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("step")
    )
    mixed = F.zip_with(
        F.zip_with("x", F.col("p.base"), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.col("p.place"),
        lambda v, place: F.when(place < F.col("step"), v["a"]).otherwise(v["b"]),
    )
    keys = [col(k) for k in key]
    ready = steps.select(*keys, "p.round", "p.order", "step", array_to_vector(mixed).alias(vector))
    scored = model.transform(ready).select(*keys, "round", "order", "step", output.alias("_f"))
    w = Window.partitionBy(*keys, "round").orderBy("step")  # features + 1 rows
    change = scored.select(*keys, "order", "step", (F.col("_f") - F.lag("_f").over(w)).alias("change")).filter("step > 0")
    names = F.array(*[F.lit(f) for f in features])
    moved = F.get(F.col("order"), F.col("step") - 1)
    return change.select(*keys, F.get(names, moved).alias("feature"), "change").groupBy(*keys, "feature").agg(
        F.avg("change").alias("shapley")
    )


def trees_of(model, label: int = 1) -> tuple[list[tuple[float, dict]], float]:
    """Weighted trees whose sum is the model's score, and a constant to add.

    The score is the number predicted, the share of votes or the probability of the class at place ``label``, or, of boosted
    trees, the score before the link function.
    """
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    if isinstance(last, BoostModel):
        first = last.state["first"]
        k = label if len(first) > 1 else 0
        return [(1.0, trees[k]) for trees in last.state["rounds"]], first[k]
    if isinstance(last, PrunedTreeModel):
        return [(1.0, last.tree(label))], 0.0
    if isinstance(last, TreeVoteModel):
        voted, total = last.state["classes"][label], sum(last.state["weights"]) or 1.0
        trees = [t | {"value": [float(v == voted) for v in t["value"]]} for t in last.state["trees"]]
        return [(w / total, t) for w, t in zip(last.state["weights"], trees)], 0.0
    kind = type(last).__name__
    share = float(label) if "Classification" in kind and "GBT" not in kind else None
    if hasattr(last, "treeWeights"):
        weights = list(last.treeWeights)
        scale = 1.0 if "GBT" in kind else 1.0 / len(weights)
        return [(w * scale, tree_arrays(t, share)) for w, t in zip(weights, last.trees)], 0.0
    return [(1.0, tree_arrays(last, share))], 0.0


def tree_expectation(tree: dict) -> float:
    """Mean score of the rows a tree was grown on."""
    leaf = np.asarray(tree["feature"]) < 0
    cover = np.asarray(tree["cover"])[leaf]
    return float((np.asarray(tree["value"])[leaf] * cover).sum() / cover.sum())


def tree_contributions(tree: dict, x: np.ndarray) -> np.ndarray:
    """(row, feature) Shapley values of one tree, all rows at once.

    The worth of a set of features is the tree's score if the others are unknown: there, both ways are taken by the share of
    rows that went them. A leaf adds its value times a product over the features of its path: whether the row would go that
    way where a feature is known, the share of rows where it isn't. Its Shapley values are weighted
    coefficients of the polynomial in which each known feature is a factor t.
    """
    out = np.zeros(x.shape)
    missing = tree.get("missing_left")

    def visit(at: int, path: dict[int, tuple[np.ndarray, float]]) -> None:
        f = tree["feature"][at]
        if f >= 0:
            value = x[:, f]
            left = value <= tree["threshold"][at]
            if missing is not None:
                left = np.where(np.isnan(value), missing[at], left)
            for child, way in ((tree["left"][at], left), (tree["right"][at], ~left)):
                share = tree["cover"][child] / tree["cover"][at] if tree["cover"][at] else 0.0
                known, unknown = path.get(f, (np.ones(len(x), bool), 1.0))
                visit(child, path | {f: (known & way, unknown * share)})
            return
        m = len(path)
        for i, (own, share) in path.items():
            poly = np.zeros((m, len(x)))  # by the number of known features
            poly[0] = 1.0
            for j, (known, unknown) in path.items():
                if j != i:
                    poly[1:] = poly[1:] * unknown + poly[:-1] * known
                    poly[0] *= unknown
            weights = np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])
            out[:, i] += tree["value"][at] * (weights @ poly) * (own - share)

    visit(0, {})
    return out


def tree_shapley(model, df: DataFrame, features: Sequence[str], key: Sequence[str], label: int = 1, vector: str = "features") -> DataFrame:
    """Exact Shapley values of a model of trees: one row per row and feature, for all rows.

    The values of a row sum to its score less the mean score of the training rows (``expected_score``).
    """
    trees, _ = trees_of(model, label)
    d = len(features)

    @F.pandas_udf("array<double>")
    def values(batch: pd.Series) -> pd.Series:
        if not len(batch):
            return pd.Series([], dtype=object)
        x = np.stack(batch.to_numpy()).astype(float)
        total = np.zeros((len(x), d))
        for weight, tree in trees:
            total += weight * tree_contributions(tree, x)
        return pd.Series(list(total))

    keys = [col(k) for k in key]
    names = F.array(*[F.lit(f) for f in features])
    out = df.select(*keys, F.posexplode(values(vector_to_array(vector))).alias("_at", "shapley"))
    return out.select(*keys, F.get(names, F.col("_at")).alias("feature"), "shapley")


def expected_score(model, label: int = 1) -> float:
    """Mean score of the training rows, which Shapley values start from."""
    trees, constant = trees_of(model, label)
    return constant + sum(w * tree_expectation(t) for w, t in trees)
