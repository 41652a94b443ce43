"""Linear models with robust losses and a penalty on absolute values, fitted by stochastic steps.

Tasks take seeded mini-batch steps over their own rows, each followed by a proximal step for the penalties, and their weights
are averaged by the rows behind them. Exact passes then go on to the optimum: slopes and second derivatives over all rows are sums
over tasks, and each step is the minimum of the quadratic model they give, with the penalties. Where that brings little, the step is
taken on a bound that holds everywhere, from the products of the features. The result is the minimum within ``tol``, so it
doesn't depend on how the rows are dealt out.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import TypeConverters
from pyspark.ml.param.shared import HasWeightCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.functions.columns import col
from tablelab.models.custom import LinearScoresModel, _Base, _classes, _param
from tablelab.operators.moments import class_moments
from tablelab.session import checkpointed, discard

log = logging.getLogger(__name__)

#: Largest second derivative of each loss by the score.
CURVATURE = {"log_loss": 0.25, "modified_huber": 2.0, "squaredError": 1.0, "huber": 1.0}
#: Sweeps of coordinate descent within one exact step.
SWEEPS = 200
#: Numbers of second derivatives that a task may add up (16 MB); wider models only take steps on the bound.
MOST_CURVES = 2_000_000


def slope(loss: str, score: np.ndarray, y: np.ndarray, epsilon: float) -> np.ndarray:
    """Derivative of the loss by the score; classes are -1 and 1."""
    if loss == "log_loss":
        return -y * 0.5 * (1 - np.tanh(0.5 * y * score))
    if loss == "modified_huber":
        return -y * np.clip(2 * (1 - y * score), 0.0, 4.0)
    rest = score - y
    return np.clip(rest, -epsilon, epsilon) if loss == "huber" else rest


def curve(loss: str, score: np.ndarray, y: np.ndarray, epsilon: float) -> np.ndarray:
    """Second derivative of the loss by the score."""
    if loss == "log_loss":
        return 0.25 * (1 - np.tanh(0.5 * score) ** 2)
    if loss == "modified_huber":
        return 2.0 * (np.abs(y * score) < 1)
    return (np.abs(score - y) < epsilon) * 1.0 if loss == "huber" else np.ones(score.shape)


def shrunk(w: np.ndarray, step: float, l1: float, l2: float) -> np.ndarray:
    """Proximal step of the penalties; the last weight is the intercept and has none."""
    out = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0.0) / (1 + step * l2)
    out[..., -1] = w[..., -1]
    return out


def bounded_step(at: np.ndarray, gradient: np.ndarray, bound: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Minimum of gradient (w - at) + (w - at) bound (w - at) / 2 + penalties, by coordinate descent where there are absolute values."""
    ridge = np.full(len(at), l2)
    ridge[-1] = 0.0
    if l1 <= 0:
        return np.linalg.lstsq(bound + np.diag(ridge), bound @ at - gradient, rcond=None)[0]
    target, w = bound @ at - gradient, at.copy()
    live = np.flatnonzero(np.diag(bound) > 1e-12)
    for _ in range(SWEEPS):
        change = 0.0
        for j in live:
            rest = target[j] - bound[j] @ w + bound[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - (l1 if j < len(w) - 1 else 0.0), 0.0) / (bound[j, j] + ridge[j])
            change, w[j] = max(change, abs(new - w[j])), new
        if change < 1e-12:
            break
    return w


def violation(w: np.ndarray, gradient: np.ndarray, l1: float, l2: float) -> float:
    """How far weights are from the optimum: the largest slope that some weight could still go down."""
    g = gradient + l2 * w
    g[..., -1] = gradient[..., -1]
    penalty = np.full(w.shape, l1)
    penalty[..., -1] = 0.0
    return float(np.max(np.where(w != 0, np.abs(g + penalty * np.sign(w)), np.maximum(np.abs(g) - penalty, 0.0))))


class StochasticModel(LinearScoresModel):
    """Scores of a linear model; for classes also ``probability_array``."""

    @property
    def coefficients(self) -> DenseVector:
        """Weights of the number, or of the last class."""
        return Vectors.dense(np.asarray(self.state["weights"])[-1])

    @property
    def intercept(self) -> float:
        return float(np.asarray(self.state["intercepts"])[-1])

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.state["classes"] is None:
            return super()._transform(df)
        weights, intercepts, loss = np.asarray(self.state["weights"]), np.asarray(self.state["intercepts"]), self.state["loss"]
        classes = [float(c) for c in self.state["classes"]]

        @F.pandas_udf("array<double>")
        def scores(batch: pd.Series) -> pd.Series:
            return pd.Series(list(np.stack(batch.to_numpy()) @ weights.T + intercepts) if len(batch) else [], dtype=object)

        @F.pandas_udf("array<double>")
        def shares(batch: pd.Series) -> pd.Series:
            if not len(batch):
                return pd.Series([], dtype=object)
            f = np.stack(batch.to_numpy())
            p = 0.5 * (1 + np.tanh(0.5 * f)) if loss == "log_loss" else (np.clip(f, -1.0, 1.0) + 1) / 2
            total = p.sum(axis=1, keepdims=True)
            return pd.Series(list(np.where(total > 0, p / np.where(total > 0, total, 1.0), 1.0 / len(classes))))

        out = df.withColumn("_scores", scores(vector_to_array(self.getFeaturesCol()))).withColumn("probability_array", shares("_scores"))
        best = F.array_position("_scores", F.array_max("_scores")).cast("int")
        return out.withColumn(self.getPredictionCol(), F.element_at(F.array(*[F.lit(c) for c in classes]), best)).drop("_scores")


class Stochastic(Estimator, _Base, HasWeightCol):
    """Minimises the mean loss + regParam * (elasticNetParam * sum |w| + (1 - elasticNetParam) / 2 * sum w^2).

    Losses are log_loss and modified_huber for classes (one against the rest where there are over two), squaredError and huber for
    numbers. Numbers are standardised first; ``epsilon`` of the huber loss and the penalty are stated on that scale. The intercept has no penalty.
    ``epochs`` counts stochastic passes, ``maxIter`` the most exact ones. A table without rows or with one class gives a model of weights 0.
    """

    loss = _param(None, "loss", "log_loss, modified_huber, squaredError or huber", TypeConverters.toString)
    regParam = _param(None, "regParam", "penalty per row", TypeConverters.toFloat)
    elasticNetParam = _param(None, "elasticNetParam", "share of the penalty on absolute values", TypeConverters.toFloat)
    epsilon = _param(None, "epsilon", "where the huber loss becomes linear", TypeConverters.toFloat)
    epochs = _param(None, "epochs", "stochastic passes", TypeConverters.toInt)
    batchRows = _param(None, "batchRows", "rows of a stochastic step", TypeConverters.toInt)
    maxIter = _param(None, "maxIter", "most exact passes", TypeConverters.toInt)
    tol = _param(None, "tol", "slope at which the fit ends", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, predictionCol=None, weightCol=None, loss=None, regParam=None, elasticNetParam=None,
                 epsilon=None, epochs=None, batchRows=None, maxIter=None, tol=None, seed=None):
        super().__init__()
        self._setDefault(loss="log_loss", regParam=1e-4, elasticNetParam=0.0, epsilon=1.35, epochs=2, batchRows=64, maxIter=100, tol=1e-5)
        self.setup(self._input_kwargs)
        if self.getOrDefault("loss") not in CURVATURE:
            raise ValueError(f"unknown loss {self.getOrDefault('loss')}")

    def _fit(self, df: DataFrame) -> StochasticModel:
        get = self.getOrDefault
        loss = get("loss")
        weight = col(get("weightCol")).cast("double") if self.isSet("weightCol") else F.lit(1.0)
        data = checkpointed(df.select(vector_to_array(self.getFeaturesCol()).alias("x"), col(self.getLabelCol()).cast("double").alias("y"), weight.alias("w")))
        try:
            facts = data.agg(F.max(F.size("x")).alias("d"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd")).first()
            d = int(facts["d"] or 0)
            classes = _classes(data, "y") if loss in ("log_loss", "modified_huber") else None
            if classes is None:
                mean, sd = facts["mean"] or 0.0, facts["sd"] or 1.0
                targets = lambda y: ((y - mean) / sd)[:, None]
                many = 1
            else:
                asked = np.array(classes if len(classes) > 2 else classes[1:])
                targets = lambda y: np.where(y[:, None] == asked[None, :], 1.0, -1.0)
                many = len(asked)
            w = np.zeros((many, d + 1))
            if d and many:
                w = self._minimum(data, targets, w)
        finally:
            discard(data)
        if classes is None:
            return StochasticModel(self, weights=w[:, :-1] * sd, intercepts=w[:, -1] * sd + mean, classes=None, loss=loss)
        if len(classes) == 2:
            w = np.vstack([-w, w])
        elif len(classes) == 1:
            w = np.zeros((1, d + 1))
        return StochasticModel(self, weights=w[:, :-1], intercepts=w[:, -1], classes=classes, loss=loss)

    def _minimum(self, data: DataFrame, targets, w: np.ndarray) -> np.ndarray:
        get, d = self.getOrDefault, w.shape[1] - 1
        l1, l2 = get("regParam") * get("elasticNetParam"), get("regParam") * (1 - get("elasticNetParam"))
        root = F.sqrt("w")
        plain = data.select(*[(F.col("x")[i] * root).alias(f"x{i}") for i in range(d)], root.alias("one"))
        cross = class_moments(plain, [*plain.columns])[None][2]
        total = float(cross[-1, -1])
        bound = CURVATURE[get("loss")] * cross / total
        first = 1.0 / max(float(np.trace(bound)), 1e-12)
        for epoch in range(get("epochs")):
            w = self._averaged(data, targets, w, first / (1 + epoch), l1, l2, get("seed") + epoch)
        held, bold = None, False
        for _ in range(get("maxIter")):
            gradient, curves = self._slopes(data, targets, w, total)
            gap = violation(w, gradient, l1, l2)
            if gap <= get("tol"):
                return w
            if bold and gap > 0.9 * held[0]:  # back, and on by the bound
                gap, w, gradient = held
                curves = None
            held, bold = (gap, w, gradient), curves is not None
            models = [c + 1e-4 * bound for c in curves] if bold else [bound] * len(w)
            w = np.stack([bounded_step(a, g, m, l1, l2) for a, g, m in zip(w, gradient, models)])
        if get("maxIter"):
            log.warning("the fit ended after %d passes with a slope of %g left", get("maxIter"), held[0])
        return w

    def _slopes(self, data: DataFrame, targets, w: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray | None]:
        """Mean slopes of the loss by each weight and, unless there are too many, second derivatives: one sum each leaves a task and Spark."""
        loss, epsilon = self.getOrDefault("loss"), self.getOrDefault("epsilon")
        many, wide = w.shape
        second = many * wide * wide <= MOST_CURVES

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            slopes, curves = np.zeros(w.shape), np.zeros((many, wide, wide) if second else 0)
            for batch in batches:
                if len(batch):
                    x, m = np.c_[np.stack(batch["x"].to_numpy()), np.ones(len(batch))], batch["w"].to_numpy()[:, None]
                    score, y = x @ w.T, targets(batch["y"].to_numpy())
                    slopes += (slope(loss, score, y, epsilon) * m).T @ x
                    if second:
                        bend = curve(loss, score, y, epsilon) * m
                        for k in range(many):
                            curves[k] += (x * bend[:, k:k + 1]).T @ x
            out = np.concatenate([slopes.ravel(), curves.ravel()])
            yield pd.DataFrame({"i": np.arange(len(out)), "v": out})

        found = data.mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros(w.size + (many * wide * wide if second else 0))
        out[found["i"].to_numpy()] = found["v"].to_numpy()
        out /= total
        return out[:w.size].reshape(w.shape), out[w.size:].reshape(many, wide, wide) if second else None

    def _averaged(self, data: DataFrame, targets, w: np.ndarray, step: float, l1: float, l2: float, seed: int) -> np.ndarray:
        """One pass of mini-batch steps in every task, and the mean of what the tasks arrive at."""
        loss, epsilon, size = self.getOrDefault("loss"), self.getOrDefault("epsilon"), self.getOrDefault("batchRows")

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, mass, taken, draw = w.copy(), 0.0, 0, np.random.default_rng(seed)
            for batch in batches:
                x, y, m = np.c_[np.stack(batch["x"].to_numpy()), np.ones(len(batch))] if len(batch) else None, batch["y"].to_numpy(), batch["w"].to_numpy()
                order = draw.permutation(len(batch))
                for start in range(0, len(batch), size):
                    rows = order[start:start + size]
                    weight = m[rows].sum()
                    if weight > 0:
                        pace = step / np.sqrt(1 + taken / 100)
                        g = (slope(loss, x[rows] @ own.T, targets(y[rows]), epsilon) * m[rows][:, None]).T @ x[rows] / weight
                        own, mass, taken = shrunk(own - pace * g, pace, l1, l2), mass + weight, taken + 1
            if mass > 0:
                yield pd.DataFrame({"i": np.arange(own.size), "v": own.ravel() * mass, "mass": mass})

        found = data.mapInPandas(walk, "i int, v double, mass double").groupBy("i").agg((F.sum("v") / F.sum("mass")).alias("v")).collect()
        out = w.ravel().copy()
        for r in found:
            out[r["i"]] = r["v"]
        return out.reshape(w.shape)
