"""Linear families over all penalties and folds from one read of the table.

The counts, sums and cross products of each fold are summed in one pass. What is left out of a fit is taken off the totals, so
every fold and every penalty is solved on matrices as large as the number of features, and held-out errors follow
from the products of the fold itself; no row is read again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from statistics import fmean, pstdev

import numpy as np
from pyspark.sql import DataFrame

from tablelab.operators.moments import class_moments

#: Sweeps of coordinate descent, and the largest change of a coefficient after which it ends.
SWEEPS, CLOSE = 10_000, 1e-10


@dataclass
class Linear:
    """Intercept and coefficients on the features as they are."""

    intercept: float
    weights: np.ndarray
    converged: bool = True


def _centred(moments: tuple) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Rows, feature means, products of centred features, with the centred target, of the target, and the target's mean."""
    n, total, cross = moments
    mean = total / n
    c = cross - n * np.outer(mean, mean)
    return n, mean[:-1], c[:-1, :-1], c[:-1, -1], float(c[-1, -1]), float(mean[-1])


def solve(moments: tuple, l1: float = 0.0, l2: float = 0.0) -> Linear:
    """Least squares of standardised features plus l1 * |w| + l2 / 2 * |w|^2 per row, by coordinate descent if l1 > 0.

    The objective is squared error / (2 rows) + l1 * sum |w| + l2 / 2 * sum w^2. Features without variance get no weight.
    """
    n, mean, xx, xy, _, y_mean = _centred(moments)
    scale = np.sqrt(np.maximum(np.diag(xx), 0.0) / max(n - 1, 1))
    used = scale > 1e-12
    inverse = np.where(used, 1.0 / np.where(used, scale, 1.0), 0.0)
    q, r = xx * np.outer(inverse, inverse) / n, xy * inverse / n
    w, converged = np.zeros(len(r)), True
    if l1 <= 0:
        at = np.ix_(used, used)
        w[used] = np.linalg.lstsq(q[at] + l2 * np.eye(int(used.sum())), r[used], rcond=None)[0]
    else:
        converged = False
        for _ in range(SWEEPS):
            change = 0.0
            for j in np.flatnonzero(used):
                rest = r[j] - q[j] @ w + q[j, j] * w[j]
                new = np.sign(rest) * max(abs(rest) - l1, 0.0) / (q[j, j] + l2)
                change, w[j] = max(change, abs(new - w[j])), new
            if change < CLOSE:
                converged = True
                break
    w = w * inverse
    return Linear(y_mean - float(w @ mean), w, converged)


def r_squared(model: Linear, moments: tuple) -> float:
    """Of the rows whose products these are."""
    n, total, cross = moments
    v = np.concatenate([-model.weights, [1.0]])  # residual = v * (x, y) - intercept
    errors = float(v @ cross @ v) - 2 * model.intercept * float(v @ total) + n * model.intercept**2
    spread = float(cross[-1, -1]) - float(total[-1]) ** 2 / n
    return 1 - errors / spread if spread > 0 else 0.0


def penalties(family: str, params: dict, rows: float) -> tuple[float, float]:
    """l1 and l2 of a family's parameters; a ridge's alpha is stated for the sum over rows, the others per row."""
    if family == "Ridge":
        return 0.0, params["alpha"] / rows
    if family == "Lasso":
        return params["regParam"], 0.0
    if family == "ElasticNet":
        return params["regParam"] * params["elasticNetParam"], params["regParam"] * (1 - params["elasticNetParam"])
    return 0.0, 0.0


def paths(df: DataFrame, features: Sequence[str], label: str, fold: str, grids: dict[str, dict[str, list]]) -> list[dict]:
    """One record per family and parameters: the held-out scores by fold, their mean and spread, and the fit on all rows.

    Rows of each fold are scored by the fit on the others. Folds must hold two rows or more; rows with a missing value are
    to be left out before.
    """
    parts = class_moments(df, [*features, label], fold)
    total = tuple(sum(m[i] for m in parts.values()) for i in range(3))
    out = []
    for family, grid in grids.items():
        for values in product(*grid.values()):
            params = dict(zip(grid, values))
            scores = []
            for m in (parts[k] for k in sorted(parts)):
                train = tuple(a - b for a, b in zip(total, m))
                scores.append(r_squared(solve(train, *penalties(family, params, train[0])), m))
            final = solve(total, *penalties(family, params, total[0]))
            out.append({"model": family, "params": params, "scores": scores, "score": fmean(scores), "std": pstdev(scores), "fit": final})
    return out


def path_table(df: DataFrame, found: list[dict]) -> DataFrame:
    """model, params, fold, score: one row per family, parameters and fold."""
    rows = [(r["model"], ",".join(f"{k}={v}" for k, v in r["params"].items()), i, float(s)) for r in found for i, s in enumerate(r["scores"])]
    return df.sparkSession.createDataFrame(rows, "model string, params string, fold int, score double")
