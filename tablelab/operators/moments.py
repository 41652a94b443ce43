"""Per-class counts, sums and cross products of a feature vector, summed on Spark.

Each task adds up its Arrow batches with a matrix product, so that only one small block per task
and class is shuffled. The result is d x d per class, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.functions.columns import col

MAX_FEATURES = 2_000


def class_moments(df: DataFrame, features: Sequence[str], label: str | None = None) -> dict:
    """{class: (count, sum vector, cross-product matrix)}; class None when there is no label."""
    d = len(features)
    if d > MAX_FEATURES:
        raise ValueError(f"{d} features exceed the limit of {MAX_FEATURES} for cross products")
    data = df.select(
        (col(label).cast("double") if label else F.lit(0.0)).alias("label"),
        F.array(*[col(c).cast("double") for c in features]).alias("x"),
    )

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[float, list] = {}
        for batch in batches:
            if batch.empty:
                continue
            x = np.stack(batch["x"].to_numpy())
            y = batch["label"].to_numpy()
            for value in np.unique(y):
                part = x[y == value]
                slot = acc.setdefault(float(value), [0, np.zeros(d), np.zeros((d, d))])
                slot[0] += len(part)
                slot[1] += part.sum(axis=0)
                slot[2] += part.T @ part
        if acc:
            yield pd.DataFrame(
                [(k, i, n, np.concatenate([[total[i]], cross[i]])) for k, (n, total, cross) in acc.items() for i in range(d)],
                columns=["label", "i", "n", "v"],
            )

    parts = data.mapInPandas(partial, "label double, i int, n long, v array<double>")
    summed = (
        parts.select("label", "i", "n", F.posexplode("v").alias("j", "v"))
        .groupBy("label", "i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
        .groupBy("label", "i")
        .agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("v"))
    )
    out: dict = {}
    for row in summed.collect():  # d rows of d + 1 numbers per class
        slot = out.setdefault(row["label"] if label else None, [row["n"], np.zeros(d), np.zeros((d, d))])
        slot[1][row["i"]] = row["v"][0]
        slot[2][row["i"]] = row["v"][1:]
    return {k: tuple(v) for k, v in out.items()}


def scatter(moments: dict) -> tuple[np.ndarray, np.ndarray, dict, int]:
    """Within-class scatter, overall mean, class means and row count."""
    n = sum(m[0] for m in moments.values())
    mean = sum(m[1] for m in moments.values()) / n
    means = {k: m[1] / m[0] for k, m in moments.items()}
    within = sum(m[2] - m[0] * np.outer(means[k], means[k]) for k, m in moments.items())
    return within, mean, means, n


def pair_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair over the rows in which both are filled, by matrix products.

    Gaps enter as zeros next to a 0/1 mask, so that the products of values and masks give the counts,
    sums and squares of each pair. Columns are centred first to keep the sums small.
    """
    d = len(columns)
    if d > MAX_FEATURES:
        raise ValueError(f"{d} columns exceed the limit of {MAX_FEATURES} for cross products")
    facts = df.agg(
        *[m for i, c in enumerate(columns) for m in (
            F.coalesce(F.avg(col(c).cast("double")), F.lit(0.0)).alias(f"m{i}"),
            F.coalesce(F.min(col(c)) != F.max(col(c)), F.lit(False)).alias(f"v{i}"))]
    ).first()
    data = df.select(
        F.array(*[col(c).cast("double") - F.lit(facts[f"m{i}"]) for i, c in enumerate(columns)]).alias("x")
    )

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((4, d, d))
        seen = False
        for batch in batches:
            if batch.empty:
                continue
            seen = True
            x = np.stack([np.asarray(r, dtype=float) for r in batch["x"]])
            mask = ~np.isnan(x)
            x = np.where(mask, x, 0.0)
            mask = mask.astype(float)
            acc += np.stack([mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x])
        if seen:
            yield pd.DataFrame([(i, acc[:, i, :].ravel()) for i in range(d)], columns=["i", "v"])

    cells = (
        data.mapInPandas(partial, "i int, v array<double>")
        .select("i", F.posexplode("v").alias("p", "v"))
        .groupBy("i", "p").agg(F.sum("v").alias("v"))
        .select("i", (F.col("p") % d).alias("j"), F.floor(F.col("p") / d).cast("int").alias("kind"), "v")
    )
    kinds = [F.max(F.when(F.col("kind") == k, F.col("v"))) for k in range(4)]
    one = cells.groupBy("i", "j").agg(
        kinds[0].alias("n"), kinds[1].alias("sx"), kinds[2].alias("sxx"), kinds[3].alias("sxy")
    )
    # (j, i) holds the sums of the second column; both orders meet under one key.
    low, high = F.least("i", "j"), F.greatest("i", "j")
    first = F.col("i") < F.col("j")
    pair = one.filter("i != j").groupBy(low.alias("a"), high.alias("b")).agg(
        F.max("n").alias("n"), F.max("sxy").alias("sxy"),
        F.max(F.when(first, F.col("sx"))).alias("sx"), F.max(F.when(~first, F.col("sx"))).alias("sy"),
        F.max(F.when(first, F.col("sxx"))).alias("sxx"), F.max(F.when(~first, F.col("sxx"))).alias("syy"),
    )
    names = F.array(*[F.lit(c) for c in columns])
    varies = F.array(*[F.lit(bool(facts[f"v{i}"])) for i in range(d)])
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    usable = (F.col("n") > 1) & F.get(varies, F.col("a")) & F.get(varies, F.col("b")) & (vx > 0) & (vy > 0)
    return pair.select(
        F.get(names, F.col("a")).alias("column_a"), F.get(names, F.col("b")).alias("column_b"),
        F.when(usable, cov / F.sqrt(vx * vy)).alias("correlation"),
    )
