"""Quality by Bradley-Terry pairwise ranking.

A good document is preferred to a bad one. With scores linear in the features of a text, the chance that i is preferred
to j is sigmoid(w . (x_i - x_j)), so w is fitted by logistic loss on feature differences of preference pairs. Ranks are turned into decisions at a
quantile of the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelab.llm import words as W
from tablelab.llm.sampling import labelled_sample
from tablelab.session import checkpointed

#: Bounds of the training sample: labelled rows of each class, and bytes of text in all; preference pairs drawn from it.
PER_CLASS, MAX_BYTES, PAIRS = 4000, 32 << 20, 40_000
#: Pull of the weights towards zero, Newton steps.
RIDGE, STEPS = 1e-4, 30

_CLASSES = np.zeros((256, 6), bool)
_CLASSES[65:91, 0] = True  # upper case
_CLASSES[48:58, 1] = True  # digits
_CLASSES[[ord(c) for c in ".,;:'\"()-?"], 2] = True  # the marks of prose
_CLASSES[33:127, 3] = True
_CLASSES[[*range(48, 58), *range(65, 91), *range(97, 123)], 3] = False
_CLASSES[:, 3] &= ~_CLASSES[:, 2]  # other marks
_CLASSES[[9, 10, 11, 12, 13, 32], 4] = True  # white space
_CLASSES[10, 5] = True
FEATURES = ("size", "upper", "digits", "prose_marks", "other_marks", "space", "lines", "word_length", "marked_words", "bare_marks", "repeats", "variety",
            "other_marks_high", "upper_high", "repeats_high", "bare_marks_high")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, features): shares of kinds of characters and words, how words repeat; all from the whole texts."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets) - 1, 1).astype(float)  # without the line feed behind
    kinds = np.stack([np.add.reduceat(_CLASSES[:, k][data], offsets[:-1], dtype=np.int64) for k in range(6)], 1).astype(float)
    kinds[:, 4:] -= 1
    w = W.words(data, offsets, W.IN_SPACED_WORD)
    count = np.bincount(w.text, minlength=n).astype(float)
    some = np.maximum(count, 1)
    x = np.zeros((n, len(FEATURES)))
    x[:, 0] = np.log1p(size)
    x[:, 1:7] = kinds / size[:, None]
    if len(w.starts):
        other = np.concatenate([[0], np.cumsum(_CLASSES[:, 3][data])])
        letters = np.concatenate([[0], np.cumsum(W.IN_LETTER_WORD[data])])
        marked = other[w.ends] > other[w.starts]
        bare = letters[w.ends] == letters[w.starts]
        again = np.concatenate([[False], (w.hashes[1:] == w.hashes[:-1]) & (w.text[1:] == w.text[:-1])])
        x[:, 7] = np.bincount(w.text, w.ends - w.starts, minlength=n) / some
        x[:, 8] = np.bincount(w.text, marked, minlength=n) / some
        x[:, 9] = np.bincount(w.text, bare, minlength=n) / some
        x[:, 10] = np.bincount(w.text, again, minlength=n) / some
        order = np.lexsort((w.hashes, w.text))
        h, t = w.hashes[order], w.text[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])])
        x[:, 11] = np.log1p(np.bincount(t, new, minlength=n)) - np.log1p(count)
    # The first little of what junk is made of tells most.
    for k, source in ((12, 4), (13, 1), (14, 10), (15, 9)):
        x[:, k] = x[:, source] / (x[:, source] + 0.05)
    return x


@dataclass
class Ranking:
    """Score of a text: weights . (features - means) / scales."""

    means: np.ndarray
    scales: np.ndarray
    weights: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.means) / self.scales @ self.weights


def _sample_features(sample: pd.DataFrame) -> np.ndarray:
    parts = [features(data, offsets) for _, data, offsets in W.chunks(pa.array(sample["text"], pa.large_string()))]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def fit(sample: pd.DataFrame, pairs: int = PAIRS, ridge: float = RIDGE, steps: int = STEPS) -> Ranking:
    """Fit to ``pairs`` preferences, a good against a bad document each, drawn so that every document of the sample takes part."""
    x, y = _sample_features(sample), sample["label"].to_numpy()
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES)))  # nothing to prefer
    draw = np.random.default_rng(8)
    n = max(pairs, len(good), len(bad))
    i, j = draw.permutation(np.resize(good, n)), draw.permutation(np.resize(bad, n))
    means, scales = x.mean(0), x.std(0) + 1e-9
    z = (x - means) / scales
    d = z[i] - z[j]
    w = np.zeros(d.shape[1])
    for _ in range(steps):  # Newton's method; the loss is convex
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) / n + ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Ranking(means, scales, w)


def _scored(model: Ranking):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for at, data, offsets in W.chunks(batch.column(last)):
                ranks = model(features(data, offsets))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, len(ranks)) for i in range(last)), pa.array(ranks)], [*batch.schema.names[:-1], "rank"])

    return run


def rank_documents(docs: DataFrame, model: Ranking, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row and its rank, any real number, higher is better; null texts count as empty."""
    marks = [f"__k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(m) for c, m in zip(keep, marks)], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = "".join(f"{m} {docs.select(F.col(f'`{c}`')).schema[0].dataType.simpleString()}, " for c, m in zip(keep, marks))
    return rows.mapInArrow(_scored(model), f"{schema}rank double").select(*[F.col(m).alias(c) for c, m in zip(keep, marks)], "rank")


def quality(docs: DataFrame, labels: DataFrame, training: Column | None = None, keep: list[str] | None = None, cut: float = 0.3, margin: float = 0.15,
            label: str = "quality", key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The columns ``keep`` (default: the key) of every row of ``docs``, then score (0 to 1) and predicted (1 where score >= ``cut``).

    The ranking is learned from a bounded sample of the labelled rows that ``training``, a condition on the column
    ``id``, lets through. With b the share of bad among all those rows, the ranks of all documents are cut half way
    between their quantiles (1 - margin) b and (1 + margin) b; score is the logistic of the rank, shifted so that the cut
    becomes ``cut``. Null and empty texts are ranked like any other. With labels of one class only, or none, every
    document gets the score ``cut``. An empty table gives an empty result.
    """
    model = fit(labelled_sample(docs, labels, label, training, per_class, max_bytes, key, text))
    marked = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    marked = marked.groupBy("id").agg(F.max("label").alias("label"))
    bad = (marked if training is None else marked.filter(training)).agg(F.coalesce(1 - F.avg("label"), F.lit(0.0))).first()[0]
    ranked = checkpointed(rank_documents(docs, model, keep or [key], text))
    ends = [max(0.0, (1 - margin) * bad), min(1.0, (1 + margin) * bad)]
    low_high = ranked.agg(F.percentile_approx("rank", ends, 20_000)).first()[0] or [0.0, 0.0]
    shift = np.log(cut / (1 - cut)) - sum(low_high) / 2
    return ranked.select(*(F.col(f"`{c}`") for c in keep or [key]), (1 / (1 + F.exp(-(F.col("rank") + float(shift))))).alias("score")).withColumn(
        "predicted", (F.col("score") >= cut).cast("int"))
