"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a probability from the words and word beginnings it holds, and the
document's is their noisy-or, 1 - (1 - p1)(1 - p2)..., trained from document labels alone. The sentence
probabilities then say where a document offends.
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

#: Bounds of the training sample: labelled rows of each class, and bytes of text in all.
PER_CLASS, MAX_BYTES = 4000, 12 << 20
#: Beginnings of words, in bytes, that are features beside the words themselves.
PREFIXES = (4, 5, 6)
#: For a feature to be learned: documents that hold it at least, and score of its lean to toxic ones.
LEAST_DOCS, LEAST_SCORE = 3, 2.0
#: Steps of training; step size; pull towards zero.
STEPS, RATE, SHRINK = 300, 1.0, 2e-5
#: Entries of the training matrix that are summed at once.
BLOCK = 1 << 20
_BREAKS = np.zeros(256, bool)
_BREAKS[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Instances:
    """Sentences of some texts: the text and byte range of each, and (sentence, feature) pairs."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sentence: np.ndarray
    feature: np.ndarray
    n_texts: int


def instances(data: np.ndarray, offsets: np.ndarray) -> Instances:
    w = W.words(data, offsets, W.IN_LETTER_WORD)
    if not len(w.starts):
        none = np.zeros(0, np.int64)
        return Instances(none, none, none, none, np.zeros(0, np.uint64), w.n_texts)
    place = np.cumsum(_BREAKS[data])[w.starts]  # the line feed behind a text breaks too
    first = np.concatenate([[True], place[1:] != place[:-1]])
    sentence = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    length = w.ends - w.starts
    features, owners = [w.hashes], [sentence]
    for n in PREFIXES:
        longer = length > n
        features.append((W.prefix_hashes(w, n) ^ np.uint64(n))[longer])
        owners.append(sentence[longer])
    last = np.concatenate([at[1:], [len(w.starts)]]) - 1
    return Instances(w.text[at], w.starts[at], w.ends[last], np.concatenate(owners), np.concatenate(features), w.n_texts)


@dataclass
class SentenceModel:
    """Weights of features, named by their hash in rising order, and the sentences' base rate."""

    features: np.ndarray
    weights: np.ndarray
    base: float

    def logits(self, x: Instances) -> np.ndarray:
        out = np.full(len(x.text), self.base)
        if len(self.features) and len(x.feature):
            at = np.minimum(np.searchsorted(self.features, x.feature), len(self.features) - 1)
            known = self.features[at] == x.feature
            pair = np.unique(x.sentence[known] * len(self.features) + at[known])
            out += np.bincount(pair // len(self.features), self.weights[pair % len(self.features)], minlength=len(out))
        return out


def noisy_or(logits: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """1 - product of (1 - sigmoid(logit)) for each text; 0 for a text without sentences."""
    return -np.expm1(-np.bincount(text, np.logaddexp(0, logits), minlength=n_texts)) if len(text) else np.zeros(n_texts)


def _vocabulary(body: pa.Array, bad: np.ndarray, least_docs: int, least_score: float) -> np.ndarray:
    """Features, in rising order, that enough documents hold and that lean to toxic ones.

    The lean is the score of the test of equal shares; a noisy-or gains next to nothing from features that speak against.
    """
    known, docs = np.zeros(0, np.uint64), np.zeros((2, 0))
    for first, data, offsets in W.chunks(body):
        x = instances(data, offsets)
        owner = x.text[x.sentence]
        order = np.lexsort((owner, x.feature))
        feature, owner = x.feature[order], owner[order]
        new = np.concatenate([[True], (feature[1:] != feature[:-1]) | (owner[1:] != owner[:-1])])[: len(feature)]
        feature, owner = feature[new], owner[new] + first
        both, at = np.unique(np.concatenate([known, feature]), return_inverse=True)
        docs = np.stack([np.bincount(at, np.concatenate([n, bad[owner] == side]), minlength=len(both)) for side, n in enumerate(docs)])
        known = both
    rows = np.array([[(~bad).sum()], [bad.sum()]])
    share = docs / np.maximum(rows, 1)
    even = docs.sum(0) / rows.sum()
    score = (share[1] - share[0]) / np.sqrt(np.maximum(even * (1 - even), 1e-12) * (1 / np.maximum(rows, 1)).sum())
    return known[(docs.sum(0) >= least_docs) & (score >= least_score)]


def _matrix(body: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text of each sentence, and (sentence, place in ``known``) of the distinct known features of all sentences, sentence by sentence."""
    text, rows, cols, sentences, size = [], [], [], 0, max(len(known), 1)
    for first, data, offsets in W.chunks(body):
        x = instances(data, offsets)
        at = np.minimum(np.searchsorted(known, x.feature), size - 1)
        hit = known[at] == x.feature if len(known) else np.zeros(len(x.feature), bool)
        pair = np.unique(x.sentence[hit] * size + at[hit])
        text.append(x.text + first)
        rows.append((pair // size + sentences).astype(np.int32))
        cols.append((pair % size).astype(np.int32))
        sentences += len(x.text)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(text or none), np.concatenate(rows or none), np.concatenate(cols or none)


def fit(sample: pd.DataFrame, least_docs: int = LEAST_DOCS, steps: int = STEPS, rate: float = RATE, shrink: float = SHRINK, least_score: float = LEAST_SCORE) -> SentenceModel:
    """Minimise the weighted log loss of the noisy-or with an L1 penalty, by proximal steps scaled per feature (AdaGrad)."""
    none = SentenceModel(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    if sample.empty or not (sample["label"] == 1).any():
        return none  # nothing offends as far as the labels tell
    body = pa.array(sample["text"], pa.large_string())
    y = sample["label"].to_numpy() == 1
    known = _vocabulary(body, y, least_docs, least_score)
    text, rows, cols = _matrix(body, known)
    texts, sentences = len(sample), len(text)
    if not sentences:
        return none
    weight = sample["weight"].to_numpy(float)
    weight = weight / weight.sum()
    blocks = [slice(i, i + BLOCK) for i in range(0, len(rows), BLOCK)]  # entries are summed in blocks, which bounds the memory

    w, b = np.zeros(len(known)), -6.0
    seen_w, seen_b = np.full(len(known), 1e-12), 1e-12
    for _ in range(steps):
        z = np.full(sentences, b)
        for s in blocks:
            first = rows[s.start]
            part = np.bincount(rows[s] - first, w[cols[s]])
            z[first : first + len(part)] += part
        total = np.bincount(text, np.logaddexp(0, z), minlength=texts)
        pull = np.where(y, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0) * weight
        g = pull[text] / (1 + np.exp(-np.clip(z, -500, 500)))
        gw, gb = np.zeros(len(known)), g.sum()
        for s in blocks:
            gw += np.bincount(cols[s], g[rows[s]], minlength=len(known))
        seen_w += gw * gw
        seen_b += gb * gb
        step = rate / np.sqrt(seen_w)
        w = w - step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * shrink, 0)
        b -= rate / np.sqrt(seen_b) * gb
    used = np.abs(w) > 1e-6
    return SentenceModel(known[used], w[used], float(b))


def _scored(model: SentenceModel, offend: float, place: int, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in W.chunks(batch.column(place)):
                x = instances(data, offsets)
                z = model.logits(x)
                n = len(offsets) - 1
                bad = np.flatnonzero(z >= np.log(offend / (1 - offend)))
                points = W.code_points(data, offsets)
                # A byte place behind a text's last word is inside the text or on its line feed.
                spans = pa.StructArray.from_arrays(
                    [pa.array(points[x.start[bad]].astype(np.int64)), pa.array(points[x.end[bad]].astype(np.int64)), pa.array(1 / (1 + np.exp(-z[bad])))],
                    ["start", "end", "p"])
                ends = np.searchsorted(x.text[bad], np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, n) for i in range(kept)), pa.array(noisy_or(z, x.text, n)), pa.ListArray.from_arrays(ends, spans)],
                    [*batch.schema.names[:kept], "score", "offending"])

    return run


def score_toxicity(docs: DataFrame, model: SentenceModel, keep: list[str], text: str = "text", offend: float = 0.5) -> DataFrame:
    """The columns ``keep`` of every row, then score (0 to 1) and offending, its sentences of probability ``offend`` or more
    as (start, end, p) in code points. Null, empty and wordless texts score 0. Rows may repeat."""
    marks = [f"__k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(m) for c, m in zip(keep, marks)], *([] if text in keep else [F.col(f"`{text}`").alias("__text")]))
    place = keep.index(text) if text in keep else len(keep)  # a text that is kept goes over once
    schema = ", ".join(f"{m} {docs.select(F.col(f'`{c}`')).schema[0].dataType.simpleString()}" for c, m in zip(keep, marks))
    scored = rows.mapInArrow(
        _scored(model, offend, place, len(keep)), f"{schema}, score double, offending array<struct<start: bigint, end: bigint, p: double>>")
    return scored.select(*[F.col(m).alias(c) for c, m in zip(keep, marks)], "score", "offending")


def fit_toxicity(docs: DataFrame, labels: DataFrame, training: Column | None = None, label: str = "toxic", key: str = "doc_id", text: str = "text",
                 per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> SentenceModel:
    """Learn from a bounded sample of the labelled rows that ``training``, a condition on the column ``id``, lets through.
    Without a toxic row the model scores everything about 0."""
    return fit(labelled_sample(docs, labels, label, training, per_class, max_bytes, key, text))
