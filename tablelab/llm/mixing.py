"""Mixing by soft membership.

A classifier learned from a labelled table gives each document a posterior over domains. Each document then gets a
rate, how often it is drawn on average, such that the expected tokens of every domain meet their targets: a
least-squares fit under rates of zero or more, by projected gradient steps. A step needs one small vector per domain from all
documents and hands one back, so every iteration is an aggregate over the stored posteriors.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelab.llm import ranking
from tablelab.llm import words as W
from tablelab.llm.sampling import first_rows
from tablelab.session import checkpointed

#: Bounds of the training sample: labelled rows of each domain, domains, and bytes of text in all.
PER_DOMAIN, MAX_DOMAINS, MAX_BYTES = 600, 64, 8 << 20
#: Buckets of hashed words that are features beside the style of a text; training steps, step size, ridge.
BUCKETS, STEPS, RATE, RIDGE = 512, 300, 0.5, 1e-4
#: The fit ends when no domain misses its target by more than this share of all tokens, when so many steps in a row have not brought
#: the squared miss down by a twentieth, or after so many iterations.
CLOSE, PATIENCE, ITERATIONS = 1e-4, 12, 400


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, words) of each text: root shares of hashed words, then its style."""
    w = W.words(data, offsets, W.IN_LETTER_WORD)
    n = len(offsets) - 1
    count = np.bincount(w.text, minlength=n)
    cell = w.text * BUCKETS + (w.hashes % np.uint64(BUCKETS)).astype(np.int64)
    share = np.bincount(cell, minlength=n * BUCKETS).reshape(n, BUCKETS) / np.maximum(count, 1)[:, None]
    return np.concatenate([np.sqrt(share), ranking.features(data, offsets)], 1), count


@dataclass
class Domains:
    """A softmax over domains."""

    names: list[str]
    means: np.ndarray
    scales: np.ndarray
    weights: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.means) / self.scales, -8, 8) @ self.weights[:-1] + self.weights[-1]
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def domain_sample(docs: DataFrame, labelled: DataFrame, key: str, text: str, per_domain: int, max_bytes: int) -> pd.DataFrame:
    """A bounded sample (id, domain, text, weight) of the labelled documents, by a hash of the key within each domain.

    A key labelled twice counts as the smaller domain; rows without key or domain are left out. ``weight`` is how many
    labelled rows one stands for. Each domain has its share of the bytes; texts above ``longest`` are left out. More than
    MAX_DOMAINS domains and a domain with only such texts are refused.
    """
    marked = checkpointed(labelled.select(F.col(f"`{key}`").alias("id"), F.col("domain").cast("string").alias("domain"))
                          .filter(F.col("id").isNotNull() & F.col("domain").isNotNull()).groupBy("id").agg(F.min("domain").alias("domain")))
    totals = {r["domain"]: r["count"] for r in marked.groupBy("domain").count().limit(MAX_DOMAINS + 1).collect()}
    if len(totals) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    rows = first_rows(docs, marked, "domain", sorted(totals), per_domain, max_bytes, key, text)
    counts = rows["domain"].value_counts()
    rows["weight"] = pd.Series([totals[x] / counts[x] for x in rows["domain"]], dtype=float)
    return rows


def fit_domains(sample: pd.DataFrame, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> Domains:
    """Weighted softmax regression by gradient steps scaled per weight (AdaGrad). Without labelled rows there is one domain, the empty name."""
    size = BUCKETS + len(ranking.FEATURES)
    names = sorted(sample["domain"].unique())
    if not names:
        return Domains([""], np.zeros(size), np.ones(size), np.zeros((size + 1, 1)))
    x = np.concatenate([features(data, offsets)[0].astype(np.float32) for _, data, offsets in W.chunks(pa.array(sample["text"], pa.large_string()))])
    means, scales = x.mean(0, dtype=float), x.std(0, dtype=float) + 1e-3
    z = np.ones((len(x), size + 1), np.float32)
    np.clip((x - means) / scales, -8, 8, out=z[:, :-1], casting="same_kind")
    del x
    y = (sample["domain"].to_numpy()[:, None] == np.array(names)[None, :]).astype(float)
    weight = sample["weight"].to_numpy(float)[:, None]
    weight = weight / weight.sum()
    w, seen = np.zeros((z.shape[1], len(names))), np.full((z.shape[1], len(names)), 1e-8)
    for _ in range(steps):
        s = z @ w
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = z.T @ (weight * (p - y)).astype(np.float32) + ridge * w
        seen += g * g
        w -= rate * 0.1 * g / np.sqrt(seen)
    return Domains(names, means, scales, w)


def _memberships(model: Domains):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for at, data, offsets in W.chunks(batch.column(last)):
                x, count = features(data, offsets)
                p = model.posteriors(x)
                lists = pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), p.ravel())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, len(p)) for i in range(last)), pa.array(count), lists], [*batch.schema.names[:-1], "n_tokens", "posterior"])

    return run


def memberships(docs: DataFrame, model: Domains, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, n_tokens, posterior) of every row, written once. Tokens are runs of letters and digits; null texts have none."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return checkpointed(rows.mapInArrow(_memberships(model), f"row long, id {kind}, n_tokens long, posterior array<double>"))


#: A step: the move down the gradient per domain, and how far to go on in the same direction before the next one.
Step = tuple[np.ndarray, float]


def _rates(p: np.ndarray, steps: list[Step]) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the given steps, all from 1, and the point from which the next step goes."""
    x = ahead = np.ones(len(p))
    for v, momentum in steps:
        before, x = x, np.maximum(0.0, ahead - p @ v)  # down the gradient, cut off at zero
        ahead = x + momentum * (x - before)
    return x, ahead


def _totals(steps: list[Step], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, gram = np.zeros((2, k)), np.zeros((k, k))
        for batch in batches:
            p = batch.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            n = batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)
            sums += np.stack([(n * rates) @ p for rates in _rates(p, steps)])
            if not steps:
                gram += (p * n[:, None]).T @ p
        yield pa.RecordBatch.from_arrays([pa.array([list(sums.ravel())]), pa.array([list(gram.ravel())])], ["sums", "gram"])

    return run


def _sum(members: DataFrame, steps: list[Step], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected tokens of each domain at the present rates and at the point ahead, and, at the start, the posteriors' token-weighted products."""
    parts = members.select("n_tokens", "posterior").mapInArrow(_totals(steps, k), "sums array<double>, gram array<double>")
    row = parts.agg(
        F.array(*[F.coalesce(F.sum(F.col("sums")[i]), F.lit(0.0)) for i in range(2 * k)]),
        F.array(*[F.coalesce(F.sum(F.col("gram")[i]), F.lit(0.0)) for i in range(k * k)])).first()
    return np.array(row[0][:k]), np.array(row[0][k:]), np.array(row[1]).reshape(k, k)


def tempered(totals: np.ndarray, power: float = 0.7) -> np.ndarray:
    """Target weights between the domains' own shares (power 1) and equal shares (power 0)."""
    raised = np.where(totals > 0, np.maximum(totals, 1e-12) ** power, 0.0)
    return raised / raised.sum() if raised.sum() else raised


def fit_rates(members: DataFrame, k: int, weights: np.ndarray | None = None, close: float = CLOSE, patience: int = PATIENCE,
              iterations: int = ITERATIONS) -> tuple[list[Step], np.ndarray, np.ndarray]:
    """(steps, expected tokens, targets). Targets are ``weights`` (default: tempered shares) of all tokens.

    Some targets can't be met by any rates: the posteriors of a domain's own documents give the others their shares too. The steps
    then end at the smallest miss that was found, and expected minus target tokens tell what is left.

    Minimises r' G r over rates of zero or more, where r is expected minus target tokens and G the inverse of the
    posteriors' token-weighted products; in the metric of tokens its gradient at a document is posterior . G r, and steps of
    length one go down. Momentum grows from step to step and starts again when the aim was overshot.
    """
    totals, ahead, gram = _sum(members, [], k)
    tokens = totals.sum()
    targets = tokens * (tempered(totals) if weights is None else np.asarray(weights, float) / np.sum(weights))
    inverse = np.linalg.pinv(gram + np.eye(k) * 1e-9 * max(np.trace(gram), 1e-9))
    miss = lambda t: float((t - targets) @ inverse @ (t - targets))
    steps: list[Step] = []
    pace, last = 1.0, miss(totals)
    best, bar, idle = (last, 0, totals), last, 0
    for _ in range(iterations):
        if tokens == 0 or np.abs(totals - targets).max() <= close * tokens:
            return steps, totals, targets
        if idle >= patience:
            break
        following = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        steps.append((inverse @ (ahead - targets), (pace - 1) / following))
        totals, ahead, _ = _sum(members, steps, k)
        now, pace = miss(totals), following
        if now > last:
            pace = 1.0
        last = now
        if now < best[0]:
            best = (now, len(steps), totals)
        bar, idle = (now, 0) if now < 0.95 * bar else (bar, idle + 1)
    return steps[:best[1]], best[2], targets


def _rated(model_names: list[str], steps: list[Step], gaps: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(model_names))
            first = p.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), batch.column("n_tokens"), pa.array(np.array(model_names, dtype=object)[first], pa.string()),
                 pa.array(_rates(p, steps)[0]), pa.array(gaps[first])], ["row", "id", "n_tokens", "domain", "rate", "gap"])

    return run


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, key: str = "doc_id", text: str = "text",
        per_domain: int = PER_DOMAIN, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per row of ``docs``: row, id, n_tokens, domain (the likeliest), rate, gap and copies.

    gap is what the fit left of that domain's target: expected minus target tokens, as a share of all tokens. Where every gap is
    within ``CLOSE`` the targets are met; greater ones mean that no rates found meet them, and a warning names the domains.

    ``labelled`` has the key and a column domain for some documents. copies is the rate rounded down, or up with the
    probability of its fraction, drawn by a hash of the key. A domain with a weight but no labelled document is refused.
    Documents without tokens count for nothing and are rated by their posterior like any other. An empty table gives an empty result.
    """
    model = fit_domains(domain_sample(docs, labelled, key, text, per_domain, max_bytes))
    unknown = sorted(n for n, w in (weights or {}).items() if w > 0 and n not in model.names)
    if unknown and not docs.isEmpty():
        raise ValueError(f"no labelled documents of the target domains {unknown}")
    members = memberships(docs, model, key, text)
    wanted = None if weights is None else np.array([weights.get(n, 0.0) for n in model.names])
    steps, totals, targets = fit_rates(members, len(model.names), wanted)
    gaps = (totals - targets) / max(targets.sum(), 1.0)
    if np.abs(gaps).max(initial=0.0) > CLOSE:
        missed = ", ".join(f"{n} by {g:+.4f}" for n, g in zip(model.names, gaps) if abs(g) > CLOSE)
        warnings.warn(f"expected tokens miss their targets, as shares of all tokens: {missed}", stacklevel=2)
    kind = members.schema["id"].dataType.simpleString()
    rated = members.select("row", "id", "n_tokens", "posterior").mapInArrow(
        _rated(model.names, steps, gaps), f"row long, id {kind}, n_tokens long, domain string, rate double, gap double")
    return rated.withColumn("copies", copies(F.col("rate"), F.col("id")))


def copies(rate: Column, key: Column) -> Column:
    """A whole number with the rate as its mean, always the same for a key."""
    draw = F.pmod(F.xxhash64(F.lit("mixing"), key.cast("string")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    whole = F.floor(rate)
    return (whole + (draw < rate - whole).cast("long")).cast("long")
