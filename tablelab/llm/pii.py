"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions on top.

The network is trained in numpy on a bounded sample of labelled spans. A text is read in overlapping windows, each
decoded by itself; the spans found are put in text offsets and one consistent set of them is chosen over the whole text. A
personal item of any kind holds a digit or an @, so windows with neither have no spans and are not computed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds, in the order of results.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A number can only start where no digit stands before, as the leftmost match takes in all of it.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[^0-9]+")
_HINT = re.compile("[0-9@]")

#: Characters of a window and from one window to the next. Spans of up to STRIDE characters lie whole in some window.
WIDTH, STRIDE = 96, 48
#: Bounds of the training sample: documents, and windows of them. Passes over it, windows of a step, step size.
SAMPLE_DOCS, SAMPLE_WINDOWS, PASSES, BATCH, RATE = 3000, 3000, 6, 64, 0.01
#: Steps at least; a small sample is passed over more often.
LEAST_STEPS = 300
#: Sizes of a character's vector and of the state in each direction.
EMBED, HIDDEN = 12, 20
#: Rows of a batch that are held as Python strings at once.
ROWS = 1000
#: Least mean log-odds of a span's tags for it to be reported.
SURE = 3.0
N_TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
N_CHARS = 130  # ASCII, anything else, padding


def _luhn(digits: str) -> bool:
    values = np.frombuffer(digits.encode(), np.uint8).astype(int) - 48
    doubled = values[-2::-2] * 2
    return (values[-1::-2].sum() + (doubled - 9 * (doubled > 9)).sum()) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the address pattern, found from each @ outwards so that long words cost no more than short ones."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            free = match.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the fixed patterns, kind by kind and in order."""
    out = [(0, s, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.sub("", m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(points, 128).astype(np.int64)


def windows(text_codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, codes) of the windows of a text that hold a digit or an @; the last one is padded."""
    n = len(text_codes)
    hint = np.flatnonzero(((text_codes >= 48) & (text_codes <= 57)) | (text_codes == 64))
    if not len(hint):
        return np.zeros(0, np.int64), np.zeros((0, WIDTH), np.int64)
    # A place lies in the windows that start at the strides in (place - WIDTH, place].
    lowest = np.maximum(-(-(hint - WIDTH + 1) // STRIDE), 0)
    starts = np.unique(np.concatenate([np.minimum(lowest + k, hint // STRIDE) for k in range(-(-WIDTH // STRIDE))])) * STRIDE
    at = starts[:, None] + np.arange(WIDTH)
    return starts, np.where(at < n, text_codes[np.minimum(at, n - 1)], 129)


@dataclass
class Tagger:
    """Weights: characters; for each direction input, state and bias of the four gates; output; transitions, first and last tag."""

    embed: np.ndarray
    wx: np.ndarray
    wh: np.ndarray
    b: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    trans: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @staticmethod
    def fresh(seed: int = 5) -> Tagger:
        r = np.random.default_rng(seed)
        bias = np.zeros((2, 4 * HIDDEN))
        bias[:, HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
        return Tagger(
            r.normal(0, 0.3, (N_CHARS, EMBED)), r.normal(0, EMBED**-0.5, (2, EMBED, 4 * HIDDEN)), r.normal(0, HIDDEN**-0.5, (2, HIDDEN, 4 * HIDDEN)), bias,
            r.normal(0, HIDDEN**-0.5, (2 * HIDDEN, N_TAGS)), np.zeros(N_TAGS), np.zeros((N_TAGS, N_TAGS)), np.zeros(N_TAGS), np.zeros(N_TAGS))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.wx, self.wh, self.b, self.out, self.bias, self.trans, self.first, self.last]

    def lighter(self) -> Tagger:
        return Tagger(*(p.astype(np.float32) for p in self.parameters()))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _read(m: Tagger, x: np.ndarray, side: int) -> tuple[np.ndarray, list]:
    """States (places, windows, HIDDEN) of one direction, and what the way back needs."""
    n, width = x.shape
    h = c = np.zeros((n, HIDDEN), m.embed.dtype)
    states, kept = np.empty((width, n, HIDDEN), m.embed.dtype), []
    inputs = (m.embed @ m.wx[side] + m.b[side])[x]
    for t in range(width) if side == 0 else range(width - 1, -1, -1):
        gates = inputs[:, t] + h @ m.wh[side]
        s = _sigmoid(gates[:, : 3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        g = np.tanh(gates[:, 3 * HIDDEN :])
        before = (h, c)
        c = f * c + i * g
        tanh_c = np.tanh(c)
        h = o * tanh_c
        states[t] = h
        kept.append((t, i, f, o, g, tanh_c, before))
    return states, kept


def emissions(m: Tagger, x: np.ndarray) -> np.ndarray:
    """(places, windows, tags)"""
    return np.concatenate([_read(m, x, 0)[0], _read(m, x, 1)[0]], 2) @ m.out + m.bias


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def crf_marginals(m: Tagger, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log normaliser of each window, tag marginals (places, windows, tags), and summed pair marginals (tags, tags)."""
    width = len(e)
    a, b = np.empty_like(e), np.empty_like(e)
    a[0], b[-1] = m.first + e[0], m.last
    for t in range(1, width):
        a[t] = e[t] + _log_sum(a[t - 1][:, :, None] + m.trans, 1)
        b[width - 1 - t] = _log_sum(m.trans + (e[width - t] + b[width - t])[:, None, :], 2)
    z = _log_sum(a[-1] + m.last, 1)
    pairs = np.zeros((N_TAGS, N_TAGS))
    for t in range(1, width):
        pairs += np.exp(a[t - 1][:, :, None] + m.trans + (e[t] + b[t])[:, None, :] - z[:, None, None]).sum(0)
    return z, np.exp(a + b - z[:, None]), pairs


def gradients(m: Tagger, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log likelihood of the tags (windows, places), and its gradients in the order of parameters()."""
    n, width = x.shape
    fore, kept_fore = _read(m, x, 0)
    back, kept_back = _read(m, x, 1)
    both = np.concatenate([fore, back], 2)
    e = both @ m.out + m.bias
    z, p, pairs = crf_marginals(m, e)
    tags = y.T
    path = np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0].sum(0) + m.first[y[:, 0]] + m.last[y[:, -1]] + m.trans[y[:, :-1], y[:, 1:]].sum(1)
    de = p.copy()
    np.put_along_axis(de, tags[:, :, None], np.take_along_axis(de, tags[:, :, None], 2) - 1, 2)
    de /= n
    d_trans = pairs / n
    np.add.at(d_trans, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1 / n)
    d_first, d_last = p[0].mean(0), p[-1].mean(0)
    np.add.at(d_first, y[:, 0], -1 / n)
    np.add.at(d_last, y[:, -1], -1 / n)
    d_out, d_bias = both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, N_TAGS), de.sum((0, 1))
    d_both = de @ m.out.T
    d_embed, d_wx, d_wh, d_b = np.zeros_like(m.embed), np.zeros_like(m.wx), np.zeros_like(m.wh), np.zeros_like(m.b)
    for side, kept in ((0, kept_fore), (1, kept_back)):
        dh = dc = np.zeros((n, HIDDEN))
        d_inputs = np.zeros((N_CHARS, 4 * HIDDEN))
        for t, i, f, o, g, tanh_c, (h0, c0) in reversed(kept):
            dh = dh + d_both[t][:, side * HIDDEN : (side + 1) * HIDDEN]
            dc = dc + dh * o * (1 - tanh_c**2)
            d_gates = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tanh_c * o * (1 - o), dc * i * (1 - g**2)], 1)
            d_wh[side] += h0.T @ d_gates
            np.add.at(d_inputs, x[:, t], d_gates)
            dh, dc = d_gates @ m.wh[side].T, dc * f
        d_wx[side] = m.embed.T @ d_inputs
        d_b[side] = d_inputs.sum(0)
        d_embed += d_inputs @ m.wx[side].T
    return float((z - path).mean()), [d_embed, d_wx, d_wh, d_b, d_out, d_bias, d_trans, d_first, d_last]


def tags_of(spans: list[tuple[int, int, int]], start: int, length: int) -> np.ndarray:
    """Tags of a window; of spans that overlap the first one counts."""
    y = np.zeros(length, np.int64)
    for kind, s, e in spans:
        s, e = max(s - start, 0), min(e - start, length)
        if s < e and not y[s:e].any():
            y[s:e] = 2 + 2 * kind
            y[s] = 1 + 2 * kind
    return y


def fit(x: np.ndarray, y: np.ndarray, passes: int = PASSES, rate: float = RATE, seed: int = 5) -> Tagger | None:
    """Train on windows and their tags with Adam; none without windows."""
    if not len(x):
        return None
    m, r = Tagger.fresh(seed), np.random.default_rng(seed)
    mean, square, step = [np.zeros_like(p) for p in m.parameters()], [np.zeros_like(p) for p in m.parameters()], 0
    each = -(-len(x) // BATCH)
    passes = max(passes, -(-LEAST_STEPS // each))
    n_steps = passes * each
    for _ in range(passes):
        order = r.permutation(len(x))
        for at in range(0, len(x), BATCH):
            part = order[at : at + BATCH]
            _, grads = gradients(m, x[part], y[part])
            norm = np.sqrt(sum((g * g).sum() for g in grads))
            step += 1
            pace = rate * (1 - 0.9 * step / n_steps)
            for p, g, u, v in zip(m.parameters(), grads, mean, square):
                g = g * min(1.0, 5.0 / (norm + 1e-12))
                u += 0.1 * (g - u)
                v += 0.001 * (g * g - v)
                p -= pace * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return m.lighter()


def training_windows(texts: list[str], spans: list[list[tuple[int, int, int]]], limit: int = SAMPLE_WINDOWS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows with a digit or an @ and their tags; if there are more than ``limit``, a draw of them."""
    xs, ys = [], []
    for text, own in zip(texts, spans):
        starts, x = windows(codes(text))
        xs.append(x)
        ys.extend(tags_of(own, s, WIDTH) for s in starts)
    x = np.concatenate(xs) if xs else np.zeros((0, WIDTH), np.int64)
    y = np.array(ys, np.int64).reshape(-1, WIDTH)
    pick = np.sort(np.random.default_rng(seed).permutation(len(x))[:limit])
    return x[pick], y[pick]


def viterbi(m: Tagger, e: np.ndarray) -> np.ndarray:
    """Best tags (windows, places)."""
    width, n, _ = e.shape
    score, back = m.first + e[0], np.zeros((width, n, N_TAGS), np.int8)
    for t in range(1, width):
        step = score[:, :, None] + m.trans
        back[t] = step.argmax(1)
        score = step.max(1) + e[t]
    tags = np.zeros((n, width), np.int64)
    tags[:, -1] = (score + m.last).argmax(1)
    for t in range(width - 1, 0, -1):
        tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
    return tags


def decode(m: Tagger, x: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
    """(kind, start, end, sureness) of the spans of each window, in window offsets. Sureness is the mean margin of the span's tags over no tag, by emissions."""
    out: list[list[tuple[int, int, int, float]]] = []
    for at in range(0, len(x), 512):
        part = x[at : at + 512]
        e = emissions(m, part)
        tags = viterbi(m, e)
        for i in range(len(part)):
            row, own = tags[i], []
            places = np.flatnonzero(row)
            j = 0
            while j < len(places):
                s = places[j]
                kind = (row[s] - 1) // 2
                end = s + 1
                while end < WIDTH and row[end] == 2 + 2 * kind:
                    end += 1
                inside = e[np.arange(s, end), i, row[s:end]] - e[s:end, i, 0]
                own.append((int(kind), int(s), int(end), float(inside.mean())))
                j = np.searchsorted(places, end)
            out.append(own)
    return out


def reconcile(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """The set of spans that don't overlap with the greatest total sureness times length, over the whole text (weighted interval scheduling).

    A span found in several windows counts with its greatest sureness.
    """
    best: dict[tuple[int, int, int], float] = {}
    for kind, s, e, sure in found:
        best[kind, s, e] = max(best.get((kind, s, e), -np.inf), sure)
    spans = sorted(best, key=lambda k: (k[2], k[1], k[0]))
    ends = [k[2] for k in spans]
    total, take = [0.0], []
    for i, (kind, s, e) in enumerate(spans):
        before = int(np.searchsorted(ends[:i], s, "right"))
        gain = total[before] + best[kind, s, e] * (e - s)
        take.append((gain > total[-1], before))
        total.append(max(gain, total[-1]))
    chosen, i = [], len(spans)
    while i:
        if take[i - 1][0]:
            chosen.append(spans[i - 1])
            i = take[i - 1][1]
        else:
            i -= 1
    return chosen[::-1]


def _holds(kind: int, piece: str) -> bool:
    return "@" in piece if kind == 0 else any("0" <= c <= "9" for c in piece)


def model_spans(m: Tagger | None, texts: list[str], base: list[list[tuple[int, int, int]]], sure: float = SURE) -> list[list[tuple[int, int, int]]]:
    """For each text the spans that the network adds: sure enough, whole in a window, holding what their kind must, clear of base spans."""
    if m is None:
        return [[] for _ in texts]
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]

    def take(owners: list[int], starts: list[int], x: list[np.ndarray]) -> None:
        for i, start, own in zip(owners, starts, decode(m, np.stack(x)) if x else []):
            text = texts[i]
            for kind, s, e, p in own:
                cut = (s == 0 and start > 0) or (e == WIDTH and start + WIDTH < len(text))
                s, e = s + start, min(e + start, len(text))
                if p >= sure and not cut and s < e and _holds(kind, text[s:e]):
                    found[i].append((kind, s, e, p))

    owners, starts, x = [], [], []
    for i, text in enumerate(texts):
        if _HINT.search(text):
            for start, row in zip(*windows(codes(text))):  # windows of several texts are decoded together
                owners.append(i)
                starts.append(int(start))
                x.append(row)
                if len(x) == 512:
                    take(owners, starts, x)
                    owners, starts, x = [], [], []
    take(owners, starts, x)
    return [[x for x in reconcile(f) if all(x[2] <= s or x[1] >= e for _, s, e in b)] for f, b in zip(found, base)]


def _found(m: Tagger | None, sure: float):
    def listed(spans: list[tuple[int, int, int]]) -> list[dict]:
        return [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sorted(spans)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
                base = [base_spans(t) if _HINT.search(t) else [] for t in texts]
                added = model_spans(m, texts, base, sure)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(map(listed, base), kind), pa.array(map(listed, added), kind)], [*batch.schema.names[:-1], "base", "added"])

    return run


def fit_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> Tagger | None:
    """Train on a bounded sample of documents that hold a digit or an @, in the order of a hash of the key, labelled by the fixed patterns.

    Only the windows are taken from the documents, where they are read. None if no document has such a character.
    """
    body = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).filter(F.col("text").rlike("[0-9@]"))
    ids = body.select("id").filter(F.col("id").isNotNull()).distinct().orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample_docs)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = training_windows(list(batch["text"]), [base_spans(t) for t in batch["text"]], sample_windows)
            order = [hash_of(row) for row in x]
            yield pd.DataFrame({"order": order, "x": list(x.astype(np.int32)), "y": list(y.astype(np.int32))})

    rows = body.join(F.broadcast(ids), "id").select("text").mapInPandas(cut, "order long, x array<int>, y array<int>")
    got = rows.dropDuplicates(["x"]).orderBy("order", "x").limit(sample_windows).toPandas()
    if got.empty:
        return None
    return fit(np.stack(got["x"].to_numpy()).astype(np.int64), np.stack(got["y"].to_numpy()).astype(np.int64))


def hash_of(row: np.ndarray) -> int:
    """A number that orders windows by their content."""
    with np.errstate(over="ignore"):
        return int((row.astype(np.uint64) * (np.arange(1, len(row) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))).sum().view(np.int64))


def find_pii(docs: DataFrame, model: Tagger | None, keep: list[str], text: str = "text", sure: float = SURE) -> DataFrame:
    """The columns ``keep`` of every row, then base and added: arrays of (kind, start, end), code points, end exclusive, in the order of kinds and starts.

    Null texts count as empty. Base spans of different kinds may overlap; added ones overlap nothing.
    """
    marks = [f"__k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(m) for c, m in zip(keep, marks)], F.col(f"`{text}`").cast("string").alias("__text"))
    spans = "array<struct<kind: string, start: bigint, end: bigint>>"
    schema = "".join(f"{m} {docs.select(F.col(f'`{c}`')).schema[0].dataType.simpleString()}, " for c, m in zip(keep, marks))
    return rows.mapInArrow(_found(model, sure), f"{schema}base {spans}, added {spans}").select(*[F.col(m).alias(c) for c, m in zip(keep, marks)], "base", "added")
