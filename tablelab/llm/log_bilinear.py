"""Language-model scores by a log-bilinear model, trained in numpy with noise-contrastive estimation.

The two tokens before a token are represented by vectors, each goes through a matrix of its place, and their sum is the
prediction; a token's score is the product of the prediction with the token's own vector, and a bias. Training tells
true tokens from ones drawn from a noise distribution (the counts), so it needs no sum over the vocabulary. Every task goes
through its training documents, and after each round the parameters of all tasks are averaged as a grouped sum,
weighted by tokens; the rounds share the documents out, so each is learned from once.

For scores the sums are taken exactly. With A and B the scores a first and a second context token add, the sums of
exp(score) of all pairs of contexts are one product of matrices, exp(A) diag(exp(bias)) exp(B)', so probabilities are
normalised at the cost of look-ups.

The model's vocabulary is the most frequent tokens and one class for all others. Within that class a token's share is its
smoothed count, so probabilities of all tokens seen in training and of one unseen one sum to 1 whatever the size of the
vocabulary. Counts are taken over all training documents; those of a bounded number of frequent words go to every
task, the others are looked up by a join, in which no word can be frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab.llm import words as W
from tablelab.session import checkpointed

#: Tokens of the model's vocabulary, the class of all others included; bytes of the longest word in it; length of the vectors.
VOCABULARY, LONGEST, SIZE = 2048, 64, 32
#: Frequent words whose counts every task has.
LOOKED = 1 << 17
#: Rounds that share the training documents out, tokens of a step, noise tokens of a step, and the rate of a step.
ROUNDS, STEP, NOISE, RATE = 2, 2048, 64, 0.1
#: The class of rare tokens, and the token that ends a text. Contexts also have a start, after the last token.
RARE, END = 0, 1
#: Texts that are gone through at a time.
TEXTS = 256
#: Bytes of text of which distinct words are counted before they leave a task.
COUNTED_BYTES = 2 << 20
#: The counts' key of the end; no word is empty.
END_WORD = ""


def _strings(w: W.Words, chosen: np.ndarray) -> pa.Array:
    """The chosen words, A-Z lower-cased."""
    if not len(chosen):
        return pa.array([], pa.large_string())
    edges = np.stack([w.starts, w.ends], axis=1).ravel()
    lowered = pa.py_buffer(W.LOWER[w.data].tobytes())
    both = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64).tobytes()), lowered)  # words and gaps in turn
    return both.take(pa.array(2 * chosen))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (word, n): distinct words of a few megabytes at a time, and the ends."""
    for batch in batches:
        for _, data, offsets in W.chunks(batch.column(0), COUNTED_BYTES):
            w = W.words(data, offsets, W.IN_SPACED_WORD)
            _, first, n = np.unique(w.hashes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([_strings(w, first).cast(pa.string()), pa.array(n, pa.int64())], ["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([END_WORD]), pa.array([batch.num_rows], pa.int64())], ["word", "n"])


@dataclass
class Vocabulary:
    """Frequent words by their hashes, sorted, with the id and the count of each; counts by id, the end's and all rare ones' too; totals of all tokens."""

    hashes: np.ndarray
    ids: np.ndarray  # RARE beyond the model's vocabulary
    times: np.ndarray
    counts: np.ndarray  # at 0: all rare tokens
    tokens: int  # N
    types: int  # V

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id and the count of each word; a count of 0 where it isn't known."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = self.hashes[at] == hashes
        return np.where(same, self.ids[at], RARE), np.where(same, self.times[at], 0)

    def shares(self) -> np.ndarray:
        """Smoothed probabilities by id; those of all rare tokens and an unseen one are in the first."""
        rare = self.counts[0] + (self.types - (len(self.counts) - 1)) + 1
        return np.concatenate([[rare], self.counts[1:] + 1]) / (self.tokens + self.types + 1)


def hash_of(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    raw = [x.encode("utf-8") for x in words]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    return W.words(data, np.array([0, len(data)]), W.IN_SPACED_WORD).hashes


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all whole texts; the empty word counts the ends."""
    return docs.select(F.col(f"`{text}`")).mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, size: int = VOCABULARY, longest: int = LONGEST, looked: int = LOOKED) -> Vocabulary:
    """The end and the most frequent words, at most ``size`` - 1 with an id and ``looked`` in all, ties by the word."""
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, types = int(total["n"] or 0), int(total["v"])
    ends = counts.filter(F.col("word") == END_WORD).collect()
    short = counts.filter((F.col("word") != END_WORD) & (F.octet_length("word") <= longest))
    most = max(size - 2, 0) if ends else 0
    # Words are chosen by how often they occur, in steps of a twelfth, so that no task returns more than the bound.
    step = F.floor(F.log2("n") * 8).cast("int")
    left, least = max(most, looked) if ends else 0, 1 << 30
    for r in sorted(short.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):  # at most 8 x 63 rows
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    top = short.filter(step >= least).toPandas()
    if len(top) < most:  # so many words of one step that none of them are among the above
        more = short.filter(step < least).orderBy(F.desc("n"), "word").limit(most - len(top)).toPandas()
        top = pd.concat([top, more])
    top = top.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
    times = top["n"].to_numpy(np.int64)
    known = np.concatenate([[r["n"] for r in ends], times[:most]]).astype(np.int64)
    hashes, ids = hash_of(top["word"].tolist()), np.arange(len(top)) + END + 1
    ids[most:] = RARE
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], ids[order], times[order], np.concatenate([[tokens - known.sum()], known]), tokens, types)


def _encoded(v: Vocabulary):
    """Rows (row, training, text) to token ids; of rare words with known counts their number and the sum of log10(c + 1); the others, distinct, with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in W.chunks(batch.column(2)):
                n = len(offsets) - 1
                w = W.words(data, offsets, W.IN_SPACED_WORD)
                ids, times = v.of(w.hashes)
                per_text = np.bincount(w.text, minlength=n) if len(w.text) else np.zeros(n, np.int64)
                # The end goes behind the words of each text.
                upto = np.cumsum(per_text)
                tokens = np.insert(ids, upto, END if len(v.counts) > END else RARE).astype("<u2")
                cuts = (upto + np.arange(1, n + 1)) * 2
                coded = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), n, [None, pa.py_buffer(np.concatenate([[0], cuts]).astype(np.int64).tobytes()), pa.py_buffer(tokens.tobytes())]).cast(pa.binary())
                near = np.flatnonzero((ids == RARE) & (times > 0))
                number, logs = np.bincount(w.text[near], minlength=n), np.bincount(w.text[near], np.log10(times[near] + 1.0), n)
                rare = np.flatnonzero(times == 0)
                order = rare[np.lexsort((w.hashes[rare], w.text[rare]))]
                new = np.ones(len(order), bool)
                new[1:] = (w.hashes[order][1:] != w.hashes[order][:-1]) | (w.text[order][1:] != w.text[order][:-1])
                first = np.flatnonzero(new)
                numbers = np.diff(np.concatenate([first, [len(order)]]))
                chosen = order[first]
                bounds = np.searchsorted(w.text[chosen], np.arange(n + 1)).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(bounds), _strings(w, chosen).cast(pa.string()))
                counts = pa.ListArray.from_arrays(pa.array(bounds), pa.array(numbers, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), batch.column(1).slice(at, n), coded, pa.array(number, pa.int64()), pa.array(logs, pa.float64()), words, counts],
                    ["id", "training", "tokens", "near", "logs", "rare", "times"])

    return run


@dataclass
class Model:
    """Vectors of contexts (the start last) and of tokens, a matrix for each of the two places, and biases."""

    contexts: np.ndarray
    tokens: np.ndarray
    places: np.ndarray
    bias: np.ndarray
    _tables: tuple | None = field(default=None, repr=False)

    @staticmethod
    def start(v: Vocabulary, size: int = SIZE, seed: int = 1) -> Model:
        """Small random vectors; biases that give the smoothed counts."""
        draw, n = np.random.default_rng(seed), len(v.counts)
        small = lambda *shape: (draw.normal(size=shape) * 0.1).astype(np.float32)
        return Model(small(n + 1, size), small(n, size), np.stack([np.eye(size, dtype=np.float32)] * 2), np.log(v.shares()).astype(np.float32))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores added by the token before and the one two before (contexts x tokens), and the logarithm of the sum of each pair of contexts."""
        if self._tables is None:
            one, two = ((self.contexts @ m) @ self.tokens.T for m in self.places)
            one = one + self.bias
            high_one, high_two = one.max(1, keepdims=True), two.max(1, keepdims=True)
            sums = np.exp(one - high_one) @ np.exp(two - high_two).T
            self._tables = one, two, np.log(np.maximum(sums, np.finfo(np.float32).tiny)) + high_one + high_two.T
        return self._tables

    def log_probabilities(self, before: np.ndarray, two_before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Natural logarithms of the normalised probabilities."""
        one, two, sums = self.tables()
        return (one[before, token] + two[two_before, token]).astype(np.float64) - sums[before, two_before]


def contexts_of(tokens: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The token before each token and the one before that; ``first`` are the places where texts begin."""
    before = np.concatenate([[start], tokens[:-1]])
    before[first] = start
    two_before = np.concatenate([[start], before[:-1]])
    two_before[first] = start
    return before, two_before


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All token ids of a batch and the place at which each text ends."""
    parts = [np.frombuffer(x, "<u2") for x in column.to_pylist()]
    return np.concatenate(parts).astype(np.int64), np.cumsum([len(p) for p in parts])


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct row numbers and the sum of the values of each."""
    rows = rows.astype(np.uint16)  # sorted by digits
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[at], np.add.reduceat(values[order], at, axis=0)


class Trainer:
    """Steps of noise-contrastive estimation; the size of each step follows past gradients (AdaGrad)."""

    def __init__(self, model: Model, shares: np.ndarray, noise: int = NOISE, rate: float = RATE, seed: int = 0):
        self.m = Model(model.contexts.copy(), model.tokens.copy(), model.places.copy(), model.bias.copy())
        self.past = {id(p): np.full_like(p, 1e-2) for p in (self.m.contexts, self.m.tokens, self.m.places, self.m.bias)}
        self.shares, self.noise, self.rate = shares / shares.sum(), noise, rate
        self.offset = (np.log(self.shares) + np.log(noise)).astype(np.float32)
        self.draw = np.random.default_rng(seed)

    def _move(self, p: np.ndarray, rows: np.ndarray | slice, g: np.ndarray) -> None:
        past = self.past[id(p)]
        past[rows] += g * g
        p[rows] += self.rate * g / np.sqrt(past[rows])

    def step(self, before: np.ndarray, two_before: np.ndarray, token: np.ndarray) -> None:
        m, n = self.m, len(token)
        drawn = self.draw.choice(len(self.shares), self.noise, p=self.shares)
        r1, r2 = m.contexts[before], m.contexts[two_before]
        predicted = r1 @ m.places[0] + r2 @ m.places[1]
        own, other, bias = m.tokens[token], m.tokens[drawn], m.bias - self.offset
        pull = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", predicted, own) + bias[token], -30, 30))) / n
        push = -1 / (1 + np.exp(np.clip(predicted @ -other.T - bias[drawn], -30, 30))) / n
        change = push @ other + pull[:, None] * own
        tokens = np.concatenate([token, drawn])
        new = [
            (m.tokens, *_sums(tokens, np.concatenate([pull[:, None] * predicted, push.T @ predicted]))),
            (m.bias, *_sums(tokens, np.concatenate([pull, push.sum(0)]))),
            (m.contexts, *_sums(np.concatenate([before, two_before]), np.concatenate([change @ m.places[0].T, change @ m.places[1].T]))),
            (m.places, slice(None), np.stack([r1.T @ change, r2.T @ change]))]
        for p, rows, g in new:
            self._move(p, rows, g)


def _trained(model: Model, shares: np.ndarray, noise: int, rate: float, step: int, seed: int):
    """Rows (tokens) to one row for each row of the parameters: its number, the tokens seen, and its values times these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, seen, waiting = Trainer(model, shares, noise, rate, seed), 0, []
        start = len(model.contexts) - 1

        def learn(last: bool) -> None:
            nonlocal waiting, seen
            columns = [np.concatenate(c) for c in zip(*waiting)]
            n = len(columns[0])
            upto = n if last else n - n % step
            for at in range(0, upto, step):
                trainer.step(*(c[at:min(at + step, upto)] for c in columns))
            seen += upto
            waiting = [tuple(c[upto:] for c in columns)] if upto < n else []

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                tokens, ends = _joined(batch.column(0).slice(at, TEXTS))
                waiting.append((*contexts_of(tokens, np.concatenate([[0], ends[:-1]]), start), tokens))
                if sum(len(c[0]) for c in waiting) >= step:
                    learn(False)
        if waiting:
            learn(True)
        values = flattened(trainer.m).astype(np.float64) * seen
        keep = slice(None) if seen else slice(0)
        names = [f"p{i}" for i in range(values.shape[1])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(values))[keep], pa.int32()), pa.array(np.full(len(values), seen)[keep], pa.int64()), *(pa.array(values[keep, i]) for i in range(values.shape[1]))],
            ["row", "seen", *names])

    return run


def flattened(m: Model) -> np.ndarray:
    """All parameters as rows as long as a vector."""
    size = m.tokens.shape[1]
    bias = np.zeros(-(-len(m.bias) // size) * size, np.float32)
    bias[: len(m.bias)] = m.bias
    return np.concatenate([m.contexts, m.tokens, m.places.reshape(-1, size), bias.reshape(-1, size)])


def restored(rows: np.ndarray, like: Model) -> Model:
    size, at = like.tokens.shape[1], np.cumsum([len(like.contexts), len(like.tokens), 2 * like.tokens.shape[1]])
    contexts, tokens, places, bias = np.split(rows.astype(np.float32), at)
    return Model(contexts, tokens, places.reshape(2, size, size), bias.ravel()[: len(like.bias)])


def train(encoded: DataFrame, v: Vocabulary, size: int = SIZE, rounds: int = ROUNDS, noise: int = NOISE, rate: float = RATE, step: int = STEP) -> Model:
    """The model after all rounds; ``encoded`` has tokens, training and a number for each row."""
    model = Model.start(v, size)
    if len(v.counts) < 2:
        return model
    own = encoded.filter("training")
    schema = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("seen", T.LongType()), *(T.StructField(f"p{i}", T.DoubleType()) for i in range(size))])
    for r in range(rounds):
        shard = own.filter(F.pmod(F.xxhash64("number"), F.lit(rounds)) == r).select("tokens")
        sums = shard.mapInArrow(_trained(model, v.shares(), noise, rate, step, r), schema).groupBy("row").agg(
            F.sum("seen").alias("seen"), *[F.sum(f"p{i}").alias(f"p{i}") for i in range(size)])
        found = sums.toPandas().sort_values("row")  # as many rows as the vocabulary has, twice
        if len(found):
            model = restored(found[[f"p{i}" for i in range(size)]].to_numpy() / found[["seen"]].to_numpy(), model)
    return model


def _scored(model: Model, v: Vocabulary):
    """Rows (number, tokens) to what needs no counts of rare words: tokens, known ones, the rare ones, and both scores of the others."""
    base = np.log10((v.counts + 1) / (v.tokens + v.types + 1))
    base[RARE] = 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = len(model.contexts) - 1
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                tokens, ends = _joined(part.column(1))
                first = np.concatenate([[0], ends[:-1]])  # no text is without its end
                p = model.log_probabilities(*contexts_of(tokens, first, start), tokens) / np.log(10)
                total = lambda x: np.add.reduceat(x, first)
                rare = tokens == RARE
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(np.concatenate([[0], ends]))), pa.array(total((~rare).astype(np.int64))), pa.array(total(base[tokens])), pa.array(total(p))],
                    ["number", "n_tokens", "n_known", "base", "model"])

    return run


def score_texts(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", size: int = VOCABULARY, longest: int = LONGEST, looked: int = LOOKED,
                vector: int = SIZE, rounds: int = ROUNDS, noise: int = NOISE, rate: float = RATE, step: int = STEP) -> DataFrame:
    """One row per row of ``docs``: id, training, n_tokens, n_known, train_tokens, base_score, score.

    Words are runs of anything but ASCII white space, A-Z lower-cased; each text ends with one more token. ``training`` chooses,
    by a column ``id``, the documents that counts and model are learned from; a null there counts as false. base_score sums
    log10((c + 1) / (N + V + 1)) over the tokens; score sums log10 of the model's normalised probabilities. Null texts count
    as empty (one token, the end). Repeated rows and rows with null or repeated keys count and are scored one by one. Without
    training rows every token has probability 1. Other columns are not read; an empty table gives no rows.
    """
    body = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    body = body.select("id", F.coalesce(training, F.lit(False)).alias("training"), "text")
    counts = checkpointed(count_tokens(body.filter("training")))
    v = vocabulary(counts, size, longest, looked)
    stored = T.StructType([
        body.schema["id"], T.StructField("training", T.BooleanType()), T.StructField("tokens", T.BinaryType()),
        T.StructField("near", T.LongType()), T.StructField("logs", T.DoubleType()),
        T.StructField("rare", T.ArrayType(T.StringType())), T.StructField("times", T.ArrayType(T.IntegerType()))])
    encoded = checkpointed(body.mapInArrow(_encoded(v), stored).withColumn("number", F.monotonically_increasing_id()))
    model = train(encoded, v, vector, rounds, noise, rate, step)
    plain = checkpointed(encoded.select("number", "tokens").mapInArrow(_scored(model, v), "number long, n_tokens long, n_known long, base double, model double"))

    # Counts of the other words by a join, then sums for each text.
    words = encoded.select("number", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("number", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    c = F.coalesce("n", F.lit(0))
    joined = words.join(counts, "word", "left").groupBy("number").agg(
        F.sum("times").alias("far"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * F.log10(c + 1)).alias("far_logs"))
    out = encoded.select("id", "training", "number", "near", "logs").join(plain, "number").join(joined, "number", "left")
    more = lambda n: F.coalesce(n, F.lit(0))
    others, logs = F.col("near") + more("far"), F.col("logs") + more("far_logs")
    every = float(v.tokens + v.types + 1)
    share = lambda total: logs - others * F.lit(float(np.log10(total)))
    return out.select(
        "id", "training", "n_tokens", (F.col("n_known") + F.col("near") + more("known")).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + share(every)).alias("base_score"), (F.col("model") + share(v.shares()[RARE] * every)).alias("score"))
