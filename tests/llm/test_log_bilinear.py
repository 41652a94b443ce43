import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelab.llm import log_bilinear as L
from tablelab.llm import queries as corpus

WORD = re.compile("[^\x20\x09-\x0d]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def tokens_of(text):
    return [*WORD.findall(lowered(text)), ""]


def base_of(rows, training):
    """n_tokens, n_known, N and base score of every text, in plain Python."""
    counts = Counter(t for k, text in rows if training(k) for t in tokens_of(text))
    n, v = sum(counts.values()), len(counts)
    return [(len(ts), sum(counts[t] > 0 for t in ts), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)) for ts in map(tokens_of, [t for _, t in rows])]


@pytest.mark.parametrize("looked", [0, 20, 1000])
def test_counts_and_base_scores(spark, documents, looked):
    rows = [(i, f"the Cat {i % 7} sat\ton the ÄMat-{i}\x0bthe end") for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \n "), (63, "long " * 20_000 + "x" * 5_000), (64, "unheard-of words"), (None, "the cat"), (5, "repeated key"), (65, "x" * 5_000)]
    got = L.score_texts(documents(rows), F.col("id") % 3 != 0, size=12, step=64, looked=looked).collect()
    want = base_of(rows, lambda k: k is not None and k % 3 != 0)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[-1], 6))
    a = sorted([(r.id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], key=key)
    b = sorted([(k, *w) for (k, _), w in zip(rows, want)], key=key)
    assert [x[:4] for x in a] == [x[:4] for x in b]
    assert np.allclose([x[4] for x in a], [x[4] for x in b])
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_probabilities_are_normalised(documents):
    """Given any two tokens, the probabilities of all tokens of the vocabulary sum to 1, computed the long way round."""
    rows = [(i, "a b c d a b e " * (i % 5 + 1)) for i in range(40)]
    counts = L.count_tokens(documents(rows))
    v = L.vocabulary(counts, 6)
    assert v.tokens == sum(len(tokens_of(t)) for _, t in rows) and v.types == 6 and len(v.counts) == 6
    assert np.isclose(v.shares().sum(), 1)
    draw = np.random.default_rng(0)
    model = L.Model.start(v, 4)
    model.places = draw.normal(size=model.places.shape).astype(np.float32)
    model.tokens, model.contexts = (draw.normal(size=x.shape).astype(np.float32) for x in (model.tokens, model.contexts))
    n = len(v.counts)
    for one in range(n + 1):
        for two in range(n + 1):
            got = np.exp(model.log_probabilities(np.full(n, one), np.full(n, two), np.arange(n)))
            scores = (model.contexts[one] @ model.places[0] + model.contexts[two] @ model.places[1]) @ model.tokens.T + model.bias
            assert np.allclose(got, np.exp(scores) / np.exp(scores).sum(), rtol=1e-4) and np.isclose(got.sum(), 1, rtol=1e-4)


def test_rare_words_share_their_class(documents):
    """An untrained model gives every token its smoothed share, in the vocabulary or not; so score and base score agree."""
    rows = [(i, f"w{i % 9} w{i % 4} common") for i in range(30)] + [(30, "new words only")]
    got = L.score_texts(documents(rows), F.col("id") < 25, size=5, looked=8, rounds=0, vector=1).collect()
    flat = L.Model.start(L.vocabulary(L.count_tokens(documents(rows[:25])), 5), 1)
    assert np.abs(flat.tokens).max() < 0.5
    for r in got:
        assert abs(r.score - r.base_score) < 0.05 * r.n_tokens


def test_gradient_step_is_the_derivative():
    """One step changes the parameters along the derivative of the noise-contrastive objective."""
    draw = np.random.default_rng(2)
    v = L.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.array([3, 4, 5, 6]), 18, 4)
    model = L.Model(*(draw.normal(size=s).astype(np.float64) for s in ((5, 3), (4, 3), (2, 3, 3), (4,))))
    before, two, token = np.array([0, 4, 2]), np.array([4, 4, 1]), np.array([1, 2, 2])
    trainer = L.Trainer(model, v.shares(), noise=6, rate=1e-3, seed=9)
    drawn = np.random.default_rng(9).choice(4, 6, p=trainer.shares)

    def objective(m):
        p = m.contexts[before] @ m.places[0] + m.contexts[two] @ m.places[1]
        off = np.log(trainer.shares * 6)
        true = (p * m.tokens[token]).sum(1) + m.bias[token] - off[token]
        false = p @ m.tokens[drawn].T + m.bias[drawn] - off[drawn]
        return float(np.mean(-np.log1p(np.exp(-true)) - np.log1p(np.exp(false)).sum(1)))

    trainer.step(before, two, token)
    for name, array in (("contexts", model.contexts), ("tokens", model.tokens), ("places", model.places), ("bias", model.bias)):
        for at in np.ndindex(array.shape):
            kept, h = array[at], 1e-5
            array[at] = kept + h
            up = objective(model)
            array[at] = kept - h
            g = (up - objective(model)) / (2 * h)
            array[at] = kept
            moved = getattr(trainer.m, name)[at] - kept
            assert abs(moved - 1e-3 * g / math.sqrt(1e-2 + g * g)) < 1e-6


def test_learns_order(documents):
    """Held-out texts in the order of the training texts get far more than by counts, shuffled ones less."""
    draw = np.random.default_rng(4)
    cycle = ["red", "green", "blue", "white", "black", "pink"]
    text = lambda at, n: " ".join(cycle[(at + i) % 6] for i in range(n))
    rows = [(i, text(i, 40)) for i in range(300)] + [(1000, text(2, 50)), (1001, " ".join(draw.permutation(text(2, 50).split())))]
    got = {r.id: r for r in L.score_texts(documents(rows), F.col("id") < 1000, size=16, vector=8, rounds=1, step=32, noise=16).collect()}
    assert got[1000].base_score == pytest.approx(got[1001].base_score)
    assert got[1000].score > 0.5 * got[1000].base_score and got[1001].score < got[1000].score - 5


def test_no_training_rows_and_empty(documents):
    got = L.score_texts(documents([(1, "a b", "x"), (2, None, "y")], "training"), F.col("id") > 5).collect()
    assert sorted((r.id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert L.score_texts(documents([]), F.col("id") > 5).collect() == []


def test_query_beats_counts(spark, folder):
    rows = corpus.QUERIES["op13_log_bilinear_scores"](spark, folder).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    out = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    want = {k: w for (k, _), w in zip(docs, base_of(docs, lambda k: not out(k)))}
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == out(r.doc_id) and (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
