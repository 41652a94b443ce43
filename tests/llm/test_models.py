"""Toxicity, quality ranking and mixing."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab.llm import mixing, ranking, toxicity
from tablelab.llm.sampling import fold_of, labelled_sample


@pytest.fixture
def labels(spark):
    return lambda rows, name: spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField(name, T.IntegerType())]))


def prose(draw, n=8):
    return " ".join(" ".join(f"w{draw.randrange(300)}" for _ in range(9)) + "." for _ in range(n))


def toxic_rows(n=240, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        text, bad = prose(draw), i % 4 == 0
        if bad:
            parts = text.split(". ")
            parts[draw.randrange(len(parts))] += f" you {draw.choice(['rotter', 'badling', 'badlet', 'badness'])} here"
            text = ". ".join(parts)
        rows.append((i, text, int(bad)))
    return rows


def test_toxicity_learns_from_documents_and_finds_sentences(documents, labels):
    rows = toxic_rows()
    docs, marks = documents([r[:2] for r in rows]), labels([(r[0], r[2]) for r in rows], "toxic")
    model = toxicity.fit_toxicity(docs, marks, fold_of(F.col("id"), 3) != 1)
    scored = {r.doc_id: r for r in toxicity.score_toxicity(docs.withColumn("held", fold_of(F.col("doc_id"), 3) == 1), model, ["doc_id", "held"]).collect()}
    held = [(scored[i], text, bad) for i, text, bad in rows if scored[i].held]
    assert np.mean([(r.score >= 0.7) == bool(bad) for r, _, bad in held]) > 0.95
    for r, text, bad in held:
        for s in r.offending:
            assert bad and any(w in text[s.start : s.end] for w in ("rotter", "badl", "badn"))


def test_toxicity_edges(documents, labels):
    rows = [(1, None, "a"), (2, "", "b"), (None, "Ünder. rotter", "c"), (3, "...", "d"), (3, "...", "d"), (4, "fine words. " * 20_000 + "rotter", "e")]
    model = toxicity.SentenceModel(*(np.array(x) for x in ([], [])), -30.0)
    model = toxicity.SentenceModel(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    out = toxicity.score_toxicity(documents(rows, "score"), model, ["doc_id", "score"])
    assert out.count() == 6 and out.columns == ["doc_id", "score", "score", "offending"]
    draw = toxic_rows(120)
    model = toxicity.fit(pd.DataFrame([{"text": t, "label": y, "weight": 1.0} for _, t, y in draw]))
    found = {r[0]: r for r in toxicity.score_toxicity(documents(rows, "x"), model, ["doc_id"]).collect()}
    assert found[1].score == found[2].score == found[3].score == 0 and not found[3].offending
    assert toxicity.score_toxicity(documents([]), model, ["doc_id"]).count() == 0
    nothing = labels([], "toxic")
    quiet = toxicity.fit_toxicity(documents([(1, "rotter")]), nothing)
    assert toxicity.score_toxicity(documents([(1, "rotter")]), quiet, ["doc_id"]).first().score < 1e-9


def test_noisy_or():
    z, text = np.array([0.0, 1.0, -2.0]), np.array([0, 0, 2])
    p = 1 / (1 + np.exp(-z))
    assert np.allclose(toxicity.noisy_or(z, text, 3), [1 - (1 - p[0]) * (1 - p[1]), 0, p[2]])


def test_sample_is_bounded_and_repeatable(documents, labels):
    docs = documents([(i, f"text {i}" * (i + 1)) for i in range(100)] + [(5, "again")] * 3 + [(None, "x")])
    marks = labels([(i, i % 2) for i in range(100)] + [(3, 0), (None, 1), (500, 1), (7, None), (8, 9)], "y")
    a = labelled_sample(docs, marks, "y", None, 20, 1 << 20)
    b = labelled_sample(docs.repartition(7), marks.repartition(3), "y", None, 20, 1 << 20)
    assert list(a["id"]) == list(b["id"]) and a["id"].is_unique and (a["label"].value_counts() <= 20).all()
    assert (a["label"] == a["id"] % 2).all()
    assert labelled_sample(docs, marks, "y", None, 20, 400)["text"].str.len().sum() <= 400


def junk(draw, kind):
    words = [f"w{draw.randrange(300)}" for _ in range(60)]
    return [" ".join(w + "$$$" for w in words), " ".join(w.upper() + "!!" for w in words), " ".join(w for w in words[:8] for _ in range(9)), " | ".join(words)][kind % 4]


def test_ranking(documents, labels):
    draw = random.Random(2)
    rows = [(i, junk(draw, i // 5) if i % 5 == 0 else prose(draw), int(i % 5 != 0)) for i in range(400)]
    docs, marks = documents([r[:2] for r in rows] + [(900, None), (901, "")]), labels([(r[0], r[2]) for r in rows], "quality")
    got = {r.doc_id: r for r in ranking.quality(docs, marks, fold_of(F.col("id"), 5) != 0).collect()}
    held = [(got[i], y) for i, _, y in rows if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert np.mean([r.predicted == y for r, y in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values()) and {900, 901} <= set(got)
    one = ranking.quality(docs, labels([(1, 1)], "quality")).collect()
    assert all(abs(r.score - 0.3) < 1e-9 for r in one)
    assert ranking.quality(documents([]), marks).collect() == []


def test_pairwise_loss_is_at_its_minimum():
    draw = random.Random(4)
    sample = pd.DataFrame([{"text": junk(draw, i) if i % 3 == 0 else prose(draw), "label": int(i % 3 != 0)} for i in range(90)])
    m = ranking.fit(sample, pairs=500, ridge=0.01)
    x, y = ranking._sample_features(sample), sample["label"].to_numpy()
    good, bad, r = np.flatnonzero(y == 1), np.flatnonzero(y == 0), np.random.default_rng(8)
    d = ((x - m.means) / m.scales)
    i, j = r.permutation(np.resize(good, 500)), r.permutation(np.resize(bad, 500))
    loss = lambda w: np.logaddexp(0, -(d[i] - d[j]) @ w).mean() + 0.005 * w @ w
    assert all(loss(m.weights) <= loss(m.weights + 0.01 * s * e) for e in np.eye(len(m.weights)) for s in (1, -1))


def two_languages(n, seed=6):
    draw = random.Random(seed)
    return [(i, " ".join(f"{'ab'[i % 4 == 0]}{draw.randrange(40)}" for _ in range(20 + draw.randrange(60)))) for i in range(n)]


def test_mixing_meets_targets(spark, documents):
    rows = two_languages(300)
    docs = documents(rows)
    labelled = spark.createDataFrame([(i, "ab"[i % 4 == 0]) for i, _ in rows if i % 2 == 0], "doc_id long, domain string")
    got = mixing.mix(docs, labelled, {"a": 1.0, "b": 1.0}).collect()
    total = sum(r.n_tokens for r in got)
    share = {d: sum(r.rate * r.n_tokens for r in got if r.domain == d) / total for d in "ab"}
    assert abs(share["a"] - 0.5) < 0.03 and abs(share["b"] - 0.5) < 0.03
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    assert sum(1 for r in got if r.domain != "ab"[r.id % 4 == 0]) <= 6


def test_rates_against_brute_force(spark):
    """After sixty steps about as good as a plain projected gradient after thousands, also for a target that is hardly in reach."""
    r = np.random.default_rng(7)
    p = r.dirichlet([0.4, 0.4, 0.4], 200)
    n = r.integers(1, 50, 200)
    members = spark.createDataFrame([(int(t), [float(v) for v in row]) for t, row in zip(n, p)], "n_tokens long, posterior array<double>")
    for weights in ([0.2, 0.3, 0.5], [0.97, 0.02, 0.01]):
        steps, totals, targets = mixing.fit_rates(members, 3, np.array(weights), close=1e-7, iterations=60)
        rates = mixing._rates(p, steps)[0]
        gram = (p * n[:, None]).T @ p
        g = np.linalg.inv(gram)
        x = np.ones(200)
        for _ in range(3000):
            x = np.maximum(0, x - p @ (g @ ((n * x) @ p - targets)))
        miss = lambda v: ((n * v) @ p - targets) @ g @ ((n * v) @ p - targets)
        assert (rates >= 0).all() and np.allclose((n * rates) @ p, totals)
        assert miss(rates) <= miss(x) + 2e-3 * targets.sum()


def test_unmet_targets_are_reported(spark, documents):
    """Where documents of one domain also hold the other's words, nearly all weight on it can't be met: steps go on to the least miss, and gap tells."""
    draw = random.Random(11)
    rows = [(i, " ".join(draw.choice([f"{'ab'[i % 2]}{draw.randrange(9)}", f"c{draw.randrange(9)}", f"{draw.choice('ab')}{draw.randrange(9)}"]) for _ in range(12))) for i in range(240)]
    docs = documents(rows).coalesce(1)
    labelled = spark.createDataFrame([(i, "ab"[i % 2]) for i, _ in rows], "doc_id long, domain string")
    with pytest.warns(UserWarning, match="miss their targets"):
        got = mixing.mix(docs, labelled, {"a": 0.9999, "b": 0.0001}).collect()
    gaps = {r.domain: r.gap for r in got}
    model = mixing.fit_domains(mixing.domain_sample(docs, labelled, "doc_id", "text", mixing.PER_DOMAIN, mixing.MAX_BYTES))
    members = {r.id: r for r in mixing.memberships(docs, model, "doc_id", "text").collect()}
    p, n = np.array([members[r.id].posterior for r in got]), np.array([r.n_tokens for r in got])
    targets = n.sum() * np.array([0.9999, 0.0001])
    found = np.array([r.rate for r in got])
    expected = ((n * found) @ p - targets) / n.sum()
    assert np.allclose(expected, [gaps["a"], gaps["b"]]) and abs(gaps["a"]) > mixing.CLOSE
    # The least possible miss, from many plain steps.
    g = np.linalg.inv((p * n[:, None]).T @ p)
    x = np.ones(len(n))
    for _ in range(20000):
        x = np.maximum(0, x - p @ (g @ ((n * x) @ p - targets)))
    miss = lambda v: ((n * v) @ p - targets) @ g @ ((n * v) @ p - targets)
    assert miss(found) <= miss(x) * 1.25 + 1e-9 * targets.sum()


def test_mixing_edges(spark, documents):
    labelled = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (2, None)], "doc_id long, domain string")
    docs = documents([(1, "a1 a2", "x"), (2, None, "y"), (3, "", "z"), (None, "b1", "w"), (1, "a1 a2", "x")], "domain")
    got = mixing.mix(docs, labelled).collect()
    assert len(got) == 5 and {r.domain for r in got} == {"a"} and all(abs(r.rate - 1) < 1e-6 for r in got)
    assert mixing.mix(documents([]), labelled).collect() == []
    none = mixing.mix(docs, labelled.filter("false")).collect()
    assert {r.domain for r in none} == {""} and all(abs(r.rate - 1) < 1e-6 for r in none)


def test_one_long_text_leaves_the_rest_of_the_sample(spark, documents, labels):
    key = lambda i: F.xxhash64(F.lit(str(i)))
    order = spark.range(1).select(F.array(*[F.struct(key(i).alias("h"), F.lit(i).alias("i")) for i in range(60)]).alias("x")).first().x
    first = min(order, key=lambda r: r.h).i
    docs = documents([(i, "long " * 2000 if i == first else f"text number {i}") for i in range(60)])
    sample = labelled_sample(docs, labels([(i, i % 2) for i in range(60)], "y"), "y", None, 100, 4000)
    assert set(sample["id"]) == set(range(60)) - {first}
    domains = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(60)], "doc_id long, domain string")
    assert set(mixing.domain_sample(docs, domains, "doc_id", "text", 100, 4000)["id"]) == set(range(60)) - {first}
    # A domain of long texts takes nothing from the others.
    docs = documents([(i, ("word " * 40 if i % 3 else "short")) for i in range(60)])
    counts = mixing.domain_sample(docs, domains, "doc_id", "text", 100, 3000)["domain"].value_counts()
    assert counts["a"] == 20 and counts["b"] >= 6 and counts["c"] >= 6
    # Rows are counted behind the bound of a text, too.
    docs = documents([(i, "long " * 2000 if i == first else f"text number {i}") for i in range(60)])
    assert len(labelled_sample(docs, labels([(i, i % 2) for i in range(60)], "y"), "y", None, 5, 4000)) == 10
    with pytest.raises(ValueError, match="longer than"):
        labelled_sample(documents([(1, "long " * 2000), (2, "x")]), labels([(1, 1), (2, 0)], "y"), "y", None, 5, 4000)
    with pytest.raises(ValueError, match="target domains"):
        mixing.mix(docs, domains, {"a": 1.0, "nowhere": 1.0})
