import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelab.llm import hyperplane_tree as H
from tests.llm.test_vector_codes import vectors  # noqa: F401


def expected(rows, scale, positives, negatives, percent, anchors):
    """All scores of all anchors, in plain Python."""
    kept = {}
    for k, v, label in rows:
        if k is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            kept.setdefault(k, []).append((label, v))
    kept = {k: (min(x)[0], [math.floor(scale * c) for c in min(x)[1]]) for k, x in kept.items()}
    out = []
    for a, (label, v) in kept.items():
        if not anchors(a):
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), k, other) for k, (other, w) in kept.items() if k != a)
        for s, p, _ in [x for x in scores if x[2] == label][:positives]:
            able = [(k, -n) for n, k, other in scores if other != label and percent * -s <= 100 * -n <= 100 * -s][:negatives]
            out += [(a, p, i + 1, k, -s, n) for i, (k, n) in enumerate(able)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def clusters(n, size=8, groups=6, spread=0.05):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(groups, size))
    return [(i, [float(np.float32(x)) for x in centres[i % groups] + spread * draw.normal(size=size)], int(i * 7 % 4)) for i in range(n)]


def test_same_as_brute_force(vectors):  # noqa: F811
    rows = clusters(400)
    rows += [(1000 + i, [0.5] * 8, i % 3) for i in range(250)]  # a third are copies, so scores tie
    rows += [(5, [0.1] * 8, 0), (None, [0.5] * 8, 1), (2000, None, 1), (2010, [0.5] * 8, None), (2020, [], 1), (2030, [0.1, None] * 4, 1), (2040, [math.nan] * 8, 1)]
    rows += [(2050, [0.0] * 8, 0), (2060, [-0.5] * 8, 1)]
    want = expected(rows, 64, 3, 4, 80, lambda k: k % 10 == 0)
    assert len(want) > 200
    for block, sample in ((40, 300), (4096, 4096)):  # many blocks of a leaf, and one
        got = H.hard_negatives(vectors(rows), F.col("id") % 10 == 0, scale=64, positives=3, negatives=4, sample=sample, splits=4, leaf=20, block=block)
        assert found(got) == want


def test_tree_leaves_out_what_cannot_be_near():
    """Rows inside an annulus are always in a leaf that is met, and well separated groups are left out."""
    v = np.array([np.floor(64 * np.array(x)) for _, x, _ in clusters(600, spread=0.02)])
    top = int((v**2).sum(1).max())
    tree = H.fit_tree(v[:200], top, 4, 10)
    x = H.lifted(v, top)
    tree.ranges = [np.full((len(p), len(p), 2), [np.inf, -np.inf]) for p in tree.points]
    for node, _, d, side in H.descend(tree, x):
        for j in np.unique(side):
            tree.ranges[node][:, j, 0] = np.minimum(tree.ranges[node][:, j, 0], d[side == j].min(0))
            tree.ranges[node][:, j, 1] = np.maximum(tree.ranges[node][:, j, 1], d[side == j].max(0))
    leaf, q = H.leaf_of(tree, x), v[:40]
    scores = q @ v.T
    for low, high in ((scores.max(1) * 0.95, scores.max(1)), (scores.max(1) * 0.8, scores.max(1) * 0.9)):
        base = (q**2).sum(1) + top
        query, met = H.leaves_met(tree, np.concatenate([q, np.zeros((40, 1))], axis=1), np.sqrt(base - 2 * high), np.sqrt(base - 2 * low))
        pairs = set(zip(query.tolist(), met.tolist()))
        inside = np.argwhere((scores >= low[:, None]) & (scores <= high[:, None]))
        assert all((i, leaf[j]) in pairs for i, j in inside.tolist())
        assert len(pairs) < 40 * tree.leaves / 2


def test_best_hits_with_ties():
    scores = np.array([[5.0, 7, 7, 7, 1, 7]])
    query, row = H.best_hits(scores, np.array([10, 60, 20, 30, 5, 40]), np.array([[True, True, True, True, True, False]]), 2)
    assert query.tolist() == [0, 0] and row.tolist() == [2, 3]


def test_few_rows_empty_tables_and_clashing_names(vectors):  # noqa: F811
    assert H.hard_negatives(vectors([]), F.col("id") % 100 == 0).collect() == []
    assert H.hard_negatives(vectors([(0, [1.0, 0.0], 1)]), F.col("id") % 100 == 0).collect() == []  # no others
    rows = [(0, [1.0, 0.0], 1, "x", "y"), (1, [0.9, 0.0], 1, "x", "y"), (2, [0.8, 0.1], 2, "x", "y"), (3, [-0.8, 0.1], 2, "x", "y")]
    got = H.hard_negatives(vectors(rows, "anchor", "leaf"), F.col("id") % 100 == 0)
    assert found(got) == [(0, 1, 1, 2, 256 * 230, 256 * 204)]
