"""Gradient boosting over histograms.

Features are binned once at sketch quantiles and stored, a block of rows and one byte per value. For every level of a tree one
pass sums the gradients and second derivatives of the loss by node, feature and bin in each task, and Spark adds the sums of
the tasks up; splits are then found from these sums, whose number doesn't depend on the rows. Of two sister nodes only
the smaller one is summed, the other is what its parent leaves. All classes of a round are grown in the same passes.

A pass over a table of few rows (``PASS_ROWS``) is over sooner than a job starts. There a model is grown by one task that holds all blocks, and
the models of a parameter grid are dealt to tasks; rows, sums and rules are the same.

Three ways to grow a tree: ``level`` splits every node that gains, ``leaf`` the leaves that gain most until there are
``maxLeaves``, ``symmetric`` all nodes of a level by one feature and threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.functions.columns import col
from tablelab.models.custom import _Base, _classes, _Fitted, _param
from tablelab.session import PASS_ROWS, checkpointed, discard

#: Bin of missing values; others are below.
MISSING = 255
#: Rows of a block, and rounds after which the scores so far are stored with the blocks.
BLOCK, KEPT_ROUNDS = 16_384, 8
#: Up to so many cuts, features are looked at apart from those with more.
NARROW = 32


@dataclass
class Node:
    depth: int
    sums: np.ndarray  # gradients, second derivatives, rows
    hist: np.ndarray | None = None  # (feature, bin, sums)
    gain: float = 0.0
    feature: int = -1
    bin: int = 0
    missing_left: bool = False
    children: tuple[int, int] | None = None
    known: bool = False  # its best split, or that it has none


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=list)
    picked: set = field(default_factory=set)  # nodes that are split for good


def first_scores(y: np.ndarray, w: np.ndarray, problem: str, classes: int) -> np.ndarray:
    """The best constant scores, from the sums of labels."""
    if problem == "regression":
        return np.array([float((w * y).sum() / w.sum())])
    shares = np.array([w[y == c].sum() for c in range(classes)]) / w.sum()
    if classes == 2:
        return np.array([math.log(max(shares[1], 1e-12) / max(shares[0], 1e-12))])
    return np.log(np.maximum(shares, 1e-12))


def derivatives(y: np.ndarray, w: np.ndarray, scores: np.ndarray, problem: str) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by score; one row for each tree of a round."""
    if problem == "regression":
        return w * (scores - y), np.broadcast_to(w, scores.shape)
    if len(scores) == 1:
        p = 1 / (1 + np.exp(-scores))
        return w * (p - y), w * p * (1 - p)
    p = np.exp(scores - scores.max(0))
    p /= p.sum(0)
    return w * (p - (y == np.arange(len(scores))[:, None])), w * p * (1 - p)


def tree_of(tree: Tree, cuts: list[np.ndarray], rate: float, l2: float) -> dict[str, list]:
    """A grown tree as arrays; ``value`` is the score of a leaf, ``cover`` the rows of a node."""
    out: dict[str, list] = {k: [] for k in ("feature", "threshold", "bin", "missing_left", "left", "right", "value", "cover", "gain")}

    def add(at: int) -> int:
        node, me = tree.nodes[at], len(out["feature"])
        inner = at in tree.picked
        row = (node.feature if inner else -1, float(cuts[node.feature][node.bin]) if inner else 0.0, node.bin, node.missing_left, 0, 0,
               -rate * float(node.sums[0] / (node.sums[1] + l2)) if node.sums[1] + l2 > 0 else 0.0, float(node.sums[2]), node.gain if inner else 0.0)
        for k, v in zip(out, row):
            out[k].append(v)
        if inner:
            out["left"][me], out["right"][me] = (add(c) for c in node.children)
        return me

    add(0)
    return out


def leaf_places(tree: dict, go_left) -> np.ndarray:
    """The node each row ends in; ``go_left(node, rows)`` says where rows go at their nodes."""
    at = go_left(None, None)
    feature, left, right = (np.asarray(tree[k]) for k in ("feature", "left", "right"))
    while True:
        rows = np.flatnonzero(feature[at] >= 0)
        if not len(rows):
            return at
        nodes = at[rows]
        at[rows] = np.where(go_left(nodes, rows), left[nodes], right[nodes])


def by_bins(tree: dict, bins: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Nodes that rows end in, from bins (feature, row), from the root or from nodes they are known to reach."""
    feature, cut, missing = (np.asarray(tree[k]) for k in ("feature", "bin", "missing_left"))

    def go(nodes, rows):
        if nodes is None:
            return np.zeros(bins.shape[1], np.int64) if start is None else start
        b = bins[feature[nodes], rows]
        return np.where(b == MISSING, missing[nodes], b <= cut[nodes])

    return leaf_places(tree, go)


def by_values(tree: dict, x: np.ndarray) -> np.ndarray:
    """Nodes that rows end in, from values (row, feature)."""
    feature, cut, missing = (np.asarray(tree[k]) for k in ("feature", "threshold", "missing_left"))

    def go(nodes, rows):
        if nodes is None:
            return np.zeros(len(x), np.int64)
        v = x[rows, feature[nodes]]
        return np.where(np.isnan(v), missing[nodes], v <= cut[nodes])

    return leaf_places(tree, go)


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """(feature, row) bins: a value is in bin b if it is above the cuts before b and not above cut b."""
    out = np.empty((len(cuts), len(x)), np.uint8)
    for f, c in enumerate(cuts):
        out[f] = np.where(np.isnan(x[:, f]), MISSING, np.searchsorted(c, x[:, f], side="left"))
    return out


def _stored(cuts: list[np.ndarray], first: np.ndarray):
    """Rows (x, y, w) to blocks: rows, bins, labels, weights and first scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
                scores = np.repeat(first[:, None], part.num_rows, axis=1)
                cells = [pa.array([v], t) for v, t in ((part.num_rows, pa.int32()), (binned(x, cuts).tobytes(), pa.binary()), (
                    part.column(1).to_numpy().astype(float).tobytes(), pa.binary()), (part.column(2).to_numpy().astype(float).tobytes(), pa.binary()), (scores.tobytes(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(cells, ["n", "bins", "y", "w", "scores"])

    return run


BLOCKS = "n int, bins binary, y binary, w binary, scores binary"


def _opened(batch: pa.RecordBatch, i: int, rounds: list[list[dict]]):
    """A block with the scores after ``rounds``, which came after the stored ones."""
    n = batch.column(0)[i].as_py()
    raw = [np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in ((1, np.uint8), (2, float), (3, float), (4, float))]
    bins, scores = raw[0].reshape(-1, n), raw[3].reshape(-1, n).copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            scores[k] += np.asarray(tree["value"])[by_bins(tree, bins)]
    return bins, raw[1], raw[2], scores


def _advanced(rounds: list[list[dict]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                scores = _opened(batch, i, rounds)[3]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in range(4)), pa.array([scores.tobytes()], pa.binary())], batch.schema.names[:5])

    return run


def _summed(rounds: list[list[dict]], growing: list[dict], wanted: list[list[int]], problem: str, share: float, seed: int):
    """Sums of gradients, second derivatives and rows by tree, wanted node, feature and bin, of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for i in range(batch.num_rows):
                bins, y, w, scores = _opened(batch, i, rounds)
                if share < 1:  # the same rows in every pass of a round
                    drawn = np.random.default_rng([seed, batch.column(5)[i].as_py()]).random(len(y)) < share
                    bins, y, w, scores = bins[:, drawn], y[drawn], w[drawn], scores[:, drawn]
                if total is None:
                    total = [np.zeros((len(nodes), len(bins), 256, 3)) for nodes in wanted]
                g, h = derivatives(y, w, scores, problem)
                for k, nodes in enumerate(wanted):
                    place = np.full(len(growing[k]["feature"]), -1)
                    place[nodes] = np.arange(len(nodes))
                    at = place[by_bins(growing[k], bins)]
                    own = np.flatnonzero(at >= 0)
                    for f in range(len(bins)):
                        cell = at[own] * 256 + bins[f, own]
                        for s, v in enumerate((g[k, own], h[k, own], None)):
                            total[k][:, f, :, s] += np.bincount(cell, v, len(nodes) * 256).reshape(-1, 256)
        found = [np.argwhere(t[:, :, :, 2] > 0) for t in total or []]
        columns = [np.concatenate([np.full(len(x), k) for k, x in enumerate(found)] or [[]]), *(np.concatenate([x[:, c] for x in found] or [[]]) for c in range(3))]
        sums = np.concatenate([t[tuple(x.T)] for t, x in zip(total or [], found)] or [np.zeros((0, 3))])
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c.astype(np.int32), pa.int32()) for c in columns), *(pa.array(sums[:, s], pa.float64()) for s in range(3))], ["k", "node", "feature", "bin", "g", "h", "n"])

    return run


SUMS = "k int, node int, feature int, bin int, g double, h double, n double"


@dataclass
class Rules:
    """What a split has to keep to."""

    depth: int
    leaves: int
    l2: float
    hessian: float
    rows: int
    growth: str
    cuts: list[np.ndarray]
    groups: list[tuple] = field(default_factory=list)  # features of few and of many bins, their bins, and which of them can be cut behind

    def __post_init__(self) -> None:
        n = np.array([len(c) for c in self.cuts])
        for at in (np.flatnonzero((n > 0) & (n <= NARROW)), np.flatnonzero(n > NARROW)):
            if len(at):
                width = int(n[at].max())
                self.groups.append((at, width, np.arange(width)[None, :] < n[at][:, None]))


def gains(hist: np.ndarray, sums: np.ndarray, rules: Rules) -> np.ndarray:
    """(side, feature, bin) gains of splitting behind each bin; -inf where a side is too small. Missing values go to the right, then to the left; without any there is one side."""
    part = lambda g, h: g * g / np.maximum(h + rules.l2, 1e-12)
    out = np.full((2 if hist[:, MISSING, 2].any() else 1, len(hist), MISSING), -np.inf)
    least = max(rules.rows, 1)
    if sums[2] < 2 * least:
        return out
    # Rounded, so that equal splits are equal whatever the order of the sums; the first feature and bin win.
    digits, whole = 9 - int(np.floor(np.log10(max(abs(sums[0]), abs(sums[1]), 1e-9)))), part(sums[0], sums[1])
    for at, width, able in rules.groups:
        cells = [hist[at, :, s] for s in range(3)]
        below = [np.cumsum(c[:, :width], axis=1) for c in cells]
        for side in range(len(out)):
            left = [b + c[:, MISSING:] for b, c in zip(below, cells)] if side else below
            right = [sums[s] - v for s, v in enumerate(left)]
            fits = able
            for _, h, n in (left, right):
                fits = fits & (n >= least) & (h >= rules.hessian)
            found = part(left[0], left[1]) + part(right[0], right[1]) - whole
            out[side, at, :width] = np.where(fits, np.round(found, digits), -np.inf)
    return out


def choose(node: Node, found: np.ndarray) -> None:
    at = int(found.argmax())
    direction, feature, bin_ = np.unravel_index(at, found.shape)
    if found.flat[at] > 1e-9:
        node.gain, node.feature, node.bin, node.missing_left = float(found.flat[at]), int(feature), int(bin_), bool(direction)


def pick(tree: Tree, rules: Rules) -> None:
    """The nodes to split, as far as their gains are known: best first for ``leaf``, else all that gain."""
    tree.picked = set()
    reach = [0]
    while reach and (rules.growth != "leaf" or len(tree.picked) < rules.leaves - 1):
        best = max(reach, key=lambda a: (tree.nodes[a].gain, -a))
        reach.remove(best)
        if tree.nodes[best].feature < 0:
            continue
        tree.picked.add(best)
        reach += tree.nodes[best].children or ()


def grow(trees: list[Tree], summed, rules: Rules) -> None:
    """Grows the trees of a round; ``summed(trees, wanted)`` gives the histograms of nodes, by tree and node."""
    new = [[0] for _ in trees]  # the root, then the smaller one of each pair of sisters
    while any(new):
        wanted = [[n for n in nodes if tree.nodes[n].hist is None] for tree, nodes in zip(trees, new)]
        for (k, node), hist in summed(trees, wanted).items():
            trees[k].nodes[node].hist = hist
        for tree in trees:
            for node in [n for n in tree.nodes if n.children and n.hist is not None]:
                left, right = (tree.nodes[c] for c in node.children)
                if left.hist is None and right.hist is not None:
                    left.hist = node.hist - right.hist
                elif right.hist is None and left.hist is not None:
                    right.hist = node.hist - left.hist
                node.hist = None
        for k, tree in enumerate(trees):
            if tree.nodes[0].depth == 0 and tree.nodes[0].hist is not None:
                tree.nodes[0].sums = tree.nodes[0].hist[0].sum(0)
            fresh = [n for n in tree.nodes if n.hist is not None and n.feature < 0 and not n.known and n.depth < rules.depth]
            found = [gains(n.hist, n.sums, rules) for n in fresh]
            if rules.growth == "symmetric" and found:
                found = np.broadcast_arrays(*found)
                total = sum(np.where(np.isfinite(f), f, 0.0) for f in found)
                total = np.where(np.any([np.isfinite(f) for f in found], axis=0), total, -np.inf)
                best = np.unravel_index(int(total.argmax()), total.shape)
                if total[best] > 1e-9:
                    for node in fresh:
                        node.gain, node.feature, node.bin, node.missing_left = float(total[best]), int(best[1]), int(best[2]), bool(best[0])
            else:
                for node, f in zip(fresh, found):
                    choose(node, f)
                    node.known = True
            pick(tree, rules)
            new[k] = []
            for at in sorted(tree.picked):
                node = tree.nodes[at]
                if node.children is None:
                    left = node.hist[node.feature, : node.bin + 1].sum(0) + (node.hist[node.feature, MISSING] if node.missing_left else 0)
                    node.children = (len(tree.nodes), len(tree.nodes) + 1)
                    tree.nodes += [Node(node.depth + 1, left), Node(node.depth + 1, node.sums - left)]
                    if node.depth + 1 < rules.depth:
                        new[k].append(node.children[int(left[2] > node.sums[2] - left[2])])
        for tree in trees:
            pick(tree, rules)


def skeleton(tree: Tree) -> dict[str, list]:
    """The tree as far as it has children, with its own node numbers."""
    nodes = tree.nodes
    inner = [n.children is not None for n in nodes]
    return {
        "feature": [n.feature if i else -1 for n, i in zip(nodes, inner)], "bin": [n.bin for n in nodes], "missing_left": [n.missing_left for n in nodes],
        "left": [n.children[0] if i else 0 for n, i in zip(nodes, inner)], "right": [n.children[1] if i else 0 for n, i in zip(nodes, inner)]}


TREE = {"feature": "int", "threshold": "double", "bin": "int", "missing_left": "boolean", "left": "int", "right": "int", "value": "double", "cover": "double", "gain": "double"}
TREES = "fit int, round int, k int, " + ", ".join(f"{k} array<{v}>" for k, v in TREE.items())
ARROW = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


class Held:
    """Sums of nodes from blocks that a task holds. Rows keep their places from one level to the next."""

    def __init__(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray):
        self.bins, self.g, self.h, self.at = bins, g, h, np.zeros(g.shape, np.int64)
        self.cells = bins + np.arange(len(bins))[:, None] * 256

    def __call__(self, trees: list[Tree], wanted: list[list[int]]) -> dict:
        out = {}
        for k, (tree, nodes) in enumerate(zip(trees, wanted)):
            if not nodes:
                continue
            grown, at = skeleton(tree), self.at[k]
            at[:] = by_bins(grown, self.bins, at)
            place = np.full(len(tree.nodes), -1)
            place[nodes] = np.arange(len(nodes))
            place = place[at]
            own = np.flatnonzero(place >= 0)
            cell = (self.cells[:, own] + place[own] * (len(self.bins) * 256)).ravel()
            weights = [np.broadcast_to(v[k, own], (len(self.bins), len(own))).ravel() for v in (self.g, self.h)]
            sums = np.stack([np.bincount(cell, v, len(nodes) * len(self.bins) * 256) for v in (*weights, None)])
            for node, hist in zip(nodes, np.moveaxis(sums.reshape(3, len(nodes), len(self.bins), 256), 0, -1)):
                out[(k, node)] = hist
        return out


def _whole(fits: list[dict], cuts: list[np.ndarray], problem: str):
    """Rows of all blocks, each with the number of the model they are for, to the trees of the models."""
    schema = pa.schema([*((c, pa.int32()) for c in ("fit", "round", "k")), *((c, pa.list_(ARROW[v])) for c, v in TREE.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                held.setdefault(batch.column(6)[i].as_py(), []).append((*_opened(batch, i, []), batch.column(5)[i].as_py()))
        for fit, blocks in held.items():
            blocks.sort(key=lambda b: b[4])
            p, sizes = fits[fit], [len(b[1]) for b in blocks]
            bins, scores = (np.concatenate([b[c] for b in blocks], axis=1) for c in (0, 3))
            y, w = (np.concatenate([b[c] for b in blocks]) for c in (1, 2))
            rules = Rules(**p["rules"], cuts=cuts)
            for r in range(p["rounds"]):
                x, (g, h) = bins, derivatives(y, w, scores, problem)
                if p["share"] < 1:
                    drawn = np.concatenate([np.random.default_rng([p["seed"] + r, b[4]]).random(n) < p["share"] for b, n in zip(blocks, sizes)])
                    x, g, h = bins[:, drawn], g[:, drawn], h[:, drawn]
                trees = [Tree([Node(0, np.zeros(3))]) for _ in scores]
                grow(trees, Held(x, g, h), rules)
                made = [tree_of(t, cuts, p["rate"], rules.l2) for t in trees]
                for k, tree in enumerate(made):
                    scores[k] += np.asarray(tree["value"])[by_bins(tree, bins)]
                yield pa.RecordBatch.from_pylist([{"fit": fit, "round": r, "k": k, **tree} for k, tree in enumerate(made)], schema)
                if all(len(t["feature"]) == 1 for t in made):  # nothing gains any more
                    break

    return run


class BoostModel(_Fitted):
    """Sums of tree scores: ``probability`` and ``prediction`` for classes, ``prediction`` for numbers."""

    def scores(self, x: np.ndarray) -> np.ndarray:
        """(row, score) before the link function."""
        out = np.repeat(np.array(self.state["first"])[None, :], len(x), axis=0)
        for trees in self.state["rounds"]:
            for k, tree in enumerate(trees):
                out[:, k] += np.asarray(tree["value"])[by_values(tree, x)]
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        classes = self.state["classes"]

        @F.pandas_udf("array<double>")
        def run(batch: pd.Series) -> pd.Series:
            if not len(batch):
                return pd.Series([], dtype=object)
            s = self.scores(np.stack(batch.to_numpy()).astype(float))
            if classes is None:
                return pd.Series(list(s))
            if len(classes) == 2:
                p = 1 / (1 + np.exp(-s))
                return pd.Series(list(np.concatenate([1 - p, p], axis=1)))
            p = np.exp(s - s.max(axis=1, keepdims=True))
            return pd.Series(list(p / p.sum(axis=1, keepdims=True)))

        out = df.withColumn("_scores", run(vector_to_array(self.getFeaturesCol())))
        if classes is None:
            return out.withColumn(self.getPredictionCol(), F.col("_scores")[0]).drop("_scores")
        best = F.array_position("_scores", F.array_max("_scores")).cast("int")
        value = F.element_at(F.array(*[F.lit(float(c)) for c in classes]), best)
        return out.withColumn(self.getPredictionCol(), value).withColumn("probability", array_to_vector("_scores")).drop("_scores")

    @property
    def featureImportances(self) -> DenseVector:
        """The gain of all splits of each feature, as shares."""
        total = np.zeros(self.state["features"])
        for trees in self.state["rounds"]:
            for tree in trees:
                for f, g in zip(tree["feature"], tree["gain"]):
                    total[f] += g if f >= 0 else 0.0
        return Vectors.dense(total / (total.sum() or 1.0))


def tree_table(df: DataFrame, model: BoostModel, features: list[str]) -> DataFrame:
    """All nodes of all trees: the way from the root as L and R, the split (feature null at a leaf), rows, gain and score."""
    rows = []
    for r, trees in enumerate(model.state["rounds"]):
        for k, t in enumerate(trees):
            todo = [(0, "")]
            while todo:
                at, path = todo.pop()
                inner = t["feature"][at] >= 0
                rows.append((r, k, path, features[t["feature"][at]] if inner else None, float(t["threshold"][at]) if inner else None, bool(t["missing_left"][at]) if inner else None,
                             int(t["cover"][at]), float(t["gain"][at]), float(t["value"][at])))
                if inner:
                    todo += [(t["left"][at], path + "L"), (t["right"][at], path + "R")]
    return df.sparkSession.createDataFrame(rows, "round int, tree int, path string, feature string, threshold double, missing_left boolean, rows long, gain double, score double")


class HistBoost(Estimator, _Base):
    """Boosted trees with second-order gains; missing values go to the side that gains more."""

    problem = _param(None, "problem", "classification or regression", TypeConverters.toString)
    weightCol = _param(None, "weightCol", "weight of a row, empty for 1", TypeConverters.toString)
    maxIter = _param(None, "maxIter", "rounds", TypeConverters.toInt)
    stepSize = _param(None, "stepSize", "shrinkage of the leaf scores", TypeConverters.toFloat)
    maxDepth = _param(None, "maxDepth", "levels of splits", TypeConverters.toInt)
    maxLeaves = _param(None, "maxLeaves", "leaves of a tree grown by leaf", TypeConverters.toInt)
    l2 = _param(None, "l2", "penalty of squared leaf scores", TypeConverters.toFloat)
    minHessian = _param(None, "minHessian", "least sum of second derivatives on each side", TypeConverters.toFloat)
    minInstancesPerNode = _param(None, "minInstancesPerNode", "least rows on each side", TypeConverters.toInt)
    subsamplingRate = _param(None, "subsamplingRate", "share of the rows each round sees", TypeConverters.toFloat)
    maxBins = _param(None, "maxBins", "bins of a feature, at most 255", TypeConverters.toInt)
    growth = _param(None, "growth", "level, leaf or symmetric", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, predictionCol=None, problem=None, weightCol=None, maxIter=None, stepSize=None, maxDepth=None,
                 maxLeaves=None, l2=None, minHessian=None, minInstancesPerNode=None, subsamplingRate=None, maxBins=None, growth=None):
        super().__init__()
        self._setDefault(problem="classification", weightCol="", maxIter=100, stepSize=0.1, maxDepth=6, maxLeaves=31, l2=1.0, minHessian=0.0,
                         minInstancesPerNode=1, subsamplingRate=1.0, maxBins=255, growth="level")
        self.setup(self._input_kwargs)

    def _cuts(self, df: DataFrame, d: int) -> list[np.ndarray]:
        """Sketch quantiles of each feature without the largest value, above which nothing can be cut off."""
        n = min(max(self.getOrDefault("maxBins"), 2), MISSING)
        wide = df.select(*[F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]).alias(f"x{i}") for i in range(d)])
        found = wide.approxQuantile([f"x{i}" for i in range(d)], [i / n for i in range(1, n)] + [1.0], 0.25 / n)
        return [np.unique(q)[:-1] if len(q) else np.zeros(0) for q in found]

    def _fit(self, df: DataFrame) -> BoostModel:
        [model] = fit_all([self], df)
        return model

    def _rules(self) -> dict:
        get = self.getOrDefault
        return {"depth": get("maxDepth"), "leaves": get("maxLeaves"), "l2": get("l2"), "hessian": get("minHessian"), "rows": get("minInstancesPerNode"), "growth": get("growth")}

    def _rounds(self, blocks: DataFrame, cuts: list[np.ndarray], first: np.ndarray) -> list[list[dict]]:
        """The trees, from a pass over the blocks for every level. The blocks stay."""
        get, problem = self.getOrDefault, self.getOrDefault("problem")
        rules = Rules(**self._rules(), cuts=cuts)
        given, rounds, fresh, tasks = blocks, [], [], blocks.rdd.getNumPartitions()  # the sums of a single task are the whole sums
        for r in range(get("maxIter")):
            if len(fresh) == KEPT_ROUNDS:
                older = blocks
                blocks = checkpointed(blocks.mapInArrow(_advanced(fresh), BLOCKS).withColumn("number", F.monotonically_increasing_id()))
                if older is not given:
                    discard(older)
                fresh, tasks = [], blocks.rdd.getNumPartitions()

            def summed(trees: list[Tree], wanted: list[list[int]]) -> dict:
                run = _summed(fresh, [skeleton(t) for t in trees], wanted, problem, get("subsamplingRate"), self.getSeed() + r)
                cells = blocks.mapInArrow(run, SUMS)
                if tasks > 1:
                    cells = cells.groupBy("k", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
                c = cells.toPandas()  # nodes x features x bins at most
                out = {(k, node): np.zeros((len(cuts), 256, 3)) for k, nodes in enumerate(wanted) for node in nodes}
                for (k, place), part in c.groupby(["k", "node"]):
                    out[(k, wanted[k][place])][part["feature"], part["bin"]] = part[["g", "h", "n"]].to_numpy()
                return out

            trees = [Tree([Node(0, np.zeros(3))]) for _ in first]
            grow(trees, summed, rules)
            made = [tree_of(t, cuts, get("stepSize"), get("l2")) for t in trees]
            rounds.append(made)
            fresh.append(made)
            if all(len(t["feature"]) == 1 for t in made):  # nothing gains any more
                break
        if blocks is not given:
            discard(blocks)
        return rounds


def _grown_at_once(estimators: Sequence[HistBoost], blocks: DataFrame, cuts: list[np.ndarray]) -> list[pd.DataFrame]:
    """The trees of each estimator, a row each: every task holds all blocks and grows one model."""
    fits = [{"rules": e._rules(), "rounds": e.getOrDefault("maxIter"), "rate": e.getOrDefault("stepSize"), "share": e.getOrDefault("subsamplingRate"), "seed": e.getSeed()} for e in estimators]
    one = blocks.select(*blocks.columns[:5], "number")
    if len(fits) == 1:
        dealt = one.coalesce(1).withColumn("fit", F.lit(0))
    else:
        numbers = blocks.sparkSession.range(0, len(fits), 1, len(fits)).select(F.col("id").cast("int").alias("fit"))
        dealt = numbers.crossJoin(F.broadcast(one)).select(*one.columns, "fit")
    trees = dealt.mapInArrow(_whole(fits, cuts, estimators[0].getOrDefault("problem")), TREES).toPandas()
    return [trees[trees["fit"] == i] for i in range(len(fits))]


def fit_all(estimators: Sequence[HistBoost], df: DataFrame) -> Iterator[BoostModel]:
    """Models of estimators that differ in how they grow trees only. Rows are binned once, and of estimators
    that differ in ``maxIter`` only the longest is grown: its first rounds are the others."""
    self = estimators[0]
    get, problem = self.getOrDefault, self.getOrDefault("problem")
    classes = _classes(df, self.getLabelCol()) if problem == "classification" else None
    w = col(get("weightCol")).cast("double") if get("weightCol") else F.lit(1.0)
    label = col(self.getLabelCol()).cast("double")
    if classes is not None:
        label = F.array_position(F.array(*[F.lit(float(c)) for c in classes]), label).cast("double") - 1
    rows = df.select(vector_to_array(self.getFeaturesCol()).alias("x"), label.alias("y"), w.alias("w"))
    one = rows.select(F.size("x").alias("d")).first()
    if one is None:
        raise ValueError("no rows to learn from")
    if classes is not None:
        sums = rows.groupBy("y").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).orderBy("y").collect()  # one row per class
        first, n = first_scores(np.array([r["y"] for r in sums]), np.array([r["w"] for r in sums]), problem, len(classes)), sum(r["n"] for r in sums)
    else:
        mean, n = rows.agg(F.sum(F.col("y") * F.col("w")) / F.sum("w"), F.count(F.lit(1))).first()
        first = np.array([float(mean)])
    cuts = self._cuts(rows, one["d"])
    blocks = checkpointed(rows.mapInArrow(_stored(cuts, first), BLOCKS).withColumn("number", F.monotonically_increasing_id()))
    like = [tuple(v for p, v in sorted(e.extractParamMap().items(), key=lambda x: x[0].name) if p.name != "maxIter") for e in estimators]
    longest = {k: max((e for e, other in zip(estimators, like) if other == k), key=lambda e: e.getOrDefault("maxIter")) for k in like}
    try:
        if n <= PASS_ROWS:
            grown = dict(zip(longest, _grown_at_once(list(longest.values()), blocks, cuts)))
            rounds_of = lambda k: [[{c: np.asarray(t[c]).tolist() for c in TREE} for t in trees.to_dict("records")] for _, trees in grown[k].sort_values(["round", "k"]).groupby("round")]
        else:
            known: dict = {}
            rounds_of = lambda k: known[k] if k in known else known.setdefault(k, longest[k]._rounds(blocks, cuts, first))
        for e, k in zip(estimators, like):
            yield BoostModel(e, classes=classes, first=first.tolist(), rounds=rounds_of(k)[:e.getOrDefault("maxIter")], features=len(cuts))
    finally:
        discard(blocks)
