"""Hard-negative mining over a multiway hyperplane tree.

The score of two integer vectors is their inner product. With one more component, sqrt(M - |x|^2) for the largest squared
length M of all rows and 0 for a query, scores become distances: |q - x|^2 = |q|^2 + M - 2 * score. So a window of scores is
an annulus around the query.

The tree (after GNAT) is fitted on a bounded sample: a node has several split points, far from each other, and a row belongs
to the one it is nearest to. All rows are then sent down; each split point keeps the smallest and the largest distance to the
rows of every sibling subtree, over all rows. A search drops a subtree if, seen from some split point, its range
doesn't meet what the annulus allows; the leaves that are left are compared exactly, in whole numbers. A first round
visits one leaf for each query, which raises the lower score of its window; a second one visits all leaves that remain.

Leaves are stored in blocks of rows and queries in chunks of near ones; a chunk meets the blocks of all leaves that one of
its queries can't leave out. So a leaf that holds a third of the rows is many tasks, and vectors travel once for a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab.llm.vector_codes import one_length, sound, whole_numbers
from tablelab.session import checkpointed

#: Integer steps of 1.0; positives of an anchor and negatives of a pair; the lowest score of a negative in percent of the positive's.
SCALE, POSITIVES, NEGATIVES, PERCENT = 256, 5, 5, 80
#: Rows the tree is fitted on, split points of a node, and sample rows below which a node is a leaf.
SAMPLE, SPLITS, LEAF = 4096, 8, 48
#: Rows of a block of a leaf and of a chunk of queries.
BLOCK, CHUNK = 4096, 256


@dataclass
class Tree:
    """Nodes by number: split points (with their added component), the child of each (a node, or ~leaf), and ranges once all rows are known."""

    points: list[np.ndarray]
    children: list[np.ndarray]
    top: int  # the largest squared length M
    leaves: int
    ranges: list[np.ndarray] | None = None  # by node: (split point, subtree, low and high)


def lifted(v: np.ndarray, top: int) -> np.ndarray:
    """Rows with the component that gives all of them the squared length ``top``."""
    v = v.astype(np.float64)
    return np.concatenate([v, np.sqrt(np.maximum(top - (v**2).sum(1), 0.0))[:, None]], axis=1)


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (points**2).sum(1)[None, :] - 2 * x @ points.T, 0.0))


def slack(top: int) -> float:
    """What rounding can move a distance by, with room to spare."""
    return 1e-6 * (1.0 + np.sqrt(float(top)))


def fit_tree(sample: np.ndarray, top: int, splits: int = SPLITS, leaf: int = LEAF) -> Tree:
    """A tree over sample rows; the split points of a node are chosen greedily, each the farthest from those before it."""
    tree = Tree([], [], top, 0)

    def grow(x: np.ndarray) -> int:
        if len(x) <= leaf:
            tree.leaves += 1
            return ~(tree.leaves - 1)
        chosen, nearest = [0], distances(x, x[:1])[:, 0]
        while len(chosen) < splits and nearest.max() > 2 * slack(top):
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, distances(x, x[chosen[-1:]])[:, 0])
        if len(chosen) == 1:  # one value only
            tree.leaves += 1
            return ~(tree.leaves - 1)
        at = len(tree.points)
        tree.points.append(x[chosen])
        tree.children.append(np.zeros(len(chosen), np.int64))
        side = distances(x, x[chosen]).argmin(1)
        for j in range(len(chosen)):
            tree.children[at][j] = grow(x[side == j])
        return at

    root = grow(lifted(sample, top))
    if root < 0:  # a single leaf
        tree.points.append(lifted(sample[:1], top))
        tree.children.append(np.array([root]))
    return tree


def descend(tree: Tree, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(node, rows there, their distances to its split points, the subtree each goes to), node by node; the root is number 0."""
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        d = distances(x[rows], tree.points[node])
        side = d.argmin(1)
        yield node, rows, d, side
        todo += [(int(c), rows[side == j]) for j, c in enumerate(tree.children[node]) if c >= 0]


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for node, rows, _, side in descend(tree, x):
        child = tree.children[node][side]
        out[rows[child < 0]] = ~child[child < 0]
    return out


def leaves_met(tree: Tree, q: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, leaf) pairs that the ranges can't exclude for rows at a distance from ``near`` to ``far``."""
    room, out = slack(tree.top), []
    todo = [(0, np.arange(len(q)))]
    while todo:
        node, rows = todo.pop()
        d = distances(q[rows], tree.points[node])
        low = np.maximum(d - far[rows][:, None], near[rows][:, None] - d) - room
        high = d + far[rows][:, None] + room
        ranges = tree.ranges[node]
        alive = ((ranges[None, :, :, 0] <= high[:, :, None]) & (ranges[None, :, :, 1] >= low[:, :, None])).all(axis=1)
        for j, child in enumerate(tree.children[node]):
            met = rows[alive[:, j]]
            if len(met) and child >= 0:
                todo.append((int(child), met))
            elif len(met):
                out.append((met, np.full(len(met), ~child)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([m for m, _ in out]), np.concatenate([x for _, x in out])


def _bytes(v: np.ndarray) -> pa.Array:
    width = v.shape[1] * 4
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(v), [None, pa.py_buffer(np.ascontiguousarray(v.astype("<i4")).tobytes())]).cast(pa.binary())


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, size).astype(np.float64)


def _integers(size: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = whole_numbers(batch.column(2), size, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _bytes(v), pa.array((v**2).sum(1))], ["id", "label", "v", "length"])

    return run


def _placed(tree: Tree, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = leaf_of(tree, lifted(_vectors(batch.column(2), size), tree.top))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], ["leaf", "id", "label", "v"])

    return run


def _ranges(tree: Tree, size: int):
    """Smallest and largest distance of each split point to the rows of each subtree, of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.stack([np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)], axis=2) for p in tree.points]
        for batch in batches:
            for node, _, d, side in descend(tree, lifted(_vectors(batch.column(0), size), tree.top)):
                for j in np.unique(side):
                    own = d[side == j]
                    found[node][:, j, 0] = np.minimum(found[node][:, j, 0], own.min(0))
                    found[node][:, j, 1] = np.maximum(found[node][:, j, 1], own.max(0))
        rows = [(n, i, j, r[i, j, 0], r[i, j, 1]) for n, r in enumerate(found) for i in range(len(r)) for j in range(len(r)) if r[i, j, 0] < np.inf]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:3]), *(pa.array(c, pa.float64()) for c in cols[3:])], ["node", "i", "j", "low", "high"])

    return run


def _packed(names: list[str], most: int, apart: bool):
    """Rows ordered by leaf, at most ``most`` as one row with a list for each column; ``apart`` keeps leaves in rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(leaf)) + 1 if apart else []
            cuts = np.unique(np.concatenate([[0, len(leaf)], edges, np.arange(0, len(leaf), most)])).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), batch.column(i)) for i in range(1, len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cuts[:-1])), *lists], names)

    return run


def _pack(rows: DataFrame, most: int, apart: bool = True) -> DataFrame:
    """``rows`` (leaf, id, ...) packed by leaf and numbered. A leaf is dealt to many tasks by the hash of the id, so none has a whole large one."""
    tasks = max(1, -(-rows.count() // (16 * most)))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(tasks))).repartition(tasks, "salt").drop("salt").sortWithinPartitions("leaf")
    schema = T.StructType([rows.schema["leaf"], *(T.StructField(f.name, T.ArrayType(f.dataType)) for f in rows.schema.fields if f.name != "leaf")])
    return checkpointed(dealt.mapInArrow(_packed(rows.columns, most, apart), schema).withColumn("number", F.monotonically_increasing_id()))


WINDOWS = "array<struct<positive: long, low: long, high: long>>"
HIT = "anchor long, positive long, id long, score long"


def _home(tree: Tree, size: int):
    """Rows (id, label, v, windows) with the leaf that they themselves would go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = leaf_of(tree, lifted(_vectors(batch.column(2), size), tree.top))
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), *batch.columns], ["leaf", *batch.schema.names])

    return run


def _opened(windows: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """A list of windows for each query as one row for each: the query's place, positive, low and high."""
    flat = windows.flatten()
    at = np.repeat(np.arange(len(windows)), np.diff(windows.offsets.to_numpy()))
    low, high = (flat.field(n).to_numpy().astype(np.float64) for n in ("low", "high"))
    return at, flat.field("positive"), low, high


def _met(tree: Tree, size: int):
    """Chunks (number, v, windows) to the leaves that some window of theirs meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q = _vectors(batch.column(1)[i].values, size)
                at, _, low, high = _opened(batch.column(2)[i].values)
                base = ((q**2).sum(1) + tree.top)[at]
                near, far = np.sqrt(np.maximum(base - 2 * high, 0.0)), np.sqrt(np.maximum(base - 2 * low, 0.0))
                leaf = np.unique(leaves_met(tree, np.concatenate([q, np.zeros((len(q), 1))], axis=1)[at], near, far)[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), batch.column(0)[i].as_py()), pa.int64()), pa.array(leaf, pa.int64())], ["chunk", "leaf"])

    return run


def best_hits(scores: np.ndarray, ids: np.ndarray, able: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the ``most`` best able rows of each query, by score and then the smaller id."""
    s = np.where(able, scores, -np.inf)
    if s.shape[1] > most:
        able = able & (s >= np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most][:, None])
    query, row = np.nonzero(able)
    order = np.lexsort((ids[row], -scores[query, row], query))
    query, row = query[order], row[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return query[rank < most], row[rank < most]


def _compared(size: int, same: bool, most: int):
    """Chunks of queries against blocks of rows, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                anchor, label, v, windows, ids, labels, vs = (c[i].values for c in batch.columns)
                mine, theirs = anchor.to_numpy(), ids.to_numpy()
                scores = _vectors(v, size) @ _vectors(vs, size).T  # whole numbers below 2^53
                equal = label.to_numpy()[:, None] == labels.to_numpy()[None, :]
                able = (equal if same else ~equal) & (mine[:, None] != theirs[None, :])
                at, positive, low, high = _opened(windows)
                scores = scores[at]
                query, row = best_hits(scores, theirs, able[at] & (scores >= low[:, None]) & (scores <= high[:, None]), most)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mine[at[query]]), positive.take(pa.array(query)), pa.array(theirs[row]), pa.array(scores[query, row].astype(np.int64))],
                    ["anchor", "positive", "id", "score"])

    return run


class Index:
    """All rows, placed in the leaves of a tree."""

    def __init__(self, rows: DataFrame, size: int, top: int, sample: int = SAMPLE, splits: int = SPLITS, leaf: int = LEAF, block: int = BLOCK):
        """``rows`` are (id, label, v); the sample is taken in the order of a hash of the id."""
        self.size = size
        picked = rows.select("v").orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # bounded
        self.tree = fit_tree(np.array([np.frombuffer(r["v"], "<i4") for r in picked]), top, splits, leaf)
        ranges = rows.select("v").mapInArrow(_ranges(self.tree, size), "node int, i int, j int, low double, high double")
        found = [np.full((len(p), len(p), 2), [np.inf, -np.inf]) for p in self.tree.points]
        for r in ranges.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # split points of all nodes, squared by node
            found[r["node"]][r["i"], r["j"]] = r["low"], r["high"]
        self.tree.ranges = found
        placed = rows.mapInArrow(_placed(self.tree, size), "leaf long, id long, label long, v binary")
        blocks = _pack(placed, block)
        self.blocks = blocks.select("leaf", F.col("number").alias("block"), F.col("id").alias("ids"), F.col("label").alias("labels"), F.col("v").alias("vs"))

    def visit(self, chunks: DataFrame, pairs: DataFrame, same: bool, most: int) -> DataFrame:
        """The best hits of every window of ``chunks`` in the leaves of ``pairs`` (chunk, leaf)."""
        # Numbers of blocks first; vectors meet by block, so a large leaf is spread.
        met = pairs.join(self.blocks.select("leaf", "block"), "leaf").select("chunk", "block")
        asked = chunks.select(F.col("number").alias("chunk"), F.col("id").alias("anchor"), "label", "v", "windows")
        both = met.join(self.blocks.drop("leaf"), "block").join(asked, "chunk").select("anchor", "label", "v", "windows", "ids", "labels", "vs")
        hits = both.mapInArrow(_compared(self.size, same, most), HIT)
        order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id")  # ``most`` rows from each block a window meets
        return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)

    def _chunks(self, queries: DataFrame, windows: DataFrame, apart: bool) -> DataFrame:
        listed = windows.groupBy("anchor").agg(F.collect_list(F.struct("positive", "low", "high")).cast(WINDOWS).alias("windows"))  # one for each positive
        asked = queries.join(listed, F.col("id") == F.col("anchor")).select("id", "label", "v", "windows")
        return _pack(asked.mapInArrow(_home(self.tree, self.size), f"leaf long, id long, label long, v binary, windows {WINDOWS}"), CHUNK, apart)

    def search(self, queries: DataFrame, windows: DataFrame, same: bool, most: int) -> DataFrame:
        """The ``most`` best rows for each window among those of the same label or of others: anchor, positive, id, score, rank.

        ``queries`` are rows of the index, ``windows`` (anchor, positive, low, high) a few for each.
        """
        windows = checkpointed(windows)
        chunks = self._chunks(queries, windows, True)
        first = self.visit(chunks, chunks.select(F.col("number").alias("chunk"), "leaf"), same, most)
        # A window with enough hits needs no score below the last one; an equal one may have a smaller id.
        floor = first.groupBy(F.col("anchor").alias("a"), F.col("positive").alias("p")).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        raised = windows.join(floor, (F.col("anchor") == F.col("a")) & F.col("positive").eqNullSafe(F.col("p")), "left").select(
            "anchor", "positive", F.when(F.col("n") >= most, F.greatest("low", "least")).otherwise(F.col("low")).alias("low"), "high")
        chunks = self._chunks(queries, checkpointed(raised), False)
        pairs = chunks.select("number", "v", "windows").mapInArrow(_met(self.tree, self.size), "chunk long, leaf long")
        return checkpointed(self.visit(chunks, pairs, same, most))


def hard_negatives(df: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE,
                   positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = PERCENT, sample: int = SAMPLE, splits: int = SPLITS,
                   leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """Columns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` chooses the anchors by a column ``id``. An anchor's positives are its ``positives`` best other rows of the
    same label; for each, the ``negatives`` best rows of other labels with percent * positive_score <= 100 * negative_score
    <= 100 * positive_score are returned, ranked from 1. Scores are inner products of floor(scale * x); ties go to the smaller
    key. Rows with a null key or label, or a vector that is null, empty or has a null, NaN or infinite component, take no part;
    of rows with one key the one with the smallest label, then vector, does. Vectors of different lengths raise
    ValueError, as do components so large that scores of floating numbers would be inexact. Other columns are not read;
    an empty table gives no rows. The tree is fitted on ``sample`` rows; every row is indexed and results are exact.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & sound(F.col("x")))
    size = one_length(rows, "x")
    spark = df.sparkSession
    if not size:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not rows.groupBy("id").count().filter("count > 1").isEmpty():
        rows = rows.groupBy("id").agg(F.min(F.struct("label", "x")).alias("m")).select("id", "m.label", "m.x")
    whole = checkpointed(rows.mapInArrow(_integers(size, scale), "id long, label long, v binary, length long"))
    top = int(whole.agg(F.max("length")).first()[0])
    if top >= 1 << 52:
        raise ValueError("scores of these vectors reach 2^52")
    index = Index(whole.drop("length"), size, top, sample, splits, leaf, block)
    chosen = whole.filter(anchors).select("id", "label", "v")
    # No score is beyond the largest squared length.
    asked = chosen.select(F.col("id").alias("anchor"), F.lit(None).cast("long").alias("positive"), F.lit(-top).cast("long").alias("low"), F.lit(top).cast("long").alias("high"))
    found = index.search(chosen, asked, True, positives)
    pairs = found.select("anchor", F.col("id").alias("positive"), F.col("score").alias("high"))
    # A negative score of the positive leaves no window.
    windows = pairs.filter("high >= 0").select("anchor", "positive", F.expr(f"({percent} * high + 99) div 100").alias("low"), "high").filter("low <= high")
    hits = index.search(chosen, windows, False, negatives)
    return hits.join(pairs.withColumnRenamed("high", "best"), ["anchor", "positive"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("best").alias("positive_score"), F.col("score").alias("negative_score"))
