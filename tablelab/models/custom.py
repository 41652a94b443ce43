"""Families without a Spark ML estimator, built from Spark jobs: QDA, nearest neighbours, boosting by
reweighting, bagging, ridge classification and Bayesian ridge. All are Estimators, so they fit into
pipelines and the cross validator."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab.functions.columns import col
from tablelab.models import penalty_paths
from tablelab.operators.moments import class_moments
from tablelab.session import checkpointed, discard

# Training rows up to this number and size in bytes are sent to every task; more are compared block by block.
NEIGHBOUR_BLOCK = 10_000
NEIGHBOUR_BYTES = 64 << 20
QUERY_BLOCK = 2_000
# Pivots for each block of training rows, and the most there are.
BLOCK_PIVOTS, MOST_PIVOTS = 4, 2_048
# Smaller blocks grow to NEIGHBOUR_BLOCK rows before there are more of them: every query is sent to each block it has to visit.
MOST_BLOCKS = 64
# Cells of a table of distances, and rows of a frame of visits, that a task holds at a time.
CELLS, VISITS = 4_000_000, 20_000


class _Base(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    def setup(self, kwargs: dict) -> None:
        self._setDefault(seed=42, featuresCol="features", labelCol="label", predictionCol="prediction")
        self._set(**{k: v for k, v in kwargs.items() if v is not None})


def _param(owner: type, name: str, doc: str, convert) -> Param:
    return Param(Params._dummy(), name, doc, convert)


def _plain(value):
    """Arrays and tuples as what JSON can hold."""
    if isinstance(value, np.ndarray):
        return {"array": value.tolist()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value.item() if isinstance(value, np.generic) else value


def _restored(value):
    if isinstance(value, dict):
        return np.array(value["array"]) if set(value) == {"array"} else {k: _restored(v) for k, v in value.items()}
    return [_restored(v) for v in value] if isinstance(value, list) else value


class _StateWriter(MLWriter):
    def __init__(self, instance: _Fitted):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        state = self.instance.state
        tables = sorted(k for k, v in state.items() if isinstance(v, DataFrame))
        plain = {k: _plain(v) for k, v in state.items() if k not in tables}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, {"state": plain, "tables": tables})
        for name in tables:
            state[name].write.parquet(f"{path}/{name}")


class _StateReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> _Fitted:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        state = {k: _restored(v) for k, v in metadata["state"].items()}
        state |= {k: self.sparkSession.read.parquet(f"{path}/{k}") for k in metadata["tables"]}
        model = self.kind(None, **state)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _Fitted(Model, _Base, MLWritable, MLReadable):
    """A fitted model; ``state`` holds what was learned: numbers, lists and arrays, and tables that are saved beside them."""

    def __init__(self, parent: Estimator | None = None, **state):
        super().__init__()
        self._setDefault(seed=42, featuresCol="features", labelCol="label", predictionCol="prediction")
        if parent is not None:
            for name in ("featuresCol", "labelCol", "predictionCol", "seed"):
                self._set(**{name: parent.getOrDefault(name)})
        self.state = state

    def copy(self, extra=None):
        return self

    def write(self) -> MLWriter:
        return _StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StateReader(cls)


def unpacked(df: DataFrame, features: str, label: str | None, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Feature vector as plain columns, with the label and the columns to keep."""
    size = df.select(F.size(vector_to_array(features)).alias("d")).first()["d"]
    names = [f"x{i}" for i in range(size)]
    array = vector_to_array(features)
    side = [col(label).cast("double").alias("label")] if label else []
    return df.select(*[col(k) for k in keep], *side, *[array[i].alias(n) for i, n in enumerate(names)]), names


class NonNegative(Transformer, HasInputCol, HasOutputCol, DefaultParamsWritable, DefaultParamsReadable):
    """Negative entries of a vector become 0, for models that accept no negative values."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        clipped = F.transform(vector_to_array(self.getInputCol()), lambda v: F.greatest(v, F.lit(0.0)))
        return df.withColumn(self.getOutputCol(), array_to_vector(clipped))


# ------------------------------------------------------------------------------------------- QDA


class QdaModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        classes, parts = self.state["classes"], self.state["parts"]

        @F.pandas_udf("array<double>")
        def posterior(batch: pd.Series) -> pd.Series:
            x = np.stack(batch.to_numpy())
            scores = np.stack([
                prior - 0.5 * np.sum(((x - mean) @ axes) ** 2, axis=1) for mean, axes, prior in parts
            ], axis=1)
            scores -= scores.max(axis=1, keepdims=True)
            p = np.exp(scores)
            return pd.Series(list(p / p.sum(axis=1, keepdims=True)))

        out = df.withColumn("probability_array", posterior(vector_to_array(self.getFeaturesCol())))
        best = F.array_position("probability_array", F.array_max("probability_array"))
        return out.withColumn(self.getPredictionCol(), F.element_at(F.array(*[F.lit(c) for c in classes]), best.cast("int")))


class Qda(Estimator, _Base):
    """Quadratic discriminant analysis from per-class moments."""

    regParam = _param(None, "regParam", "share of the identity mixed into each covariance", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, predictionCol=None, regParam=None):
        super().__init__()
        self._setDefault(regParam=0.0)
        self.setup(self._input_kwargs)

    def _fit(self, df: DataFrame) -> QdaModel:
        plain, names = unpacked(df, self.getFeaturesCol(), self.getLabelCol())
        moments = class_moments(plain, names, "label")
        total, reg = sum(m[0] for m in moments.values()), self.getOrDefault("regParam")
        parts, classes = [], sorted(moments)
        for c in classes:
            n, s, cross = moments[c]
            mean = s / n
            cov = (cross - n * np.outer(mean, mean)) / max(n - 1, 1)
            values, vectors = np.linalg.eigh((1 - reg) * cov + reg * np.eye(len(mean)))
            values = np.maximum(values, max(values.max(), 1e-12) * 1e-9)
            parts.append((mean, vectors / np.sqrt(values), math.log(n / total) - 0.5 * float(np.log(values).sum())))
        return QdaModel(self, classes=classes, parts=parts)


# --------------------------------------------------------------------------------- neighbours


def _nearest(x: np.ndarray, train: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of the k nearest training rows, ties by position."""
    d2 = np.maximum((x**2).sum(1)[:, None] - 2 * x @ train.T + (train**2).sum(1)[None, :], 0.0)
    d2 = np.round(d2, 9)
    k = min(k, train.shape[0])
    if k > 32 or not np.isfinite(d2).all():
        order = np.argsort(d2, axis=1, kind="stable")[:, :k]
        return order, np.sqrt(np.take_along_axis(d2, order, axis=1))
    order, dist, rows = np.empty((len(x), k), np.int64), np.empty((len(x), k)), np.arange(len(x))
    for i in range(k):  # the first of the smallest that are left
        order[:, i] = d2.argmin(axis=1)
        dist[:, i] = d2[rows, order[:, i]]
        d2[rows, order[:, i]] = np.inf
    return order, np.sqrt(dist)


def _nearest_sliced(x: np.ndarray, train: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same, a bounded table of distances at a time."""
    step = max(1, CELLS // max(len(train), 1))
    found = [_nearest(x[at:at + step], train, k) for at in range(0, len(x), step)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class NeighboursModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        k, weighted, problem = self.state["k"], self.state["weighted"], self.state["problem"]
        found = self._found(df)
        weight = F.when(F.lit(weighted), 1.0 / F.greatest(F.col("d"), F.lit(1e-12))).otherwise(1.0)
        if problem == "regression":
            votes = found.groupBy("_key").agg((F.sum(F.col("y") * weight) / F.sum(weight)).alias("_vote"))
        else:
            per_class = found.groupBy("_key", "y").agg(F.sum(weight).alias("w"))
            votes = per_class.groupBy("_key").agg(F.min(F.struct(-F.round("w", 9), F.col("y")))["y"].alias("_vote"))
        keyed = df.withColumn("_key", self._key(df))
        return keyed.join(votes, "_key").withColumn(self.getPredictionCol(), F.col("_vote")).drop("_key", "_vote")

    def _key(self, df: DataFrame):
        return F.struct(*[col(c) for c in self.state["key"]])

    def _found(self, df: DataFrame) -> DataFrame:
        """The k nearest training rows of every row: (_key, y, d)."""
        k, train = self.state["k"], self.state["train"]
        queries = df.select(self._key(df).alias("_key"), vector_to_array(self.getFeaturesCol()).alias("x"))
        result = T.StructType([queries.schema["_key"], T.StructField("y", T.DoubleType()), T.StructField("d", T.DoubleType())])
        if self.state["pivots"] is None:
            local = train.orderBy("id").select("x", "y").toPandas()  # at most NEIGHBOUR_BLOCK rows
            shared = df.sparkSession.sparkContext.broadcast((np.stack(local["x"].to_numpy()), local["y"].to_numpy()))

            def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                points, labels = shared.value
                for batch in batches:
                    for start in range(0, len(batch), QUERY_BLOCK // 4):
                        part = batch.iloc[start:start + QUERY_BLOCK // 4]
                        order, dist = _nearest(np.stack(part["x"].to_numpy()), points, k)
                        yield pd.DataFrame({
                            "_key": np.repeat(part["_key"].to_numpy(), order.shape[1]) if not isinstance(part["_key"].iloc[0], dict)
                            else [key for key in part["_key"] for _ in range(order.shape[1])],
                            "y": labels[order].ravel(), "d": dist.ravel(),
                        })

            return queries.mapInPandas(search, result)
        # Larger training sets: a query goes to the part it lies in, and then to the parts that may hold something nearer
        # than what it found there.
        pivots, radii = self.state["pivots"], self.state["radii"]

        def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield batch.assign(part=_distances(np.stack(batch["x"].to_numpy()), pivots).argmin(axis=1))

        def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            step = max(1, VISITS // len(pivots))  # a query may have to visit every part
            for batch in batches:
                for at in range(0, len(batch), step):
                    few = batch.iloc[at:at + step]
                    query, part = parts_met(np.stack(few["x"].to_numpy()), pivots, radii, few["bound"].fillna(np.inf).to_numpy())
                    yield few.iloc[query][["_key", "x"]].assign(part=part)

        placed = T.StructType([*queries.schema.fields, T.StructField("part", T.LongType())])
        queries = checkpointed(queries)
        first = checkpointed(self._visit(checkpointed(queries.mapInPandas(home, placed)), result))
        bound = first.groupBy(F.col("_key").alias("_of")).agg(F.max("d").alias("most"), F.count(F.lit(1)).alias("n"))
        bounded = queries.join(bound, F.col("_key") == F.col("_of"), "left").select("_key", "x", F.when(F.col("n") >= k, F.col("most")).alias("bound"))
        more = self._visit(checkpointed(bounded.mapInPandas(others, placed)), result)
        return self._best(first.unionByName(more)).select("_key", "y", "d")

    def _best(self, found: DataFrame) -> DataFrame:
        w = Window.partitionBy("_key").orderBy("d", "id")  # k rows from each block a query visits
        return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= self.state["k"]).drop("r")

    def _visit(self, visits: DataFrame, result: T.StructType) -> DataFrame:
        """The k nearest rows in the parts that queries visit: (_key, y, d, id). Both sides are cut into blocks, so no part is one task."""
        k, train, counts, most = self.state["k"], self.state["train"], self.state["counts"], self.state["blockRows"]
        asked = {r["part"]: r["count"] for r in visits.groupBy("part").count().collect()}  # one row per part
        blocks = F.array(*[F.lit(max(1, math.ceil(n / most))) for n in counts])
        chunks = F.array(*[F.lit(max(1, math.ceil(asked.get(i, 0) / QUERY_BLOCK))) for i in range(len(counts))])
        here = lambda numbers: F.get(numbers, F.col("part").cast("int"))
        upto = lambda numbers: F.explode(F.sequence(F.lit(0), here(numbers) - 1))
        left = visits.withColumn("chunk", F.pmod(F.xxhash64("_key"), here(chunks)).cast("int")).withColumn("block", upto(blocks))
        right = train.filter(F.col("part").isin(list(asked))).withColumn("block", F.pmod(F.xxhash64("id"), here(blocks)).cast("int")).withColumn("chunk", upto(chunks))
        wide = T.StructType([*result.fields, T.StructField("id", train.schema["id"].dataType)])

        def block_search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if a.empty or b.empty:
                return pd.DataFrame({f.name: [] for f in wide.fields})
            b = b.sort_values("id", kind="stable")
            order, dist = _nearest_sliced(np.stack(a["x"].to_numpy()), np.stack(b["x"].to_numpy()), k)
            return pd.DataFrame({
                "_key": [key for key in a["_key"] for _ in range(order.shape[1])],
                "y": b["y"].to_numpy()[order].ravel(), "d": dist.ravel(), "id": b["id"].to_numpy()[order].ravel(),
            })

        keys = ["part", "block", "chunk"]
        return self._best(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block_search, wide))


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ points.T + (points**2).sum(1)[None, :], 0.0))


def parts_met(x: np.ndarray, pivots: np.ndarray, radii: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, part) pairs, but for each query's own part, that may hold a row no farther than its bound.

    A row of a part is no farther from the part's pivot than its radius and not nearer to another pivot, so it is at least
    distance - radius and half the difference of the two distances away.
    """
    d = _distances(x, pivots)
    own = d.argmin(axis=1)
    least = np.maximum(d - radii[None, :], (d - d.min(axis=1)[:, None]) / 2)
    room = 1e-6 * (1.0 + d.max(axis=1, initial=0.0))  # what rounding can change
    able = (least <= (bound + room)[:, None]) & (radii >= 0)[None, :]
    able[np.arange(len(x)), own] = False
    return np.nonzero(able)


class Neighbours(Estimator, _Base):
    """Exact k nearest neighbours. ``key`` names the columns that identify a row.

    Training sets over ``blockRows`` rows or ``NEIGHBOUR_BYTES`` are divided by their nearest pivot, a bounded sample of them.
    Where that would make over ``MOST_BLOCKS`` blocks, blocks grow to ``NEIGHBOUR_BLOCK`` rows before there are more.
    """

    k = _param(None, "k", "number of neighbours", TypeConverters.toInt)
    weights = _param(None, "weights", "uniform or distance", TypeConverters.toString)
    problem = _param(None, "problem", "classification or regression", TypeConverters.toString)
    key = _param(None, "key", "identifying columns", TypeConverters.toListString)
    blockRows = _param(None, "blockRows", "training rows that are sent to a task as a whole", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, predictionCol=None, k=None, weights=None, problem=None, key=None, blockRows=None):
        super().__init__()
        self._setDefault(blockRows=NEIGHBOUR_BLOCK, k=5, weights="uniform", problem="classification", key=["id"])
        self.setup(self._input_kwargs)

    def _fit(self, df: DataFrame) -> NeighboursModel:
        get = self.getOrDefault
        train = df.select(
            F.concat_ws("|", *[col(c).cast("string") for c in get("key")]).alias("id"),
            vector_to_array(self.getFeaturesCol()).alias("x"), col(self.getLabelCol()).cast("double").alias("y"),
        )
        rows, most = train.count(), get("blockRows")
        state = {"rows": rows, "k": get("k"), "weighted": get("weights") == "distance", "problem": get("problem"), "key": get("key"), "blockRows": most}
        sizes = train.agg(F.max(F.size("x")).alias("d")).first()
        if rows <= most and rows * (sizes["d"] or 0) * 8 <= NEIGHBOUR_BYTES:
            return NeighboursModel(self, train=train, pivots=None, radii=None, counts=None, **state)
        most = state["blockRows"] = max(most, min(NEIGHBOUR_BLOCK, math.ceil(rows / MOST_BLOCKS)))
        n = min(MOST_PIVOTS, BLOCK_PIVOTS * math.ceil(rows / most) + 1)
        pivots = np.stack([r["x"] for r in train.select("x").orderBy(F.xxhash64("id"), "id").limit(n).collect()])  # bounded

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    d = _distances(np.stack(batch["x"].to_numpy()), pivots)
                    yield batch.assign(part=d.argmin(axis=1), away=d.min(axis=1))

        schema = T.StructType([*train.schema.fields, T.StructField("part", T.LongType()), T.StructField("away", T.DoubleType())])
        train = checkpointed(train.mapInPandas(placed, schema))
        radii, counts = np.full(len(pivots), -1.0), [0] * len(pivots)
        for r in train.groupBy("part").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # one row per pivot
            radii[r["part"]], counts[r["part"]] = r["radius"], r["n"]
        return NeighboursModel(self, train=train.drop("away"), pivots=pivots, radii=radii, counts=counts, **state)


# ----------------------------------------------------------------------- boosting and bagging


def tree_arrays(tree, label: float | None = None) -> dict[str, list]:
    """A fitted Spark tree as arrays, node by node: feature (-1 at a leaf), threshold, left, right, predicted value and weight of its rows.

    With ``label`` the value is the share of that class.
    """
    out: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "value": [], "cover": []}

    def add(node) -> int:
        at = len(out["feature"])
        inner = node.getClass().getSimpleName() == "InternalNode"
        if inner and node.split().getClass().getSimpleName() != "ContinuousSplit":
            raise ValueError("trees over nominal features can't be taken apart")
        out["feature"].append(int(node.split().featureIndex()) if inner else -1)
        out["threshold"].append(float(node.split().threshold()) if inner else 0.0)
        out["value"].append(float(node.prediction() if label is None else node.impurityStats().prob(label)))
        out["cover"].append(float(node.impurityStats().count()))
        out["left"].append(0)
        out["right"].append(0)
        if inner:
            out["left"][at] = add(node.leftChild())
            out["right"][at] = add(node.rightChild())
        return at

    add(tree._java_obj.rootNode())
    return out


def tree_values(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The value of the leaf each row ends in; all rows go down a level at a time."""
    at = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    while True:
        feature = tree["feature"][at]
        inner = feature >= 0
        if not inner.any():
            return tree["value"][at]
        go_left = x[rows, np.maximum(feature, 0)] <= tree["threshold"][at]
        at = np.where(inner, np.where(go_left, tree["left"][at], tree["right"][at]), at)


class TreeVoteModel(_Fitted):
    """Weighted vote of trees, all of them in one pass over a batch."""

    def _transform(self, df: DataFrame) -> DataFrame:
        classes, weights = np.array(self.state["classes"]), self.state["weights"]
        trees = [{k: np.array(v) for k, v in t.items()} for t in self.state["trees"]]

        @F.pandas_udf("array<double>")
        def shares(batch: pd.Series) -> pd.Series:
            if not len(batch):
                return pd.Series([], dtype=object)
            x = np.stack(batch.to_numpy())
            votes = np.zeros((len(x), len(classes)))
            for tree, weight in zip(trees, weights):
                votes += weight * (tree_values(tree, x)[:, None] == classes[None, :])
            return pd.Series(list(votes / (sum(weights) or 1.0)))

        out = df.withColumn("probability_array", shares(vector_to_array(self.getFeaturesCol())))
        best = F.array_position("probability_array", F.array_max("probability_array"))
        labels = F.array(*[F.lit(float(c)) for c in classes])
        return out.withColumn(self.getPredictionCol(), F.element_at(labels, best.cast("int")))


def _votes(parent: Estimator, classes: list[float], trees: list[tuple]) -> TreeVoteModel:
    return TreeVoteModel(parent, classes=classes, weights=[float(w) for _, w in trees], trees=[tree_arrays(t) for t, _ in trees])


def _classes(df: DataFrame, label: str) -> list[float]:
    return sorted(r[0] for r in df.select(col(label).cast("double")).distinct().collect())  # one row per class


class AdaBoost(Estimator, _Base):
    """Stage-wise boosting: each tree sees the rows its predecessors got wrong with more weight."""

    rounds = _param(None, "rounds", "number of trees", TypeConverters.toInt)
    learningRate = _param(None, "learningRate", "shrinkage of the tree weights", TypeConverters.toFloat)
    maxDepth = _param(None, "maxDepth", "depth of each tree", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, predictionCol=None, rounds=None, learningRate=None, maxDepth=None):
        super().__init__()
        self._setDefault(rounds=50, learningRate=1.0, maxDepth=1)
        self.setup(self._input_kwargs)

    def _fit(self, df: DataFrame) -> TreeVoteModel:
        label, features = self.getLabelCol(), self.getFeaturesCol()
        classes = _classes(df, label)
        k, rate = max(len(classes), 2), self.getOrDefault("learningRate")
        work = checkpointed(df.select(col(features).alias("f"), col(label).cast("double").alias("y"), F.lit(1.0).alias("w")))
        trees: list = []
        stored = work
        for i in range(self.getOrDefault("rounds")):
            tree = DecisionTreeClassifier(
                featuresCol="f", labelCol="y", weightCol="w", maxDepth=self.getOrDefault("maxDepth"), seed=self.getSeed() + i
            ).fit(work)
            miss = F.when(F.col("prediction") != F.col("y"), 1.0).otherwise(0.0)
            # A tree reads its rows several times: stored, or every reading would evaluate all the trees before it.
            judged = checkpointed(tree.transform(work).select("f", "y", "w", miss.alias("miss")))
            discard(stored)
            stored = judged
            got = judged.agg(F.sum("w").alias("all"), F.sum(F.col("w") * F.col("miss")).alias("bad")).first()
            error = got["bad"] / got["all"]
            if error >= 1 - 1 / k:
                if not trees:
                    trees.append((tree, 1.0))
                break
            alpha = rate * (math.log((1 - error) / max(error, 1e-10)) + math.log(k - 1))
            trees.append((tree, alpha))
            if error <= 1e-10:
                break
            scale = 1.0 / got["all"]
            work = judged.select("f", "y", (F.col("w") * F.lit(scale) * F.exp(F.lit(alpha) * F.col("miss"))).alias("w"))
        discard(stored)
        return _votes(self, classes, trees)


class Bagging(Estimator, _Base):
    """Trees on bootstrap samples, equal votes."""

    rounds = _param(None, "rounds", "number of trees", TypeConverters.toInt)
    sampleShare = _param(None, "sampleShare", "size of each sample", TypeConverters.toFloat)
    maxDepth = _param(None, "maxDepth", "depth of each tree", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, predictionCol=None, rounds=None, sampleShare=None, maxDepth=None):
        super().__init__()
        self._setDefault(rounds=10, sampleShare=1.0, maxDepth=10)
        self.setup(self._input_kwargs)

    def _fit(self, df: DataFrame) -> TreeVoteModel:
        label, features, seed = self.getLabelCol(), self.getFeaturesCol(), self.getSeed()
        work = checkpointed(df.select(col(features).alias("f"), col(label).cast("double").alias("y"), F.xxhash64(col(features), col(label)).alias("key")))
        share, trees = self.getOrDefault("sampleShare"), []
        for i in range(self.getOrDefault("rounds")):
            # How often a row is drawn: a Poisson number that only depends on the row and the round, so a model can be made again.
            uniform = F.pmod(F.xxhash64("key", F.lit(seed + i)), F.lit(1 << 40)) / F.lit(float(1 << 40))
            chance, total, drawn = math.exp(-share), math.exp(-share), F.lit(0.0)
            for n in range(1, 9):
                drawn = F.when(uniform >= total, F.lit(float(n))).otherwise(drawn)
                chance *= share / n
                total += chance
            weighted = work.withColumn("w", drawn).filter("w > 0")
            trees.append((DecisionTreeClassifier(featuresCol="f", labelCol="y", weightCol="w", maxDepth=self.getOrDefault("maxDepth"), seed=seed).fit(weighted), 1.0))
        return _votes(self, _classes(work, "y"), trees)


# ---------------------------------------------------------------------------- linear families


class LinearScoresModel(_Fitted):
    """Class with the largest linear score, or the value of a single score."""

    def _transform(self, df: DataFrame) -> DataFrame:
        weights, intercepts, classes = self.state["weights"], self.state["intercepts"], self.state["classes"]

        @F.pandas_udf("array<double>")
        def scores(batch: pd.Series) -> pd.Series:
            return pd.Series(list(np.stack(batch.to_numpy()) @ weights.T + intercepts))

        out = df.withColumn("_scores", scores(vector_to_array(self.getFeaturesCol())))
        if classes is None:
            value = F.col("_scores")[0]
        else:
            best = F.array_position("_scores", F.array_max("_scores")).cast("int")
            value = F.element_at(F.array(*[F.lit(float(c)) for c in classes]), best)
        return out.withColumn(self.getPredictionCol(), value).drop("_scores")


    @property
    def coefficients(self) -> DenseVector:
        """Weights of a single score."""
        return Vectors.dense(np.asarray(self.state["weights"])[0])

    @property
    def intercept(self) -> float:
        return float(np.asarray(self.state["intercepts"])[0])


class GramLinear(Estimator, _Base):
    """Least squares with penalties, solved on the products of the features that one pass sums: ``penalty_paths.solve``."""

    family = _param(None, "family", "LinearRegression, Ridge, Lasso or ElasticNet", TypeConverters.toString)
    alpha = _param(None, "alpha", "penalty of a ridge, over all rows", TypeConverters.toFloat)
    regParam = _param(None, "regParam", "penalty of the others, per row", TypeConverters.toFloat)
    elasticNetParam = _param(None, "elasticNetParam", "share of the penalty on absolute values", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, predictionCol=None, family=None, alpha=None, regParam=None, elasticNetParam=None):
        super().__init__()
        self._setDefault(family="LinearRegression", alpha=1.0, regParam=1.0, elasticNetParam=0.5)
        self.setup(self._input_kwargs)

    def _fit(self, df: DataFrame) -> LinearScoresModel:
        plain, names = unpacked(df, self.getFeaturesCol(), self.getLabelCol())
        moments = class_moments(plain, [*names, "label"])[None]
        params = {k: self.getOrDefault(k) for k in ("alpha", "regParam", "elasticNetParam")}
        found = penalty_paths.solve(moments, *penalty_paths.penalties(self.getOrDefault("family"), params, moments[0]))
        return LinearScoresModel(self, weights=found.weights[None, :], intercepts=np.array([found.intercept]), classes=None)


class RidgeClassifier(Estimator, _Base):
    """Least squares on +1 / -1 codes of each class."""

    alpha = _param(None, "alpha", "ridge penalty", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, predictionCol=None, alpha=None):
        super().__init__()
        self._setDefault(alpha=1.0)
        self.setup(self._input_kwargs)

    def _fit(self, df: DataFrame) -> LinearScoresModel:
        classes = _classes(df, self.getLabelCol())
        plain, names = unpacked(df, self.getFeaturesCol(), self.getLabelCol())
        moments = class_moments(plain, names, "label")
        n = sum(m[0] for m in moments.values())
        mean = sum(m[1] for m in moments.values()) / n
        cross = sum(m[2] for m in moments.values()) - n * np.outer(mean, mean)
        solve = np.linalg.inv(cross + self.getOrDefault("alpha") * np.eye(len(names)))
        weights, intercepts = [], []
        for c in classes:
            target_mean = (2 * moments[c][0] - n) / n
            xy = 2 * moments[c][1] - sum(m[1] for m in moments.values()) - n * target_mean * mean
            w = solve @ xy
            weights.append(w)
            intercepts.append(target_mean - w @ mean)
        return LinearScoresModel(self, weights=np.array(weights), intercepts=np.array(intercepts), classes=classes)


class BayesianRidge(Estimator, _Base):
    """Ridge whose penalty is found by maximising the evidence, on the cross products of the table."""

    rounds = _param(None, "rounds", "evidence iterations", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, predictionCol=None, rounds=None):
        super().__init__()
        self._setDefault(rounds=300)
        self.setup(self._input_kwargs)

    def _fit(self, df: DataFrame) -> LinearScoresModel:
        plain, names = unpacked(df, self.getFeaturesCol(), self.getLabelCol())
        n, total, cross = class_moments(plain, [*names, "label"])[None]
        mean = total / n
        centred = cross - n * np.outer(mean, mean)
        xx, xy, yy = centred[:-1, :-1], centred[:-1, -1], centred[-1, -1]
        values, vectors = np.linalg.eigh(xx)
        values = np.clip(values, 0.0, None)
        proj = vectors.T @ xy
        noise, weight = 1.0 / max(yy / n, 1e-12), 1.0
        w = np.zeros(len(names))
        for _ in range(self.getOrDefault("rounds")):
            new = vectors @ (proj / (values + weight / noise))
            residual = max(yy - 2 * new @ xy + new @ xx @ new, 1e-12)
            gamma = float(np.sum(noise * values / (weight + noise * values)))
            weight = (gamma + 2e-6) / (float(new @ new) + 2e-6)
            noise = (n - gamma + 2e-6) / (residual + 2e-6)
            done = np.abs(new - w).sum() < 1e-3
            w = new
            if done:
                break
        return LinearScoresModel(self, weights=w[None, :], intercepts=np.array([mean[-1] - w @ mean[:-1]]), classes=None)
