"""Cost-complexity pruning: the subtree with the least risk + alpha * leaves, and the path of all such subtrees.

Risk is impurity by share of the training rows. A fitted tree is small, so it is pruned where it stands; what the rows
say about its nodes is summed on Spark, for all subtrees of the path in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import TypeConverters
from pyspark.ml.param.shared import HasWeightCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelab.functions.columns import col
from tablelab.models.custom import _Base, _Fitted, _param, tree_arrays, tree_values

#: Relative room for rounding when risks are compared.
ROOM = 1e-12


def risks(tree) -> np.ndarray:
    """Impurity of each node by its share of all rows, in the order of ``tree_arrays``."""
    out: list[float] = []

    def add(node) -> None:
        out.append(float(node.impurity()) * float(node.impurityStats().count()))
        if node.getClass().getSimpleName() == "InternalNode":
            add(node.leftChild())
            add(node.rightChild())

    root = tree._java_obj.rootNode()
    add(root)
    return np.array(out) / float(root.impurityStats().count())


def collapsed(tree: dict, risk: np.ndarray, alpha: float) -> np.ndarray:
    """Nodes that become leaves: the smallest subtree with the least risk + alpha * leaves. Children come after their parents."""
    cost, cut = risk + alpha, np.asarray(tree["feature"]) < 0
    for i in range(len(risk) - 1, -1, -1):
        if tree["feature"][i] >= 0:
            below = cost[tree["left"][i]] + cost[tree["right"][i]]
            cut[i] = cost[i] <= below + ROOM * max(risk[0], 1e-300)
            cost[i] = min(cost[i], below)
    return cut


def kept(tree: dict, cut: np.ndarray) -> list[int]:
    """Nodes of the tree that ends at ``cut``, parents first."""
    out, todo = [], [0]
    while todo:
        i = todo.pop()
        out.append(i)
        if not cut[i]:
            todo += [tree["right"][i], tree["left"][i]]
    return out


def weakest_links(tree: dict, risk: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """(alpha, nodes that are leaves) of all subtrees that are best for some alpha, from the whole tree to the root alone."""
    cut, out = np.asarray(tree["feature"]) < 0, []
    out.append((0.0, cut.copy()))
    while not cut[0]:
        below, leaves, least, weak = risk.copy(), np.ones(len(risk)), np.inf, []
        for i in reversed(kept(tree, cut)):
            if cut[i]:
                continue
            below[i] = below[tree["left"][i]] + below[tree["right"][i]]
            leaves[i] = leaves[tree["left"][i]] + leaves[tree["right"][i]]
            gain = max((risk[i] - below[i]) / (leaves[i] - 1), 0.0)
            if gain < least - ROOM * risk[0]:
                least, weak = gain, [i]
            elif gain <= least + ROOM * risk[0]:
                weak.append(i)
        cut[weak] = True
        if out[-1][0] >= least - ROOM * risk[0]:
            out.pop()
        out.append((least, cut.copy()))
    return out


def pruned(tree: dict, cut: np.ndarray) -> tuple[dict, list[int]]:
    """The arrays of the tree that ends at ``cut``, and the nodes they come from."""
    nodes = kept(tree, cut)
    place = {n: i for i, n in enumerate(nodes)}
    out: dict[str, list] = {k: [v[n] for n in nodes] for k, v in tree.items()}
    for i, n in enumerate(nodes):
        out["left"][i], out["right"][i] = (0, 0) if cut[n] else (place[tree["left"][n]], place[tree["right"][n]])
        if cut[n]:
            out["feature"][i], out["threshold"][i] = -1, 0.0
    return out, nodes


class PrunedTreeModel(_Fitted):
    """One tree; for classes with the shares of each leaf as ``probability_array``."""

    def tree(self, label: int = 1) -> dict:
        """The tree's arrays, with the share of the class at place ``label`` as value."""
        tree, shares = self.state["tree"], self.state["shares"]
        return tree if shares is None else tree | {"value": [float(s[label]) for s in shares]}

    @property
    def featureImportances(self) -> DenseVector:
        """Risk that the splits on each feature take away, summing to 1."""
        tree, risk, out = self.state["tree"], self.state["risk"], np.zeros(self.state["features"])
        for i, f in enumerate(tree["feature"]):
            if f >= 0:
                out[f] += risk[i] - risk[tree["left"][i]] - risk[tree["right"][i]]
        return Vectors.dense(out / out.sum() if out.sum() > 0 else out)

    def _transform(self, df: DataFrame) -> DataFrame:
        tree = {k: np.array(v) for k, v in self.state["tree"].items()}
        place = tree | {"value": np.arange(len(tree["feature"]))}

        @F.pandas_udf("int")
        def leaf(batch: pd.Series) -> pd.Series:
            return pd.Series(tree_values(place, np.stack(batch.to_numpy())) if len(batch) else [], dtype="int32")

        at = lambda numbers: F.get(F.array(*[F.lit(float(v)) for v in numbers]), F.col("_leaf"))
        out = df.withColumn("_leaf", leaf(vector_to_array(self.getFeaturesCol()))).withColumn(self.getPredictionCol(), at(tree["value"]))
        if self.state["shares"] is not None:
            shares = np.array(self.state["shares"])
            out = out.withColumn("probability_array", F.array(*[at(shares[:, k]) for k in range(shares.shape[1])]))
        return out.drop("_leaf")


class PrunedTree(Estimator, _Base, HasWeightCol):
    """A decision tree of Spark, cut back to the subtree with the least risk + ``alpha`` * leaves. Classes are numbers from 0."""

    alpha = _param(None, "alpha", "price of a leaf", TypeConverters.toFloat)
    problem = _param(None, "problem", "classification or regression", TypeConverters.toString)
    maxDepth = _param(None, "maxDepth", "depth before pruning", TypeConverters.toInt)
    minInstancesPerNode = _param(None, "minInstancesPerNode", "least rows of a node", TypeConverters.toInt)
    impurity = _param(None, "impurity", "gini or entropy", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, predictionCol=None, weightCol=None, alpha=None, problem=None, maxDepth=None,
                 minInstancesPerNode=None, impurity=None, seed=None):
        super().__init__()
        self._setDefault(alpha=0.001, problem="classification", maxDepth=5, minInstancesPerNode=1, impurity="gini")
        self.setup(self._input_kwargs)

    def grown(self, df: DataFrame):
        """The tree before it is pruned."""
        get = self.getOrDefault
        shared = {"featuresCol": get("featuresCol"), "labelCol": get("labelCol"), "maxDepth": get("maxDepth"), "minInstancesPerNode": get("minInstancesPerNode"), "seed": get("seed")}
        if self.isSet("weightCol"):
            shared["weightCol"] = get("weightCol")
        if get("problem") == "regression":
            return R.DecisionTreeRegressor(**shared).fit(df)
        return C.DecisionTreeClassifier(impurity=get("impurity"), **shared).fit(df)

    def _fit(self, df: DataFrame) -> PrunedTreeModel:
        spark_tree = self.grown(df)
        whole, risk = tree_arrays(spark_tree), risks(spark_tree)
        tree, nodes = pruned(whole, collapsed(whole, risk, self.getOrDefault("alpha")))
        shares = None
        if self.getOrDefault("problem") == "classification":
            by_class = [tree_arrays(spark_tree, float(c))["value"] for c in range(spark_tree.numClasses)]
            shares = [[float(values[n]) for values in by_class] for n in nodes]
        return PrunedTreeModel(self, tree=tree, shares=shares, risk=[float(risk[n]) for n in nodes], features=int(spark_tree.numFeatures))


def pruning_path(held: DataFrame, spark_tree, problem: str = "classification", features: str = "features", label: str = "label") -> DataFrame:
    """alpha, leaves, risk, held_error: the subtrees of a tree, and their error on held-out rows (share of misses or mean squared error).

    Each row meets the nodes on its way once; the errors it would have if it stopped there are summed by node.
    """
    tree, risk = tree_arrays(spark_tree), risks(spark_tree)
    arrays = {k: np.array(v) for k, v in tree.items()}

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        errors, counts = np.zeros(len(risk)), np.zeros(len(risk), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            x, y, at, rows = np.stack(batch["x"].to_numpy()), batch["y"].to_numpy(), np.zeros(len(batch), np.int64), np.arange(len(batch))
            while len(rows):
                missed = y[rows] - arrays["value"][at]
                np.add.at(errors, at, missed**2 if problem == "regression" else missed != 0)
                np.add.at(counts, at, 1)
                inner = arrays["feature"][at] >= 0
                rows, at = rows[inner], at[inner]
                at = np.where(x[rows, arrays["feature"][at]] <= arrays["threshold"][at], arrays["left"][at], arrays["right"][at])
        yield pd.DataFrame({"node": np.arange(len(risk)), "error": errors, "n": counts})

    rows = held.select(vector_to_array(features).alias("x"), col(label).cast("double").alias("y"))
    found = rows.mapInPandas(walk, "node int, error double, n long").groupBy("node").agg(F.sum("error").alias("error"), F.sum("n").alias("n")).collect()
    error, counts = np.zeros(len(risk)), np.zeros(len(risk))
    for r in found:  # one row per node
        error[r["node"]], counts[r["node"]] = r["error"], r["n"]
    out = []
    for alpha, cut in weakest_links(tree, risk):
        leaves = [i for i in kept(tree, cut) if cut[i]]
        out.append((float(alpha), len(leaves), float(risk[leaves].sum()), float(error[leaves].sum() / counts[0]) if counts[0] else None))
    return held.sparkSession.createDataFrame(out, "alpha double, leaves long, risk double, held_error double")
