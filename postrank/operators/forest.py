"""Boosted forests as tables: staged evaluation with patience (M2) and exact per-row tree attribution (M4).

A fitted ensemble is a table of nodes (its saved form), bounded by trees x nodes. From it comes a table of leaf paths:
for each leaf and each feature on its path the values that lead there and the share of training rows that does. Both are
sent to the tasks, which work on Arrow batches of rows; no row is shuffled.

* :func:`staged_curve` sums the trees' predictions one after the other and gives the error after each, in one
  pass over the validation rows. :func:`best_iteration` applies the patience rule to that curve and :func:`truncated`
  keeps that many trees.
* :func:`attribute` gives Shapley values of the path-dependent expectation. A leaf's part depends only on which of
  its features a row agrees with, so it is computed once per combination and looked up for every row.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

NODES = ("tree int, weight double, node int, value double, cover double, left int, right int, feature int, "
         "threshold double, categories array<double>")
PATH_FEATURES = 14  # different features of one path at most: a leaf keeps 2^n sums
CELLS = 1 << 22  # row x leaf x feature cells held at once


def tree_nodes(model: GBTRegressionModel, spark: SparkSession) -> DataFrame:
    """The nodes of a fitted ensemble, from its saved form: children are -1 at a leaf; a split goes left up to its
    threshold, or for its categories."""
    path = scratch_path(spark, f"forest_{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    n = F.col("nodeData")
    s = n["split"]
    numeric = s["numCategories"] < 0
    weights = spark.createDataFrame(list(enumerate(map(float, model.treeWeights))), "tree int, weight double")
    rows = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), n["prediction"].alias("value"), n["rawCount"].cast("double").alias("cover"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"), F.when(n["leftChild"] >= 0, s["featureIndex"]).alias("feature"),
        F.when(numeric, F.get(s["leftCategoriesOrThreshold"], 0)).alias("threshold"),
        F.when(~numeric, s["leftCategoriesOrThreshold"]).alias("categories"))
    columns = [c.split()[0] for c in NODES.split(", ")]
    return rows.join(F.broadcast(weights), "tree").select(*columns)  # one row per tree


@dataclass
class Forest:
    """Node arrays of all trees, one after the other."""

    weight: np.ndarray  # by tree
    root: np.ndarray  # by tree
    value: np.ndarray
    cover: np.ndarray
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    categories: list[frozenset[float] | None]

    @classmethod
    def of(cls, nodes: DataFrame) -> Forest:
        """From a table of nodes: collected, as it is bounded by the size of the model."""
        rows = sorted(nodes.collect(), key=lambda r: (r["tree"], r["node"]))
        place = {(r["tree"], r["node"]): i for i, r in enumerate(rows)}
        child = lambda r, side: place[r["tree"], r[side]] if r[side] is not None and r[side] >= 0 else -1
        roots = [i for i, r in enumerate(rows) if i == 0 or rows[i - 1]["tree"] != r["tree"]]
        number = lambda name, other: np.array([other if r[name] is None else r[name] for r in rows], dtype=float)
        return cls(np.array([rows[i]["weight"] for i in roots]), np.array(roots), number("value", 0), number("cover", 0),
                   np.array([child(r, "left") for r in rows]), np.array([child(r, "right") for r in rows]),
                   number("feature", -1).astype(int), number("threshold", np.nan),
                   [None if r["categories"] is None else frozenset(r["categories"]) for r in rows])

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        column = x[:, self.feature[node]]
        if self.categories[node] is None:
            return column <= self.threshold[node]
        return np.isin(column, list(self.categories[node]))

    def staged(self, x: np.ndarray) -> np.ndarray:
        """Each tree's weighted prediction for each row."""
        out = np.zeros((len(x), len(self.root)))
        for t, root in enumerate(self.root.tolist()):
            stack = [(root, np.arange(len(x)))]
            while stack:
                node, rows = stack.pop()
                if self.left[node] < 0:
                    out[rows, t] = self.weight[t] * self.value[node]
                elif len(rows):
                    left = self.goes_left(node, x[rows])
                    stack += [(self.left[node], rows[left]), (self.right[node], rows[~left])]
        return out

    def leaf_paths(self) -> tuple[list[tuple[float, list[tuple[int, float]], list[list[tuple[int, bool]]]]], float]:
        """Of each leaf: its weighted value, (feature, share of training rows) for the features of its path, and for each
        of them the splits (node, left) to agree with; and the mean of all rows."""
        out, mean = [], 0.0
        for t, root in enumerate(self.root.tolist()):
            stack = [(root, {})]
            while stack:
                node, path = stack.pop()
                if self.left[node] < 0:
                    value = self.weight[t] * self.value[node]
                    mean += value * math.prod(z for z, _ in path.values())
                    out.append((value, [(f, z) for f, (z, _) in path.items()], [steps for _, steps in path.values()]))
                    continue
                f = int(self.feature[node])
                for child, is_left in ((self.left[node], True), (self.right[node], False)):
                    z, steps = path.get(f, (1.0, []))
                    share = self.cover[child] / self.cover[node]
                    stack.append((child, {**path, f: (z * share, [*steps, (node, is_left)])}))
        return out, mean


def shares(value: float, z: np.ndarray) -> np.ndarray:
    """Shapley values of one leaf for every combination of features that a row agrees with (bit k: the k-th): sums over
    the subsets of the others, by the coefficients of the product of (z + o x)."""
    d = len(z)
    o = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(float)
    weight = np.array([math.factorial(m) * math.factorial(d - m - 1) / math.factorial(d) for m in range(d)])
    out = np.zeros((1 << d, d))
    for j in range(d):
        p = np.zeros((1 << d, d))
        p[:, 0] = 1
        for k in range(d):
            if k != j:
                p[:, 1:] = p[:, 1:] * z[k] + p[:, :-1] * o[:, [k]]
                p[:, 0] *= z[k]
        out[:, j] = value * (o[:, j] - z[j]) * (p @ weight)
    return out


class Attribution:
    """Leaf paths laid out for batches of rows."""

    def __init__(self, forest: Forest, features: int):
        self.forest, self.features = forest, features
        leaves, self.mean = forest.leaf_paths()
        widest = max((len(path) for _, path, _ in leaves), default=0)
        if widest > PATH_FEATURES:
            raise ValueError(f"a path has more than {PATH_FEATURES} features")
        self.groups = []  # leaves with equally many features together
        for d in range(1, widest + 1):
            some = [leaf for leaf in leaves if len(leaf[1]) == d]
            if some:
                self.groups.append((np.array([[f for f, _ in path] for _, path, _ in some]), [steps for _, _, steps in some],
                                    np.stack([shares(value, np.array([z for _, z in path])) for value, path, _ in some])))

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.features))
        size = max(1, sum(f.size for f, _, _ in self.groups))
        for at in range(0, len(x), max(1, CELLS // size)):
            part = x[at:at + max(1, CELLS // size)]
            left = {n: self.forest.goes_left(n, part) for n in np.flatnonzero(self.forest.left >= 0).tolist()}
            for feature, steps, table in self.groups:
                pattern = np.zeros((len(part), len(steps)), dtype=np.int64)
                for leaf, path in enumerate(steps):
                    for k, splits in enumerate(path):
                        agrees = np.ones(len(part), dtype=bool)
                        for node, is_left in splits:
                            agrees &= left[node] == is_left
                        pattern[:, leaf] |= agrees.astype(np.int64) << k
                found = table[np.arange(len(steps)), pattern]  # rows x leaves x features of a path
                for f in np.unique(feature).tolist():
                    out[at:at + len(part), f] += found[:, feature == f].sum(axis=1)
        return out


def _mapped(df: DataFrame, vector: str, fields: list[T.StructField], work) -> DataFrame:
    """``df`` with columns that ``work`` computes from the rows' feature arrays."""
    keep = [c for c in df.columns if c != vector and c not in {f.name for f in fields}]
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])

    def run(batches):
        for b in batches:
            x = np.array(b.column(len(keep)).to_pylist(), dtype=float).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], *work(x)], names=schema.names)

    return df.select(*keep, vector).mapInArrow(run, schema)


def predict(df: DataFrame, nodes: DataFrame, vector: str = "x") -> DataFrame:
    """``df`` with prediction, the sum of the trees of ``nodes``, from the array column ``vector`` (replaced)."""
    forest = df.sparkSession.sparkContext.broadcast(Forest.of(nodes))
    return _mapped(df, vector, [T.StructField("prediction", T.DoubleType())], lambda x: [pa.array(forest.value.staged(x).sum(axis=1))])


def attribute(df: DataFrame, nodes: DataFrame, features: int, vector: str = "x") -> DataFrame:
    """M4: ``df`` with prediction, base (the mean of the training rows) and contributions, one per feature of the array
    column ``vector`` (replaced). base + the sum of the contributions is the prediction of every row.

    A feature's contribution is its Shapley value: what knowing it adds to the expected prediction, averaged over all
    orders of learning the features, where an unknown one follows the training rows' shares down the tree."""
    forest = Forest.of(nodes)
    sent = df.sparkSession.sparkContext.broadcast(Attribution(forest, features))
    fields = [T.StructField("prediction", T.DoubleType()), T.StructField("base", T.DoubleType()),
              T.StructField("contributions", T.ArrayType(T.DoubleType()))]

    def work(x):
        a = sent.value
        return [pa.array(a.forest.staged(x).sum(axis=1)), pa.array(np.full(len(x), a.mean)), pa.array(list(a.of(x)), pa.list_(pa.float64()))]

    return _mapped(df, vector, fields, work)


def ranked_attribution(rows: DataFrame, names: list[str]) -> DataFrame:
    """M4: feature and mean |contribution| over ``rows`` of :func:`attribute`, the largest first."""
    means = rows.agg(*[F.avg(F.abs(F.get("contributions", i))).alias(f) for i, f in enumerate(names)])
    return means.unpivot([], names, "feature", "mean_abs").orderBy(F.col("mean_abs").desc(), "feature")


def staged_curve(df: DataFrame, nodes: DataFrame, label: str, vector: str = "x") -> DataFrame:
    """M2: iteration (from 1), n and mse of the first so many trees over the rows of ``df`` that have a label. Each task
    sums squared errors of all stages in one pass; only those sums are shuffled. Without such rows there is no curve."""
    sent = df.sparkSession.sparkContext.broadcast(Forest.of(nodes))

    def run(batches):
        forest = sent.value
        n, sse = 0, np.zeros(len(forest.root))
        for b in batches:
            x = np.array(b.column(0).to_pylist(), dtype=float).reshape(b.num_rows, -1)
            error = forest.staged(x).cumsum(axis=1) - b.column(1).to_numpy(zero_copy_only=False)[:, None]
            n, sse = n + len(x), sse + (error * error).sum(axis=0)
        at = np.arange(1, len(sse) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.full(len(sse), n)), pa.array(sse)],
                                         names=["iteration", "n", "sse"])

    rows = df.where(F.col(label).isNotNull()).select(vector, F.col(label).cast("double").alias(label))
    sums = rows.mapInArrow(run, "iteration int, n bigint, sse double").groupBy("iteration").agg(F.sum("n").alias("n"), F.sum("sse").alias("sse"))
    return sums.where(F.col("n") > 0).select("iteration", "n", (F.col("sse") / F.col("n")).alias("mse"))


def with_patience(curve: DataFrame, patience: int = 20) -> DataFrame:
    """M2: ``curve`` with best_so_far, the iteration of the least error up to here (the first of equals), stopped, whether
    training ends here (``patience`` rounds after it), and is_best, the iteration that is kept."""
    w = Window.orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)  # one row per tree
    best = F.min(F.struct("mse", "iteration")).over(w)["iteration"]
    out = curve.withColumn("best_so_far", best).withColumn("late", F.col("iteration") - F.col("best_so_far") >= patience)
    end = F.coalesce(F.min(F.when(F.col("late"), F.col("iteration"))).over(Window.partitionBy()), F.max("iteration").over(Window.partitionBy()))
    out = out.withColumn("end", end)
    kept = F.max(F.when(F.col("iteration") == F.col("end"), F.col("best_so_far"))).over(Window.partitionBy())
    return out.select("iteration", "n", "mse", "best_so_far", (F.col("iteration") >= F.col("end")).alias("stopped"),
                      (F.col("iteration") == kept).alias("is_best"))


def truncated(model: GBTRegressionModel, trees: int) -> GBTRegressionModel:
    """The ensemble of the first ``trees`` trees."""
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    java = model._java_obj
    if not 1 <= trees <= model.getNumTrees:
        raise ValueError("an ensemble keeps one tree at least and no more than it has")
    kept = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, trees)
    weights = sc._gateway.new_array(sc._gateway.jvm.double, trees)
    for i in range(trees):
        kept[i], weights[i] = java.trees()[i], java.treeWeights()[i]
    return model._copyValues(GBTRegressionModel(sc._jvm.org.apache.spark.ml.regression.GBTRegressionModel(model.uid, kept, weights)))
