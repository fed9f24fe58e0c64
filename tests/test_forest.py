"""Staged evaluation with patience, and per-row tree attribution against all subsets of the features."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from postrank.operators import forest as FO


def random_forest(spark, seed, features=4, trees=3, depth=4):
    """Trees with repeated features on a path, numeric and categorical splits."""
    r, rows = random.Random(seed), []
    for t in range(trees):
        fresh = itertools.count()

        def grow(level, cover):
            node = next(fresh)
            if level == 0 or cover < 2 or r.random() < .15 and node:
                rows.append((t, .5 + t, node, r.uniform(-5, 5), float(cover), -1, -1, None, None, None))
                return node
            a = r.randint(1, cover - 1)
            left, right, f = grow(level - 1, a), grow(level - 1, cover - a), r.randrange(features)
            split = (None, [float(c) for c in range(5) if r.random() < .5]) if f == 0 else (r.uniform(-1, 1), None)
            rows.append((t, .5 + t, node, 0.0, float(cover), left, right, f, *split))
            return node

        # the root must be the first node of its tree
        grow(depth, 200)
    return rows, spark.createDataFrame(rows, FO.NODES)


def expected(rows, tree, node, x, known):
    n = next(r for r in rows if r[0] == tree and r[2] == node)
    if n[5] < 0:
        return n[3]
    a, b = (expected(rows, tree, c, x, known) for c in n[5:7])
    if n[7] in known:
        return a if (x[n[7]] <= n[8] if n[9] is None else x[n[7]] in n[9]) else b
    cover = {r[2]: r[4] for r in rows if r[0] == tree}
    return (cover[n[5]] * a + cover[n[6]] * b) / n[4]


def shapley(rows, x, features):
    trees = sorted({(r[0], r[1]) for r in rows})
    value = {s: sum(w * expected(rows, t, 0, x, s) for t, w in trees)
             for k in range(features + 1) for s in itertools.combinations(range(features), k)}
    out = []
    for j in range(features):
        others = [s for s in value if j not in s]
        out.append(sum(math.factorial(len(s)) * math.factorial(features - len(s) - 1) / math.factorial(features)
                       * (value[tuple(sorted((*s, j)))] - value[s]) for s in others))
    return value[tuple(range(features))], value[()], out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_contributions_equal_the_average_over_all_subsets(spark, seed):
    rows, nodes = random_forest(spark, seed)
    r = random.Random(seed)
    xs = [[float(r.randrange(6)), *(r.uniform(-1.2, 1.2) for _ in range(3))] for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(xs)), "id int, x array<double>").repartition(3)
    got = FO.attribute(df, nodes, 4).collect()
    assert len(got) == len(xs)
    for g in got:
        prediction, base, parts = shapley(rows, xs[g["id"]], 4)
        assert abs(g["prediction"] - prediction) < 1e-9 and abs(g["base"] - base) < 1e-9
        assert np.allclose(g["contributions"], parts, atol=1e-9)
        assert abs(g["base"] + sum(g["contributions"]) - g["prediction"]) < 1e-9


@pytest.fixture(scope="module")
def boosted(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *(float(v) for v in rng.normal(size=3)), "val" if i % 3 == 0 else "train") for i in range(600)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, split string")
    noise = F.when(F.col("split") == "train", F.sin(F.col("id") * 12.9898) * 6).otherwise(0.0)
    df = df.withColumn("y", 5 * F.col("a") + F.when(F.col("b") > 0, 3.0).otherwise(-3.0) + noise)
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).withColumn("x", vector_to_array("features"))
    model = GBTRegressor(featuresCol="features", labelCol="y", maxIter=25, maxDepth=5, stepSize=.6, seed=1).fit(rows.where("split = 'train'"))
    return rows, model


def test_fitted_trees_predict_as_the_library_does(spark, boosted):
    rows, model = boosted
    nodes = FO.tree_nodes(model, spark)
    want = {r["id"]: r["prediction"] for r in model.transform(rows).select("id", "prediction").collect()}
    for r in FO.attribute(rows.select("id", "x"), nodes, 3).collect():
        assert abs(r["prediction"] - want[r["id"]]) < 1e-6
        assert abs(r["base"] + sum(r["contributions"]) - want[r["id"]]) < 1e-6
    ranked = FO.ranked_attribution(FO.attribute(rows.select("id", "x"), nodes, 3), ["a", "b", "c"]).collect()
    assert [r["feature"] for r in ranked][0] == "a" and ranked[-1]["feature"] == "c"


def test_curve_and_truncated_model_on_a_planted_overfit(spark, boosted):
    """The noise of the training rows is not in the validation rows: the error falls, then rises."""
    rows, model = boosted
    val = rows.where("split = 'val'")
    curve = FO.with_patience(FO.staged_curve(val, FO.tree_nodes(model, spark), "y"), 5)
    points = sorted(curve.collect(), key=lambda r: r["iteration"])
    library = model.evaluateEachIteration(val, "squared")
    assert len(points) == 25 and np.allclose([p["mse"] for p in points], library)
    best = next(p["iteration"] for p in points if p["is_best"])
    end = next(p["iteration"] for p in points if p["stopped"])
    errors, run = [p["mse"] for p in points], None
    for i in range(25):  # the rule, one round at a time
        run = i if run is None or errors[i] < errors[run] else run
        if i - run >= 5:
            break
    assert (best, end) == (run + 1, i + 1) and 1 <= best < end < 25
    kept = FO.truncated(model, best)
    assert kept.getNumTrees == best and kept.treeWeights == model.treeWeights[:best]
    mse = PipelineModel(stages=[kept]).transform(val).agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0]
    assert abs(mse - errors[best - 1]) < 1e-9
    with pytest.raises(ValueError):
        FO.truncated(model, 0)


def test_curve_without_rows_or_labels(spark, boosted):
    rows, model = boosted
    nodes = FO.tree_nodes(FO.truncated(model, 2), spark)
    none = FO.with_patience(FO.staged_curve(rows.withColumn("y", F.lit(None).cast("double")), nodes, "y"), 5)
    assert none.collect() == []
    assert FO.attribute(rows.select("id", "x").limit(0), nodes, 3).collect() == []
