"""Lambda by cross-validation over Gram sums, and the grid from segment models, against one row at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postrank.operators import model as M
from postrank.operators.segments import KEYS


@pytest.fixture(scope="module")
def rows(spark):
    """Design rows of two categories: one follows two features, the other is noise."""
    rng = np.random.default_rng(5)
    d = len(M.model_columns())
    out = []
    for i in range(240):
        x = rng.normal(size=d)
        y = 50 + (8 * x[0] - 5 * x[3] if i % 2 else 0) + rng.normal() * (1 if i % 2 else 12)
        out.append((i, "signal" if i % 2 else "noise", None if i % 5 == 0 else str(i % 3 == 0), "question", float(y), *map(float, x)))
    names = ["post_id", *KEYS, M.LABEL, *(f"_x{i}" for i in range(d))]
    types = ["long", "string", "string", "string", "double", *["double"] * d]
    return spark.createDataFrame(out, ", ".join(f"{n} {t}" for n, t in zip(names, types))).repartition(3)


def test_chosen_lambda_equals_row_wise_cross_validation(rows):
    dealt = rows.withColumn("fold", F.pmod(F.xxhash64("post_id"), F.lit(M.FOLDS))).toPandas()
    x = dealt[[c for c in dealt.columns if c.startswith("_x")]].to_numpy()
    y, fold = dealt[M.LABEL].to_numpy(), dealt["fold"].to_numpy()

    def error(inside, lam):
        total = 0.0
        for k in range(M.FOLDS):
            a, b = inside & (fold != k), inside & (fold == k)
            mx, my = x[a].mean(axis=0), y[a].mean()
            c = np.linalg.solve((x[a] - mx).T @ (x[a] - mx) + lam * np.eye(x.shape[1]), (x[a] - mx).T @ (y[a] - my))
            total += ((y[b] - my - (x[b] - mx) @ c) ** 2).sum()
        return total / inside.sum()

    got = {(r["category"], r["has_media"], r["engagement_mechanism"]): r for r in M.tuned_lambdas(rows).collect()}
    assert len(got) == 24  # a missing media key has segments of its own
    for category in ("signal", "noise", "ALL"):
        inside = np.ones(len(y), bool) if category == "ALL" else (dealt["category"] == category).to_numpy()
        errors = {lam: error(inside, lam) for lam in M.LAMBDAS}
        r = got[category, "ALL", "ALL"]
        assert r["lam"] == min(errors, key=errors.get) and abs(r["cv_mse"] - errors[r["lam"]]) < 1e-6 * errors[r["lam"]]
    assert got["signal", "ALL", "ALL"]["lam"] < got["noise", "ALL", "ALL"]["lam"]


def test_a_segment_of_one_row_takes_the_default(rows):
    one = M.tuned_lambdas(rows.where("post_id = 7")).collect()
    assert {(r["lam"], r["cv_mse"]) for r in one} == {(1.0, None)}


def test_grid_scores_the_median_post_of_each_community(spark):
    posts = spark.createDataFrame([("c0", "cat", True, "question", 10.0), ("c0", "cat", True, "question", 30.0), ("c0", "cat", None, None, 50.0),
                                   ("c1", None, False, "question", None)],
                                  "subreddit string, category string, has_media boolean, engagement_mechanism string, size double")
    profiles = M.community_profiles(posts, {"size": "size"})
    keys = "category string, has_media string, engagement_mechanism string"
    coef = spark.createDataFrame([("ALL", "ALL", "ALL", 1.0, 2.0, .5, -3.0), ("cat", None, None, 200.0, 0.0, 0.0, 0.0), (None, "ALL", "ALL", -9.0, 0.0, 1.0, 0.0)],
                                 f"{keys}, intercept double, b_size double, b_hour_of_day double, b_day_of_week double")
    got = {tuple(r)[:6]: r[6] for r in M.model_grid(coef, profiles, posts, ["size", "hour_of_day", "day_of_week"]).collect()}
    assert len(got) == 4 * 168
    for h in range(24):
        for d in range(7):
            assert got["ALL", "ALL", "ALL", "c0", h, d] == 1 + 2 * 30 + .5 * h - 3 * d
            assert got["ALL", "ALL", "ALL", "c1", h, d] == max(0, 1 + .5 * h - 3 * d)  # no known size counts as 0
            assert got["cat", None, None, "c0", h, d] == 100 and got[None, "ALL", "ALL", "c1", h, d] == max(0, h - 9)
    fixed = coef.select(*KEYS, F.when(F.col("category") == "ALL", 40.0).alias("o_size"))
    again = {tuple(r)[:6]: r[6] for r in M.model_grid(coef, profiles, posts, ["size", "hour_of_day", "day_of_week"], fixed).collect()}
    assert again["ALL", "ALL", "ALL", "c0", 0, 0] == 81 and again["cat", None, None, "c0", 0, 0] == 100


def test_community_profiles_are_medians_without_held_values(spark):
    rows = spark.createDataFrame([("a", 1, 2.5), ("a", 4, None), ("a", 2, 7.5), ("b", None, float("inf")), (None, 3, 1.0), (None, 3, -1.0), ("c", 5, -0.25)],
                                 "subreddit string, n int, x double")
    out = M.community_profiles(rows, {"n": "n", "x y": "x"})
    want = rows.groupBy("subreddit").agg(F.median("n").alias("p_n"), F.median("x").alias("p_x y"))
    assert out.columns == want.columns and sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    assert "ObjectHashAggregate" not in out._jdf.queryExecution().executedPlan().toString() and M.community_profiles(rows.limit(0), {"n": "n"}).count() == 0
