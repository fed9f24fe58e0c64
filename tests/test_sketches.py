"""Sketches against exact figures, on skewed data."""

import math
import tempfile

import numpy as np
from pyspark.sql import functions as F

from postrank.operators import segments as S
from postrank.operators import sketches as SK
from postrank.operators.joins import join_segments


def skewed(spark, n=60_000):
    """Two thirds in one community and segment, heavy tails, many ties, missing keys and labels."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        hot = i % 3 > 0
        y = float(np.floor(rng.pareto(1.2) * 10)) if hot else float(rng.normal(50, 3))
        rows.append((i, "hot" if hot else f"c{i % 40}", None if i % 50 == 1 else "cat", i % 7 == 0 if i % 11 else None, "question",
                     None if i % 500 == 3 else math.nan if i % 500 == 4 else y, int(rng.integers(0, 24)), int(rng.geometric(.02))))
    return spark.createDataFrame(rows, "post_id long, subreddit string, category string, has_media boolean, engagement_mechanism string, "
                                       "virality_index double, hour_of_day int, body_length int").repartition(7)


def test_quantiles_are_within_their_rank_error(spark):
    posts = skewed(spark).persist()
    rows = posts.toPandas()
    known = rows[rows.virality_index.notna()]
    for r in SK.community_median(posts, "virality_index").collect():
        v = known[known.subreddit == r["subreddit"]].virality_index
        assert r["n"] == len(v) and (v < r["subreddit_baseline"]).mean() - SK.RANK_ERROR <= .5 <= (v <= r["subreddit_baseline"]).mean() + SK.RANK_ERROR
    thresholds = {(r["category"], r["has_media"]): r for r in SK.label_thresholds(posts).where("engagement_mechanism = 'ALL'").collect()}
    assert set(thresholds) == {(c, m) for c in ("cat", None, "ALL") for m in ("True", "False", None, "ALL")}
    for (category, media), r in thresholds.items():
        v = known
        if category != "ALL":
            v = v[v.category.isna() if category is None else v.category == category]
        if media != "ALL":
            v = v[v.has_media.isna() if media is None else v.has_media.eq(media == "True")]
        v = v.virality_index
        assert r["n"] == len(v) and (v < r["thr"]).mean() - SK.RANK_ERROR <= .75 <= (v <= r["thr"]).mean() + SK.RANK_ERROR
    ranges = SK.optimal_ranges(posts)
    assert ranges.columns == S.optimal_ranges(posts).columns
    errors = SK.range_errors(posts, ranges).collect()
    assert len(errors) == 24 and max(r["error"] for r in errors) <= SK.RANK_ERROR
    posts.unpersist()


def test_small_groups_and_missing_values(spark):
    rows = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 2.0), ("b", None), (None, 7.0), ("c", math.nan)], "subreddit string, score double")
    got = {r["subreddit"]: (r["n"], r["subreddit_baseline"]) for r in SK.community_median(rows).collect()}
    assert got == {"a": (3, 2.0), "b": (0, None), "c": (0, None), None: (1, 7.0)}
    assert SK.community_median(rows.limit(0)).count() == 0


def test_distinct_counts(spark):
    posts = skewed(spark, 3000)
    exact = {tuple(r)[:3]: r for r in S.segment_cube(posts.fillna(0.0, ["virality_index"])).collect()}
    got = {tuple(r)[:3]: r for r in SK.segment_cube(posts.fillna(0.0, ["virality_index"])).collect()}
    assert set(got) == set(exact)
    for k, r in got.items():  # some dozens of communities are counted exactly
        assert r["n_posts"] == exact[k]["n_posts"] and r["n_subreddits"] == exact[k]["n_subreddits"]
    many = spark.range(200_000).select((F.col("id") % 50_000).cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
    counts = dict(map(tuple, SK.distinct_counts(many).collect()))
    assert abs(counts["a"] / 50_000 - 1) < .06 and counts["b"] == 0


def test_segment_joins_never_send_the_posts(spark):
    """Rows spread over their segments look small before a run; the table of segments is sent, or none."""
    path = f"{tempfile.mkdtemp(prefix='run-', dir='/tmp')}/posts"
    skewed(spark, 2000).write.parquet(path)
    posts = spark.read.parquet(path)
    thr = SK.label_thresholds(posts)
    for out in (SK.top_posts_of_segments(posts), join_segments(S.segment_memberships(posts), thr, S.KEYS),
                join_segments(S.segment_memberships(posts), thr, S.KEYS, max_rows=1), SK.range_errors(posts, SK.optimal_ranges(posts))):
        assert "BuildLeft" not in out._jdf.queryExecution().executedPlan().toString()
    assert join_segments(S.segment_memberships(posts), thr, S.KEYS, max_rows=1).count() == 8 * 2000
