"""Engagement index edge rows and baselines."""

import math

from postrank.operators.labels import community_baseline, engagement_index, median_score


def test_index_edge_rows(spark):
    rows = [(1, "a", 10), (2, "a", 30), (3, "b", 0), (4, "b", 0), (5, "c", None), (6, "c", 4),
            (7, "d", -1), (8, "d", 3), (9, "e", 7), (10, None, 5), (11, "A", 10)]
    df = spark.createDataFrame(rows, "post_id long, subreddit string, score long")
    out = {r.post_id: r for r in engagement_index(df).collect()}
    assert all(0.0 <= r.virality_index <= 100.0 for r in out.values())
    assert out[3].subreddit_baseline == 0.0 and out[5].virality_index == 0.0
    assert out[10].subreddit_baseline == 5.0           # missing community is its own group
    assert out[11].subreddit_baseline == 10.0          # case matters: 'A' is not 'a'
    assert math.isclose(out[1].subreddit_baseline, 20.0)
    # score -1: ln(0) is undefined -> that component counts 0
    assert out[7].virality_index >= 0.0


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 5)], "post_id long, subreddit string, score long")
    assert [r.virality_index for r in engagement_index(df).collect()] == [0.0, 0.0]


def test_median_variant(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 3), (3, "a", 10), (4, "b", 4)],
                               "post_id long, subreddit string, score long")
    b = {r.subreddit: r.subreddit_baseline for r in community_baseline(df, "median").collect()}
    assert b == {"a": 3.0, "b": 4.0}
    m = {r.post_id: r for r in median_score(df).collect()}
    assert m[3].viral_score == 10 / 4 and m[3].is_top_quartile and not m[1].is_top_quartile
