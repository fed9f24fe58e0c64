"""Ladder, top-N, confidence and response-shape tests on small in-test tables."""

import math

import pytest
from pyspark.sql import functions as F

from fixtures import contract_tables, ladder_metadata, ladder_predictions, requests
from postrank.dims import FEATURE_NAMES
from postrank.functions import format as fmt
from postrank.operators import recommend as R
from postrank.operators import segments as S


def _ladder(spark, rows):
    req = R.normalize_keys(requests(spark, [(c, p, m, "newbie") for c, p, m in rows]))
    out = R.match_segment(req, ladder_metadata(spark)).orderBy("request_id").collect()
    return [r["m_test_r2"] for r in out]


def test_fallback_ladder(spark):
    got = _ladder(spark, [("Food & Cooking", "True", "question"), ("Food & Cooking", "True", None),
                          ("Food & Cooking", None, None), ("unknown", None, None),
                          ("Gaming", "True", "showcase"), ("Food & Cooking", "", "question")])
    assert got == [0.15, 0.12, 0.09, 0.05, 0.05, 0.11]


def test_ladder_without_global_row_gives_no_match(spark):
    meta = ladder_metadata(spark).filter(F.col("category") != "ALL")
    req = R.normalize_keys(requests(spark, [("Pets", None, None, "newbie")]))
    r = R.match_segment(req, meta).first()
    assert r["m_level"] is None and r["m_test_r2"] is None


def test_top_communities_order_and_slot(spark):
    t = R.top_communities(ladder_predictions(spark), 5).orderBy("rank").collect()
    assert [(r.subreddit, r.predicted_score) for r in t] == [("Cooking", 70.0), ("Baking", 60.0), ("food", 30.0)]
    assert (t[0].best_hour, t[0].best_day, t[0].sample_size) == (9, "Sunday", 2)
    assert [r.subreddit for r in R.top_communities(ladder_predictions(spark), 2).orderBy("rank").collect()] \
        == ["Cooking", "Baking"]


def test_unknown_segment_has_no_rows(spark):
    p = ladder_predictions(spark)
    assert R.segment_rows(p, "Unknown", "True", "question").count() == 0


def test_day_name_unknown_integer_prints_itself(spark):
    from postrank.functions.text import day_name
    r = spark.createDataFrame([(0,), (6,), (9,)], "d int").select(day_name(F.col("d")).alias("n")).collect()
    assert [x.n for x in r] == ["Sunday", "Saturday", "9"]


CONF = [(0.15, 1000, "high"), (0.05, 200, "low"), (-0.1, 5000, "none"), (None, 1000, "none"),
        (0.15, 50, "none"), (0.10, 500, "high"), (0.00, 100, "low"), (0.15, None, "none"),
        (float("nan"), 1000, "none")]


def test_confidence_boundaries(spark):
    df = spark.createDataFrame([(r, n) for r, n, _ in CONF], "r2 double, n long")
    got = df.select(fmt.confidence_tier(F.col("r2"), F.col("n")).alias("t"),
                    fmt.confidence_reason(F.col("r2"), F.col("n")).alias("why")).collect()
    assert [g.t for g in got] == [t for _, _, t in CONF]
    assert got[0].why == "R² of 0.15 on 1,000 posts (above baseline)"
    assert got[3].why == "no model metrics available for this segment"
    assert got[4].why.endswith("(sample too small for a reliable estimate)")
    assert got[2].why.endswith("(worse than predicting the average)")


@pytest.fixture(scope="module")
def responses(spark):
    meta, preds, ranges = contract_tables(spark)
    cases = [("Food & Cooking", None, "question"), ("Home & Interior", None, None),
             ("Mental Health", None, "showcase"), ("Pets", None, None)]
    rows = [(c, p, m, mode) for c, p, m in cases for mode in ("newbie", "experienced", "technical")]
    out = R.recommend(requests(spark, rows), meta, preds, ranges).orderBy("request_id").collect()
    return {(r["query"]["category"], rows[r.request_id][3]): r for r in out}


EXPECTED = {"Food & Cooking": "high", "Home & Interior": "low", "Mental Health": "none", "Pets": "none"}


def test_response_tiers_and_shape(responses):
    for (cat, mode), r in responses.items():
        assert r.confidence == EXPECTED[cat]
        assert r.confidence_reason
        assert set(r.model_quality.asDict()) == {"test_r2", "test_rmse", "sample_size"}
        if r.confidence == "none":
            assert r.recommendations == []
        if r.confidence == "low":
            assert r.recommendations and all(x.predicted_score is None for x in r.recommendations)
        if r.confidence == "high":
            assert all(x.predicted_score is not None and 0 <= x.predicted_score <= 100 for x in r.recommendations)
        for x in r.recommendations:
            assert isinstance(x.guidance, str) and x.guidance
            assert x.best_day is None or not x.best_day.isdigit()
            assert x.best_hour is None or 0 <= x.best_hour <= 23
        if mode != "technical":
            assert r.drivers == []
    assert responses[("Pets", "newbie")].notes == ["No model metadata found for this query."]
    assert responses[("Food & Cooking", "newbie")].notes == [
        "Matched segment: Food & Cooking / has_media=ALL / question."]


def test_technical_drivers(responses):
    d = responses[("Food & Cooking", "technical")].drivers
    assert [x.feature for x in d][:3] == ["engagement_mechanism", "category", "subreddit"]
    assert all(x.feature in FEATURE_NAMES and not x.feature.endswith("_shap") for x in d)
    assert all(isinstance(x.shap_value, float) for x in d)


def test_recommendations_ranked(responses):
    r = responses[("Food & Cooking", "newbie")]
    assert [x.subreddit for x in r.recommendations] == ["Cooking", "Baking", "food"]
    assert math.isclose(r.recommendations[0].predicted_score, 62.4)
    assert r.recommendations[0].guidance == "r/Cooking is a good fit. Try posting on Sunday around 9:00."


def test_ranges_and_advice(responses):
    r = responses[("Food & Cooking", "experienced")]
    assert [(x.feature, x.text) for x in r.optimal_ranges] == [("title_length", "8-14 words"),
                                                              ("hour_of_day", "9:00-17:00 UTC")]
    assert r.ranges_sentence == "Target a title length of 8-14 words and a posting hour of 9:00-17:00 UTC."
    assert r.advice == "For Food & Cooking posts like yours, the data favors posting Sunday around 9:00 UTC."
    t = responses[("Food & Cooking", "technical")]
    assert t.advice == ("Across 3 subreddits in Food & Cooking, this segment averages a predicted virality "
                        "of 59.2. The strongest slot in the grid is Sunday around 9:00 UTC.")
    assert t.recommendations[0].guidance == (
        "For this segment the model weights engagement_mechanism, category, subreddit most heavily. "
        "Post on Sunday around 9:00. Structure your post with those factors in mind.")
    h = responses[("Home & Interior", "newbie")]
    assert [x.text for x in h.optimal_ranges] == ["Monday to Friday"]
    assert responses[("Mental Health", "newbie")].advice == ""


def test_guidance_differs_by_mode(spark):
    df = spark.createDataFrame([(m,) for m in ("newbie", "experienced", "technical")], "mode string")
    g = df.select(fmt.guidance(F.col("mode"), F.lit("Cooking"), F.lit(9), F.lit("Sunday"),
                               F.array(F.lit("subreddit"))).alias("g")).collect()
    assert len({x.g for x in g}) == 3 and all(x.g.strip() for x in g)


def test_equal_cells_choose_the_earliest_slot_whatever_the_order_of_summation(spark):
    """A cell whose mean equals its community's is that mean in every cell, but for the last bits of a double."""
    score = [37.3, 11.7, 90.1, 0.1, 55.55]
    rows = [("cat", None, "question", f"c{c}", h, d, s) for c in range(3) for i, s in enumerate(score) for h, d in ((5, 3), (9 + i, 1))]
    rows += [("cat", None, "question", f"c{c}", h, 2, s) for c in range(3) for h in (1, 2) for s in score]
    df = spark.createDataFrame(rows, "category string, has_media boolean, engagement_mechanism string, subreddit string, "
                                     "hour_of_day int, day_of_week int, virality_index double").repartition(4)
    even = df.where("day_of_week <> 1")  # all cells of all communities have the same mean
    got = R.top_communities(S.prediction_grid(even)).collect()
    for key in {(r["category"], r["has_media"], r["engagement_mechanism"]) for r in got}:
        top = sorted((r["rank"], r["subreddit"], r["best_hour"], r["best_day"]) for r in got
                     if (r["category"], r["has_media"], r["engagement_mechanism"]) == key)
        assert top == [(1, "c0", 0, "Sunday"), (2, "c1", 0, "Sunday"), (3, "c2", 0, "Sunday")]
    assert any(r["has_media"] is None for r in got)
    slots = R.segment_slot(S.prediction_grid(even)).collect()
    assert {(r["best_day_of_week"], r["best_hour"]) for r in slots} == {(0, 0)}
