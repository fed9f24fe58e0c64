"""The registered queries: one per operator of the inventory.

Each entry takes (spark, sf_dir) and returns a DataFrame over the whole test
tables (through the adapters). Double columns are rounded to 4 places so the
DuckDB oracle (``oracle.py``) can be compared value by value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import ALL
from ..functions import format as fmt
from ..functions import text as T
from ..operators import dataset as DS
from ..operators import keywords as KW
from ..operators import parse as PR
from ..operators import posts as P
from ..operators import profile as PF
from ..operators import recommend as R
from ..operators import segments as S
from ..operators import sentiment as SN
from ..operators import sketches as SK
from ..operators import textfeat as TF
from ..operators.joins import join_keys, join_segments
from ..operators.labels import community_baseline, global_min_max, median_score, scale_min_max
from ..session import scratch_path
from ..sources import adapters as A
from ..sources import io
from ..sources.lexicons import emotion_lexicon, sentiment_lexicon
from . import stages as G

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def q(name: str):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return G.finish(fn(spark, sf))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return run
    return deco


def _scratch(spark: SparkSession, sf: str, name: str) -> str:
    tag = hashlib.md5(sf.encode()).hexdigest()[:8]
    return scratch_path(spark, f"{name}_{tag}")


def _pred_keyed(spark, sf):
    """Split event posts with the served grid's prediction for their own cell."""
    sp = G.event_split(spark, sf)
    pred = G.serving(spark, sf)["predictions"]
    return join_keys(S.keyed(sp), pred, [*S.KEYS, "subreddit", "hour_of_day", "day_of_week"], "inner")


# --- A: sources and sinks ---------------------------------------------------

@q("a1_read_posts")
def a1(spark, sf):
    """Export the raw posts to Parquet and read them back with the schema."""
    path = _scratch(spark, sf, "a1_raw_posts")
    io.export(G.raw(spark, sf), path)
    return io.read_posts(spark, path)


@q("a2_read_posts_csv")
def a2(spark, sf):
    """Write the raw posts as quoted multi-line CSV and read them back with the schema."""
    path = _scratch(spark, sf, "a2_raw_posts_csv")
    io.write_posts_csv(G.raw(spark, sf), path)
    return io.read_posts_csv(spark, path)


@q("a3_stage_raw_posts")
def a3(spark, sf):
    return io.stage(G.raw(spark, sf), _scratch(spark, sf, "a3_raw_posts"), "raw_posts")


@q("a5_export_partitioned")
def a5(spark, sf):
    """Export labels partitioned by community; read back per partition value."""
    out = io.export(G.labels(spark, sf), _scratch(spark, sf, "a5_post_labels"), partition_by=["subreddit"])
    return out.groupBy("subreddit").agg(F.count("*").alias("n_rows"),
                                        F.avg("virality_index").alias("avg_index"))


@q("a6_load_serving")
def a6(spark, sf):
    G.serving(spark, sf)
    return spark.sql("SELECT 'model_metadata' AS table_name, count(*) AS n_rows FROM model_metadata "
                     "UNION ALL SELECT 'predictions', count(*) FROM predictions "
                     "UNION ALL SELECT 'optimal_ranges', count(*) FROM optimal_ranges")


@q("a7_describe_schema")
def a7(spark, sf):
    return io.describe_schema(G.model_ready(spark, sf))


# --- B: projections and filters ---------------------------------------------

@q("b1_filter_language")
def b1(spark, sf):
    return P.filter_language(G.raw(spark, sf), "en")


@q("b2_filter_communities")
def b2(spark, sf):
    return P.filter_communities(G.raw(spark, sf))


@q("b3_process_posts")
def b3(spark, sf):
    return G.processed(spark, sf)


@q("b5_clean_posts")
def b5(spark, sf):
    return P.clean_posts(G.raw(spark, sf))


@q("b6_post_features")
def b6(spark, sf):
    return G.features(spark, sf)


@q("b7_segment_rows")
def b7(spark, sf):
    return R.segment_rows(G.serving(spark, sf)["predictions"], "cat1", "True", "question")


@q("b7_bound_lookup")
def b7b(spark, sf):
    """One segment's metadata by bound parameters, without an option for media."""
    G.serving(spark, sf)
    return R.lookup_rows(spark, "model_metadata", "cat1", None, "question").select(*R.KEYS, "sample_size")


@q("b8_normalize_keys")
def b8(spark, sf):
    r = R.normalize_keys(A.event_requests(spark, sf))
    return r.select("request_id", "category", "post_type", "mechanism",
                    F.col("_pt").alias("post_type_key"), F.col("_mech").alias("mechanism_key"))


@q("b9_trainable")
def b9(spark, sf):
    return DS.trainable_count(G.model_ready(spark, sf))


@q("b10_sample_errors")
def b10(spark, sf):
    t = _pred_keyed(spark, sf).filter(F.col("split") == "test")
    return DS.sample_errors(t, "virality_index", "predicted_viral_score", 10, ["posted_at_local", "post_id"])


# --- C: joins ---------------------------------------------------------------

@q("c1_posts_with_features")
def c1(spark, sf):
    return DS.posts_with_features(G.processed(spark, sf), G.features(spark, sf))


@q("c2_model_ready")
def c2(spark, sf):
    return G.model_ready(spark, sf)


@q("c2_bucketed")
def c2b(spark, sf):
    """C2 and C3 over tables bucketed by post_id: four tables joined without an exchange."""
    t = G.bucketed(spark, sf)
    m = DS.build_model_ready(t["by_post_labels"], t["by_post_features"], t["by_post_nlp"])
    return DS.attach_timestamp(m, t["by_post_times"])


@q("c3_attach_timestamp")
def c3(spark, sf):
    m = DS.attach_timestamp(G.model_ready(spark, sf), G.processed(spark, sf))
    return m.select("post_id", "virality_index", "posted_at_local")


@q("c4_add_category")
def c4(spark, sf):
    return TF.add_category(G.processed(spark, sf)).select("post_id", "subreddit", "category")


@q("c5_unmapped")
def c5(spark, sf):
    return TF.unmapped(G.processed(spark, sf))


@q("c7_keyword_category")
def c7(spark, sf):
    return PR.keyword_category(A.text_requests(spark, sf)).select("request_id", "category")


@q("c7_keyword_table")
def c7t(spark, sf):
    """C7 against a keyword table that grows with the data: one word of every document, in ten categories."""
    return KW.category_by_keywords(A.text_requests(spark, sf), A.word_keywords(spark, sf)).select("request_id", "category")


@q("c8_fuzzy_category")
def c8(spark, sf):
    t = PR.keyword_category(A.text_requests(spark, sf), out="_kw").filter(F.col("_kw").isNull())
    return PR.fuzzy_category(t, "text", "request_id", "fuzzy_category")


@q("c9_match_segment")
def c9(spark, sf):
    meta = G.serving(spark, sf)["model_metadata"]
    r = R.match_segment(R.normalize_keys(A.event_requests(spark, sf)), meta)
    return r.select("request_id", F.col("m_level").alias("level"), F.col("m_category").alias("m_category"),
                    F.col("m_has_media").alias("m_has_media"),
                    F.col("m_engagement_mechanism").alias("m_engagement_mechanism"),
                    F.col("m_sample_size").alias("sample_size"))


@q("c10_match_ranges")
def c10(spark, sf):
    sv = G.serving(spark, sf)
    r = R.match_segment(R.normalize_keys(A.event_requests(spark, sf)), sv["model_metadata"].select(*S.KEYS))
    rr = sv["optimal_ranges"].select(*S.KEYS, F.col("hour_of_day_opt_min").alias("hmin"))
    r = R.match_segment(r, rr, cat="m_category", pt="m_has_media", mech="m_engagement_mechanism", prefix="rm_")
    return r.select("request_id", F.col("rm_level").alias("level"), F.col("rm_category").alias("r_category"),
                    F.col("rm_has_media").alias("r_has_media"),
                    F.col("rm_engagement_mechanism").alias("r_engagement_mechanism"),
                    F.col("rm_hmin").alias("hour_of_day_opt_min"))


# --- D: aggregations ----------------------------------------------------------

@q("d1_community_mean")
def d1(spark, sf):
    return community_baseline(G.processed(spark, sf), "mean")


@q("d2_community_median")
def d2(spark, sf):
    return community_baseline(A.event_posts(spark, sf), "median")


@q("d3_global_min_max")
def d3(spark, sf):
    return global_min_max(G.event_labelled(spark, sf), "virality_index")


@q("d4_top_communities")
def d4(spark, sf):
    return R.top_communities(G.serving(spark, sf)["predictions"], 5)


@q("d5_best_slot")
def d5(spark, sf):
    return R.community_slots(G.serving(spark, sf)["predictions"])


@q("d6_segment_overview")
def d6(spark, sf):
    return R.segment_overview(G.serving(spark, sf)["predictions"])


@q("d7_segment_slot")
def d7(spark, sf):
    return R.segment_slot(G.serving(spark, sf)["predictions"])


@q("d8_media_compare")
def d8(spark, sf):
    return R.media_compare(G.serving(spark, sf)["predictions"])


@q("d9_best_mechanism")
def d9(spark, sf):
    return R.best_mechanism(G.serving(spark, sf)["predictions"])


@q("d10_value_counts")
def d10(spark, sf):
    return PF.value_counts(G.nlp(spark, sf), "engagement_mechanism")


@q("d11_null_counts")
def d11(spark, sf):
    return PF.null_counts(G.nlp(spark, sf))


@q("d12_describe")
def d12(spark, sf):
    return PF.describe(G.nlp(spark, sf), "readability")


@q("d13_profile_categoricals")
def d13(spark, sf):
    return PF.profile_categoricals(G.serving(spark, sf)["predictions"])


@q("d14_profile_metrics")
def d14(spark, sf):
    return PF.profile_metrics(G.serving(spark, sf)["model_metadata"])


R2_EDGES = [float("-inf"), 0.0, 0.05, 0.10, 0.20, float("inf")]
R2_LABELS = ["below 0", "0 to 0.05", "0.05 to 0.10", "0.10 to 0.20", "above 0.20"]


@q("d15_bucket_counts")
def d15(spark, sf):
    return PF.bucket_counts(G.serving(spark, sf)["model_metadata"], "test_r2", R2_EDGES, R2_LABELS)


@q("d16_domain_check")
def d16(spark, sf):
    p = G.serving(spark, sf)["predictions"]
    return PF.domain_check(p, "hour_of_day", 0, 23).unionByName(PF.domain_check(p, "day_of_week", 0, 6))


@q("d14_profile_outcomes")
def d14b(spark, sf):
    """The second name rule: prediction, score, hour and day columns of the grid."""
    return PF.profile_metrics(G.serving(spark, sf)["predictions"], PF.looks_like_outcome)


@q("d17_segment_cube")
def d17(spark, sf):
    return S.segment_cube(G.event_labelled(spark, sf))


@q("d18_body_stats")
def d18(spark, sf):
    return PF.body_stats(G.processed(spark, sf))


@q("d19_time_range")
def d19(spark, sf):
    return PF.time_range(G.event_split(spark, sf), "posted_at_local", "split")


@q("d20_regression_metrics")
def d20(spark, sf):
    m = S.regression_metrics(_pred_keyed(spark, sf), "virality_index", "predicted_viral_score", ["split"])
    return S.overfitting_gap(m).withColumn("vs_baseline", S.compare_to_baseline(F.col("r2")))


@q("d2_sketched_median")
def d2b(spark, sf):
    """The median score of each community by sketch: whether its rank is within the stated error."""
    posts = A.event_posts(spark, sf)
    rows = join_keys(posts, SK.community_median(posts), ["subreddit"])
    return rows.groupBy("subreddit").agg(F.max("n").alias("n"),
                                         (SK.rank_error(F.col("score"), F.col("subreddit_baseline"), 0.5) <= SK.RANK_ERROR).alias("within"))


@q("d6_sketched_overview")
def d6b(spark, sf):
    return SK.segment_overview(G.serving(spark, sf)["predictions"])


@q("d13_sketched_counts")
def d13b(spark, sf):
    return SK.distinct_counts(G.serving(spark, sf)["predictions"])


@q("d17_sketched_cube")
def d17b(spark, sf):
    return SK.segment_cube(G.event_labelled(spark, sf))


@q("m8_sketched_ranges")
def m8b(spark, sf):
    """Optimal ranges by sketch: whether the segment's threshold and the ends of its ranges are within the stated rank error."""
    posts = G.event_split(spark, sf)
    thr = SK.label_thresholds(posts)
    labels = join_segments(S.segment_memberships(posts), thr, S.KEYS).groupBy(*S.KEYS).agg(
        F.max("n").alias("n"), (SK.rank_error(F.col("virality_index"), F.col("thr"), 0.75) <= SK.RANK_ERROR).alias("threshold_within"))
    ends = SK.range_errors(posts, SK.optimal_ranges(posts)).select(*S.KEYS, (F.col("error") <= SK.RANK_ERROR).alias("ends_within"))
    return join_keys(labels, ends, S.KEYS)


# --- E: windows -----------------------------------------------------------------

@q("e4_temporal_split")
def e4(spark, sf):
    return G.event_split(spark, sf).select("post_id", "split")


@q("e5_check_split")
def e5(spark, sf):
    return DS.check_split(G.event_split(spark, sf))


# --- F: sorts and top-k -----------------------------------------------------------

@q("f2_top_posts")
def f2(spark, sf):
    return TF.top_posts(G.nlp(spark, sf).select("post_id", "nrc_anger", "nrc_joy", "readability"),
                        "nrc_anger", 5)


@q("f3_rank_drivers")
def f3(spark, sf):
    return R.rank_drivers(G.serving(spark, sf)["model_metadata"], 3)


# --- H: scalar functions ------------------------------------------------------------

@q("h1_split_title_body")
def h1(spark, sf):
    title, body = T.split_title_body(F.col("text"))
    return G.raw(spark, sf).select("post_id", title.alias("title"), body.alias("body"))


@q("h2_word_count")
def h2(spark, sf):
    p = G.processed(spark, sf)
    return p.select("post_id", T.word_count(F.col("title")).alias("title_length"),
                    T.word_count(F.col("body")).alias("body_length"))


@q("h3_post_mechanism")
def h3(spark, sf):
    j = DS.posts_with_features(G.processed(spark, sf), G.features(spark, sf))
    return j.select("post_id", T.post_mechanism(F.col("title"), F.col("has_media")).alias("engagement_mechanism"))


@q("h4_request_mechanism")
def h4(spark, sf):
    t = PR.keyword_category(A.text_requests(spark, sf), "text", "_kw")
    return t.select("request_id", T.request_mechanism(F.col("text"), F.col("_kw")).alias("mechanism"))


@q("h5_location")
def h5(spark, sf):
    return A.text_requests(spark, sf).select("request_id", T.location(F.col("text")).alias("location"))


@q("h6_normalize_label")
def h6(spark, sf):
    c = A.label_rows(spark, sf)
    return c.select("conv_id", "turn", T.normalize_label(F.col("text")).alias("label"))


@q("h7_resolve_label")
def h7(spark, sf):
    c = A.label_rows(spark, sf)
    return c.select("conv_id", "turn", PR.resolve_label_expr(F.col("text")).alias("category"))


@q("h9_tokens")
def h9(spark, sf):
    p = G.processed(spark, sf)
    tok = T.tokens(TF.post_text(F.col("title"), F.col("body")))
    return p.select("post_id", F.size(tok).alias("n_tokens"), F.array_join(tok, " ").alias("tokens"))


@q("h10_format_range")
def h10(spark, sf):
    rng = G.serving(spark, sf)["optimal_ranges"]
    r = rng.select(*S.KEYS, *[F.col(c).alias(f"r_{c}") for c in rng.columns if c not in S.KEYS])
    r = R.usable_ranges(r.withColumn("drivers", F.array().cast("array<struct<feature:string,shap_value:double>>")),
                        "drivers", "r_", "rngs", limit=5)
    return r.select(*S.KEYS, F.array_join(F.transform("rngs", lambda x: F.concat(x["feature"], F.lit("="),
                                                                                 x["text"])), " | ")
                    .alias("ranges"))


@q("h11_guidance")
def h11(spark, sf):
    sv = G.serving(spark, sf)
    top = R.top_communities(sv["predictions"], 5)
    d = R.drivers(sv["model_metadata"]).select(*S.KEYS, F.transform(F.slice("drivers", 1, 3),
                                                                   lambda x: x["feature"]).alias("top3"))
    j = join_keys(top, d, S.KEYS)
    modes = F.explode(F.array(F.lit("newbie"), F.lit("experienced"), F.lit("technical"))).alias("mode")
    j = j.select("*", modes)
    return j.select(*S.KEYS, "rank", "subreddit", "mode",
                    fmt.guidance(F.col("mode"), F.col("subreddit"), F.col("best_hour"), F.col("best_day"),
                                 F.coalesce(F.col("top3"), F.array().cast("array<string>"))).alias("guidance"))


@q("h12_advice")
def h12(spark, sf):
    f = R.segment_facts(G.serving(spark, sf)["predictions"])
    modes = F.explode(F.array(F.lit("newbie"), F.lit("experienced"), F.lit("technical"))).alias("mode")
    f = f.select("*", modes)
    return f.select(*S.KEYS, "mode", fmt.advice(F.col("mode"), F.col("category"), F.col("n_subreddits"),
                                                 F.col("avg_score"), F.col("best_day"), F.col("best_hour"),
                                                 F.lit(True)).alias("advice"))


def _seg_ranges(spark, sf):
    sv = G.serving(spark, sf)
    meta = R.drivers(sv["model_metadata"]).select(*S.KEYS, "drivers")
    rng = sv["optimal_ranges"]
    r = rng.select(*S.KEYS, *[F.col(c).alias(f"r_{c}") for c in rng.columns if c not in S.KEYS])
    return R.usable_ranges(join_keys(r, meta, S.KEYS), "drivers", "r_", "optimal_ranges")


@q("h13_ranges_sentence")
def h13(spark, sf):
    return _seg_ranges(spark, sf).select(*S.KEYS, fmt.ranges_sentence(F.col("optimal_ranges")).alias("sentence"))


@q("h15_location_note")
def h15(spark, sf):
    t = A.text_requests(spark, sf)
    return t.select("request_id", fmt.location_note(T.location(F.col("text"))).alias("note"))


@q("h21_timing")
def h21(spark, sf):
    ts = F.col("posted_at_local")
    return G.processed(spark, sf).select("post_id", T.hour_of_day(ts).alias("hour_of_day"),
                                         T.day_of_week(ts).alias("day_of_week"),
                                         T.day_of_week_monday0(ts).alias("day_of_week_monday0"),
                                         T.day_name(T.day_of_week(ts)).alias("day_name"))


@q("h30_log_terms")
def h30(spark, sf):
    p = G.processed(spark, sf)
    j = join_keys(p, community_baseline(p), ["subreddit"])
    r = T.ratio(F.col("score"), F.col("subreddit_baseline"))
    return j.select("post_id", r.alias("score_to_avg_ratio"), T.guarded_log1p(F.col("score")).alias("log_score"),
                    T.guarded_log1p(r).alias("log_ratio"))


@q("h31_min_max")
def h31(spark, sf):
    return scale_min_max(A.event_posts(spark, sf).select("post_id", "score"), "score", "score_scaled")


@q("h33_engagement_index")
def h33(spark, sf):
    return G.labels(spark, sf)


@q("h34_median_score")
def h34(spark, sf):
    return median_score(A.event_posts(spark, sf))


@q("h35_pct_lift")
def h35(spark, sf):
    m = R.media_compare(G.serving(spark, sf)["predictions"])
    return m.select("category", "engagement_mechanism",
                    T.pct_lift(F.col("avg_score_with_media"), F.col("avg_score_without_media")).alias("lift_pct"))


# --- N: text features ---------------------------------------------------------------

@q("n1_sentiment")
def n1(spark, sf):
    return TF.sentiment(G.processed(spark, sf), sentiment_lexicon(spark))


@q("n1_sentiment_rules")
def n1r(spark, sf):
    """All published rules; SQL has none of them, see tests/test_sentiment.py."""
    return SN.sentiment_by_rules(G.processed(spark, sf), sentiment_lexicon(spark))


@q("n2_emotions")
def n2(spark, sf):
    return TF.emotions(G.processed(spark, sf), emotion_lexicon(spark))


@q("n3_readability")
def n3(spark, sf):
    return TF.readability(G.processed(spark, sf))


@q("n4_nlp_features")
def n4(spark, sf):
    return G.nlp(spark, sf)


# --- M: segment producers --------------------------------------------------------------

@q("m6_segment_metadata")
def m6(spark, sf):
    return G.serving(spark, sf)["model_metadata"]


@q("m7_prediction_grid")
def m7(spark, sf):
    return G.serving(spark, sf)["predictions"]


@q("m8_optimal_ranges")
def m8(spark, sf):
    return G.serving(spark, sf)["optimal_ranges"]


def _trained(spark, sf):
    from ..operators import model as M
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        ms = G.model_split(spark, sf)
        _MODELS[key] = M.train_gbt(ms)
    return _MODELS[key]


_MODELS: dict = {}


@q("m1_assemble")
def m1(spark, sf):
    """Indexed categoricals + assembled feature vectors of all rows."""
    from pyspark.ml import Pipeline
    from ..operators import model as M
    ms = G.model_split(spark, sf)
    pm = Pipeline(stages=M.assemble_stages()).fit(M.prepare(ms))
    v = pm.transform(M.prepare(ms))
    from pyspark.ml.functions import vector_to_array
    return v.select("post_id", "split", F.size(vector_to_array("features")).alias("n_features"),
                    "subreddit_idx", "category_idx", "engagement_mechanism_idx")


@q("m2_train_gbt")
def m2(spark, sf):
    """Boosted trees (300 x depth 6, rate 0.05, validation stopping); metrics on train and test."""
    from ..operators import model as M
    ms = G.model_split(spark, sf)
    sc = M.score(_trained(spark, sf), ms.filter(F.col("split").isin("train", "test")))
    m = S.regression_metrics(sc, "virality_index", "prediction", ["split"])
    return m.withColumn("vs_baseline", S.compare_to_baseline(F.col("r2")))


@q("m3_score")
def m3(spark, sf):
    from ..operators import model as M
    ms = G.model_split(spark, sf)
    return M.score(_trained(spark, sf), ms.filter(F.col("split") == "test")).select(
        "post_id", F.col("virality_index").alias("actual"), F.col("prediction").alias("predicted"))


@q("m4_attribution")
def m4(spark, sf):
    """Ranked attribution: tree split-gain importances and the linear model's mean |contribution|."""
    from ..operators import model as M
    imp = M.gbt_importances(_trained(spark, sf))
    lin = M.segment_models(G.model_split(spark, sf)).filter(
        (F.col("category") == ALL) & (F.col("has_media") == ALL) & (F.col("engagement_mechanism") == ALL))
    lin_long = lin.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"),
                                                       F.col(f"{f}_shap").alias("mean_abs"))
                                              for f in M.FEATURE_NAMES])).alias("x")).select("x.*")
    return imp.join(lin_long, "feature", "full")


def _patient(spark, sf):
    from ..operators import model as M
    key = (spark.sparkContext.applicationId, sf, "patient")
    if key not in _MODELS:
        _MODELS[key] = M.train_patiently(G.model_split(spark, sf))
    return _MODELS[key]


@q("m2_patience")
def m2c(spark, sf):
    """Validation error after each tree, where training ends (20 rounds without a better one) and the iteration kept."""
    return _patient(spark, sf)[1]


@q("m4_tree_attribution")
def m4t(spark, sf):
    """Mean |contribution| of each feature to the boosted trees' predictions over the test part, ranked."""
    from ..operators import forest, model as M
    model = _patient(spark, sf)[0]
    test = M.feature_rows(model, G.model_split(spark, sf).where(F.col("split") == "test")).select("post_id", "x")
    rows = forest.attribute(test, forest.tree_nodes(model.stages[-1], spark), len(M.FEATURE_NAMES))
    return forest.ranked_attribution(rows, M.FEATURE_NAMES)


# A given forest, so that SQL can follow: (tree, weight, node, value, cover, left, right, feature, threshold).
GIVEN_FEATURES = ["hour_of_day", "body_length", "post_length_proxy"]
GIVEN_FOREST = [
    (0, 1.0, 0, 45.0, 97.0, 1, 2, 1, 40.5), (0, 1.0, 1, 38.0, 61.0, 3, 4, 0, 11.5), (0, 1.0, 2, 55.5, 36.0, 5, 6, 2, 120.5),
    (0, 1.0, 3, 33.25, 35.0, -1, -1, None, None), (0, 1.0, 4, 44.65, 26.0, -1, -1, None, None),
    (0, 1.0, 5, 50.0, 23.0, -1, -1, None, None), (0, 1.0, 6, 68.4, 13.0, -1, -1, None, None),
    (1, 0.5, 0, 0.0, 97.0, 1, 2, 0, 17.5), (1, 0.5, 1, -2.0, 67.0, 3, 4, 0, 5.5), (1, 0.5, 2, 4.5, 30.0, -1, -1, None, None),
    (1, 0.5, 3, -6.0, 19.0, -1, -1, None, None), (1, 0.5, 4, -0.4, 48.0, 5, 6, 1, 15.5),
    (1, 0.5, 5, -3.0, 17.0, -1, -1, None, None), (1, 0.5, 6, 0.75, 31.0, -1, -1, None, None),
    (2, 0.5, 0, 0.0, 97.0, 1, 2, 2, 60.5), (2, 0.5, 1, -1.5, 43.0, -1, -1, None, None), (2, 0.5, 2, 1.25, 54.0, -1, -1, None, None),
    (3, 0.5, 0, 0.0, 97.0, 1, 2, 1, 5.5), (3, 0.5, 1, 9.0, 20.0, -1, -1, None, None), (3, 0.5, 2, -2.25, 77.0, -1, -1, None, None),
]


def _given_forest(spark):
    from ..operators import forest
    return spark.createDataFrame([(*r, None) for r in GIVEN_FOREST], forest.NODES)


def _given_rows(spark, sf, *keep):
    rows = G.model_split(spark, sf)
    return rows.select(*keep, F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(-1e6)) for f in GIVEN_FEATURES]).alias("x"))


@q("m2_staged_curve")
def m2s(spark, sf):
    """The error of a given forest after each of its trees over the validation part, patience 2."""
    from ..operators import forest
    rows = _given_rows(spark, sf, "split", "virality_index").where(F.col("split") == "val")
    return forest.with_patience(forest.staged_curve(rows, _given_forest(spark), "virality_index"), 2)


@q("m4_row_attribution")
def m4r(spark, sf):
    """Contributions of three features to a given forest's prediction for every post."""
    from ..operators import forest
    rows = forest.attribute(_given_rows(spark, sf, "post_id"), _given_forest(spark), len(GIVEN_FEATURES))
    return rows.select("post_id", "prediction", "base", *[F.get("contributions", i).alias(f) for i, f in enumerate(GIVEN_FEATURES)])


@q("m4_permutation_importance")
def m4p(spark, sf):
    """R2 drop of the boosted model on the test part when each feature is permuted."""
    from ..operators import model as M
    ms = G.model_split(spark, sf).filter(F.col("split") == "test")
    return M.permutation_importance(_trained(spark, sf), ms)


@q("m5_driver_direction")
def m5(spark, sf):
    """Top-5 drivers of the overall linear model with direction and controllability."""
    from ..operators import model as M
    t = M.segment_contributions(G.model_split(spark, sf), only=dict.fromkeys(S.KEYS, ALL))
    att = t.agg(*[F.avg(F.abs(F.col(f"{f}_contrib"))).alias(f) for f in M.FEATURE_NAMES]) \
           .unpivot([], M.FEATURE_NAMES, "feature", "mean_abs")
    return M.driver_direction(t, att, 5)


@q("m6_segment_models")
def m6b(spark, sf):
    """model_metadata from per-segment ridge models (grouped sums + one solve per segment)."""
    from ..operators import model as M
    return M.segment_models(G.model_split(spark, sf))


@q("m6_tuned_models")
def m6c(spark, sf):
    """model_metadata from per-segment ridge models whose lambda is chosen by 5-fold cross-validation over Gram sums."""
    from ..operators import model as M
    return M.segment_models(G.model_split(spark, sf), lam=None)


@q("m7_model_grid")
def m7b(spark, sf):
    """The prediction grid from the tuned segment models and the communities' median posts."""
    from ..operators import model as M
    return M.segment_model_grid(G.model_split(spark, sf))


@q("m7_given_grid")
def m7c(spark, sf):
    """The grid from given coefficients (so that SQL can follow) and the communities' median posts."""
    from ..operators import model as M
    posts = G.model_split(spark, sf)
    features = ["title_length", "body_length", "hour_of_day", "day_of_week", "has_media"]
    rows = posts.withColumn("media", F.col("has_media").cast("int").cast("double"))
    profiles = M.community_profiles(rows, {"title_length": "title_length", "body_length": "body_length", "has_media": "media"})
    segments = S.rollup_keys(S.keyed(posts), [F.count("*").alias("n")])
    size = F.length(F.coalesce("category", F.lit(""))).cast("double")
    coef = segments.select(*S.KEYS, (F.lit(30.0) + size).alias("intercept"), F.lit(0.75).alias("b_title_length"), F.lit(-0.0625).alias("b_body_length"),
                           (size / 16).alias("b_hour_of_day"), F.lit(-1.5).alias("b_day_of_week"), F.lit(7.25).alias("b_has_media"))
    fixed = segments.select(*S.KEYS, F.when(F.col("has_media") == "True", 1.0).when(F.col("has_media") == "False", 0.0).alias("o_has_media"))
    return M.model_grid(coef, profiles, posts, features, fixed)


# --- R: recommendation --------------------------------------------------------------------

@q("r1_confidence")
def r1(spark, sf):
    m = G.serving(spark, sf)["model_metadata"]
    return m.select(*S.KEYS, fmt.confidence_tier(F.col("test_r2"), F.col("sample_size")).alias("confidence"),
                    fmt.confidence_reason(F.col("test_r2"), F.col("sample_size")).alias("reason"))


@q("r2_parse_requests")
def r2(spark, sf):
    return PR.parse_requests(A.text_requests(spark, sf)).drop("raw_text")


@q("r3_usable_ranges")
def r3(spark, sf):
    r = _seg_ranges(spark, sf)
    return r.select(*S.KEYS, F.posexplode("optimal_ranges").alias("pos", "x")).select(
        *S.KEYS, (F.col("pos") + 1).alias("rank"), F.col("x.feature").alias("feature"),
        F.col("x.label").alias("label"), F.col("x.text").alias("text"))


def _recommend(spark, sf):
    sv = G.serving(spark, sf)
    return R.recommend(A.event_requests(spark, sf), sv["model_metadata"], sv["predictions"],
                       sv["optimal_ranges"])


@q("r4_recommend")
def r4(spark, sf):
    r = _recommend(spark, sf)
    return r.select(
        "request_id", "confidence", "confidence_reason",
        F.col("model_quality.test_r2").alias("test_r2"), F.col("model_quality.test_rmse").alias("test_rmse"),
        F.col("model_quality.sample_size").alias("sample_size"),
        F.size("recommendations").alias("n_recs"),
        F.array_join(F.transform("drivers", lambda d: d["feature"]), ",").alias("drivers"),
        "advice", "ranges_sentence",
        F.array_join(F.transform("optimal_ranges", lambda x: F.concat(x["feature"], F.lit("="), x["text"])),
                     " | ").alias("optimal_ranges"),
        F.array_join("notes", " ").alias("notes"))


@q("r4_recommend_items")
def r4i(spark, sf):
    r = _recommend(spark, sf)
    x = r.select("request_id", F.posexplode("recommendations").alias("pos", "x"))
    return x.select("request_id", (F.col("pos") + 1).alias("rank"), "x.subreddit", "x.best_hour", "x.best_day",
                    "x.predicted_score", "x.sample_size", "x.guidance")


@q("r5_segment_facts")
def r5(spark, sf):
    return R.segment_facts(G.serving(spark, sf)["predictions"])


# --- S: streaming -----------------------------------------------------------------

STREAM_BATCHES = 4  # micro-batches of a run, about
STREAM_FILE_ROWS = 10_000  # posts of one source file, about: some tens of megabytes of text


def _stream_run(spark, sf):
    import uuid
    from ..streaming.collect import start_collect
    src = _scratch(spark, sf, "s_source")
    # a folder of files = the stream: more files for more documents, and as many of them to a batch as make a few batches
    files = max(STREAM_BATCHES, -(-spark.read.parquet(f"{sf}/documents.parquet").count() // STREAM_FILE_ROWS))
    io.materialize(G.raw(spark, sf).repartition(files), src)
    run = scratch_path(spark, f"s_run_{uuid.uuid4().hex[:8]}")
    start_collect(spark, src, f"{run}/out", f"{run}/checkpoint", f"{run}/progress",
                  max_files_per_trigger=-(-files // STREAM_BATCHES)).awaitTermination()
    return run


@q("s1_collect_stream")
def s1(spark, sf):
    """Stream the raw posts through the allow-list filter into Parquet (equals B2 in batch)."""
    from ..streaming.collect import collected
    return collected(spark, f"{_stream_run(spark, sf)}/out")


@q("s2_stream_progress")
def s2(spark, sf):
    """Rows checked and kept, from the progress table of a run of several micro-batches."""
    from ..streaming.collect import progress_counts
    return progress_counts(spark, f"{_stream_run(spark, sf)}/progress")


def queries() -> dict[str, Query]:
    return dict(QUERIES)
