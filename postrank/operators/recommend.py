"""Recommendations for a whole table of requests.

Plan shape: everything that depends only on a segment (top communities, best
slot, facts, drivers, ranges) is computed once per segment from the serving
tables, which are small (segments x communities x 168 at most). The request
table -- the part that grows -- then streams through broadcast hash joins
only: no shuffle of requests at all, and a hot segment shared by a third of
the requests costs nothing extra. Every broadcast side is counted first
(``join_checked``); a side over the bound falls back to a shuffle join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dims import ALL, FEATURE_NAMES, RANGE_FEATURES, SEGMENT_KEYS
from ..functions import format as fmt
from ..functions.text import day_name
from .joins import fits_broadcast, join_checked, join_keys, join_sized
from .segments import DIGITS

KEYS = SEGMENT_KEYS


# B7 / B8 --------------------------------------------------------------------
def normalize_keys(requests: DataFrame, post_type: str = "post_type", mechanism: str = "mechanism") -> DataFrame:
    """Missing (NULL or '') options become 'ALL' in ``_pt`` / ``_mech``."""
    return (requests
            .withColumn("_pt", F.coalesce(F.nullif(F.col(post_type), F.lit("")), F.lit(ALL)))
            .withColumn("_mech", F.coalesce(F.nullif(F.col(mechanism), F.lit("")), F.lit(ALL))))


def segment_rows(table: DataFrame, category: str, has_media: str, mechanism: str) -> DataFrame:
    """Rows of one segment, keys bound as literals (never string-built SQL)."""
    return table.filter((F.col("category") == F.lit(category)) & (F.col("has_media") == F.lit(has_media))
                        & (F.col("engagement_mechanism") == F.lit(mechanism)))


LOOKUP_TABLES = ("model_metadata", "optimal_ranges", "predictions")


def lookup_rows(spark: SparkSession, table: str, category: str, post_type: str | None = None,
                mechanism: str | None = None) -> DataFrame:
    """B7 over the registered serving tables: the rows of one segment, 'ALL' for an option that is missing.

    Values reach the query as bound parameters and are only ever data. The table's name is bound as an identifier and
    must be one of LOOKUP_TABLES; any other is an error. A missing category finds nothing.
    """
    if table not in LOOKUP_TABLES:
        raise ValueError(f"unknown segment table: {table}")
    return spark.sql("SELECT * FROM IDENTIFIER(:table) WHERE category = :category AND has_media = :post_type "
                     "AND engagement_mechanism = :mechanism",
                     args={"table": table, "category": category, "post_type": post_type or ALL, "mechanism": mechanism or ALL})


# C9 / C10 -------------------------------------------------------------------
def match_segment(requests: DataFrame, seg: DataFrame, cat: str = "category", pt: str = "_pt",
                  mech: str = "_mech", prefix: str = "m_") -> DataFrame:
    """5-level fallback, first match wins, for every request at once.

    Levels: (cat, pt, mech), (cat, ALL, mech), (cat, pt, ALL), (cat, ALL, ALL),
    (ALL, ALL, ALL). Adds ``{prefix}level`` (1-5, NULL if none), the matched
    keys ``{prefix}category`` ... and the segment row's other columns.
    Each level is one broadcast hash join against the distinct segment keys.
    """
    seg, small = fits_broadcast(seg.dropDuplicates(KEYS))
    keys = seg.select(*KEYS)
    cands = [(F.col(cat), F.col(pt), F.col(mech)), (F.col(cat), F.lit(ALL), F.col(mech)),
             (F.col(cat), F.col(pt), F.lit(ALL)), (F.col(cat), F.lit(ALL), F.lit(ALL))]
    r = requests
    for i, cand in enumerate(cands):
        k = keys.select(*[F.col(c).alias(f"_k{i}_{j}") for j, c in enumerate(KEYS)],
                        F.lit(True).alias(f"_hit{i}"))
        cond = reduce(lambda a, b: a & b, [cand[j] == k[f"_k{i}_{j}"] for j in range(3)])
        r = join_sized(r, k, small, cond, "left").drop(*[f"_k{i}_{j}" for j in range(3)])
    glob = keys.filter(reduce(lambda a, b: a & b, [F.col(c) == ALL for c in KEYS])) \
               .select((F.count("*") > 0).alias("g")).scalar()
    cands.append((F.lit(ALL), F.lit(ALL), F.lit(ALL)))
    hits = [F.coalesce(F.col(f"_hit{i}"), F.lit(False)) for i in range(4)] + [glob]
    level = reduce(lambda acc, i: acc.when(hits[i], F.lit(i + 1)), range(1, 5),
                   F.when(hits[0], F.lit(1)))
    r = r.withColumn(f"{prefix}level", level)
    for j, c in enumerate(KEYS):
        pick = reduce(lambda acc, i: acc.when(hits[i], cands[i][j]), range(1, 5),
                      F.when(hits[0], cands[0][j]))
        r = r.withColumn(f"{prefix}{c}", pick)
    r = r.drop(*[f"_hit{i}" for i in range(4)])
    rest = seg.select(*[F.col(c).alias(f"_s_{c}") for c in KEYS],
                      *[F.col(c).alias(f"{prefix}{c}") for c in seg.columns if c not in KEYS])
    cond = reduce(lambda a, b: a & b, [F.col(f"{prefix}{c}") == F.col(f"_s_{c}") for c in KEYS])
    return join_sized(r, rest, small, cond, "left").drop(*[f"_s_{c}" for c in KEYS])


# D4 / D5 / F1 ---------------------------------------------------------------
def community_slots(pred: DataFrame) -> DataFrame:
    """D4 + D5 per (segment, community): mean score, grid rows, best slot.

    Best slot = highest score, ties to the earlier day then the earlier hour:
    one ``max_by`` in the same aggregate (no query per community).
    """
    order = F.struct(F.col("predicted_viral_score"), -F.col("day_of_week"), -F.col("hour_of_day"))
    return (pred.groupBy(*KEYS, "subreddit").agg(
        F.avg("predicted_viral_score").alias("predicted_score"),
        F.count("*").alias("sample_size"),
        F.max_by(F.struct("hour_of_day", "day_of_week"), order).alias("_best"))
        .select(*KEYS, "subreddit", "predicted_score", "sample_size",
                F.col("_best.hour_of_day").alias("best_hour"),
                day_name(F.col("_best.day_of_week")).alias("best_day")))


def top_communities(pred: DataFrame, n: int = 5) -> DataFrame:
    """D4 + D5: the top ``n`` communities of each segment, with ``rank``.

    Ordered by mean predicted score desc (to DIGITS places), then community name. The window
    partitions are segments over per-community rows (bounded by communities).
    """
    w = Window.partitionBy(*KEYS).orderBy(F.round("predicted_score", DIGITS).desc(), F.col("subreddit").asc())
    return community_slots(pred).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_community_lists(pred: DataFrame, n: int = 5) -> DataFrame:
    """One row per segment with its ranked top-``n`` list (array of structs)."""
    t = top_communities(pred, n)
    item = F.struct("rank", "subreddit", "best_hour", "best_day", "predicted_score", "sample_size")
    return t.groupBy(*KEYS).agg(F.array_sort(F.collect_list(item)).alias("_recs"))


# D6-D9 / R5 -----------------------------------------------------------------
def segment_overview(pred: DataFrame) -> DataFrame:
    """Rows, distinct communities, mean score per segment."""
    return pred.groupBy(*KEYS).agg(F.count("*").alias("n_rows"),
                                   F.countDistinct("subreddit").alias("n_subreddits"),
                                   F.avg("predicted_viral_score").alias("avg_score"))


def segment_slot(pred: DataFrame) -> DataFrame:
    """Best (day, hour) of a segment by mean score; ties to earlier day, hour."""
    s = pred.groupBy(*KEYS, "day_of_week", "hour_of_day").agg(F.avg("predicted_viral_score").alias("a"))
    best = F.max_by(F.struct("day_of_week", "hour_of_day"),
                    F.struct(F.round("a", DIGITS), -F.col("day_of_week"), -F.col("hour_of_day")))
    return (s.groupBy(*KEYS).agg(best.alias("_b"))
             .select(*KEYS, F.col("_b.day_of_week").alias("best_day_of_week"),
                     F.col("_b.hour_of_day").alias("best_hour")))


def media_compare(pred: DataFrame) -> DataFrame:
    """Mean score with and without media per (category, mechanism)."""
    s = F.col("predicted_viral_score")
    return pred.groupBy("category", "engagement_mechanism").agg(
        F.avg(F.when(F.col("has_media") == "True", s)).alias("avg_score_with_media"),
        F.avg(F.when(F.col("has_media") == "False", s)).alias("avg_score_without_media"))


def best_mechanism(pred: DataFrame) -> DataFrame:
    """Best concrete mechanism per (category, has_media); ties by name."""
    s = (pred.filter(F.col("engagement_mechanism") != ALL)
             .groupBy("category", "has_media", "engagement_mechanism")
             .agg(F.avg("predicted_viral_score").alias("a")))
    return s.groupBy("category", "has_media").agg(
        F.min_by("engagement_mechanism", F.struct(-F.round("a", DIGITS), F.col("engagement_mechanism")))
        .alias("best_mechanism"))


def segment_facts(pred: DataFrame) -> DataFrame:
    """One row of facts per segment that has prediction rows."""
    o = segment_overview(pred)
    f = join_keys(o, segment_slot(pred), KEYS)
    f = join_keys(f, media_compare(pred), ["category", "engagement_mechanism"])
    f = join_keys(f, best_mechanism(pred), ["category", "has_media"])
    return f.select(*KEYS, "n_rows", "n_subreddits", "avg_score",
                    F.try_element_at(F.array(*[F.lit(d) for d in
                                               ["Sunday", "Monday", "Tuesday", "Wednesday",
                                                "Thursday", "Friday", "Saturday"]]),
                                     F.col("best_day_of_week") + 1).alias("best_day"),
                    "best_hour", "avg_score_with_media", "avg_score_without_media", "best_mechanism")


# F3 -------------------------------------------------------------------------
def drivers(df: DataFrame, out: str = "drivers", prefix: str = "") -> DataFrame:
    """array of (feature, shap_value) from the 19 ``*_shap`` columns.

    Missing (NULL / NaN) values are dropped; ordered by |value| desc, then the
    fixed feature order (a stable sort).
    """
    items = [F.struct(F.lit(i).alias("o"), F.lit(f).alias("feature"),
                      F.nanvl(F.col(f"{prefix}{f}_shap").cast("double"), F.lit(None).cast("double"))
                      .alias("shap_value"))
             for i, f in enumerate(FEATURE_NAMES)]
    arr = F.filter(F.array(*items), lambda x: x["shap_value"].isNotNull())
    arr = F.array_sort(F.transform(arr, lambda x: F.struct((-F.abs(x["shap_value"])).alias("k"),
                                                           x["o"].alias("o"), x["feature"].alias("feature"),
                                                           x["shap_value"].alias("shap_value"))))
    return df.withColumn(out, F.transform(arr, lambda x: F.struct(x["feature"].alias("feature"),
                                                                 x["shap_value"].alias("shap_value"))))


def rank_drivers(meta: DataFrame, k: int = 3) -> DataFrame:
    """F3 as a table: segment keys, rank, feature, shap_value for the top ``k``."""
    d = drivers(meta).select(*KEYS, F.posexplode("drivers").alias("pos", "d"))
    return d.filter(F.col("pos") < k).select(*KEYS, (F.col("pos") + 1).alias("rank"),
                                               F.col("d.feature").alias("feature"),
                                               F.col("d.shap_value").alias("shap_value"))


# R3 -------------------------------------------------------------------------
def usable_ranges(df: DataFrame, drivers_col: str = "drivers", prefix: str = "r_",
                  out: str = "optimal_ranges", limit: int = 3) -> DataFrame:
    """Shown ranges: both bounds present, swapped if reversed, dropped if
    equal, ordered by the segment's driver rank (absent features last), top 3."""
    items = []
    for i, (f, label) in enumerate(RANGE_FEATURES):
        lo = F.nanvl(F.col(f"{prefix}{f}_opt_min").cast("double"), F.lit(None).cast("double"))
        hi = F.nanvl(F.col(f"{prefix}{f}_opt_max").cast("double"), F.lit(None).cast("double"))
        items.append(F.struct(F.lit(i).alias("o"), F.lit(f).alias("feature"), F.lit(label).alias("label"),
                              F.least(lo, hi).alias("lo"), F.greatest(lo, hi).alias("hi"),
                              (lo.isNotNull() & hi.isNotNull()).alias("ok")))
    feats = F.transform(F.coalesce(F.col(drivers_col), F.array()), lambda d: d["feature"])
    arr = F.filter(F.array(*items), lambda x: x["ok"] & (x["lo"] != x["hi"]))
    ranked = F.transform(arr, lambda x: F.struct(
        F.when(F.array_position(feats, x["feature"]) > 0, F.array_position(feats, x["feature"]) - 1)
         .otherwise(F.size(feats)).alias("rk"),
        x["o"].alias("o"), x["feature"].alias("feature"), x["label"].alias("label"),
        x["lo"].alias("lo"), x["hi"].alias("hi")))
    top = F.slice(F.array_sort(ranked), 1, limit)
    return df.withColumn(out, F.transform(top, lambda x: F.struct(
        x["feature"].alias("feature"), x["label"].alias("label"),
        fmt.range_text(x["feature"], x["lo"], x["hi"]).alias("text"))))


# R4 -------------------------------------------------------------------------
REC_TYPE = ("array<struct<subreddit:string,best_hour:int,best_day:string,predicted_score:double,"
            "sample_size:bigint,guidance:string>>")


def recommend(requests: DataFrame, metadata: DataFrame, predictions: DataFrame,
              ranges: DataFrame | None = None, top_n: int = 5,
              prediction_keys: str = "request") -> DataFrame:
    """The full response for every request, in a fixed shape.

    requests: request_id, category, post_type, mechanism, mode.
    Output: request_id, query, confidence, confidence_reason,
    recommendations, model_quality, drivers, advice, ranges_sentence,
    optimal_ranges, notes.

    Rules: 'none' gives no recommendations; predicted_score only at 'high';
    drivers only in 'technical' mode; advice and ranges only for a matched
    segment that is not 'none'. Predictions are looked up with the request's
    own keys (``prediction_keys='request'``, as reproduced) or the matched
    segment's keys (``'matched'``).
    """
    r = normalize_keys(requests)
    r = match_segment(r, metadata)
    r2 = F.nanvl(F.col("m_test_r2").cast("double"), F.lit(None).cast("double"))
    n = F.col("m_sample_size").cast("bigint")
    r = (r.withColumn("confidence", fmt.confidence_tier(r2, n))
          .withColumn("confidence_reason", fmt.confidence_reason(r2, n)))
    r = drivers(r, "_drivers_all", prefix="m_")
    top3 = F.transform(F.slice(F.col("_drivers_all"), 1, 3), lambda d: d["feature"])

    # ranked top communities of the segment (request keys or matched keys)
    lists = top_community_lists(predictions, top_n)
    pk = (["category", "_pt", "_mech"] if prediction_keys == "request"
          else ["m_category", "m_has_media", "m_engagement_mechanism"])
    lists = lists.select(*[F.col(c).alias(f"_p_{c}") for c in KEYS], "_recs")
    cond = reduce(lambda a, b: a & b, [F.col(pk[j]) == F.col(f"_p_{c}") for j, c in enumerate(KEYS)])
    r = join_checked(r, lists, cond, "left").drop(*[f"_p_{c}" for c in KEYS])
    high = F.col("confidence") == "high"
    recs = F.transform(rank_items(F.coalesce(F.col("_recs"), F.array())), lambda x: F.struct(
        x["subreddit"].alias("subreddit"), x["best_hour"].alias("best_hour"), x["best_day"].alias("best_day"),
        F.when(high, x["predicted_score"]).alias("predicted_score"),
        x["sample_size"].alias("sample_size"),
        fmt.guidance(F.col("mode"), x["subreddit"], x["best_hour"], x["best_day"], top3).alias("guidance")))
    r = r.withColumn("recommendations",
                     F.when(F.col("confidence") == "none", F.array().cast(REC_TYPE))
                     .otherwise(recs))

    # segment facts and advice (matched keys)
    facts = segment_facts(predictions).select(*[F.col(c).alias(f"_f_{c}") for c in KEYS],
                                             *[F.col(c).alias(f"f_{c}") for c in
                                               ["n_subreddits", "avg_score", "best_day", "best_hour"]])
    cond = reduce(lambda a, b: a & b, [F.col(f"m_{c}") == F.col(f"_f_{c}") for c in KEYS])
    r = join_checked(r, facts, cond, "left")
    show = F.col("m_level").isNotNull() & (F.col("confidence") != "none")
    r = r.withColumn("advice", F.when(show, fmt.advice(
        F.col("mode"), F.col("m_category"), F.col("f_n_subreddits"), F.col("f_avg_score"),
        F.col("f_best_day"), F.col("f_best_hour"), F.col("_f_category").isNotNull())).otherwise(F.lit("")))

    # optimal ranges: the same ladder from the matched keys
    if ranges is not None:
        rr = ranges.select(*KEYS, *[F.col(c).alias(f"r_{c}") for c in ranges.columns if c not in KEYS])
        r = match_segment(r, rr, cat="m_category", pt="m_has_media", mech="m_engagement_mechanism",
                          prefix="rm_")
        r = r.withColumnsRenamed({f"rm_r_{c}": f"r_{c}" for c in ranges.columns if c not in KEYS})
        r = usable_ranges(r, "_drivers_all", prefix="r_", out="_ranges")
        r = r.withColumn("optimal_ranges", F.when(show, F.col("_ranges")).otherwise(F.array().cast(
            "array<struct<feature:string,label:string,text:string>>")))
    else:
        r = r.withColumn("optimal_ranges", F.array().cast("array<struct<feature:string,label:string,text:string>>"))
    r = r.withColumn("ranges_sentence", fmt.ranges_sentence(F.col("optimal_ranges")))

    notes = F.when(F.col("m_level").isNull(), F.array(F.lit("No model metadata found for this query."))) \
             .otherwise(F.array(F.concat(F.lit("Matched segment: "), F.col("m_category"),
                                         F.lit(" / has_media="), F.col("m_has_media"), F.lit(" / "),
                                         F.col("m_engagement_mechanism"), F.lit("."))))
    return r.select(
        "request_id",
        F.struct(F.col("category"), F.col("post_type"), F.col("mechanism")).alias("query"),
        "confidence", "confidence_reason", "recommendations",
        F.struct(r2.alias("test_r2"),
                 F.nanvl(F.col("m_test_rmse").cast("double"), F.lit(None).cast("double")).alias("test_rmse"),
                 n.alias("sample_size")).alias("model_quality"),
        F.when(F.col("mode") == "technical", F.col("_drivers_all"))
         .otherwise(F.array().cast("array<struct<feature:string,shap_value:double>>")).alias("drivers"),
        "advice", "ranges_sentence", "optimal_ranges", notes.alias("notes"))


def rank_items(recs: Column) -> Column:
    """Recommendations by predicted score, highest first, a missing score counting as 0 and
    equal ones keeping their order, each with its rank from 1."""
    keyed = F.transform(recs, lambda x, i: F.struct((-F.coalesce(F.nanvl(x["predicted_score"], F.lit(0.0)), F.lit(0.0))).alias("k"),
                                                    i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda y, i: y["x"].withField("rank", i + 1))
