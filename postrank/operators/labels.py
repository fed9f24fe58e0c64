"""Labels: community baselines and the 0-100 engagement index.

The index is half the global log-score and half the log of the score relative
to the community mean, each min-max scaled over all rows:

    index = 100 * (0.5 * coalesce(norm(ln(score+1)), 0)
                   + 0.5 * coalesce(norm(ln(score/baseline + 1)), 0))

Plan shape: one grouped aggregate per community (partial aggregation on the
map side, so a community holding a third of all rows costs nothing extra),
joined back with a size-checked broadcast; the global min / max are scalar
subqueries over partial aggregates -- never a window over ``()``, which
would pull every row into one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import guarded_log1p, min_max, ratio
from .joins import join_checked


def community_baseline(posts: DataFrame, how: str = "mean", score: str = "score",
                       key: str = "subreddit", approx: bool = False) -> DataFrame:
    """One row per community with ``subreddit_baseline``.

    ``mean`` is the default label baseline; ``median`` interpolates linearly
    (exact ``percentile`` keeps one count per distinct score, so memory follows
    distinct scores, not rows; ``approx=True`` bounds it by a sketch instead).
    """
    s = F.col(score).cast("double")
    if how == "mean":
        agg = F.avg(s)
    elif how == "median":
        agg = F.percentile_approx(s, 0.5, 10000) if approx else F.median(s)
    else:
        raise ValueError(f"unknown baseline: {how}")
    return posts.groupBy(key).agg(agg.alias("subreddit_baseline"))


def _attach(posts: DataFrame, base: DataFrame, key: str, null_safe: bool) -> DataFrame:
    b = base.withColumnRenamed(key, "_bkey")
    cond = posts[key].eqNullSafe(b["_bkey"]) if null_safe else posts[key] == b["_bkey"]
    return join_checked(posts, b, cond, "left").drop("_bkey")


def global_min_max(df: DataFrame, col: str) -> DataFrame:
    """D3: one row (min, max) from partial aggregates."""
    return df.agg(F.min(col).alias("min"), F.max(col).alias("max"))


def scale_min_max(df: DataFrame, col: str, out: str | None = None,
                  fit: Column | None = None) -> DataFrame:
    """Add ``out`` = (x - min) / (max - min), NULL for a constant column.

    ``fit`` restricts the rows the min / max are taken from.
    """
    src = df if fit is None else df.filter(fit)
    mn = src.select(F.min(col)).scalar()
    mx = src.select(F.max(col)).scalar()
    return df.withColumn(out or f"{col}_scaled", min_max(F.col(col), mn, mx))


def engagement_index(posts: DataFrame, score: str = "score", key: str = "subreddit",
                     fit: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """post_id, subreddit, subreddit_baseline, virality_index.

    By default the baseline and the min / max come from all rows (as the
    reproduced label does); ``fit`` restricts them to e.g. the training part.
    ``keep`` carries further input columns through (no join back needed).
    """
    keep = [c for c in (keep or []) if c not in ("post_id", key, score)]
    p = posts.select("post_id", key, score, *keep, *([fit.alias("_fit")] if fit is not None else []))
    base_src = p if fit is None else p.filter("_fit")
    # One pass gives the community means and, since ln(x + 1) is increasing,
    # the extremes of the log score: ln(min / max valid score + 1).
    s = F.col(score)
    base = base_src.groupBy(key).agg(F.avg(s.cast("double")).alias("subreddit_baseline"),
                                     F.min(F.when(s > -1, s)).alias("_smin"),
                                     F.max(F.when(s > -1, s)).alias("_smax")).cache()
    j = _attach(p, base.select(key, "subreddit_baseline"), key, null_safe=True)
    j = (j.withColumn("_log_score", guarded_log1p(F.col(score)))
          .withColumn("_log_ratio", guarded_log1p(ratio(F.col(score), F.col("subreddit_baseline")))))
    src = j if fit is None else j.filter("_fit")
    ns = min_max(F.col("_log_score"), base.select(guarded_log1p(F.min("_smin"))).scalar(),
                 base.select(guarded_log1p(F.max("_smax"))).scalar())
    nr = min_max(F.col("_log_ratio"), src.select(F.min("_log_ratio")).scalar(),
                 src.select(F.max("_log_ratio")).scalar())
    idx = (F.lit(0.5) * F.coalesce(ns, F.lit(0.0)) + F.lit(0.5) * F.coalesce(nr, F.lit(0.0))) * 100.0
    return j.select("post_id", key, "subreddit_baseline", idx.alias("virality_index"), *keep)


def median_score(posts: DataFrame, score: str = "score", key: str = "subreddit",
                 approx: bool = False) -> DataFrame:
    """H34 (with D2): post_id, subreddit_baseline (median), viral_score, is_top_quartile.

    viral_score = score / (median + 1); top when above 1.5. Rows without a
    community get no baseline (groups of a missing key are not formed).
    """
    p = posts.select("post_id", key, score)
    base = community_baseline(p.filter(F.col(key).isNotNull()), "median", score, key, approx)
    j = _attach(p, base, key, null_safe=False)
    vs = ratio(F.col(score), F.col("subreddit_baseline") + 1.0)
    return j.select("post_id", "subreddit_baseline", vs.alias("viral_score"),
                    F.coalesce(vs > 1.5, F.lit(False)).alias("is_top_quartile"))
