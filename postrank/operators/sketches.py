"""Mergeable sketches in place of exact state: quantiles (D2, M8) by KLL, distinct counts (D6, D13, D17) by HyperLogLog.

A sketch is built once per finest cell, next to the rows, and merged up the cube by grouping sets, so that no aggregation holds
all values of a segment, however skewed: a quantile sketch has some kilobytes, a distinct one 4 KB. The
exact forms stay where they are (``labels``, ``segments``, ``recommend``, ``profile``).

A quantile here is a value of the column whose rank is off by ``RANK_ERROR`` of the rows at most (99 % of the time; groups of
fewer than ``K`` rows are exact); exact quantiles interpolate between two values instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import RANGE_FEATURES
from .joins import join_keys, join_segments
from .segments import KEYS, keyed, rollup_keys, segment_memberships

K = 800  # of a quantile sketch
RANK_ERROR = 0.01  # single-sided error of K = 800 is about 0.004
LG_K = 12  # of a distinct sketch: a standard error of 1.6 %, exact for some dozens


def known(value: Column) -> Column:
    """A number as double; NaN counts as missing."""
    x = value.cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def community_median(posts: DataFrame, score: str = "score", key: str = "subreddit", k: int = K) -> DataFrame:
    """D2 by sketch: key, n and subreddit_baseline, a median score. A community without scores has none (null)."""
    rows = posts.select(key, known(F.col(score)).alias("_s"))
    found = (rows.where(F.col("_s").isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.kll_sketch_agg_double("_s", k).alias("_q"))
             .select(key, "n", F.kll_sketch_get_quantile_double("_q", F.lit(0.5).cast("double")).alias("subreddit_baseline")))
    return join_keys(rows.select(key).distinct(), found, [key]).select(key, F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "subreddit_baseline")


def label_thresholds(labelled: DataFrame, score: str = "virality_index", top: float = 0.75, k: int = K) -> DataFrame:
    """Segment keys, n and thr, the ``top`` quantile of the label: one sketch per finest segment, merged up the cube."""
    rows = keyed(labelled).withColumn("_y", known(F.col(score))).where(F.col("_y").isNotNull())
    cells = rows.groupBy(*KEYS).agg(F.count("*").alias("n"), F.kll_sketch_agg_double("_y", k).alias("_q"))
    merged = rollup_keys(cells, [F.sum("n").alias("n"), F.kll_merge_agg_double("_q", k).alias("_q")])
    return merged.select(*KEYS, "n", F.kll_sketch_get_quantile_double("_q", F.lit(top).cast("double")).alias("thr"))


def top_posts_of_segments(labelled: DataFrame, score: str = "virality_index", top: float = 0.75, k: int = K) -> DataFrame:
    """Each post once per segment in whose top part its label is, with thr."""
    rows = keyed(labelled).withColumn("_y", known(F.col(score))).where(F.col("_y").isNotNull())
    return join_segments(segment_memberships(rows), label_thresholds(labelled, score, top, k), KEYS).where(F.col("_y") >= F.col("thr"))


def optimal_ranges(labelled: DataFrame, score: str = "virality_index", top: float = 0.75, lo: float = 0.25, hi: float = 0.75, k: int = K) -> DataFrame:
    """M8 by sketch: as ``segments.optimal_ranges``. Per segment only sketches of the label and the features are held; a task
    adds its rows to them before anything is shuffled. Segments without labels are left out."""
    have = [f for f, _ in RANGE_FEATURES if f in labelled.columns]
    best = top_posts_of_segments(labelled, score, top, k)
    sketches = best.groupBy(*KEYS).agg(*[F.kll_sketch_agg_double(known(F.col(f)), k).alias(f"_q_{f}") for f in have],
                                       *[F.count(known(F.col(f))).alias(f"_n_{f}") for f in have])
    ends = []
    for f, _ in RANGE_FEATURES:
        for name, p in (("min", lo), ("max", hi)):
            end = F.when(F.col(f"_n_{f}") > 0, F.kll_sketch_get_quantile_double(f"_q_{f}", F.lit(p).cast("double"))) if f in have \
                else F.lit(None).cast("double")
            ends.append(end.alias(f"{f}_opt_{name}"))
    return sketches.select(*KEYS, *ends)


def rank_error(value: Column, bound: Column, p: float) -> Column:
    """An aggregate: how far the rank of ``bound`` among the values is from ``p``, as a share of them."""
    n = F.nullif(F.count(value), F.lit(0))
    below, upto = F.count_if(value < bound) / n, F.count_if(value <= bound) / n
    return F.greatest(below - F.lit(p), F.lit(p) - upto, F.lit(0.0))


def range_errors(labelled: DataFrame, ranges: DataFrame, score: str = "virality_index", top: float = 0.75, lo: float = 0.25, hi: float = 0.75,
                 k: int = K) -> DataFrame:
    """Segment keys, n_top and the largest rank error of the ends in ``ranges`` among the segment's top posts."""
    have = [f for f, _ in RANGE_FEATURES if f in labelled.columns]
    rows = join_segments(top_posts_of_segments(labelled, score, top, k), ranges, KEYS)
    errors = [rank_error(known(F.col(f)), F.col(f"{f}_opt_{name}"), p) for f in have for name, p in (("min", lo), ("max", hi))]
    worst = reduce(lambda a, b: F.greatest(a, F.coalesce(b, F.lit(0.0))), errors, F.lit(0.0))
    return rows.groupBy(*KEYS).agg(F.count("*").alias("n_top"), worst.alias("error"))


# distinct counts ----------------------------------------------------------------

def segment_cube(df: DataFrame, score: str = "virality_index", community: str = "subreddit") -> DataFrame:
    """D17 by sketch: the communities of a cell are one sketch, built once and merged under the grouping sets."""
    y = F.col(score).cast("double")
    cells = keyed(df).groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum(y).alias("sy"), F.count(y).alias("ny"),
                                         F.hll_sketch_agg(community, LG_K).alias("_h"))
    return rollup_keys(cells, [F.sum("n").alias("n_posts"), F.try_divide(F.sum("sy"), F.sum("ny")).alias("avg_index"),
                               F.hll_sketch_estimate(F.hll_union_agg("_h")).alias("n_subreddits")])


def segment_overview(pred: DataFrame) -> DataFrame:
    """D6 by sketch: rows, distinct communities, mean score per segment in one pass, without a second shuffle by community."""
    return pred.groupBy(*KEYS).agg(F.count("*").alias("n_rows"), F.hll_sketch_estimate(F.hll_sketch_agg("subreddit", LG_K)).alias("n_subreddits"),
                                   F.avg("predicted_viral_score").alias("avg_score"))


def distinct_counts(df: DataFrame) -> DataFrame:
    """D13 by sketch: column_name and n_unique of every string column, from one aggregate without a shuffle of values."""
    cols = [c for c, t in df.dtypes if t == "string"]
    one = df.agg(*[F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c), LG_K)), F.lit(0).cast("bigint")).alias(c) for c in cols])
    return one.unpivot([], cols, "column_name", "n_unique")
