"""Segment tables: roll-up, quality metrics, prediction grid, optimal ranges.

Segments are category x has_media x engagement_mechanism, with "ALL" rows for
every rolled-up key (the partial cube the serving tables use).

Scale notes. Every producer here first aggregates posts to the finest cell
it needs (keys x community x hour x day [x split]) -- one pass with
map-side partial aggregation -- and rolls those small sums up with grouping
sets. So the 8-fold cube expansion happens on cell sums, never on posts, and
a hot segment or community is only ever a few partial sums per task.
Percentiles (optimal ranges) are taken from frequency tables, which are
counted once and rolled up; a group's state holds its distinct values.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import ALL, RANGE_FEATURES, SEGMENT_KEYS
from .joins import join_keys, join_segments

KEYS = SEGMENT_KEYS
DIGITS = 9  # decimal places at which predictions and their means are compared


def media_key(c: Column) -> Column:
    """Boolean has_media as the segment key string 'True' / 'False'."""
    return F.when(c, F.lit("True")).when(~c, F.lit("False"))


def keyed(df: DataFrame) -> DataFrame:
    """Posts with has_media turned into its key string."""
    if dict(df.dtypes).get("has_media") == "boolean":
        return df.withColumn("has_media", media_key(F.col("has_media")))
    return df


def _subsets(keys: list[str]) -> list[list[str]]:
    return [list(c) for r in range(len(keys), -1, -1) for c in combinations(keys, r)]


def rollup_keys(df: DataFrame, aggs: list[Column], always: list[str] | None = None,
                keys: list[str] = KEYS) -> DataFrame:
    """Grouping sets over every subset of ``keys`` (always grouping ``always``).

    A rolled-up key becomes 'ALL'; a real NULL key stays NULL (never
    ``coalesce`` alone, which would merge it with the roll-up).
    """
    always = always or []
    sets = [[*s, *always] for s in _subsets(keys)]
    g = df.groupingSets(sets, *keys, *always).agg(
        *aggs, *[F.grouping(k).alias(f"_g_{k}") for k in keys])
    for k in keys:
        g = g.withColumn(k, F.when(F.col(f"_g_{k}") == 1, F.lit(ALL)).otherwise(F.col(k)))
    return g.drop(*[f"_g_{k}" for k in keys])


def segment_cube(df: DataFrame, score: str = "virality_index", community: str = "subreddit") -> DataFrame:
    """Cube over the segment keys with 'ALL' roll-ups: posts, mean score, communities.

    Posts are first summed per keys and community, so the eightfold expansion and the distinct
    count work on those sums.
    """
    y = F.col(score).cast("double")
    cells = keyed(df).groupBy(*KEYS, community).agg(F.count("*").alias("n"), F.sum(y).alias("sy"), F.count(y).alias("ny"))
    return rollup_keys(cells, [F.sum("n").alias("n_posts"), F.try_divide(F.sum("sy"), F.sum("ny")).alias("avg_index"),
                               F.countDistinct(community).alias("n_subreddits")])


def segment_memberships(df: DataFrame) -> DataFrame:
    """Each row once per segment it belongs to (8 rows: every key or 'ALL')."""
    k = keyed(df)
    opts = [[F.col(c), F.lit(ALL)] for c in KEYS]
    combos = [F.struct(*[opts[j][i].alias(KEYS[j]) for j, i in enumerate(bits)])
              for bits in ((a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1))]
    rest = [c for c in k.columns if c not in KEYS]
    return (k.select(*rest, F.explode(F.array(*combos)).alias("_seg"))
             .select(*[F.col(f"_seg.{c}").alias(c) for c in KEYS], *rest))


# ---------------------------------------------------------------------------
# D20 regression metrics
# ---------------------------------------------------------------------------

def regression_metrics(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """N, rmse, mae, r2, label mean and std per group (or overall).

    All sums, so it groups (and rolls up) like any aggregate.
    """
    err = F.col(p) - F.col(y)
    aggs = [F.count(y).alias("n"),
            F.sqrt(F.avg(err * err)).alias("rmse"),
            F.avg(F.abs(err)).alias("mae"),
            (F.lit(1.0) - F.sum(err * err) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"),
            F.avg(y).alias("y_mean"),
            F.stddev_samp(y).alias("y_std")]
    return df.groupBy(*(by or [])).agg(*aggs)


def overfitting_gap(metrics: DataFrame, by: str = "split") -> DataFrame:
    """``metrics`` with overfit_gap, the R2 of 'train' less the R2 of 'test', on every row."""
    gap = metrics.agg((F.max(F.when(F.col(by) == "train", F.col("r2")))
                       - F.max(F.when(F.col(by) == "test", F.col("r2")))).alias("overfit_gap"))
    return metrics.join(F.broadcast(gap), F.lit(True), "left")  # one row


def compare_to_baseline(r2: Column, baseline: float = 0.06, band: float = 0.005) -> Column:
    """IMPROVED / ~UNCHANGED / REGRESSED against a reference R2."""
    d = r2 - F.lit(baseline)
    return (F.when(d > band, "IMPROVED").when(F.abs(d) <= band, "~UNCHANGED").otherwise("REGRESSED"))


# ---------------------------------------------------------------------------
# Cell sums (one pass over posts)
# ---------------------------------------------------------------------------

def cell_sums(labelled: DataFrame, score: str = "virality_index",
              extra: list[str] | None = None) -> DataFrame:
    """Finest cells: segment keys x subreddit x hour x day [x extra] -> n, sy, syy."""
    k = keyed(labelled)
    y = F.col(score).cast("double")
    return (k.groupBy(*KEYS, "subreddit", "hour_of_day", "day_of_week", *(extra or []))
             .agg(F.count(y).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy")))


def _roll_cells(cells: DataFrame) -> DataFrame:
    return rollup_keys(cells, [F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy")],
                       always=["subreddit", "hour_of_day", "day_of_week"])


def _grid_from_cells(cells: DataFrame, prior: float) -> DataFrame:
    """Shrunk cell means for every (segment, community) x 24 hours x 7 days."""
    rolled = _roll_cells(cells).filter(F.col("n") > 0)
    comm = (rolled.groupBy(*KEYS, "subreddit")
                  .agg((F.sum("sy") / F.sum("n")).alias("_cm")))
    grid = (comm.select(*KEYS, "subreddit", "_cm",
                        F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour_of_day"))
                .select("*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("day_of_week")))
    on = [*KEYS, "subreddit", "hour_of_day", "day_of_week"]
    cell = rolled.select(*[F.col(c).alias(f"_c_{c}") for c in on], F.col("n").alias("_n"),
                         F.col("sy").alias("_sy"))
    cond = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in on])
    j = grid.join(cell, cond, "left")
    pred = ((F.coalesce(F.col("_sy"), F.lit(0.0)) + F.lit(prior) * F.col("_cm"))
            / (F.coalesce(F.col("_n"), F.lit(0)) + F.lit(prior)))
    # rounded, so that cells which are equal but for the order of summation tie
    return j.select(*on, F.round(F.least(F.greatest(pred, F.lit(0.0)), F.lit(100.0)), DIGITS)
                    .alias("predicted_viral_score"))


def prediction_grid(labelled: DataFrame, score: str = "virality_index", prior: float = 5.0) -> DataFrame:
    """M7 (observed-mean version): the ``predictions`` serving table.

    For every segment, every community observed in it and every hour x day:
    the mean label of that cell shrunk toward the community's segment mean,
    (sum_cell + prior * mean_community) / (n_cell + prior). Cells without
    posts get the community mean. Clamped to 0-100, rounded to DIGITS places.
    """
    return _grid_from_cells(cell_sums(labelled, score), prior)


# ---------------------------------------------------------------------------
# M6 (observed-mean version): model_metadata from the split
# ---------------------------------------------------------------------------

def segment_metadata(labelled: DataFrame, score: str = "virality_index", prior: float = 5.0,
                     split: str = "split") -> DataFrame:
    """model_metadata for the grid model: fitted on ``train``, scored on ``test``.

    sample_size counts all posts of the segment. test_r2 / test_rmse compare
    the train-fitted grid (community mean, then segment mean, where a cell is
    unseen) with the test labels. Attribution columns hold the mean absolute
    main effect over the test posts of the three inputs the grid model uses:
    subreddit |m_community - m_segment|, hour_of_day |m_hour - m_segment|,
    day_of_week |m_day - m_segment|; the other 16 are NULL (unused inputs).
    Everything is computed from cell sums.
    """
    from ..dims import FEATURE_NAMES

    cells = cell_sums(labelled, score, extra=[split])
    on = [*KEYS, "subreddit", "hour_of_day", "day_of_week"]
    train = _roll_cells(cells.filter(F.col(split) == "train").drop(split)).filter(F.col("n") > 0)
    test = _roll_cells(cells.filter(F.col(split) == "test").drop(split)).filter(F.col("n") > 0)
    size = rollup_keys(cells, [F.sum("n").alias("sample_size")])

    seg_m = train.groupBy(*KEYS).agg((F.sum("sy") / F.sum("n")).alias("m_seg"))
    com_m = train.groupBy(*KEYS, "subreddit").agg((F.sum("sy") / F.sum("n")).alias("m_com"))
    hour_m = train.groupBy(*KEYS, "hour_of_day").agg((F.sum("sy") / F.sum("n")).alias("m_hour"))
    day_m = train.groupBy(*KEYS, "day_of_week").agg((F.sum("sy") / F.sum("n")).alias("m_day"))
    cell_p = train.select(*on, "n", "sy").withColumnRenamed("n", "n_tr").withColumnRenamed("sy", "sy_tr")

    t = test
    for other, cols in ((cell_p, on), (com_m, [*KEYS, "subreddit"]), (seg_m, KEYS),
                        (hour_m, [*KEYS, "hour_of_day"]), (day_m, [*KEYS, "day_of_week"])):
        t = join_keys(t, other, cols)
    pred = F.coalesce(
        (F.coalesce(F.col("sy_tr"), F.lit(0.0)) + F.lit(prior) * F.col("m_com"))
        / (F.coalesce(F.col("n_tr"), F.lit(0)) + F.lit(prior)),
        F.col("m_seg"))
    pred = F.least(F.greatest(pred, F.lit(0.0)), F.lit(100.0))
    t = t.withColumn("_p", pred)
    # sum over the cell's posts of (y - p)^2 = syy - 2 p sy + n p^2
    sse = F.col("syy") - F.lit(2.0) * F.col("_p") * F.col("sy") + F.col("n") * F.col("_p") * F.col("_p")

    def eff(m: str) -> Column:
        return F.sum(F.col("n") * F.abs(F.coalesce(F.col(m), F.col("m_seg")) - F.col("m_seg")))

    q = t.groupBy(*KEYS).agg(
        F.sum("n").alias("_n"), F.sum(sse).alias("_sse"), F.sum("sy").alias("_sy"),
        F.sum("syy").alias("_syy"), F.count_if(F.col("m_seg").isNull()).alias("_unfit"),
        eff("m_com").alias("_e_sub"), eff("m_hour").alias("_e_hour"), eff("m_day").alias("_e_day"))
    sst = F.col("_syy") - F.col("_sy") * F.col("_sy") / F.col("_n")
    fitted = F.col("_unfit") == 0
    q = q.select(*KEYS,
                 F.when(fitted, F.lit(1.0) - F.col("_sse") / F.nullif(sst, F.lit(0.0))).alias("test_r2"),
                 F.when(fitted, F.sqrt(F.greatest(F.col("_sse"), F.lit(0.0)) / F.col("_n"))).alias("test_rmse"),
                 F.when(fitted, F.col("_e_sub") / F.col("_n")).alias("subreddit_shap"),
                 F.when(fitted, F.col("_e_hour") / F.col("_n")).alias("hour_of_day_shap"),
                 F.when(fitted, F.col("_e_day") / F.col("_n")).alias("day_of_week_shap"))
    out = join_keys(size, q, KEYS)
    cols = [*KEYS, F.col("sample_size").cast("bigint").alias("sample_size"), "test_r2", "test_rmse"]
    have = {"subreddit_shap", "hour_of_day_shap", "day_of_week_shap"}
    cols += [F.col(f"{f}_shap") if f"{f}_shap" in have else F.lit(None).cast("double").alias(f"{f}_shap")
             for f in FEATURE_NAMES]
    return out.select(*cols)


# ---------------------------------------------------------------------------
# M8 optimal ranges
# ---------------------------------------------------------------------------

def optimal_ranges(labelled: DataFrame, score: str = "virality_index",
                   top: float = 0.75, lo: float = 0.25, hi: float = 0.75) -> DataFrame:
    """M8: per segment, the 25th-75th percentile of each shown feature among
    posts whose label is at or above the segment's 75th percentile.

    Posts are counted once into a frequency table (keys, label, feature, value); roll-ups, the label's
    percentile and the features' percentiles are all taken from those counts. Segments with a
    missing key are kept. Features missing from the input give NULL bounds.
    """
    k = keyed(labelled).withColumn("_y", F.col(score).cast("double"))
    feats = [f for f, _ in RANGE_FEATURES if f in k.columns]
    labels = k.groupBy(*KEYS, "_y").agg(F.count("*").alias("n"))
    thr = _rolled(labels, ["_y"]).groupBy(*KEYS).agg(F.percentile("_y", top, F.col("n")).alias("_thr"))
    out = thr.select(*KEYS)
    if feats:
        long = k.select(*KEYS, "_y", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("v"))
                                                         for f in feats])).alias("x")).select(*KEYS, "_y", "x.f", "x.v")
        counts = long.groupBy(*KEYS, "_y", "f", "v").agg(F.count("*").alias("n"))
        best = join_segments(_rolled(counts, ["_y", "f", "v"]), thr, KEYS).where(F.col("_y") >= F.col("_thr"))
        best = best.groupBy(*KEYS, "f", "v").agg(F.sum("n").alias("n"))
        ends = best.groupBy(*KEYS).pivot("f", feats).agg(F.percentile("v", lo, F.col("n")).alias("opt_min"),
                                                         F.percentile("v", hi, F.col("n")).alias("opt_max"))
        out = join_keys(out, ends, KEYS)
    return out.select(*KEYS, *[F.col(f"{f}_opt_{b}") if f in feats else F.lit(None).cast("double").alias(f"{f}_opt_{b}")
                               for f, _ in RANGE_FEATURES for b in ("min", "max")])


def _rolled(counts: DataFrame, always: list[str]) -> DataFrame:
    return rollup_keys(counts, [F.sum("n").alias("n")], always=always)
