"""Models on tables (M1-M6) with pyspark.ml and grouped sums.

* M1-M3: the global boosted-tree regressor (``GBTRegressor``) on the
  model-ready table: categoricals indexed with levels fixed on all rows,
  validation part as the early-stopping indicator, scored on train / test.
* M4: attribution -- the trees' built-in split-gain importances, and exact
  per-row contributions of the trees (``forest.attribute``); exact linear
  attribution mean |b_j (x_j - mean_j)| for the per-segment linear models.
* M5: direction of a driver (sign of corr(feature, contribution)).
* M6: one ridge model per segment from grouped sums: X'X and X'y are sums,
  so they are aggregated per finest segment on the executors and rolled up
  with grouping sets; only the small per-segment matrices reach a grouped
  pandas UDF that solves each system. No segment's rows ever meet in one task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dims import ALL, CATEGORICAL_FEATURES, CONTROLLABLE, FEATURE_NAMES, NON_CONTROLLABLE, NUMERIC_FEATURES
from .joins import join_keys, join_segments
from .segments import DIGITS, KEYS, keyed, rollup_keys, segment_memberships

LABEL = "virality_index"


# M1 -------------------------------------------------------------------------
def assemble_stages(features: list[str] = FEATURE_NAMES) -> list:
    """StringIndexer per categorical (levels from all rows, unseen kept) + VectorAssembler."""
    cats = [f for f in features if f in CATEGORICAL_FEATURES]
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep", stringOrderType="alphabetAsc")
           for c in cats]
    cols = [f if f not in cats else f"{f}_idx" for f in features]
    return idx + [VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")]


# A missing number is a value of its own below all others, so trees can split it off and no row is dropped.
MISSING = -1e6


def prepare(df: DataFrame, features: list[str] = FEATURE_NAMES) -> DataFrame:
    """Numeric features as double (missing: MISSING), has_media as 0/1; every row stays."""
    def number(f: str) -> Column:
        x = F.col(f).cast("int").cast("double") if f == "has_media" else F.col(f).cast("double")
        return F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(MISSING))

    return df.withColumns({f: number(f) for f in features if f not in CATEGORICAL_FEATURES})


# M2 / M3 ----------------------------------------------------------------------
def train_gbt(df: DataFrame, max_iter: int = 300, max_depth: int = 6, step: float = 0.05,
              seed: int = 42, features: list[str] = FEATURE_NAMES, split: str = "split"):
    """M2: category levels from all rows, trees from the train and validation rows that have a label;
    validation drives early stopping.

    Returns the fitted ``PipelineModel``. Spark stops on a validation
    tolerance rather than a patience count.
    """
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)  # boosting checkpoints its lineage every 10 iterations
    data = prepare(df, features)
    levels = Pipeline(stages=assemble_stages(features)).fit(data)
    n_levels = max([2, *(len(s.labels) for s in levels.stages if hasattr(s, "labels"))])
    gbt = GBTRegressor(featuresCol="features", labelCol=LABEL, maxIter=max_iter, maxDepth=max_depth,
                       stepSize=step, seed=seed, maxBins=max(64, n_levels + 1),
                       validationIndicatorCol="_is_val")
    rows = data.where(F.col(split).isin("train", "val") & F.col(LABEL).isNotNull())
    trees = gbt.fit(levels.transform(rows.withColumn("_is_val", F.col(split) == "val")))
    return PipelineModel(stages=[*levels.stages, trees])


def feature_rows(model: PipelineModel, df: DataFrame, features: list[str] = FEATURE_NAMES) -> DataFrame:
    """``df`` with x, the array of model inputs, as the trees of :mod:`.forest` read them."""
    from pyspark.ml.functions import vector_to_array

    stages = PipelineModel(stages=model.stages[:-1])
    rows = stages.transform(prepare(df, features)).withColumn("x", vector_to_array("features"))
    return rows.drop("features", *[f"{c}_idx" for c in CATEGORICAL_FEATURES])


def train_patiently(df: DataFrame, max_iter: int = 300, max_depth: int = 6, step: float = 0.05, patience: int = 20, first: int = 40,
                    seed: int = 42, features: list[str] = FEATURE_NAMES, split: str = "split") -> tuple[PipelineModel, DataFrame, int]:
    """M2: trees from the train rows, ended once the validation error has not improved for ``patience`` rounds: the
    model of the best iteration, the curve (as :func:`forest.with_patience`) and that iteration.

    Boosting is the same tree by tree however many are asked for, so ``first`` rounds are tried, then twice as
    many, until the rule ends them or ``max_iter`` is reached; the curve costs one pass over the validation rows.
    """
    from ..session import checkpoint_dir
    from . import forest

    spark = df.sparkSession
    checkpoint_dir(spark)
    data = prepare(df, features)
    levels = Pipeline(stages=assemble_stages(features)).fit(data)
    n_levels = max([2, *(len(s.labels) for s in levels.stages if hasattr(s, "labels"))])
    train = levels.transform(data.where((F.col(split) == "train") & F.col(LABEL).isNotNull())).select("features", LABEL)
    rounds = min(first, max_iter)
    while True:
        trees = GBTRegressor(featuresCol="features", labelCol=LABEL, maxIter=rounds, maxDepth=max_depth, stepSize=step, seed=seed,
                             maxBins=max(64, n_levels + 1)).fit(train)
        model = PipelineModel(stages=[*levels.stages, trees])
        curve = forest.with_patience(forest.staged_curve(feature_rows(model, df.where(F.col(split) == "val"), features),
                                                         forest.tree_nodes(trees, spark), LABEL), patience)
        points = curve.collect()  # one row per tree
        curve = spark.createDataFrame(points, curve.schema)
        best = next((r["iteration"] for r in points if r["is_best"]), rounds)
        if rounds >= max_iter or rounds - best >= patience:
            return PipelineModel(stages=[*levels.stages, forest.truncated(trees, best)]), curve, best
        rounds = min(2 * rounds, max_iter)


def score(model, df: DataFrame, features: list[str] = FEATURE_NAMES) -> DataFrame:
    """M3: add ``prediction``."""
    return model.transform(prepare(df, features))


def gbt_importances(model, features: list[str] = FEATURE_NAMES) -> DataFrame:
    """M4 (trees): split-gain importances, ranked."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature"))


# M6 -------------------------------------------------------------------------
def target_encode(train: DataFrame, df: DataFrame, col: str, k: float = 20.0) -> DataFrame:
    """Smoothed train mean of the label per level: (sum + k * global) / (n + k)."""
    glob = train.select(F.avg(LABEL)).scalar()
    enc = (train.groupBy(col).agg(F.sum(LABEL).alias("_s"), F.count(LABEL).alias("_n"))
           .select(col, ((F.col("_s") + k * glob) / (F.col("_n") + k)).alias(f"{col}_enc")))
    return join_keys(df, enc, [col]).withColumn(
        f"{col}_enc", F.coalesce(F.col(f"{col}_enc"), glob))


def model_columns() -> list[str]:
    return [*NUMERIC_FEATURES, *[f"{c}_enc" for c in CATEGORICAL_FEATURES]]


def _design(df: DataFrame) -> DataFrame:
    """Numeric design columns, missing values as 0 (the ridge term keeps
    constant columns at coefficient 0)."""
    cols = model_columns()

    def num(c: str) -> Column:
        x = F.col(c).cast("int").cast("double") if c == "has_media" else F.col(c).cast("double")
        return F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(0.0))
    return df.select("*", *[num(c).alias(f"_x{i}") for i, c in enumerate(cols)])


def gram_sums(train: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per segment (with 'ALL' roll-ups) and ``by``: n, sums of x, y, x_i x_j (i <= j), x_i y, y^2."""
    by = by or []
    d = len(model_columns())
    x = [F.col(f"_x{i}") for i in range(d)]
    y = F.col(LABEL).cast("double")
    terms = [F.count(y).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy")]
    terms += [F.sum(x[i]).alias(f"sx{i}") for i in range(d)]
    terms += [F.sum(x[i] * y).alias(f"sxy{i}") for i in range(d)]
    terms += [F.sum(x[i] * x[j]).alias(f"sxx{i}_{j}") for i in range(d) for j in range(i, d)]
    fine = keyed(train).groupBy(*KEYS, *by).agg(*terms)   # one pass, partial aggregation
    sums = [c for c in fine.columns if c not in KEYS and c not in by]
    return rollup_keys(fine, [F.sum(c).alias(c) for c in sums], always=by)


def _matrices(r, d: int) -> tuple[float, float, float, np.ndarray, np.ndarray, np.ndarray]:
    """n, sum y, sum y^2, sums x, x y and x x' of a row of Gram sums."""
    sxx = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            sxx[i, j] = sxx[j, i] = r[f"sxx{i}_{j}"]
    sx, sxy = (np.array([r[f"{name}{i}"] for i in range(d)], dtype=float) for name in ("sx", "sxy"))
    return float(r["n"]), float(r["sy"] or 0), float(r["syy"] or 0), sx, sxy, sxx


def _ridge(n: float, sy: float, sx: np.ndarray, sxy: np.ndarray, sxx: np.ndarray, lam: float) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of the centred ridge from sums."""
    m, my = sx / n, sy / n
    b = np.linalg.solve(sxx - n * np.outer(m, m) + lam * np.eye(len(m)), sxy - n * m * my)
    return float(my - m @ b), b


LAMBDAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10_000.0)
FOLDS = 5


def choose_lambda(grams: DataFrame, lambdas: tuple[float, ...] = LAMBDAS, fold: str = "fold", default: float = 1.0) -> DataFrame:
    """M6: per segment the lambda of the least cross-validated error, from Gram sums per fold alone: a fold's model is
    that of the total less the fold, and its squared error on the fold is a form in the fold's sums. segment keys, lam,
    cv_mse (null, with ``default``, where fewer than two folds have rows), the smaller lambda of equal ones.
    """
    d = len(model_columns())
    schema = T.StructType([*(T.StructField(k, T.StringType()) for k in KEYS), T.StructField("lam", T.DoubleType()),
                           T.StructField("cv_mse", T.DoubleType())])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_matrices(r, d) for _, r in pdf.sort_values(fold).iterrows() if r["n"] > 0]
        keys = [pdf[k].iloc[0] for k in KEYS]
        if len(parts) < 2:
            return pd.DataFrame([[*keys, default, None]], columns=schema.names)
        total = [sum(p[i] for p in parts) for i in range(6)]
        best = (np.inf, default)
        for lam in sorted(lambdas):
            sse = 0.0
            for n, sy, syy, sx, sxy, sxx in parts:
                a, b = _ridge(total[0] - n, total[1] - sy, total[3] - sx, total[4] - sxy, total[5] - sxx, lam)
                sse += syy - 2 * a * sy - 2 * b @ sxy + n * a * a + 2 * a * (b @ sx) + b @ sxx @ b
            best = min(best, (max(0.0, sse) / total[0], lam))
        return pd.DataFrame([[*keys, best[1], best[0]]], columns=schema.names)

    return grams.groupBy(*KEYS).applyInPandas(choose, schema)  # FOLDS rows per segment


def tuned_lambdas(train: DataFrame, key: str = "post_id", folds: int = FOLDS, lambdas: tuple[float, ...] = LAMBDAS) -> DataFrame:
    """M6: :func:`choose_lambda` over the rows of ``train`` (design columns), dealt into folds by a hash of ``key``.
    One pass over the rows, however many lambdas and folds."""
    dealt = train.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int"))
    return choose_lambda(gram_sums(dealt, ["fold"]), lambdas)


def solve_ridge(gram: DataFrame, lam: float = 1.0) -> DataFrame:
    """One small solve per segment (grouped pandas UDF on the per-segment sums).

    Centred ridge: coefficients from (Sxx - n m m') + lam I, intercept from
    the means; a column ``lam`` of ``gram`` takes the argument's place. Returns segment keys, n_train,
    intercept, b0..b(d-1), means.
    """
    d = len(model_columns())
    own = "lam" in gram.columns
    out_schema = T.StructType([T.StructField(k, T.StringType()) for k in KEYS] +
                              [T.StructField("n_train", T.LongType()), T.StructField("intercept", T.DoubleType())] +
                              [T.StructField(f"b{i}", T.DoubleType()) for i in range(d)] +
                              [T.StructField(f"m{i}", T.DoubleType()) for i in range(d)])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in pdf.iterrows():
            if r["n"] <= 0:
                continue
            n, sy, _, sx, sxy, sxx = _matrices(r, d)
            a, b = _ridge(n, sy, sx, sxy, sxx, r["lam"] if own else lam)
            rows.append([r[k] for k in KEYS] + [int(n), a] + b.tolist() + (sx / n).tolist())
        return pd.DataFrame(rows, columns=[f.name for f in out_schema.fields])

    return gram.groupBy(*KEYS).applyInPandas(solve, out_schema)


def design_rows(model_ready: DataFrame, split: str = "split") -> DataFrame:
    """``model_ready`` with its design columns; categoricals are target-encoded on the train part."""
    train = model_ready.filter((F.col(split) == "train") & F.col(LABEL).isNotNull())
    enc = model_ready
    for c in CATEGORICAL_FEATURES:
        enc = target_encode(train, enc, c)
    return _design(enc)


def segment_contributions(model_ready: DataFrame, lam: float | None = 1.0, split: str = "split",
                          only: dict[str, str] | None = None) -> DataFrame:
    """Test rows x their 8 segments (or those of ``only``, by key) with the segment model's prediction ``_p``
    and per-feature contributions ``<f>_contrib`` = b_j (x_j - mean_j). Without ``lam`` every segment's own is
    chosen by cross-validation."""
    cols = model_columns()
    d = len(cols)
    names = [*NUMERIC_FEATURES, *CATEGORICAL_FEATURES]
    x = design_rows(model_ready, split)
    coef = segment_coefficients(x.filter((F.col(split) == "train") & F.col(LABEL).isNotNull()), lam)
    test = x.filter((F.col(split) == "test") & F.col(LABEL).isNotNull()).select(
        *KEYS, LABEL, *[F.col(f"_x{i}").alias(f"_v_{names[i]}") for i in range(d)])
    # a single segment needs no copy of each row for the seven others
    if only and all(v == ALL for v in only.values()):
        test = test.withColumns({k: F.lit(v) for k, v in only.items()})
    else:
        test = segment_memberships(test)
    t = join_segments(test, coef, KEYS)  # one row per segment
    v = [F.col(f"_v_{names[i]}") for i in range(d)]
    pred = F.col("intercept") + reduce(lambda a, b: a + b, [F.col(f"b{i}") * v[i] for i in range(d)])
    t = t.withColumn("_p", F.least(F.greatest(pred, F.lit(0.0)), F.lit(100.0)))
    return t.select(*KEYS, LABEL, "_p", *[f"_v_{n}" for n in names],
                    *[(F.col(f"b{i}") * (v[i] - F.col(f"m{i}"))).alias(f"{names[i]}_contrib")
                      for i in range(d)])


def segment_coefficients(train: DataFrame, lam: float | None = 1.0) -> DataFrame:
    """M6: the segments' ridge models from the design rows of ``train``, with one lambda or (None) tuned ones."""
    grams = gram_sums(train)
    return solve_ridge(join_keys(grams, tuned_lambdas(train), KEYS) if lam is None else grams, lam or 1.0)


def segment_models(model_ready: DataFrame, lam: float | None = 1.0, split: str = "split") -> DataFrame:
    """M6: model_metadata from per-segment ridge models, with one lambda or (None) with each segment's own, chosen by
    cross-validation over its train rows; then lam and cv_rmse follow the other columns.

    Fitted on the train part (categoricals target-encoded on train), scored
    on the test part. sample_size = posts of the segment; test_r2 /
    test_rmse on test; ``<feature>_shap`` = mean |b_j (x_j - mean_j)| over
    the segment's test posts (exact attribution of a linear model).
    """
    t = segment_contributions(model_ready, lam, split)
    err = F.col("_p") - F.col(LABEL)
    aggs = [F.count("*").alias("_n"), F.sum(err * err).alias("_sse"),
            (F.var_pop(LABEL) * F.count(LABEL)).alias("_sst")]
    aggs += [F.avg(F.abs(F.col(f"{f}_contrib"))).alias(f"{f}_shap") for f in FEATURE_NAMES]
    q = t.groupBy(*KEYS).agg(*aggs)
    size = rollup_keys(keyed(model_ready), [F.count("*").alias("sample_size")])
    out = join_keys(size, q, KEYS)
    more = []
    if lam is None:
        train = design_rows(model_ready, split).filter((F.col(split) == "train") & F.col(LABEL).isNotNull())
        out = join_keys(out, tuned_lambdas(train), KEYS)
        more = ["lam", F.sqrt("cv_mse").alias("cv_rmse")]
    return out.select(*KEYS, F.col("sample_size").cast("bigint"),
                      (F.lit(1.0) - F.col("_sse") / F.nullif(F.col("_sst"), F.lit(0.0))).alias("test_r2"),
                      F.sqrt(F.col("_sse") / F.col("_n")).alias("test_rmse"),
                      *[f"{f}_shap" for f in FEATURE_NAMES], *more)


# M7 from the models -----------------------------------------------------------
SLOT = ("hour_of_day", "day_of_week")


def community_profiles(rows: DataFrame, columns: dict[str, str], community: str = "subreddit") -> DataFrame:
    """Per community the median of each feature (``columns``: feature to column of ``rows``), as p_<feature>.

    The values of a community and feature are put in order by a window, which spills, and the one or two at the middle are
    averaged, as ``median`` does, but no task holds a group's distinct values. Missing values don't count; a
    community without values has none (null).
    """
    values = F.array(*[F.col(c).cast("double") for c in columns.values()])
    long = rows.select(F.col(community).alias("_c"), F.posexplode(values).alias("_f", "_v"))
    group = Window.partitionBy("_c", "_f")
    ranked = long.select("_c", "_f", "_v", F.row_number().over(group.orderBy(F.col("_v").asc_nulls_last())).alias("_r"), F.count("_v").over(group).alias("_n"))
    middle = ranked.where((F.col("_r") * 2 >= F.col("_n")) & (F.col("_r") * 2 <= F.col("_n") + 2))
    ends = [(F.when(F.col("_f") == i, F.col("_v")), f"p_{f}") for i, f in enumerate(columns)]
    return middle.groupBy(F.col("_c").alias(community)).agg(*[(F.min(v) * 0.5 + F.max(v) * 0.5).alias(name) for v, name in ends])


def model_grid(coefficients: DataFrame, profiles: DataFrame, posts: DataFrame, features: list[str], overrides: DataFrame | None = None,
               community: str = "subreddit") -> DataFrame:
    """M7 (model version): the ``predictions`` table from segment models: for every segment, every community observed in it and
    every hour x day, what the segment's model says of the community's median post at that time, within 0-100.

    ``coefficients``: segment keys, intercept and b_<feature>; ``profiles``: p_<feature> per community; ``overrides`` has, by
    segment keys, o_<feature> where the segment itself fixes a value (null: the profile's). What does not
    depend on the time is summed once per segment and community, and only then spread over the 168 slots.
    """
    observed = rollup_keys(keyed(posts).groupBy(*KEYS, community).agg(F.count("*").alias("n")), [F.sum("n").alias("n")], always=[community])
    t = join_keys(join_keys(observed.drop("n"), profiles, [community]), coefficients, KEYS, "inner")
    fixed = [] if overrides is None else [c[2:] for c in overrides.columns if c.startswith("o_")]
    if overrides is not None:
        t = join_keys(t, overrides, KEYS)
    still = [f for f in features if f not in SLOT]
    value = {f: F.coalesce(F.col(f"o_{f}"), F.col(f"p_{f}")) if f in fixed else F.col(f"p_{f}") for f in still}
    base = reduce(lambda a, b: a + b, [F.col(f"b_{f}") * F.coalesce(value[f], F.lit(0.0)) for f in still], F.col("intercept"))
    t = t.select(*KEYS, community, base.alias("_base"), *[F.col(f"b_{f}").alias(f"_{f}") for f in SLOT])
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour_of_day")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("day_of_week"))
    score = F.col("_base") + F.col("_hour_of_day") * F.col("hour_of_day") + F.col("_day_of_week") * F.col("day_of_week")
    return t.select(*KEYS, community, *SLOT, F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)), DIGITS).alias("predicted_viral_score"))


def segment_model_grid(model_ready: DataFrame, lam: float | None = None, split: str = "split") -> DataFrame:
    """M7: :func:`model_grid` of the segment models (M6, tuned unless ``lam`` is given) on the train part. A segment's media key
    and post type take the place of the community's medians."""
    x = design_rows(model_ready, split)
    train = x.filter((F.col(split) == "train") & F.col(LABEL).isNotNull())
    names = model_columns()
    coef = segment_coefficients(train, lam)
    coef = coef.select(*KEYS, "intercept", *[F.col(f"b{i}").alias(f"b_{f}") for i, f in enumerate(names)])
    profiles = community_profiles(x, {f: f"_x{i}" for i, f in enumerate(names) if f not in SLOT})
    types = x.groupBy("engagement_mechanism").agg(F.max("engagement_mechanism_enc").alias("o_engagement_mechanism_enc"))
    fixed = join_keys(coef.select(*KEYS), types, ["engagement_mechanism"])
    fixed = fixed.withColumn("o_has_media", F.when(F.col("has_media") == "True", 1.0).when(F.col("has_media") == "False", 0.0))
    return model_grid(coef, profiles, model_ready, names, fixed)


# M5 -------------------------------------------------------------------------
def driver_direction(contrib: DataFrame, attribution: DataFrame, k: int = 5) -> DataFrame:
    """M5: for the top ``k`` features by attribution, the sign of
    corr(feature value, contribution) and whether a poster controls it.

    ``contrib`` has, per row, ``_v_<f>`` (value) and ``<f>_contrib``;
    ``attribution`` has (feature, mean_abs).
    """
    spark = contrib.sparkSession
    top = attribution.orderBy(F.col("mean_abs").desc(), F.col("feature")).limit(k)
    numeric = [f for f in FEATURE_NAMES if f not in CATEGORICAL_FEATURES and f"{f}_contrib" in contrib.columns]
    def corr(a: Column, b: Column) -> Column:
        # a constant column has no correlation (NULL), never a division error
        return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    corr = contrib.agg(*[corr(F.col(f"_v_{f}"), F.col(f"{f}_contrib")).alias(f) for f in numeric])
    corr_long = corr.unpivot([], numeric, "feature", "corr") if numeric else \
        spark.createDataFrame([], "feature string, corr double")
    ctrl = dict(CONTROLLABLE)
    non = dict(NON_CONTROLLABLE)
    tags = spark.createDataFrame(
        [(f, f in CATEGORICAL_FEATURES,
          f"NOT controllable ({non[f]})" if f in non else f"CONTROLLABLE ({ctrl.get(f, 'other')})")
         for f in FEATURE_NAMES], "feature string, is_cat boolean, controllable string")
    j = top.join(F.broadcast(tags), "feature", "left").join(F.broadcast(corr_long), "feature", "left")
    msg = (F.when(F.col("is_cat"), F.concat(F.col("feature"),
                                            F.lit(" matters but direction is category-specific")))
           .otherwise(F.concat(F.lit("higher "), F.col("feature"), F.lit(" -> "),
                               F.when(F.col("corr") >= 0, "higher").otherwise("lower"),
                               F.lit(" predicted virality"))))
    return j.select("feature", "mean_abs", msg.alias("direction"), "controllable")




# M4 (trees, permutation) --------------------------------------------------------
def permutation_importance(model, test: DataFrame, features: list[str] = FEATURE_NAMES,
                           seed: int = 42, key: str = "post_id") -> DataFrame:
    """M4: R2 drop when one feature is permuted across the test rows.

    The permutation is a seeded rank join: rows ranked by key and rows ranked
    by a seeded hash of the key are paired rank for rank (exact distributed
    ranks, no collect), and the paired row's value replaces the feature.
    """
    from .dataset import global_rank
    from .segments import regression_metrics

    t = test.where(F.col(LABEL).isNotNull()).select(key, LABEL, *features)
    by_key = global_rank(t, [key], "_r").select("_r", LABEL, *features)
    by_hash = global_rank(t.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))), ["_h", key], "_r")
    donors = by_hash.select("_r", *[F.col(f).alias(f"_donor_{f}") for f in features])
    # one join pairs every row with one donor of all features; its variants are made where it stands
    paired = by_key.join(donors, "_r")
    variants = [F.struct(F.lit(v or "").alias("feature"),
                         *[F.col(f"_donor_{f}" if f == v else f).alias(f) for f in features]) for v in (None, *features)]
    rows = paired.select(LABEL, F.explode(F.array(*variants)).alias("x")).select(
        LABEL, F.col("x.feature").alias("feature"), *[F.col(f"x.{f}").alias(f) for f in features])
    r2 = regression_metrics(score(model, rows, features), LABEL, "prediction", ["feature"]).select("feature", "r2")
    base = r2.where(F.col("feature") == "").select(F.max("r2")).scalar()
    return r2.where(F.col("feature") != "").select("feature", (base - F.col("r2")).alias("importance"))
