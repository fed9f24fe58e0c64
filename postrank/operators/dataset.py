"""Training-table assembly and the time-ordered split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

LOCAL_BITS = 33  # monotonically_increasing_id = (partition << 33) + row in partition


def posts_with_features(posts: DataFrame, feats: DataFrame) -> DataFrame:
    """Processed posts (post_id, title, body, subreddit) with has_media, inner on post_id."""
    return (posts.select("post_id", "title", "body", "subreddit")
            .join(feats.select("post_id", "has_media"), "post_id", "inner"))


def build_model_ready(labels: DataFrame, feats: DataFrame, nlp: DataFrame) -> DataFrame:
    """Label + post features + NLP features, left joins on post_id.

    All three tables are post-sized, so these are shuffle joins on post_id
    (both sides hash-partitioned by the same key; a bucketed layout by
    post_id removes the exchanges). Duplicate column names are an error.
    """
    f = feats.drop("subreddit") if "subreddit" in feats.columns else feats
    left = labels.select("post_id", "virality_index")
    names = [c for c in left.columns] + [c for c in f.columns if c != "post_id"] + \
            [c for c in nlp.columns if c != "post_id"]
    dup = sorted({c for c in names if names.count(c) > 1})
    if dup:
        raise ValueError(f"duplicate columns in model-ready join: {dup}")
    return left.join(f, "post_id", "left").join(nlp, "post_id", "left")


def attach_timestamp(df: DataFrame, posts: DataFrame) -> DataFrame:
    """Inner join of posted_at_local by post_id."""
    return df.join(posts.select("post_id", "posted_at_local"), "post_id", "inner")


def trainable(df: DataFrame, label: str = "virality_index", key: str = "post_id") -> DataFrame:
    """Adds ``trainable`` = label and every feature present (NULL and NaN count as missing)."""
    def present(c: str) -> Column:
        col = F.col(c)
        dt = dict(df.dtypes)[c]
        ok = col.isNotNull()
        return ok & ~F.isnan(col) if dt in ("double", "float") else ok
    feats = [c for c in df.columns if c not in (key,)]
    return df.withColumn("trainable", reduce(lambda a, b: a & b, [present(c) for c in feats]))


def trainable_count(df: DataFrame, label: str = "virality_index") -> DataFrame:
    """B9 report: one row (trainable, total)."""
    t = trainable(df, label)
    return t.agg(F.count_if("trainable").alias("trainable"), F.count("*").alias("total"))


def sample_errors(df: DataFrame, actual: str, predicted: str, n: int = 10,
                  order: list[str] | None = None) -> DataFrame:
    """First ``n`` rows in a given order with the error predicted - actual."""
    o = order or ["post_id"]
    return (df.select(*o, F.col(actual).alias("actual_viral_score"),
                      F.col(predicted).alias("predicted_viral_score"))
              .withColumn("error", F.col("predicted_viral_score") - F.col("actual_viral_score"))
              .orderBy(*o).limit(n))


def global_rank(df: DataFrame, order: list[str], name: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """Exact 1-based rank over a total order, without a single-partition window.

    Adds ``name`` and ``{name}_total`` (the number of rows).

    Range-partition on the full sort key (sampling picks balanced bounds even
    when one timestamp holds a third of the rows, since the key is made unique
    by the tie-breaker), sort within partitions, number rows locally, and add
    the count of all earlier partitions (one small row per partition). The
    numbered rows are checkpointed once before the two uses.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_last() for c in order]
    r = (df.repartitionByRange(p, *keys).sortWithinPartitions(*keys)
           .withColumn("_mid", F.monotonically_increasing_id()))
    # The numbering depends on the sampled range bounds; materialise it once
    # (reliable checkpoint in the shared folder) so the per-partition counts
    # and the rows read the very same numbering, also after a lost executor.
    r = r.checkpoint(eager=True)
    r = (r.withColumn("_pid", F.shiftright("_mid", LOCAL_BITS))
          .withColumn("_local", F.col("_mid").bitwiseAND((1 << LOCAL_BITS) - 1)))
    counts = r.groupBy("_pid").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"),
                            F.sum("_n").over(whole).alias(f"{name}_total"))
    # one row per range partition: bounded by ``p``, so broadcasting is safe
    out = r.join(F.broadcast(offsets), "_pid", "inner")
    return out.withColumn(name, F.col("_off") + F.col("_local") + 1).drop("_mid", "_pid", "_local", "_off")


def temporal_split(df: DataFrame, ts: str = "posted_at_local", key: str = "post_id",
                   train: float = 0.70, val: float = 0.85) -> DataFrame:
    """Adds ``split`` in train / val / test by time order (missing times last; tie: the unique key).

    The cuts are the rows at floor(n * 0.70) and floor(n * 0.85). Rows are counted per day; the exact
    row is then looked up by rank in the day that holds it, and ``split`` is a comparison with those
    two rows, so the table itself is neither shuffled nor written.
    """
    day = F.to_date(F.col(ts))
    days = df.groupBy(day.alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("d").asc_nulls_last()).collect()
    total = sum(r["n"] for r in days)

    def before(cut: int) -> Column:
        """Whether a row comes before the row of rank ``cut`` (from 0)."""
        passed = 0
        for r in days:
            if cut < passed + r["n"]:
                rows = df.filter(day.eqNullSafe(F.lit(r["d"]))).select(ts, key)
                at = global_rank(rows, [ts, key], "_rank").filter(F.col("_rank") == cut - passed + 1)
                bound = at.select(F.col(ts).cast("string").alias("ts"), key).first()
                same = F.col(key) < F.lit(bound[key])
                if bound["ts"] is None:
                    return F.col(ts).isNotNull() | same
                b = F.lit(bound["ts"]).cast(df.schema[ts].dataType)
                return F.coalesce((F.col(ts) < b) | ((F.col(ts) == b) & same), F.lit(False))
            passed += r["n"]
        return F.lit(True)

    first, second = before(int(total * train)), before(int(total * val))
    return df.withColumn("split", F.when(first, "train").when(second, "val").otherwise("test"))


def check_split(df: DataFrame, ts: str = "posted_at_local") -> DataFrame:
    """E5: one row: max(train) <= min(val) and max(val) <= min(test), plus part sizes."""
    s = df.groupBy("split").agg(F.min(ts).alias("mn"), F.max(ts).alias("mx"), F.count("*").alias("n"))
    g = s.agg(*[F.max(F.when(F.col("split") == p, F.col(c))).alias(f"{p}_{c}")
                for p in ("train", "val", "test") for c in ("mn", "mx", "n")])
    return g.select(
        ((F.col("train_mx") <= F.col("val_mn")) & (F.col("val_mx") <= F.col("test_mn"))).alias("ordered"),
        F.coalesce(F.col("train_n"), F.lit(0)).alias("n_train"),
        F.coalesce(F.col("val_n"), F.lit(0)).alias("n_val"),
        F.coalesce(F.col("test_n"), F.lit(0)).alias("n_test"))
