"""Shared stages of the offline flow and the serving build, as lazy DataFrames.

raw posts -> processed posts -> post features -> labels -> NLP features ->
model-ready table; event posts -> labels -> split -> serving tables.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import day_of_week, hour_of_day
from ..operators import dataset as DS
from ..operators import posts as P
from ..operators import segments as S
from ..operators.labels import engagement_index
from ..operators.textfeat import nlp_features
from ..sources import adapters as A
from ..sources.layout import write_together
from ..session import scratch_path
from ..sources.io import load_serving, materialize
from ..sources.lexicons import emotion_lexicon, sentiment_lexicon


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return A.raw_posts(spark, sf)


def processed(spark: SparkSession, sf: str) -> DataFrame:
    """Processed posts, written once: features, labels and text features all read this table."""
    return written(spark, sf, "processed_posts", lambda: P.process_posts(raw(spark, sf)))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return P.post_features(processed(spark, sf))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return engagement_index(processed(spark, sf))


def nlp(spark: SparkSession, sf: str) -> DataFrame:
    return nlp_features(processed(spark, sf), features(spark, sf), emotion_lexicon(spark),
                        sentiment_lexicon(spark))


def model_ready(spark: SparkSession, sf: str) -> DataFrame:
    return DS.build_model_ready(labels(spark, sf), features(spark, sf), nlp(spark, sf))


def model_split(spark: SparkSession, sf: str) -> DataFrame:
    """Model-ready table with its timestamp (C3) and the time-ordered split (E4), written once."""
    return written(spark, sf, "model_split", lambda: DS.temporal_split(
        DS.attach_timestamp(model_ready(spark, sf), processed(spark, sf))))


def event_labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Event posts with the index and the timing features."""
    ep = A.event_posts(spark, sf)
    rest = [c for c in ep.columns if c not in ("post_id", "subreddit")]
    idx = engagement_index(ep, keep=rest).drop("subreddit_baseline")
    ts = F.col("posted_at_local")
    return (idx.withColumn("hour_of_day", hour_of_day(ts))
              .withColumn("day_of_week", day_of_week(ts)))


_WRITTEN: dict[tuple[str, str, str], str] = {}


def written(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """Build a table once per session and data folder, write it as Parquet in
    the shared checkpoint folder, and read it back (lineage cut, survives a
    lost executor, and later readers get exact sizes from the files)."""
    key = (spark.sparkContext.applicationId, sf, name)
    path = _WRITTEN.get(key)
    if path is None:
        tag = hashlib.md5(sf.encode()).hexdigest()[:8]
        path = scratch_path(spark, f"tables/{name}_{tag}")
        materialize(build(), path)
        _WRITTEN[key] = path
    return spark.read.parquet(path)


_BUCKETED: dict[tuple, dict[str, str]] = {}


def bucketed(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Labels, features, text features and processed posts, bucketed by post_id once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUCKETED:
        tag = hashlib.md5(sf.encode()).hexdigest()[:8]
        tables = {"by_post_labels": labels(spark, sf), "by_post_features": features(spark, sf),
                  "by_post_nlp": nlp(spark, sf), "by_post_times": processed(spark, sf).select("post_id", "posted_at_local")}
        write_together(tables, scratch_path(spark, f"bucketed/{tag}"), tag=f"_{tag}")
        _BUCKETED[key] = {n: f"{n}_{tag}" for n in tables}
    return {n: spark.table(t) for n, t in _BUCKETED[key].items()}


def event_split(spark: SparkSession, sf: str) -> DataFrame:
    return written(spark, sf, "event_split", lambda: DS.temporal_split(event_labelled(spark, sf)))


SERVING_BUILDERS = {"model_metadata": S.segment_metadata, "predictions": S.prediction_grid,
                    "optimal_ranges": S.optimal_ranges}


def build_serving(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One serving table (lazy plan) from the labelled, split event posts."""
    return SERVING_BUILDERS[name](event_split(spark, sf))


def serving(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The serving tables, written once and registered as views."""
    return load_serving(spark, {
        n: written(spark, sf, n, lambda n=n: build_serving(spark, sf, n)) for n in SERVING_BUILDERS})


def finish(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double column (for engine-independent comparison)."""
    cols = [F.round(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c)
            for c, t in df.dtypes]
    return df.select(*cols)
