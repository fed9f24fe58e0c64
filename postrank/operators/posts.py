"""Post tables (B1-B6, H1, H20-H23): projections and filters only.

Everything here is a narrow transformation (no shuffle); filters on the raw
columns reach the Parquet scan as pushed filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import category_dim
from ..functions import text as T
from .joins import join_dim


def filter_language(raw: DataFrame, lang: str = "en") -> DataFrame:
    """B1: rows of one language."""
    return raw.filter(F.col("language") == F.lit(lang))


def filter_communities(raw: DataFrame, dim: DataFrame | None = None, col: str = "subreddit") -> DataFrame:
    """B2: rows whose community is allow-listed (trimmed, case-insensitive).

    A left-semi join against the 50-row dimension, broadcast (its size is
    fixed in code), so the post side is never shuffled.
    """
    d = (dim if dim is not None else category_dim(raw.sparkSession)).select(
        F.col("community_lc").alias("_clc"))
    return join_dim(raw, d, F.lower(F.trim(F.col(col))) == F.col("_clc"), "left_semi")


def process_posts(raw: DataFrame, lang: str = "en", sep: str = ": ") -> DataFrame:
    """B1 + H1 + B3: processed_posts (English rows, title/body split, timestamp cast)."""
    r = filter_language(raw, lang)
    title, body = T.split_title_body(F.col("text"), sep)
    return r.select("post_id", "subreddit", title.alias("title"), body.alias("body"), "url", "score",
                    "author", F.col("date").cast("timestamp_ntz").alias("posted_at_local"), "token_count")


def post_features(processed: DataFrame) -> DataFrame:
    """B6 + H20 + H21: post_id, hour_of_day, day_of_week (Sunday=0), has_media, post_length_proxy."""
    ts = F.col("posted_at_local")
    return processed.select("post_id", T.hour_of_day(ts).alias("hour_of_day"),
                            T.day_of_week(ts).alias("day_of_week"),
                            T.has_media(F.col("url"), F.col("body")).alias("has_media"),
                            F.col("token_count").alias("post_length_proxy"))


def clean_posts(raw: DataFrame) -> DataFrame:
    """B5 + H8 + H23 + H2 + H21 (Monday=0 variant): the lower-case cleaning table.

    post_id, clean_text, is_deleted, posted_at_local, text_length, hour_of_day, day_of_week.
    """
    ts = T.parse_timestamp(F.col("date"))
    clean = T.clean_text(F.col("text"))
    return raw.select("post_id", clean.alias("clean_text"), T.flag_deleted(F.col("text")).alias("is_deleted"),
                      ts.alias("posted_at_local"), T.word_count(clean).alias("text_length"),
                      T.hour_of_day(ts).alias("hour_of_day"), T.day_of_week_monday0(ts).alias("day_of_week"))
