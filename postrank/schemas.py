"""Explicit schemas for every table the engine reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

from .dims import EMOTIONS, FEATURE_NAMES, RANGE_FEATURES

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TS = T.TimestampNTZType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


RAW_POSTS = _st(("post_id", L), ("subreddit", S), ("text", S), ("url", S), ("score", L),
                ("date", TS), ("author", S), ("token_count", L), ("language", S))

PROCESSED_POSTS = _st(("post_id", L), ("subreddit", S), ("title", S), ("body", S), ("url", S),
                      ("score", L), ("author", S), ("posted_at_local", TS), ("token_count", L))

POST_FEATURES = _st(("post_id", L), ("hour_of_day", I), ("day_of_week", I), ("has_media", B),
                    ("post_length_proxy", L))

POST_LABELS = _st(("post_id", L), ("subreddit", S), ("subreddit_baseline", D), ("virality_index", D))

NLP_FEATURES = _st(("post_id", L), ("vader_compound", D), *[(f"nrc_{e}", D) for e in EMOTIONS],
                   ("readability", D), ("title_length", I), ("body_length", I),
                   ("subreddit", S), ("category", S), ("engagement_mechanism", S))

MODEL_METADATA = _st(("category", S), ("has_media", S), ("engagement_mechanism", S),
                     ("sample_size", L), ("test_r2", D), ("test_rmse", D),
                     *[(f"{f}_shap", D) for f in FEATURE_NAMES])

PREDICTIONS = _st(("category", S), ("has_media", S), ("engagement_mechanism", S), ("subreddit", S),
                  ("hour_of_day", I), ("day_of_week", I), ("predicted_viral_score", D))

OPTIMAL_RANGES = _st(("category", S), ("has_media", S), ("engagement_mechanism", S),
                     *[(f"{f}_opt_{b}", D) for f, _ in RANGE_FEATURES for b in ("min", "max")])

REQUESTS = _st(("request_id", L), ("category", S), ("post_type", S), ("mechanism", S), ("mode", S))

TEXT_REQUESTS = _st(("request_id", L), ("text", S))

LEXICON = _st(("word", S), ("emotion", S), ("flag", S))

SENTIMENT_LEXICON = _st(("word", S), ("valence", D))
