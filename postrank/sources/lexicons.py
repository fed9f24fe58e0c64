"""Sample lexicons shipped with the package (project-owned test inputs).

No real emotion or sentiment lexicon is available offline, and the invented
test prose shares few words with one, so the sample lexicons pair a few real
emotion words with frequent words of the test text. The jobs read any
lexicon of the same shape.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.textfeat import read_lexicon

DATA = os.path.join(os.path.dirname(os.path.dirname(__file__)), "data")
EMOTION_SAMPLE = os.path.join(DATA, "emotion_lexicon_sample.tsv")
SENTIMENT_SAMPLE = os.path.join(DATA, "sentiment_lexicon_sample.tsv")


def emotion_lexicon(spark: SparkSession, path: str = EMOTION_SAMPLE) -> DataFrame:
    """(word, emotion) rows of a tab-separated word / emotion / flag file."""
    return read_lexicon(spark, path)


def sentiment_lexicon(spark: SparkSession, path: str = SENTIMENT_SAMPLE) -> DataFrame:
    """(word, valence) rows of a tab-separated word / valence file."""
    parts = F.split(F.trim(F.col("value")), "\t")
    return (spark.read.text(path).select(parts.alias("p")).filter(F.size("p") == 2)
            .select(F.get("p", 0).alias("word"), F.get("p", 1).cast("double").alias("valence"))
            .filter(F.col("valence").isNotNull()))


def emotion_rows(path: str = EMOTION_SAMPLE) -> list[tuple[str, str]]:
    """The sample's valid (word, emotion) rows, for inlining in oracle SQL."""
    from ..dims import EMOTIONS
    out = []
    for line in open(path, encoding="utf-8"):
        p = line.strip().split("\t")
        if len(p) == 3 and p[2] == "1" and p[1] in EMOTIONS:
            out.append((p[0], p[1]))
    return out


def sentiment_rows(path: str = SENTIMENT_SAMPLE) -> list[tuple[str, float]]:
    out = []
    for line in open(path, encoding="utf-8"):
        p = line.strip().split("\t")
        if len(p) == 2:
            out.append((p[0], float(p[1])))
    return out
