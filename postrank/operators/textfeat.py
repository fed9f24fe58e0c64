"""Per-post text features as Spark jobs.

Lexicons are DataFrames (dimension tables), joined by broadcast after the
token arrays are exploded. Each post's tokens are produced inside one task,
so the grouped aggregate after the join is partially aggregated map-side to
one row per post before its shuffle: the shuffled volume is post-sized,
never token-sized. That aggregate has sums only, so tokens are hashed as
they come and never sorted or held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import EMOTIONS, category_dim
from ..functions.text import post_mechanism, tokens, word_count
from .joins import join_checked, join_dim

# Sentiment constants of the published lexicon method: normalisation alpha
# and the negation scalar, and the negation words.
SENT_ALPHA = 15.0
NEG_SCALAR = -0.74
NEGATIONS = ["not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "nowhere",
             "cannot", "can't", "don't", "doesn't", "didn't", "isn't", "aren't", "wasn't",
             "weren't", "won't", "wouldn't", "shouldn't", "couldn't", "without"]


def post_text(title: Column, body: Column) -> Column:
    """title + ' ' + body, stripped; missing parts count as ''."""
    return F.trim(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))))


# A8 -------------------------------------------------------------------------
def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated word, emotion, flag; malformed lines are skipped.

    Returns (word, emotion) for flag '1' and one of the eight emotions.
    """
    parts = F.split(F.trim(F.col("value")), "\t")
    lines = spark.read.text(path).select(parts.alias("p"))
    ok = lines.filter(F.size("p") == 3).select(
        F.get("p", 0).alias("word"), F.get("p", 1).alias("emotion"), F.get("p", 2).alias("flag"))
    return ok.filter((F.col("flag") == "1") & F.col("emotion").isin(EMOTIONS)).select("word", "emotion")


def _emotion_flags(lex: DataFrame) -> DataFrame:
    """word -> one 0/1 column per emotion (one row per word)."""
    return lex.groupBy("word").agg(*[F.max(F.when(F.col("emotion") == e, 1).otherwise(0)).alias(f"_e_{e}")
                                     for e in EMOTIONS])


# N1 / N2 (one token pass) ----------------------------------------------------
def token_features(posts: DataFrame, emo_lex: DataFrame | None = None, sent_lex: DataFrame | None = None,
                   title: str = "title", body: str = "body", carry: list[Column] | None = None) -> DataFrame:
    """Emotion rates and sentiment from a single explode of the tokens.

    Both lexicons are broadcast dimension tables (size-checked); the per-post
    aggregate is partially aggregated in the task that exploded the post, so
    only one post-sized row per post is shuffled. ``carry`` columns (per-post
    values) ride along as grouping keys (``first`` of a string would make the
    aggregate sort all tokens); rows of one post_id are then added up and
    their per-post values taken with ``first``.
    """
    carry = carry or []
    text = post_text(F.col(title), F.col(body))
    base = posts.select("post_id", *carry, (text == "").alias("_empty"), tokens(text).alias("_tok"))
    names = [c for c in base.columns if c not in ("post_id", "_empty", "_tok")]
    if sent_lex is not None:
        neg = F.array(*[F.lit(w) for w in NEGATIONS])
        # transform's index is 0-based; slice is 1-based: tokens i-3 .. i-1 are
        # positions max(i-2,1) .. i (1-based), i.e. up to three before token i.
        items = F.transform(F.col("_tok"), lambda w, i: F.struct(
            w.alias("word"),
            F.arrays_overlap(F.slice(F.col("_tok"), F.greatest(i - 2, F.lit(1)),
                                     i - F.greatest(i - 2, F.lit(1)) + 1), neg).alias("neg")))
    else:
        items = F.transform(F.col("_tok"), lambda w: F.struct(w.alias("word"), F.lit(False).alias("neg")))
    ex = base.select("post_id", *names, "_empty", F.size("_tok").alias("_n"), F.explode_outer(items).alias("t"))
    ex = ex.select("post_id", *names, "_empty", "_n", F.col("t.word").alias("word"),
                   F.coalesce(F.col("t.neg"), F.lit(False)).alias("neg"))
    own, sums = [*names, "_empty", "_n"], {}
    if emo_lex is not None:
        ex = join_checked(ex, _emotion_flags(emo_lex), "word", "left")
        sums |= {f"_h_{e}": F.coalesce(F.col(f"_e_{e}"), F.lit(0)) for e in EMOTIONS}
    if sent_lex is not None:
        lx = sent_lex.groupBy("word").agg(F.first("valence").alias("valence"))
        ex = join_checked(ex, lx, "word", "left")
        v = F.col("valence") * F.when(F.col("neg"), F.lit(NEG_SCALAR)).otherwise(F.lit(1.0))
        sums["_s"] = F.coalesce(v, F.lit(0.0))
    g = ex.groupBy("post_id", *own).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    g = g.groupBy("post_id").agg(*[F.first(c).alias(c) for c in own], *[F.sum(n).alias(n) for n in sums])
    out = [F.col("post_id"), *[F.col(c) for c in names]]
    if emo_lex is not None:
        out += [F.when(F.col("_empty"), F.lit(None).cast("double"))
                 .when(F.col("_n") == 0, F.lit(0.0))
                 .otherwise(F.col(f"_h_{e}") / F.col("_n")).alias(f"nrc_{e}") for e in EMOTIONS]
    if sent_lex is not None:
        comp = F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + F.lit(SENT_ALPHA))
        out.append(F.when(F.col("_empty"), F.lit(None).cast("double"))
                   .otherwise(F.least(F.greatest(comp, F.lit(-1.0)), F.lit(1.0))).alias("vader_compound"))
    return g.select(*out)


def emotions(posts: DataFrame, lex: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """post_id + nrc_<emotion> = hits / words.

    NULL when the text is empty, 0.0 when it has no word tokens. A word that
    carries several emotions counts once for each.
    """
    return token_features(posts, emo_lex=lex, title=title, body=body)


def sentiment(posts: DataFrame, lex: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """post_id + vader_compound in [-1, 1]; NULL for empty text.

    Sum of word valences (a valence flips and shrinks by the negation scalar
    when one of the three previous tokens is a negation), normalised as
    s / sqrt(s^2 + 15). Lexicon: (word, valence).
    """
    return token_features(posts, sent_lex=lex, title=title, body=body)


# N3 -------------------------------------------------------------------------
def readability_expr(text: Column) -> Column:
    """Reading ease: 206.835 - 1.015 words/sentences - 84.6 syllables/words.

    words: whitespace words; sentences: groups of . ! ? (at least 1);
    syllables: vowel groups [aeiouy]+ per word, at least 1 per word.
    NULL for empty text or text without words.
    """
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(r"\S+"), 0)
    nw = F.size(words)
    ns = F.greatest(F.regexp_count(t, F.lit(r"[.!?]+")), F.lit(1))
    syl = F.aggregate(words, F.lit(0).cast("bigint"),
                      lambda acc, w: acc + F.greatest(F.regexp_count(F.lower(w), F.lit("[aeiouy]+")),
                                                      F.lit(1)).cast("bigint"))
    return F.when(nw > 0, F.lit(206.835) - F.lit(1.015) * nw / ns - F.lit(84.6) * syl / nw)


def readability(posts: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """post_id + readability over title + body."""
    return posts.select("post_id", readability_expr(post_text(F.col(title), F.col(body))).alias("readability"))


# C4 / C5 --------------------------------------------------------------------
def add_category(df: DataFrame, dim: DataFrame | None = None, col: str = "subreddit") -> DataFrame:
    """C4: category by lower-cased community name; 'unknown' when unmapped."""
    d = (dim if dim is not None else category_dim(df.sparkSession)).select(
        F.col("community_lc").alias("_clc"), F.col("category").alias("_cat"))
    j = join_dim(df, d, F.lower(F.col(col)) == F.col("_clc"), "left")
    out = j.withColumn("category", F.coalesce(F.col("_cat"), F.lit("unknown")))
    return out.drop("_clc", "_cat")


def unmapped(df: DataFrame, dim: DataFrame | None = None, col: str = "subreddit") -> DataFrame:
    """Sorted distinct community names with no category."""
    d = (dim if dim is not None else category_dim(df.sparkSession)).select(F.col("community_lc").alias("_clc"))
    a = join_dim(df.select(col), d, F.lower(F.col(col)) == F.col("_clc"), "left_anti")
    return a.filter(F.col(col).isNotNull()).distinct().orderBy(col)


# N4 -------------------------------------------------------------------------
def nlp_features(posts: DataFrame, feats: DataFrame, emo_lex: DataFrame, sent_lex: DataFrame,
                 dim: DataFrame | None = None) -> DataFrame:
    """The 16-column NLP feature table keyed on post_id (text dropped).

    posts: processed posts (post_id, title, body, subreddit); feats: post
    features (post_id, has_media). One post-level join (post_id), then one
    token pass (:func:`token_features`) that also carries the per-post
    columns, so the text is read once and nothing post-sized is cached.
    """
    p = posts.select("post_id", "title", "body", "subreddit").join(
        feats.select("post_id", "has_media"), "post_id", "inner")
    p = add_category(p, dim)
    carry = [F.col("subreddit"), F.col("category"),
             post_mechanism(F.col("title"), F.col("has_media")).alias("engagement_mechanism"),
             readability_expr(post_text(F.col("title"), F.col("body"))).alias("readability"),
             word_count(F.col("title")).alias("title_length"), word_count(F.col("body")).alias("body_length")]
    out = token_features(p, emo_lex, sent_lex, carry=carry)
    return out.select("post_id", "vader_compound", *[f"nrc_{e}" for e in EMOTIONS], "readability",
                      "title_length", "body_length", "subreddit", "category", "engagement_mechanism")


def top_posts(df: DataFrame, col: str, k: int = 5, key: str = "post_id") -> DataFrame:
    """top ``k`` rows by a column (ties by key), a bounded top-k."""
    return df.orderBy(F.col(col).desc_nulls_last(), F.col(key).asc()).limit(k)
