"""Adapters: turn the driver's test tables into post-shaped input.

These only reshape rows into the schemas the jobs expect; they do none of the
jobs' work. Every job downstream is written for any data of these schemas.

* ``raw_posts``      documents joined to events -> raw post rows (text jobs)
* ``event_posts``    events -> labelled-post volume (labels, segments, splits)
* ``event_requests`` events -> a table of recommendation requests
* ``text_requests``  documents -> free-text requests (parsing jobs)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_count


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan that yields fewer splits than there are cores (a file
    with one row group reads as one partition) round-robin over the cores.
    On a cluster the inputs have far more splits than cores: no-op."""
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:
            return df.repartition(cores)
    except Exception:  # noqa: BLE001 - sessions without RDD access: leave the scan as it is
        pass
    return df


# Stand-in community names for the documents' sources, by source number:
# sources 0-14 take these names (target communities written in varied case and
# spacing), the others keep their own name (communities outside the list).
SOURCE_COMMUNITIES = ["Cooking", "baking", "FOOD", "gaming", "PCGaming", "skincareaddiction", "Frugal",
                      "investing", "loseit", "running", "buildapc", "Anxiety", "jobs", "DIY",
                      " HomeImprovement "]


def source_community(source: Column) -> Column:
    idx = F.expr("try_cast(substring(source, 4) AS INT)")
    names = F.array(*[F.lit(n) for n in SOURCE_COMMUNITIES])
    return F.when(idx < len(SOURCE_COMMUNITIES), F.element_at(names, idx + 1)).otherwise(source)


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, subreddit, text, url, score, date, author, token_count, language."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    j = d.join(e, d.doc_id == e.event_id, "inner")
    first = F.split_part(F.col("text"), F.lit(". "), F.lit(1))
    head = (F.when(F.col("event_type") == "click", F.concat(first, F.lit("?")))
            .when(F.col("event_type") == "purchase", F.concat(F.lit("[OC] "), first))
            .otherwise(first))
    rest = F.when(F.length("text") > F.length(first) + 2,
                  F.concat(F.lit(": "), F.expr("substring(text, length(split_part(text, '. ', 1)) + 3)"))
                  ).otherwise(F.lit(""))
    out = j.select(
        F.col("doc_id").alias("post_id"),
        source_community(F.col("source")).alias("subreddit"),
        F.concat(F.when(F.col("doc_id") % 41 == 6, "[deleted] ").otherwise(""), head, rest).alias("text"),
        F.concat(F.when(F.col("doc_id") % 5 == 0, F.lit("https://i.redd.it/"))
                 .otherwise(F.lit("https://example.com/p/")),
                 F.col("doc_id").cast("string")).alias("url"),
        F.floor("value").cast("bigint").alias("score"),
        F.col("ts").alias("date"),
        F.col("user_id").cast("string").alias("author"),
        F.col("lang").alias("language"),
    )
    return out.withColumn("token_count", word_count(F.col("text")).cast("bigint")).select(
        "post_id", "subreddit", "text", "url", "score", "date", "author", "token_count", "language")


def event_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, subreddit, category, engagement_mechanism, has_media, score, posted_at_local.

    Some categories, media flags and scores are missing and some scores are -1 or less, so that
    every branch of the jobs downstream is met.
    """
    e = read_table(spark, sf_dir, "events")
    comm = (F.col("user_id") % 48).cast("string")
    return e.select(
        F.col("event_id").alias("post_id"),
        F.concat(F.lit("c"), comm).alias("subreddit"),
        F.when(F.col("user_id") % 48 != 37, F.concat(F.lit("cat"), ((F.col("user_id") % 48) % 10).cast("string")))
         .alias("category"),
        F.when(F.col("event_type") == "click", "question")
         .when(F.col("event_type") == "purchase", "showcase")
         .otherwise("statement").alias("engagement_mechanism"),
        F.when(F.col("event_id") % 50 != 11, F.col("event_id") % 3 == 0).alias("has_media"),
        F.when(F.col("event_id") % 97 == 5, F.lit(None).cast("bigint"))
         .when(F.col("event_id") % 89 == 7, F.lit(-1).cast("bigint"))
         .when(F.col("event_id") % 101 == 3, F.lit(-5).cast("bigint"))
         .otherwise(F.floor("value").cast("bigint")).alias("score"),
        F.col("ts").alias("posted_at_local"),
    )


def _mode(c: Column) -> Column:
    return (F.when(c == 0, "newbie").when(c == 1, "experienced").otherwise("technical"))


def event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, category, post_type, mechanism, mode.

    Some categories have no segment (cat10, cat11) and some options are
    missing, so the fallback ladder is exercised on every level.
    """
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("cat"), ((F.col("user_id") % 48) % 12).cast("string")).alias("category"),
        F.when(F.col("event_id") % 3 == 0, "True").when(F.col("event_id") % 3 == 1, "False")
         .otherwise(F.lit(None).cast("string")).alias("post_type"),
        F.when(F.col("event_type") == "click", "question")
         .when(F.col("event_type") == "purchase", "showcase")
         .when(F.col("event_type") == "view", "statement")
         .otherwise(F.lit(None).cast("string")).alias("mechanism"),
        _mode(F.col("user_id") % 3).alias("mode"),
    )


def text_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, text: every document as a free-text request (whole text, unchanged), and beside them planted requests
    with negative ids: some of the texts as questions, announcements, with a place or with misspelt
    keywords in front, and blank and missing ones."""
    d = read_table(spark, sf_dir, "documents")
    k, t = F.col("doc_id") % 11, F.col("text")
    planted = (F.when(k == 1, F.concat(t, F.lit(" ?"))).when(k == 2, F.concat(F.lit("just finished this: "), t))
               .when(k == 3, F.concat(F.lit("meetup near New York "), t)).when(k == 4, F.concat(F.lit("lpatop reciep "), t))
               .when(k == 5, F.lit("  ")).when(k == 7, F.concat(F.lit("anxeity "), t)))  # 6: missing
    more = d.where(k.between(1, 7)).select((-1 - F.col("doc_id")).alias("request_id"), planted.alias("text"))
    return d.select(F.col("doc_id").alias("request_id"), "text").unionByName(more)


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, text: every conversation turn as a free label, and beside them planted ones with
    negative turns, names of categories: exact, decorated, inside a sentence, misspelt or refused."""
    c = read_table(spark, sf_dir, "conversations")
    k = F.col("conv_id") % 8
    planted = (F.when(k == 0, "Food & Cooking").when(k == 1, "**gaming**.").when(k == 2, "I think Fitness and health fits")
               .when(k == 3, "Skincare & Beuty").when(k == 4, "none").when(k == 5, "Mental Helath").when(k == 6, "tehc & gadgets"))
    more = c.where(k < 7).select("conv_id", (-1 - F.col("turn")).alias("turn"), planted.alias("text"))
    return c.select("conv_id", "turn", "text").unionByName(more)


def word_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, keyword, category: the first longer word of every document as a keyword, in ten categories."""
    d = read_table(spark, sf_dir, "documents")
    word = F.regexp_extract(F.lower("text"), "[a-z]{4,}", 0)
    k = d.select("doc_id", word.alias("keyword")).where(F.col("keyword") != "").groupBy("keyword").agg(F.min("doc_id").alias("ordinal"))
    return k.select("ordinal", "keyword", F.concat(F.lit("cat"), (F.col("ordinal") % 10).cast("string")).alias("category"))
