"""Bucketed tables, bound lookups and keyword tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from postrank.operators.dataset import attach_timestamp, build_model_ready
from postrank.operators.keywords import category_by_keywords
from postrank.operators.recommend import lookup_rows
from postrank.session import scratch_path
from postrank.sources.layout import drop_bucketed, write_bucketed, write_together


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_without_an_exchange(spark):
    keys = [*range(500), *[7] * 300]  # one key holds a third of the rows
    post = spark.createDataFrame([(k,) for k in [*range(500), None]], "post_id long")
    tables = {"t_labels": spark.createDataFrame([(k, k / 10) for k in keys], "post_id long, virality_index double"),
              "t_feats": post.select("post_id", (F.col("post_id") % 24).alias("hour_of_day")),
              "t_nlp": post.where("post_id % 3 = 0").select("post_id", F.lit(1).alias("title_length")),
              "t_posts": post.select("post_id", F.lit("2024-01-01").cast("timestamp_ntz").alias("posted_at_local"))}
    plain = attach_timestamp(build_model_ready(*[tables[n] for n in ("t_labels", "t_feats", "t_nlp")]), tables["t_posts"])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables beyond the broadcast bound
    try:
        t = write_together(tables, scratch_path(spark, "test_bucketed"), buckets=6)
        got = attach_timestamp(build_model_ready(t["t_labels"], t["t_feats"], t["t_nlp"]), t["t_posts"])
        assert "Exchange" in plan_of(plain) and "Exchange" not in plan_of(got)
        assert plan_of(got).count("Bucketed: true") == 4
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and got.count() == 800
        files = t["t_feats"].select(F.input_file_name()).distinct().count()
        assert files <= 6  # one file for each bucket that has rows
        again = write_bucketed(post, "t_feats", scratch_path(spark, "test_bucketed_again"), buckets=6)  # replaces the name
        assert again.columns == ["post_id"]
        with pytest.raises(ValueError):
            write_bucketed(post, "t; DROP TABLE t_nlp", scratch_path(spark, "x"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        drop_bucketed(spark, tables)


def test_bound_lookup_takes_values_as_data(spark):
    rows = [("Food", "True", "question", 3), ("Food", "ALL", "ALL", 9), ("x' OR '1'='1", "ALL", "ALL", 1), (None, "ALL", "ALL", 2)]
    for name in ("model_metadata", "secrets"):
        spark.createDataFrame(rows, "category string, has_media string, engagement_mechanism string, sample_size int") \
             .createOrReplaceTempView(name)
    size = lambda *a: [r.sample_size for r in lookup_rows(spark, "model_metadata", *a).collect()]
    assert size("Food", "True", "question") == [3] and size("Food") == [9] and size("Food", "", "") == [9]
    assert size("x' OR '1'='1") == [1] and size("' OR 1=1 --") == [] and size(None) == []
    for table in ("secrets", "model_metadata; DROP VIEW secrets", "model_metadata, secrets", ""):
        with pytest.raises(ValueError):
            lookup_rows(spark, table, "Food")


def plain_category(text, keywords):
    per = {}
    for ordinal, keyword, category in keywords:
        if keyword and ordinal is not None and category is not None and keyword in (text or "").lower():
            h, f = per.get(category, (0, ordinal))
            per[category] = (h + 1, min(f, ordinal))
    return max(((h, -f, c) for c, (h, f) in per.items()), default=(0, 0, None))[2]


def test_keyword_table_equals_brute_force(spark):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    keywords = [(i, word(rnd.randint(3, 9)), f"c{rnd.randrange(40)}") for i in range(50_000)]
    texts = [" ".join(word(rnd.randint(1, 12)).title() for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    texts += [None, "", "zzz", keywords[5][1], texts[0], word(200_000)]
    extra = [(1, None, "c1"), (None, "abc", "c1"), (2, "", "c1"), (3, "abc", None), (50_001, keywords[5][1], "c2"), (50_002, keywords[5][1], "c2")]
    kw = spark.createDataFrame(keywords + extra, "ordinal int, keyword string, category string")
    df = spark.createDataFrame(list(enumerate(texts)), "request_id int, text string").withColumn("category", F.lit("old"))
    want = {i: plain_category(t, keywords + extra) for i, t in enumerate(texts)}
    for block in (200_000, 20_000):  # one automaton, and several blocks
        got = category_by_keywords(df, kw, block=block)
        assert got.columns == ["request_id", "text", "category"]
        assert {r.request_id: r.category for r in got.collect()} == want
    assert {r.category for r in category_by_keywords(df, kw.limit(0)).collect()} == {None}
    assert category_by_keywords(df.limit(0), kw).count() == 0
    assert not re.search("Exchange", plan_of(category_by_keywords(df, kw)))
    with pytest.raises(ValueError):
        category_by_keywords(df, spark.createDataFrame([(1, "x" * 300, "c")], "ordinal int, keyword string, category string"))
