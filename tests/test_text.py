"""Text rules: title/body split, word counts, mechanism, media flag, features."""

from pyspark.sql import functions as F

from postrank.functions import text as T
from postrank.operators import textfeat as TF


def test_split_title_body_edges(spark):
    rows = [(None,), ("",), ("no separator",), ("a: b: c",), (": lead",)]
    df = spark.createDataFrame(rows, "text string")
    t, b = T.split_title_body(F.col("text"))
    got = [(r.t, r.b) for r in df.select(t.alias("t"), b.alias("b")).collect()]
    assert got == [(None, ""), ("", ""), ("no separator", ""), ("a", "b: c"), ("", "lead")]


def test_word_count_and_mechanism(spark):
    df = spark.createDataFrame([("Why so slow?", False), ("[OC] my desk", False), ("plain words", True),
                                ("plain words", False), (None, None)], "title string, m boolean")
    got = df.select(T.word_count(F.col("title")).alias("n"),
                    T.post_mechanism(F.col("title"), F.col("m")).alias("k")).collect()
    assert [g.n for g in got] == [3, 3, 2, 2, 0]
    assert [g.k for g in got] == ["question", "showcase", "showcase", "statement", "statement"]


def test_has_media_never_null(spark):
    df = spark.createDataFrame([("https://i.redd.it/x", ""), (None, "see imgur.com/a"), (None, None)],
                               "url string, body string")
    assert [r.h for r in df.select(T.has_media(F.col("url"), F.col("body")).alias("h")).collect()] == \
        [True, True, False]


def test_emotions_sentiment_readability(spark):
    posts = spark.createDataFrame([(1, "I love this", "so happy"), (2, "", ""), (3, "123 456", ""),
                                   (4, "not happy at all", "")], "post_id long, title string, body string")
    lex = spark.createDataFrame([("love", "joy"), ("love", "trust"), ("happy", "joy")], "word string, emotion string")
    e = {r.post_id: r for r in TF.emotions(posts, lex).collect()}
    assert e[1].nrc_joy == 2 / 5 and e[1].nrc_trust == 1 / 5 and e[1].nrc_fear == 0.0
    assert e[2].nrc_joy is None and e[3].nrc_joy == 0.0
    slex = spark.createDataFrame([("love", 3.2), ("happy", 2.7)], "word string, valence double")
    s = {r.post_id: r.vader_compound for r in TF.sentiment(posts, slex).collect()}
    assert s[2] is None and s[3] == 0.0 and s[1] > 0.8 and s[4] < 0
    r = {x.post_id: x.readability for x in TF.readability(posts).collect()}
    assert r[2] is None and r[1] is not None


def test_category_and_unmapped(spark):
    df = spark.createDataFrame([("Cooking",), ("FOOD",), ("pets",), (" DIY ",)], "subreddit string")
    got = [r.category for r in TF.add_category(df).collect()]
    assert got == ["Food & Cooking", "Food & Cooking", "unknown", "unknown"]
    assert [r.subreddit for r in TF.unmapped(df).collect()] == [" DIY ", "pets"]


def test_tokens_are_added_up_without_sorting_them(spark):
    """The aggregate over exploded tokens hashes them; rows of one post_id are added up, a missing id is one like others."""
    from postrank.operators.textfeat import token_features
    rows = [(1, "a", "Good day", "not good"), (1, "a", "Good day", "not good"), (2, None, "", None), (None, "b", "bad", "joy"), (3, "b", "!!", "")]
    posts = spark.createDataFrame(rows, "post_id long, subreddit string, title string, body string")
    emo = spark.createDataFrame([("joy", "joy"), ("good", "joy")], "word string, emotion string")
    sent = spark.createDataFrame([("good", 2.0), ("bad", -3.0)], "word string, valence double")
    out = token_features(posts, emo, sent, carry=[F.col("subreddit")])
    got = {r["post_id"]: r for r in out.collect()}
    s = 2 * (2 + 2 * -0.74)
    assert set(got) == {1, 2, 3, None} and out.count() == 4
    assert got[1]["nrc_joy"] == 4 / 4 and abs(got[1]["vader_compound"] - s / (s * s + 15) ** .5) < 1e-12 and got[1]["subreddit"] == "a"
    assert got[2]["nrc_joy"] is None and got[2]["vader_compound"] is None and got[2]["subreddit"] is None
    assert got[None]["nrc_joy"] == .5 and got[3]["nrc_joy"] == 0.0 and got[3]["vader_compound"] == 0.0
    plan = out._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Generate") - 2500:plan.index("Generate")]  # what stands right above the explode
    assert "SortAggregate" not in below[below.rindex("Aggregate(") - 20:]
