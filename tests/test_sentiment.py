"""Each published sentiment rule on sentences whose sums are worked out by hand."""

import math

from postrank.operators.sentiment import sentiment_by_rules

LEXICON = [("good", 1.9), ("great", 3.1), ("bad", -2.5), ("doubt", -1.5), ("love", 3.2), ("zero", 0.0)]
G, B, N = 1.9, -2.5, -0.74
CASES = [
    ("it is good", G),
    ("it is bad", B),
    ("nothing here", 0.0),
    ("zero effect", 0.0),
    ("very good", G + 0.293),  # boosters fade with distance
    ("very much good", G + 0.293 * 0.95),
    ("very much a good one", G + 0.293 * 0.9),
    ("very much of a good one", G),
    ("very bad", B - 0.293),
    ("slightly good", G - 0.293),
    ("slightly bad", B + 0.293),
    ("it is GOOD", G + 0.733),  # capitals count in a text of mixed case only
    ("IT IS GOOD", G),
    ("it is BAD", B - 0.733),
    ("VERY good", G + 0.293 + 0.733),
    ("not good", G * N),  # negation within three words
    ("not a good", G * N),
    ("not at the good", G * N),
    ("not at all the good", G),
    ("isn't good", G * N),
    ("Isn't very good", (G + 0.293) * N),
    ("never so good", (G + 0.293) * 1.25),
    ("never was this good", G * 1.25),
    ("without doubt good", -1.5 * N + G),
    ("least good", G * N),
    ("at least good", G),
    ("the least good", G * N),
    ("good but bad", G * 0.5 + B * 1.5),
    ("good, but it is bad.", G * 0.5 + B * 1.5),
    ("good great", G + 3.1),
    ("good!", G + 0.292),
    ("good!!!!!!", G + 4 * 0.292),
    ("bad!!", B - 2 * 0.292),
    ("good?", G),
    ("good??", G + 2 * 0.18),
    ("good?????", G + 0.96),
    ("not bad!", B * N + 0.292),
]


def test_rules_by_hand(spark):
    rows = [(i, t[:3], t[3:].lstrip(" ")) if t[3:4] == " " else (i, t, None) for i, (t, _) in enumerate(CASES)]
    posts = spark.createDataFrame(rows, "post_id long, title string, body string")
    lex = spark.createDataFrame(LEXICON + [("good", 0.1), ("none", None)], "word string, valence double")
    got = {r.post_id: r.compound for r in sentiment_by_rules(posts, lex).collect()}
    assert len(got) == len(CASES)
    for i, (text, total) in enumerate(CASES):
        assert abs(got[i] - total / math.sqrt(total * total + 15)) < 1e-12, (text, got[i])


def test_empty_missing_repeated_and_long(spark):
    rows = [(1, None, None), (2, "", " "), (3, "!!!", ""), (None, "good", ""), (None, "bad", ""), (4, "good", ""), (4, "bad", ""),
            (5, "good " * 20_000, "")]
    posts = spark.createDataFrame(rows, "post_id long, title string, body string")
    lex = spark.createDataFrame(LEXICON, "word string, valence double")
    got = sorted(((r.post_id or 0, r.compound) for r in sentiment_by_rules(posts, lex).collect()), key=str)
    one = lambda v: v / math.sqrt(v * v + 15)
    want = sorted([(1, None), (2, None), (3, 0.0), (0, one(G)), (0, one(B)), (4, one(G)), (4, one(B)), (5, one(G * 20_000))], key=str)
    assert [k for k, _ in got] == [k for k, _ in want]
    assert all(a == b or abs(a - b) < 1e-12 for (_, a), (_, b) in zip(got, want))
    assert sentiment_by_rules(posts.limit(0), lex).count() == 0
    assert {r.compound for r in sentiment_by_rules(posts.where("post_id > 2"), lex.limit(0)).collect()} == {0.0}
