"""Free-text request parsing (keyword, typo-tolerant, mechanism, location)."""

import difflib
import random
import re

from postrank.functions.similarity import block_ratio
from postrank.functions.text import normalize_label
from postrank.operators import parse as PR
from postrank.operators.parse import parse_requests, resolve_label_expr
from pyspark.sql import functions as F

CASES = [
    ("best recipe for sourdough bread", "Food & Cooking", "statement", None),
    ("my gaming pc build", "Gaming", None, None),
    ("how do I fix my resume?", "Career & Work", "question", None),
    ("just finished my gaming PC build", "Gaming", "showcase", None),
    ("anxiety tips for college students", "Mental Health", "statement", None),
    ("knitting workshop in Chicago", None, None, "Chicago"),
    ("promote my restaurant in Austin", "Food & Cooking", None, "Austin"),
    ("", None, None, None),
    ("asdfghjkl", None, None, None),
    ("easy recipe to cook while playing a game", "Food & Cooking", None, None),
    ("best sunscren for oily skn", "Skincare & Beauty", None, None),
    ("moisturiser advice", "Skincare & Beauty", None, None),
    ("yogga at dawn", "Fitness & Health", None, None),
]


def test_parse_examples(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(CASES)], "request_id long, text string")
    out = {r.request_id: r for r in parse_requests(df).collect()}
    for i, (text, cat, mech, loc) in enumerate(CASES):
        r = out[i]
        assert r.category == cat, text
        if mech is not None:
            assert r.mechanism == mech, text
        assert r.location_mentioned == loc, text
        assert r.post_type is None and r.raw_text == text
    assert out[7].mechanism is None and out[7].category_source is None
    assert out[8].mechanism is None
    assert out[0].category_source == "keyword"
    assert out[10].category_source == "fuzzy"  # no keyword is a substring; "sunscren" ~ "sunscreen"
    assert out[11].category_source == "fuzzy" and out[12].category_source == "fuzzy"


def test_keyword_ties_first_seen(spark):
    # one hit each for Gaming ("game") and Food ("cook"): the keyword seen first in the
    # keyword order decides ("cook" precedes "game")
    df = spark.createDataFrame([(1, "game then cook")], "request_id long, text string")
    assert parse_requests(df).first().category == "Food & Cooking"


def test_normalize_and_resolve_label(spark):
    rows = [("Skincare & Beauty.",), (" skincare and beauty ",), ("**Skincare&Beauty**",),
            ("Category: Gaming",), ("Skincare & Beuty",), ("none",), ("Pets",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(normalize_label(F.col("t")).alias("n"), resolve_label_expr(F.col("t")).alias("c")).collect()
    assert [g.n for g in got[:3]] == ["skincare and beauty"] * 3
    assert [g.c for g in got] == ["Skincare & Beauty"] * 3 + ["Gaming", "Skincare & Beauty", None, None]


def test_swapped_letters_resolve_by_matching_blocks(spark):
    # "lpatop" ~ "laptop": blocks "l" + "atop" or "pa"...: 5 of 6 letters match on both sides, 10 / 12 >= 0.8
    texts = ["lpatop", "reciep", "anxeity", "rceipe book", "ytniv qqqqq"]
    df = spark.createDataFrame(list(enumerate(texts)), "request_id long, text string")
    got = {r.request_id: (r.category, r.category_source) for r in parse_requests(df).collect()}
    assert got == {0: ("Tech & Gadgets", "fuzzy"), 1: ("Food & Cooking", "fuzzy"), 2: ("Mental Health", "fuzzy"),
                   3: ("Food & Cooking", "fuzzy"), 4: (None, None)}


def test_fuzzy_matches_equal_the_plain_ratio(spark):
    """The length and edit-distance bounds lose no keyword that the ratio accepts."""
    import random
    from difflib import get_close_matches
    from postrank.dims import CATEGORY_KEYWORDS
    from postrank.operators.parse import fuzzy_token_matches
    r = random.Random(11)
    words = [k for k, _ in CATEGORY_KEYWORDS if " " not in k]
    tokens = set()
    while len(tokens) < 1500:
        w = list(r.choice(words))
        for _ in range(r.randint(1, 4)):
            i = r.randrange(len(w))
            op = r.randrange(4)
            w[i:i + 1] = [] if op == 0 and len(w) > 1 else [w[i], r.choice("aeinrstz")] if op == 1 else [r.choice("aeinrstz")]
            if op == 3 and i + 1 < len(w):
                w[i], w[i + 1] = w[i + 1], w[i]
        if len(w) >= 5:
            tokens.add("".join(w))
    got = {x.token: x.keyword for x in fuzzy_token_matches(spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}
    want = {t: m[0] for t in tokens if (m := get_close_matches(t, [k for k, _ in CATEGORY_KEYWORDS], n=1, cutoff=0.8))}
    assert got == want


def test_block_ratio_equals_the_library(spark):
    """10,000 pairs: random ones over few letters (many ties) and words with slips; empty and missing strings."""
    rnd = random.Random(7)
    word = lambda n, letters: "".join(rnd.choice(letters) for _ in range(n))
    pairs = [(word(rnd.randint(0, 11), "abc"), word(rnd.randint(0, 11), "abc")) for _ in range(5000)]
    for _ in range(4996):
        a = word(rnd.randint(5, 14), "abcdefgh")
        b = list(a)
        for _ in range(rnd.randint(1, 3)):
            b[rnd.randrange(len(b))] = rnd.choice(["", "x", "ab", "ä"])
        pairs.append((a, "".join(b)))
    pairs += [("", ""), ("a", ""), ("", "a"), ("mental health", "mental helath")]
    df = spark.createDataFrame(pairs, "a string, b string").repartition(8)
    got = df.select("a", "b", block_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert len(got) == 10_000
    assert all(r["r"] == difflib.SequenceMatcher(None, r["a"], r["b"]).ratio() for r in got)
    none = spark.createDataFrame([(None, "a"), ("a", None)], "a string, b string")
    assert [r[0] for r in none.select(block_ratio(F.col("a"), F.col("b"))).collect()] == [None, None]


def test_typo_matching_runs_without_python(spark, capsys):
    df = spark.createDataFrame([(1, "sunscren and yogga"), (2, None)], "request_id int, text string")
    PR.fuzzy_category(df).explain()
    df.select(PR.resolve_label_expr(F.col("text"))).explain()
    assert not re.search("Python|InArrow|InPandas", capsys.readouterr().out)
