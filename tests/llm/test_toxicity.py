import random
import re

import numpy as np
from pyspark.sql import functions as F

from postrank.llm import toxicity as X
from postrank.llm.common import in_held_out_fold

CALM = [f"word{i}" for i in range(400)]


def corpus(n=900):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(CALM) for _ in range(40)]
        bad = r.random() < 0.2
        for _ in range(r.randint(1, 3) if bad else 0):
            w[r.randrange(40)] = r.choice(["idiotic", "moronic", "scumbag"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_finds_planted_words_without_reading_held_out_labels(spark, make_docs):
    rows, labels = corpus()
    held = in_held_out_fold(F.col("doc_id"))
    docs = make_docs(rows)
    table = spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in X.score(docs, X.fit(docs, table, ~held)).collect()}
    right = sum(got[i]["predicted"] == t for i, t in labels)
    assert right >= 0.97 * len(labels)
    flipped = table.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in X.score(docs, X.fit(docs, flipped, ~held)).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-9 for i, r in got.items())


def test_edge_rows(spark, make_docs):
    rows, labels = corpus(300)
    docs = make_docs(rows + [(None, None), (1000, ""), (1001, None), (1002, "word1 " * 50_000)]).withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    everything = F.lit(True)
    got = X.score(docs, X.fit(docs, none, everything)).select("score", "predicted").distinct().collect()
    assert len(got) == 1 and got[0]["predicted"] == 0
    one = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, toxic int")
    assert X.score(docs, X.fit(docs, one, everything)).where("predicted = 0").count() == 0
    model = X.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), everything)
    got = {r["doc_id"]: r["score"] for r in X.score(docs, model).collect()}
    assert got[1000] == got[1001] == got[None] and 0 <= min(got.values()) <= max(got.values()) <= 1
    assert X.score(docs.limit(0), model).count() == 0
    X.fit(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int"), everything)


def test_label_model_finds_accurate_and_copied_voters():
    r = np.random.default_rng(1)
    y = r.random(20_000) < 0.2
    v = np.zeros((len(y), X.VOTERS), dtype=bool)
    v[:, 0] = np.where(y, r.random(len(y)) < 0.8, r.random(len(y)) < 0.01)
    v[:, 1] = v[:, 0]  # a copy
    v[:, 2] = np.where(y, r.random(len(y)) < 0.6, r.random(len(y)) < 0.02)
    v[:, X.LEXICONS] = r.random(len(y)) < 0.3  # says nothing
    codes, counts = np.unique((v * (1 << np.arange(X.VOTERS))).sum(axis=1), return_counts=True)
    m = X.LabelModel(dict(zip(codes.tolist(), counts.tolist())), 0.2)
    assert m.weights[0] < 0.75 and m.weights[2] > m.weights[0]
    assert abs(np.log(m.rates[1, X.LEXICONS] / m.rates[0, X.LEXICONS])) < 0.2
    assert m.posterior(0b111) > 0.95 and m.posterior(0) < 0.1


def test_scores_equal_plain_sums_of_given_weights(spark, make_docs):
    """A text's features by their definition: words, and beginnings shared by enough different words."""
    import math
    import random

    r = random.Random(6)
    features = {"bad": 0, "worse": 1, "1x4^badl": 2, "2x4^badl": 3, "4x5^badly": 4, "1x7^badlyxx": 5, "été": 6}
    features = {k.encode().decode("latin-1"): v for k, v in features.items()}
    weights = [r.uniform(-2, 2) for _ in features] + [-.5]

    def plain(text):
        found = {w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split()}
        z = weights[-1]
        for name, i in features.items():
            name = name.encode("latin-1").decode()
            if "^" in name:
                times, (size, start) = int(name.split("x")[0]), name.split("x", 1)[1].split("^")
                z += weights[i] * (sum(w.encode()[:int(size)] == start.encode() and len(w.encode()) > int(size) for w in found) >= times)
            else:
                z += weights[i] * (name in found)
        return 1 / (1 + math.exp(-z))

    some = ["bad", "Worse", "badly", "badlyx", "badlyxxy", "badlymore", "badlyever", "badlz", "été", "fine", "ok"]
    texts = [" ".join(r.choices(some, k=r.randint(0, 12))) for _ in range(200)] + [None, "", "bad " * 50_000]
    import numpy as np

    got = {x["doc_id"]: x for x in X.score(make_docs(list(enumerate(texts))), {"features": features, "weights": np.array(weights)}).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i]["score"] - plain(t)) < 1e-9 and got[i]["predicted"] == (plain(t) >= .3), t


def test_patterns_equal_their_regular_expressions():
    shout, repeat = re.compile(r"\b[A-Z]{3,}\b"), re.compile(r"([^\W\d])\1{3}")
    r = random.Random(9)
    texts = ["", "a", "AAA", "AB", "xABCD ABC", "AAAA", "aaaa", "____", "1111", "!!!!", "²²²²", "ééééé", "    ", "a\U0001F600\U0001F600\U0001F600\U0001F600"]
    texts += ["".join(r.choice("aAB !_1é") for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += ["".join(c * r.randrange(1, 6) for c in r.choices("abA!1_ ", k=9)) for _ in range(1000)]
    for t in texts:
        want = [t.count("!") * 200 > len(t), len(shout.findall(t)) * 60 > len(t), repeat.search(t) is not None]
        assert [bool(p(t, X.code_points(t))) for p in X.PATTERNS] == want, t
