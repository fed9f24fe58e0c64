from pyspark.sql import functions as F

from postrank.llm import langid as L
from postrank.llm.common import in_held_out_fold


def test_held_out_accuracy_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = in_held_out_fold(F.col("doc_id"))
    blind = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))  # must not matter
    model = L.fit(blind, ~held)
    got = L.predict(docs, model).where(held).select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got) and "xx" not in model["langs"]


def test_edge_rows(spark, make_docs):
    train = [(i, "the quick brown fox and the dog " * 3, "en") for i in range(20)]
    train += [(100 + i, "der schnelle braune fuchs und der hund " * 3, "de") for i in range(20)]
    edge = [(200, None, "en"), (201, "", "en"), (202, "123 !!", "de"), (203, "und der hund", None), (203, "und der hund", None),
            (None, "the dog", "en"), (204, "中文 й", None), (205, "the fox " * 40_000, None)]
    docs = make_docs(train + edge).withColumn("score", F.lit("clash"))
    model = L.fit(docs, F.col("doc_id") < 200)
    got = [(r["doc_id"], r["lang_pred"], r["score"], r["rejected"]) for r in L.predict(docs, model).collect()]
    by_id = {g[0]: g[1:] for g in got}
    assert [by_id[i][:2] for i in (200, 201, 202)] == [("und", 0.0)] * 3
    assert by_id[203][0] == "de" and by_id[None][0] == by_id[205][0] == "en"
    assert by_id[204][0] in ("de", "en") and by_id[204][2]
    assert len(got) == len(train) + len(edge)
    assert {r["lang_pred"] for r in L.predict(docs, L.fit(docs.limit(0), F.lit(True))).collect()} == {"und"}
    assert L.predict(docs.limit(0), model).count() == 0


def test_predictions_equal_plain_cosines_with_given_centroids(spark, make_docs):
    """TF-IDF of hashed byte n-grams, cosine with every centroid, one text and one n-gram at a time."""
    import math
    import random

    import numpy as np

    r = random.Random(3)
    rng = np.random.default_rng(3)
    centroids = rng.random((5, L.DIMS)).astype(np.float32) * (rng.random((5, L.DIMS)) < .2)
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    model = {"langs": ["aa", "aa", "bb", "bb", "cc"], "idf": (1 + rng.random(L.DIMS)).astype(np.float32), "centroids": centroids,
             "least": np.full(5, .2)}

    def slot(gram):
        g = gram[0] if len(gram) == 1 else gram[0] * 257 + gram[1] + 1000 if len(gram) == 2 else (gram[0] * 257 + gram[1]) * 257 + gram[2] + 100_000
        return (g % 2**32) * 2_654_435_761 % 2**32 >> 20

    def plain(text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0, True
        body = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in f" {text.lower()} ".encode())
        times = {}
        for n in (1, 2, 3):
            for i in range(len(body) - n + 1):
                times[slot(body[i:i + n])] = times.get(slot(body[i:i + n]), 0) + 1
        times.pop(slot(b" "), None)
        v = {s: math.log1p(k) * float(model["idf"][s]) for s, k in times.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosine = [sum(x * float(c[s]) for s, x in v.items()) / norm for c in centroids]
        k = max(range(5), key=lambda k: cosine[k])
        return model["langs"][k], cosine[k], cosine[k] < .2

    texts = ["".join(r.choices("abcdeéß ,1XYZ", k=r.randint(1, 80))) for _ in range(150)] + ["²", "½ ① Ⅷ", "٣", "_", "Ⅷa", "中", None, ""]
    got = {x["doc_id"]: x for x in L.predict(make_docs(list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        lang, score, rejected = plain(t)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-5 and got[i]["rejected"] == rejected, t


def test_rare_languages_are_learned_too(spark, make_docs):
    rows = [(i, "the quick brown fox and the dog", "en") for i in range(300)] + [(1000, "ñandú çok güzel öyle", "rare")]
    assert L.fit(make_docs(rows), F.lit(True))["langs"] == ["en", "rare"]
