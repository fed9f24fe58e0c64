"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of hashed byte n-grams (one to three bytes of its
lower-cased letters), normalised to length 1. Each language has several centroids,
found by spherical k-means on a bounded sample of its training rows; the centroid of
the highest cosine names the language, and a text further from it than its own
training rows is marked as rejected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, quoted, shared

DIMS = 4096
CENTROIDS = 3  # per language
SAMPLE = 500  # training rows per language expected in the k-means sample; at most twice as many
LANGUAGES = 5000  # more labels are an error: their centroids would no longer fit a worker
ROUNDS = 10
REJECT = 0.01  # share of a centroid's training rows that its distance limit leaves out
CHUNK_TEXTS, CHUNK_BYTES = 128, 1 << 20
UNDETERMINED = "und"

LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def counts(body: bytes) -> np.ndarray:
    """n-gram counts of one lower-cased text over the hashed dimensions."""
    a = np.frombuffer(b" " + body.translate(LETTERS) + b" ", dtype=np.uint8).astype(np.uint32)
    grams = [a, a[:-1] * 257 + a[1:] + 1_000, (a[:-2] * 257 + a[1:-1]) * 257 + a[2:] + 100_000]
    slots = np.concatenate([(g * np.uint32(2_654_435_761)) >> np.uint32(20) for g in grams])
    spaces = slots[0]  # the slot of a lone space says nothing
    out = np.bincount(slots, minlength=DIMS)
    out[spaces] = 0
    return out


def chunks(column: pa.Array):
    """Lists of texts (null: None) of bounded size, so that the dense vectors stay small."""
    part, size = [], 0
    for x in column:
        t = x.as_py()
        part.append(t)
        size += len(t or "")
        if len(part) >= CHUNK_TEXTS or size >= CHUNK_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def vectors(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    x = np.zeros((len(texts), DIMS), dtype=np.float32)
    for i, t in enumerate(texts):
        if t:
            x[i] = np.log1p(counts(t.lower().encode("utf-8", "surrogatepass"))) * idf
    return unit(x)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """In how many texts each dimension occurs: one vector per task, summed by Spark."""
    def run(batches):
        seen = np.zeros(DIMS, dtype=np.int64)
        for b in batches:
            for x in b.column(0):
                seen += counts((x.as_py() or "").lower().encode("utf-8", "surrogatepass")) > 0
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], names=["dim", "n"])

    out = np.zeros(DIMS)
    for r in rows.select("__text").mapInArrow(run, "dim int, n bigint").groupBy("dim").agg(F.sum("n").alias("n")).collect():
        out[r["dim"]] = r["n"]
    return out


def clusters(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart rows: centroids and each one's least accepted cosine."""
    first = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(first) < min(CENTROIDS, len(x)):
        near = (x @ x[first].T).max(axis=1)
        if near.min() > 0.9999:
            break
        first.append(int(np.argmin(near)))
    c = x[first]
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        c = unit(np.stack([x[own == k].sum(axis=0) if (own == k).any() else c[k] for k in range(len(c))]))
    cosine = x @ c.T
    own = np.argmax(cosine, axis=1)
    least = [np.quantile(cosine[own == k, k], REJECT) if (own == k).any() else 0.0 for k in range(len(c))]
    return c, np.array(least)


def fit(df: DataFrame, training: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict:
    """Centroids learned from the rows where ``training`` holds, text and language are not null.

    Document frequencies cover all these rows. The k-means sample is drawn per language by a hash of
    the key, about SAMPLE rows and never over twice as many, and clustered language by language. All
    languages are learned; more than LANGUAGES are an error.
    """
    rows = (df.where(training & quoted(text).isNotNull() & quoted(lang).isNotNull())
            .select(quoted(text).cast("string").alias("__text"), quoted(lang).cast("string").alias("__lang"),
                    (F.pmod(F.xxhash64(quoted(key)), F.lit(1 << 30)) / float(1 << 30)).alias("__draw")))
    sizes = rows.groupBy("__lang").count().limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return {"langs": [], "centroids": np.zeros((0, DIMS), np.float32), "least": np.zeros(0), "idf": np.zeros(DIMS, np.float32)}
    total = sum(r["count"] for r in sizes)
    idf = (np.log((1 + total) / (1 + document_frequencies(rows))) + 1).astype(np.float32)
    rate = F.create_map(*[x for r in sizes for x in (F.lit(r["__lang"]), F.lit(min(1.0, SAMPLE / r["count"])))])
    best = Window.partitionBy("__lang").orderBy("__draw", F.xxhash64("__text"))
    sample = (rows.where(F.col("__draw") < F.coalesce(F.try_element_at(rate, F.col("__lang")), F.lit(0.0)))
              .withColumn("__at", F.row_number().over(best)).where(F.col("__at") <= 2 * SAMPLE)
              .select("__lang", "__text"))

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        texts = rows["__text"].tolist()
        x = np.concatenate([vectors(texts[i:i + CHUNK_TEXTS], idf) for i in range(0, len(texts), CHUNK_TEXTS)])
        x = x[x.any(axis=1)]
        if not len(x):
            return pd.DataFrame({"lang": [], "vector": [], "least": []})
        c, least = clusters(x)
        return pd.DataFrame({"lang": rows["__lang"].iloc[0], "vector": [v.tobytes() for v in c], "least": least})

    found = sorted(sample.groupBy("__lang").applyInPandas(cluster, "lang string, vector binary, least double").collect())
    return {"langs": [r["lang"] for r in found], "idf": idf, "least": np.array([r["least"] for r in found]),
            "centroids": np.array([np.frombuffer(bytes(r["vector"]), np.float32) for r in found]).reshape(-1, DIMS)}


def predict(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``df`` with lang_pred, score (cosine with the nearest centroid, 0 to 1) and rejected (the cosine is
    below what the centroid's own rows reach).

    ``und`` with score 0, rejected, if the text is null, empty or has no letter, or if nothing was
    learned. Equal cosines: the first language in alphabetical order. Repeated rows get equal
    results; a result column replaces an input column of its name. One pass, no shuffle.
    """
    sent = shared(df.sparkSession, model)
    fields = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("rejected", T.BooleanType())])

    def make():
        m = sent.value

        def function(column: pa.Array) -> list:
            langs, scores, far = [], [], []
            for texts in chunks(column):
                if not m["langs"]:
                    langs += [UNDETERMINED] * len(texts)
                    scores += [0.0] * len(texts)
                    far += [True] * len(texts)
                    continue
                cosine = vectors(texts, m["idf"]) @ m["centroids"].T
                best = np.argmax(cosine, axis=1)
                for t, k, row in zip(texts, best.tolist(), cosine):
                    known = bool(t) and any(map(str.isalpha, t))
                    langs.append(m["langs"][k] if known else UNDETERMINED)
                    scores.append(float(min(1.0, max(0.0, row[k]))) if known else 0.0)
                    far.append(not known or bool(row[k] < m["least"][k]))
            return [langs, scores, far]
        return function

    return map_text(df, text, fields, make)
