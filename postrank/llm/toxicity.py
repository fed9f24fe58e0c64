"""Toxicity by weak supervision.

1. Lexicons are learned from a bounded sample of labelled training rows: words and word beginnings
   that occur with the label far more often than chance allows. Dealt into several lists they are
   voters; patterns of writing (shouting, exclamation, repeated characters) are voters too.
2. A generative label model (two latent classes; EM on the counts of vote patterns over all documents)
   estimates each voter's accuracy and, from residual correlations within the classes, how much of
   its evidence others already give; that share is discounted in the posterior.
3. A linear classifier is trained on the posterior labels of a bounded sample of training rows and
   scores every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, most, quoted, shared, written
from .decontam import NORMAL

LABELLED = 10_000  # labelled rows that the lexicons are learned from
TRAINED = 10_000  # rows that the classifier is trained on (expected; drawn by a hash of the key)
PREFIXES = (4, 5, 6, 7)  # bytes of a word's beginning that count as a token
TIMES = (1, 2, 4)  # a beginning is a token of its own when so many different words of a text share it
LISTS = 2  # lexicons per kind of token
TOKENS = 20_000  # tokens in all lexicons, and features of the classifier, at most
PRECISE = 0.85  # share of label 1 among a lexicon token's rows, at least
SUMMED = 100_000  # tokens whose sums a task holds before it reports them

PREFIXED = re.compile(r"(\d+)x(\d+)\^")  # words have no ^
SHOUT = re.compile(r"\b[A-Z]{3,}\b")
LETTER = re.compile(r"[^\W\d]")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def shouts(text: str, points: np.ndarray) -> bool:
    """More than one word in capitals per 60 characters; the words are looked for only where three capitals follow another."""
    capital = (points >= 65) & (points <= 90)
    return bool((capital[2:] & capital[1:-1] & capital[:-2]).any()) and len(SHOUT.findall(text)) * 60 > len(text)


def repeats(text: str, points: np.ndarray) -> bool:
    """A letter four times in a row."""
    same = points[1:] == points[:-1]
    at = np.flatnonzero(same[2:] & same[1:-1] & same[:-2])
    return any(LETTER.match(chr(c)) for c in np.unique(points[at]).tolist())


PATTERNS = (lambda t, points: t.count("!") * 200 > len(t), shouts, repeats)
LEXICONS = (1 + len(PREFIXES)) * LISTS
VOTERS = LEXICONS + len(PATTERNS)


def words(text: str) -> set[bytes]:
    return set(text.lower().encode("utf-8", "surrogatepass").translate(NORMAL).split())


def beginnings(word: bytes) -> list[str]:
    return [f"{n}^{word[:n].decode('latin-1')}" for n in PREFIXES if len(word) > n]


def tokens(text: str) -> list[str]:
    """A text's tokens, each once: its words, and word beginnings with how often they are shared."""
    found = words(text)
    shared = Counter(p for w in found for p in beginnings(w))
    return [w.decode("latin-1") for w in found] + [f"{t}x{p}" for p, n in shared.items() for t in TIMES if n >= t]


class Lookup:
    """What a table of tokens has for a text: words by one intersection, beginnings by their bytes, length by length."""

    def __init__(self, table: dict[str, int]):
        self.whole: dict[bytes, int] = {}
        self.begun: dict[int, dict[bytes, list[tuple[int, int]]]] = {n: {} for n in PREFIXES}
        for token, entry in table.items():
            if m := PREFIXED.match(token):
                start = token[m.end():].encode("latin-1")
                self.begun[int(m[2])].setdefault(start, []).append((int(m[1]), entry))
            else:
                self.whole[token.encode("latin-1")] = entry
        self.names = frozenset(self.whole)

    def of(self, text: str) -> set[int]:
        found = words(text)
        out = {self.whole[w] for w in found & self.names}
        for n, known in self.begun.items():
            found = [w for w in found if len(w) > n]
            for start, shared_by in Counter([s for w in found if (s := w[:n]) in known]).items():
                out.update([entry for times, entry in known[start] if shared_by >= times])
        return out


def token_sums(rows: DataFrame) -> DataFrame:
    """Per token of ``rows`` (text, weight): in how many texts it is and the sum of their weights."""
    def run(batches):
        n, a = Counter(), Counter()
        for b in batches:
            for x, weight in zip(b.column(0), b.column(1).to_pylist()):
                found = tokens(x.as_py() or "")
                n.update(found)
                if weight:
                    for t in found:
                        a[t] += weight
                if len(n) > SUMMED:
                    yield report(n, a)
        yield report(n, a)

    def report(n, a):
        out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()),
                                          pa.array([float(a[t]) for t in n], pa.float64())], names=["token", "n", "a"])
        n.clear()
        a.clear()
        return out

    return (rows.select("text", "weight").mapInArrow(run, "token string, n bigint, a double")
            .groupBy("token").agg(F.sum("n").alias("n"), F.sum("a").alias("a")))


def associated(sums: DataFrame, base: float, above_only: bool) -> list[tuple[str, float, float]]:
    """The tokens whose association with the weight is beyond chance, given how many are tried; the
    strongest TOKENS of them."""
    sums = written(sums, "sums")
    tried = max(1, sums.where(F.col("n") >= 3).count())
    a, n = F.col("a"), F.col("n")
    xlog = lambda k, e: F.when(k > 1e-9, k * F.log(k / e)).otherwise(0.0)
    g = xlog(a, n * base) + xlog(n - a, n * (1 - base))
    some = sums.where((n >= 3) & (g >= float(np.log(tried)) + 1.0))
    if above_only:
        some = some.where((a + 0.5) / (n + 1) >= PRECISE)
    found = most(some.withColumn("g", g), F.col("g"), TOKENS, more=True).collect()
    found.sort(key=lambda r: (-r["g"], r["token"]))
    return [(r["token"], r["n"], r["a"]) for r in found[:TOKENS]]


def lexicons(found: list[tuple[str, float, float]]) -> dict[str, int]:
    """Token to voter: tokens of a kind are dealt out over its lists in order of strength."""
    out, dealt = {}, [0] * (1 + len(PREFIXES))
    for token, _, _ in found:
        kind = 1 + PREFIXES.index(int(m[2])) if (m := PREFIXED.match(token)) else 0
        out[token] = kind * LISTS + dealt[kind] % LISTS
        dealt[kind] += 1
    return out


def vote_factory(lexicon):
    def make():
        lookup = Lookup(lexicon.value)

        def function(column: pa.Array) -> list:
            out = []
            for x in column:
                t = x.as_py() or ""
                v = 0
                for j in lookup.of(t):
                    v |= 1 << j
                points = code_points(t)
                for j, p in enumerate(PATTERNS, LEXICONS):
                    v |= bool(p(t, points)) << j
                out.append(v)
            return [out]
        return function
    return make


class LabelModel:
    """Two latent classes with voters that fire or abstain; the share of class 1 is that of the labels.

    A voter that fires gives the log ratio of its rates in the two classes, times
    1 / (1 + sum of its positive correlations with other voters within the classes), so lexicons that
    fire together do not add up as if independent. A voter that abstains says nothing by itself, as
    lexicons of other languages always do; that no lexicon fires at all counts once.
    """

    def __init__(self, patterns: dict[int, int], base: float, rounds: int = 50):
        v = np.array([[p >> j & 1 for j in range(VOTERS)] for p in patterns], dtype=float).reshape(-1, VOTERS)
        n = np.array(list(patterns.values()), dtype=float)
        silent = 1 - v[:, :LEXICONS].max(axis=1, initial=0)
        self.prior = min(0.9, max(1e-4, base))
        self.rates = np.array([[0.02] * LEXICONS + [0.1] * len(PATTERNS), [0.6] * LEXICONS + [0.1] * len(PATTERNS)])
        self.silent = np.array([0.95, 0.05])
        self.weights = np.ones(VOTERS)
        for _ in range(rounds):
            q = self.posterior_of(v)
            mass = np.stack([n * (1 - q), n * q])
            total = mass.sum(axis=1, keepdims=True)
            self.rates = (mass @ v + [[0.01], [0.5]]) / (total + 1.0)
            # a lexicon was chosen because it goes with the label; firing never speaks against it
            self.rates[1, :LEXICONS] = np.maximum(self.rates[1, :LEXICONS], self.rates[0, :LEXICONS])
            self.silent = np.clip((mass @ silent + [0.5, 0.01]) / (total[:, 0] + 1.0), 1e-5, 1 - 1e-5)
            self.weights = 1 / (1 + self.correlations(v, mass))

    def correlations(self, v: np.ndarray, mass: np.ndarray) -> np.ndarray:
        both = np.zeros((VOTERS, VOTERS))
        for c in range(2):
            r = (v - self.rates[c]) * np.sqrt(mass[c])[:, None]
            cov = r.T @ r / max(1.0, mass[c].sum())
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
            both += np.maximum(cov / np.outer(sd, sd), 0) * mass[c].sum() / max(1.0, mass.sum())
        np.fill_diagonal(both, 0)
        return both.sum(axis=1)

    def posterior_of(self, v: np.ndarray) -> np.ndarray:
        r = np.clip(self.rates, 1e-5, 1 - 1e-5)
        silent = 1 - v[:, :LEXICONS].max(axis=1, initial=0)
        z = (np.log(self.prior / (1 - self.prior)) + (v * np.log(r[1] / r[0])) @ self.weights
             + silent * np.log(self.silent[1] / self.silent[0]))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def posterior(self, pattern: int) -> float:
        return float(self.posterior_of(np.array([[pattern >> j & 1 for j in range(VOTERS)]], dtype=float))[0])


def logistic(rows: Sequence[Sequence[int]], target: np.ndarray, size: int, rounds: int = 300, decay: float = 1e-3) -> np.ndarray:
    """Weights of the features and, last, the intercept: full-batch descent with per-weight steps."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    w = np.zeros(size + 1)
    mean = float(np.clip(target.mean(), 1e-4, 1 - 1e-4))
    w[-1] = np.log(mean / (1 - mean))
    past = np.full(size + 1, 1e-8)
    for _ in range(rounds):
        z = w[-1] + np.bincount(at, w[feature], minlength=len(rows))
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        g = np.append(np.bincount(feature, e[at], minlength=size), e.sum())
        g[:-1] += decay * w[:-1] / max(1, len(rows)) * 50
        past += g * g
        w -= 0.5 * g / np.sqrt(past)
    return w


def smallest(rows: DataFrame, digest: Column, k: int) -> DataFrame:
    """The ``k`` rows of the smallest hashes (of 64 bits), then smallest ids. Only rows below a hash that leaves some more
    than ``k`` are sorted."""
    n = rows.count()
    if n <= k:
        return rows
    share = (k + 8 * k ** 0.5 + 20) / n
    few = rows.where(digest <= int(min(1.0, share) * 2**64) - 2**63 - 1)
    return (few if few.count() >= k else rows).orderBy(digest, "doc_id").limit(k)


def fit(df: DataFrame, labels: DataFrame, training: Column, text: str = "text", key: str = "doc_id",
        label: str = "toxic") -> dict:
    """The classifier's features and weights. Labels are read for rows where ``training`` holds only;
    the same holds for the classifier's rows. Vote patterns are counted over all rows of ``df``.

    A row is labelled 1 if any of its labels is; null labels and keys are left out; of training rows that share a key
    the largest text is learned from. Without labelled
    rows of both classes there is nothing to learn and every text scores the share of label 1.
    """
    spark = df.sparkSession
    rows = df.select(quoted(key).alias("doc_id"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"))
    marked = smallest(labels.where(training & quoted(label).isNotNull() & quoted(key).isNotNull())
                      .groupBy(quoted(key).alias("doc_id")).agg(F.max((quoted(label) == 1).cast("double")).alias("weight")),
                      F.xxhash64("doc_id"), LABELLED)
    # LABELLED rows of 16 bytes at most: a bounded broadcast, so texts are not shuffled
    sample = (rows.join(F.broadcast(marked), "doc_id").groupBy("doc_id", "weight")
              .agg(F.max("text").alias("text")).select("text", "weight"))
    n, a = marked.agg(F.count("*"), F.sum("weight")).first()
    base = a / n if n else 0.0
    if not 0 < base < 1:
        return {"features": {}, "weights": np.array([np.log((base + 1e-9) / (1 - base + 1e-9))])}
    lexicon = lexicons(associated(token_sums(sample), base, above_only=True))
    voters = shared(spark, lexicon)
    vote = T.StructType([T.StructField("votes", T.IntegerType())])
    voted = map_text(rows, "text", vote, vote_factory(voters), keep=[])
    model = LabelModel({r["votes"]: r["count"] for r in voted.groupBy("votes").count().collect()}, base)

    size = df.count()
    draw = F.pmod(F.xxhash64(F.lit("train"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    drawn = df.where(training).select(quoted(key).alias("doc_id"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"))
    drawn = (drawn.where(draw < min(1.0, TRAINED / max(1, size)))
             .groupBy("doc_id").agg(F.max("text").alias("text")).select("text"))
    drawn = written(map_text(drawn, "text", vote, vote_factory(voters)), "drawn")  # read several times below
    weight = F.create_map(*[x for p in sorted({r["votes"] for r in drawn.select("votes").distinct().collect()} | {0})
                            for x in (F.lit(p), F.lit(model.posterior(p)))])
    drawn = drawn.withColumn("weight", F.coalesce(F.try_element_at(weight, F.col("votes")), F.lit(model.posterior(0))))
    mean = drawn.agg(F.avg("weight")).first()[0] or 0.0
    if not 0 < mean < 1:
        return {"features": {}, "weights": np.array([np.log((base + 1e-9) / (1 - base + 1e-9))])}
    chosen = associated(token_sums(drawn), mean, above_only=False)
    features = {t: i for i, (t, _, _) in enumerate(chosen)}
    sent = shared(spark, features)

    def make():
        lookup = Lookup(sent.value)
        return lambda column: [[sorted(lookup.of(x.as_py() or "")) for x in column]]

    found = map_text(drawn, "text", T.StructType([T.StructField("found", T.ArrayType(T.IntegerType()))]), make, keep=["weight"])
    got = found.toArrow()  # TRAINED rows, about
    weights = got.column("weight").to_numpy()
    lists = [x.values.to_numpy(zero_copy_only=False) for chunk in got.column("found").chunks for x in chunk]
    # in a fixed order, as sums depend on it: big-endian bytes are ordered as the lists are
    at = sorted(range(len(lists)), key=lambda i: (weights[i], lists[i].astype(">u4").tobytes()))
    return {"features": features, "weights": logistic([lists[i] for i in at], weights[at], len(features)), "label_model": model}


def score(df: DataFrame, model: dict, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``df`` with score (0 to 1) and predicted (1 if score >= ``threshold``) from the whole text alone.

    A null or empty text has no features and scores the intercept; repeated rows score the same; a
    result column replaces an input column of its name. One pass, no shuffle.
    """
    sent = shared(df.sparkSession, (model["features"], model["weights"]))
    fields = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def make():
        features, w = sent.value
        lookup = Lookup(features)

        def function(column: pa.Array) -> list:
            z = np.array([w[-1] + sum(w[i] for i in lookup.of(x.as_py() or "")) for x in column])
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            return [s.tolist(), (s >= threshold).astype(int).tolist()]
        return function

    return map_text(df, text, fields, make)
