"""Free-text requests to recommendation parameters.

Keyword matching runs as one projection: 76 ``contains`` tests per row on
the lower-cased text (bound once), counted per category (no join, no shuffle). Typo-tolerant matching runs only
on rows the exact pass left without a category, and compares *distinct*
tokens with the keywords: an equi-join on token length (a keyword is only
comparable to tokens whose length is within the similarity bound) and an edit
distance that the similarity implies. What is left, a few tokens close to some
keyword, gets the matching-block ratio as a column expression. The
matched-token table is small and is broadcast back after a size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import CATEGORIES, CATEGORY_KEYWORDS, FUZZY_CUTOFF, FUZZY_MIN_LEN, keyword_dim
from ..functions.similarity import block_ratio
from ..functions.text import location, normalize_label, request_mechanism
from .joins import join_checked, join_dim


WHITESPACE = " \t\n\r\f\x0b"


def _strip(c: Column) -> Column:
    """Strip surrounding whitespace (no regex: a character-set trim)."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(WHITESPACE))


def _categories_in_order() -> list[str]:
    seen: list[str] = []
    for _, c in CATEGORY_KEYWORDS:
        if c not in seen:
            seen.append(c)
    return seen


# C7 -------------------------------------------------------------------------
def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (a lambda variable), so
    the optimizer cannot copy the expression into each use."""
    return F.get(F.transform(F.array(value), body), 0)


def keyword_category_expr(text: Column) -> Column:
    """Category with the most keyword hits (substring match on lower text).

    Ties go to the category whose earliest *hit* keyword comes first in the
    keyword order; NULL when nothing hits. The lower-cased text and the list
    of hit keywords are each computed once per row (76 ``contains`` tests).
    """
    kws = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("c"), F.lit(i).alias("i"))
                    for i, (k, c) in enumerate(CATEGORY_KEYWORDS)])

    def per_hits(hits: Column) -> Column:
        cands = []
        for cat in _categories_in_order():
            mine = F.filter(hits, lambda x: x["c"] == F.lit(cat))
            cands.append(F.struct(F.size(mine).alias("h"),
                                  (-F.array_min(F.transform(mine, lambda x: x["i"]))).alias("f"),
                                  F.lit(cat).alias("c")))
        return F.array_max(F.filter(F.array(*cands), lambda x: x["h"] > 0))["c"]

    return _bind(F.lower(F.coalesce(text, F.lit(""))),
                 lambda low: _bind(F.filter(kws, lambda x: low.contains(x["k"])), per_hits))


def keyword_category(df: DataFrame, text: str = "text", out: str = "category") -> DataFrame:
    """C7 as a DataFrame operator (one projection, no join, no shuffle)."""
    return df.withColumn(out, keyword_category_expr(F.col(text)))


# C8 -------------------------------------------------------------------------
def _keyword_lengths(df: DataFrame) -> DataFrame:
    """Keyword dim exploded to every token length it can match at the cutoff."""
    kw = keyword_dim(df.sparkSession)
    lk = F.length("keyword")
    # 2 * matches / (lt + lk) >= c with at most min(lt, lk) matches
    lo = F.ceil(lk * F.lit(FUZZY_CUTOFF / (2 - FUZZY_CUTOFF)) - F.lit(1e-9))
    hi = F.floor(lk * F.lit((2 - FUZZY_CUTOFF) / FUZZY_CUTOFF) + F.lit(1e-9))
    return kw.select("ordinal", "keyword", "category",
                     F.explode(F.sequence(F.greatest(lo, F.lit(FUZZY_MIN_LEN)).cast("int"),
                                          hi.cast("int"))).alias("_len"))


def _may_match(a: Column, b: Column) -> Column:
    """A matching-block ratio of at least the cutoff leaves at most (1 - cutoff) * (la + lb) letters
    unmatched, and deleting and inserting those is an edit path."""
    total = F.length(a) + F.length(b)
    return F.levenshtein(a, b) <= total * F.lit(1 - FUZZY_CUTOFF) + F.lit(1e-9)


def fuzzy_token_matches(tok: DataFrame) -> DataFrame:
    """Distinct tokens -> best keyword -> category.

    Similarity is the matching-block ratio, at least the cutoff; the best keyword is the
    highest similarity, ties to the larger keyword string.
    """
    d = tok.select("token").distinct().withColumn("_len", F.length("token"))
    near = join_dim(d, _keyword_lengths(tok), "_len", "inner").filter(_may_match(F.col("token"), F.col("keyword")))
    close = near.withColumn("_ratio", block_ratio(F.col("keyword"), F.col("token"))).filter(F.col("_ratio") >= FUZZY_CUTOFF)
    best = F.max_by(F.struct("keyword", "category"), F.struct("_ratio", "keyword", "ordinal"))
    return close.groupBy("token").agg(best.alias("_best")).select("token", "_best.keyword", "_best.category")


def fuzzy_category(df: DataFrame, text: str = "text", key: str = "request_id",
                   out: str = "fuzzy_category") -> DataFrame:
    """Typo-tolerant category from tokens of at least 5 letters.

    Every token that matches a keyword adds one hit to its category; the
    most hits wins, ties to the category matched first in the text.
    Returns (key, out) for rows with at least one match.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))  # surrounding whitespace holds no tokens
    tok = (df.select(key, F.posexplode(F.regexp_extract_all(low, F.lit("[a-z]+"), 0)).alias("pos", "token"))
             .filter(F.length("token") >= FUZZY_MIN_LEN))
    m = fuzzy_token_matches(tok)
    hits = join_checked(tok, m, "token", "inner")
    per = hits.groupBy(key, "category").agg(F.count("*").alias("h"), F.min("pos").alias("p"))
    best = per.groupBy(key).agg(F.max_by("category", F.struct(F.col("h"), -F.col("p"))).alias(out))
    return best


# H7 -------------------------------------------------------------------------
def resolve_label_expr(label: Column) -> Column:
    """Free label -> canonical category: exact normalised, contained, near match 0.8."""
    norm = normalize_label(label)
    names = {" ".join(c.lower().replace("&", " and ").split()): c for c in CATEGORIES}
    exact = F.coalesce(*[F.when(norm == F.lit(n), F.lit(c)) for n, c in names.items()])
    contained = F.coalesce(*[F.when(norm.contains(n), F.lit(c)) for n, c in names.items()])
    known = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(c).alias("c")) for n, c in names.items()])

    def closest(label: Column) -> Column:
        def near(x: Column) -> Column:
            total = F.length(label) + F.length(x["n"])
            by_length = F.abs(F.length(label) - F.length(x["n"])) <= total * F.lit(1 - FUZZY_CUTOFF) + F.lit(1e-9)
            return by_length & _may_match(label, x["n"])

        rated = F.transform(F.filter(known, near), lambda x: F.struct(block_ratio(x["n"], label).alias("r"), x["n"].alias("n"), x["c"].alias("c")))
        return F.array_max(F.filter(rated, lambda x: x["r"] >= FUZZY_CUTOFF))["c"]

    # only labels without an exact or a contained name are compared; the rest are NULL there
    near = _bind(F.when(exact.isNull() & contained.isNull() & (norm != ""), norm), closest)
    return (F.when((norm == "") | (norm == "none") | norm.isNull(), F.lit(None).cast("string"))
            .otherwise(F.coalesce(exact, contained, near)))


# R2 -------------------------------------------------------------------------
def parse_requests(df: DataFrame, text: str = "text", key: str = "request_id") -> DataFrame:
    """R2: key, category, post_type, mechanism, location_mentioned, raw_text, category_source.

    Keyword category first; the typo-tolerant pass only for rows without
    one. Blank text gives all NULL (raw_text kept).
    """
    stripped = _strip(F.col(text))
    # Not cached: at scale the request table (with its text) is re-read for the
    # typo-tolerant branch instead of being held in memory or on local disk.
    base = keyword_category(df.select(key, F.col(text).alias("raw_text"), stripped.alias("_s")), "_s", "_kw")
    need = base.filter(F.col("_kw").isNull() & (F.col("_s") != ""))
    fz = fuzzy_category(need.select(key, F.col("_s").alias("_t")), "_t", key, "_fz")
    j = join_checked(base, fz, key, "left")
    blank = F.col("_s") == ""
    cat = F.when(~blank, F.coalesce(F.col("_kw"), F.col("_fz")))
    src = F.when(blank, F.lit(None)).when(F.col("_kw").isNotNull(), F.lit("keyword")) \
           .when(F.col("_fz").isNotNull(), F.lit("fuzzy"))
    return j.select(key, cat.alias("category"), F.lit(None).cast("string").alias("post_type"),
                    F.when(~blank, request_mechanism(F.col("_s"), cat)).alias("mechanism"),
                    F.when(~blank, location(F.col("_s"))).alias("location_mentioned"),
                    "raw_text", src.cast("string").alias("category_source"))
