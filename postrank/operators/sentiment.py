"""Sentiment by the published rules of the valence-lexicon method.

:func:`postrank.operators.textfeat.sentiment` sums valences with a negation rule only. Here words keep their case and
place, and each lexicon word is adjusted by the words before it: boosters that fade with distance, capitals in a text
that is not all capitals, negation, "never so", "without doubt" and "least"; then the parts before and after "but" are
weighed, and exclamation and question marks add to the sum.

The lexicon is joined by words; what a post gets back is a map of its own lexicon words, bounded by its different words. The
rules are one expression over the post's words, so nothing the size of all words is sorted or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import join_checked
from .textfeat import NEGATIONS, NEG_SCALAR, SENT_ALPHA, post_text

# Fixed values of the published method.
BOOST = 0.293
CAPITALS = 0.733
FADING = {1: 1.0, 2: 0.95, 3: 0.9}
NEVER_SO = 1.25
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION, MOST_EXCLAMATIONS = 0.292, 4
QUESTION, MANY_QUESTIONS = 0.18, 0.96
BOOSTERS = ["absolutely", "amazingly", "awfully", "completely", "considerable", "considerably", "decidedly", "deeply",
            "enormous", "enormously", "entirely", "especially", "exceptional", "exceptionally", "extreme", "extremely",
            "fabulously", "fully", "greatly", "hella", "highly", "hugely", "incredible", "incredibly", "intensely", "major",
            "majorly", "more", "most", "particularly", "purely", "quite", "really", "remarkably", "so", "substantially",
            "thoroughly", "total", "totally", "tremendous", "tremendously", "uber", "unbelievably", "unusually", "utter",
            "utterly", "very"]
DAMPENERS = ["almost", "barely", "hardly", "kinda", "kindof", "kind-of", "less", "little", "marginal", "marginally",
             "occasional", "occasionally", "partly", "scarce", "scarcely", "slight", "slightly", "somewhat", "sorta", "sortof",
             "sort-of"]


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def words_with_case(text: Column) -> Column:
    """Words between white space without the punctuation around them; a word of two letters or less without it keeps it
    (emoticons)."""
    def bare(w: Column) -> Column:
        return _bind(F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", ""), lambda x: F.when(F.length(x) > 2, x).otherwise(w))

    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), 0), bare)


def _capitals(w: Column) -> Column:
    return (w == F.upper(w)) & (w != F.lower(w))


def _negates(w: Column) -> Column:
    return w.isin(NEGATIONS) | w.contains("n't")


def _adjusted(words: Column, low: Column, hits: Column, mixed: Column, i: Column) -> Column:
    """The valence of word ``i`` after the rules on it and the three words before; NULL if the lexicon lacks it."""
    def before(k: int) -> Column:
        return F.get(low, i - k)

    def plain(k: int) -> Column:
        """There is a word ``k`` places before, and it isn't in the lexicon."""
        return before(k).isNotNull() & ~F.coalesce(F.map_contains_key(hits, F.coalesce(before(k), F.lit(""))), F.lit(False))

    def moved(v: Column, k: int) -> Column:
        up = F.when(before(k).isin(BOOSTERS), BOOST).when(before(k).isin(DAMPENERS), -BOOST)
        signed = F.when(v < 0, -up).otherwise(up)
        loud = F.when(_capitals(F.get(words, i - k)) & mixed, signed + F.when(v > 0, CAPITALS).otherwise(-CAPITALS)).otherwise(signed)
        between = [before(j) for j in range(1, k)]
        so = F.lit(False)
        doubt = F.lit(False)
        for b in between:
            so, doubt = so | b.isin("so", "this"), doubt | (b == "doubt")
        factor = (F.when((before(k) == "never") & so, NEVER_SO).when((before(k) == "without") & doubt, 1.0)
                  .when(_negates(before(k)), NEG_SCALAR).otherwise(1.0))
        return F.when(plain(k), (v + F.coalesce(loud, F.lit(0.0)) * FADING[k]) * factor).otherwise(v)

    def least(v: Column) -> Column:
        alone = plain(1) & (before(1) == "least") & ~F.coalesce(before(2).isin("at", "very"), F.lit(False))
        return F.when(alone, v * NEG_SCALAR).otherwise(v)

    def rules(v: Column) -> Column:
        loud = F.when(_capitals(F.get(words, i)) & mixed, v + F.when(v > 0, CAPITALS).otherwise(-CAPITALS)).otherwise(v)
        return _bind(loud, lambda a: _bind(moved(a, 1), lambda b: _bind(moved(b, 2), lambda c: _bind(moved(c, 3), least))))

    valence = F.try_element_at(hits, F.get(low, i))
    return F.when(valence.isNotNull() & (valence != 0), _bind(valence, rules))


def compound(text: Column, words: Column, hits: Column) -> Column:
    """The compound score of a text with its ``words`` (as of :func:`words_with_case`) and the valences of its lexicon words."""
    def of(low: Column) -> Column:
        loud = F.size(F.filter(words, _capitals))
        mixed = (loud > 0) & (loud < F.size(words))
        but = F.array_position(low, "but")

        def weighed(w: Column, i: Column) -> Column:
            v = _adjusted(words, low, hits, mixed, i)
            return v * F.when((but == 0) | (i + 1 == but), 1.0).when(i + 1 < but, BEFORE_BUT).otherwise(AFTER_BUT)

        values = F.filter(F.transform(low, weighed), lambda v: v.isNotNull())
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)

    marks, asked = F.regexp_count(text, F.lit("!")), F.regexp_count(text, F.lit(r"\?"))
    more = (F.least(marks, F.lit(MOST_EXCLAMATIONS)) * EXCLAMATION
            + F.when(asked <= 1, 0.0).when(asked <= 3, asked * QUESTION).otherwise(MANY_QUESTIONS))
    total = _bind(F.transform(words, F.lower), of)
    return _bind(total, lambda s: _bind(F.when(s > 0, s + more).when(s < 0, s - more).otherwise(s), lambda t: F.least(
        F.greatest(t / F.sqrt(t * t + SENT_ALPHA), F.lit(-1.0)), F.lit(1.0))))


def sentiment_by_rules(posts: DataFrame, lex: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """post_id and compound in [-1, 1], NULL for an empty text, 0 without a lexicon word.

    ``lex``: word (lower case), valence; of a word that comes twice the larger valence counts. Rows of a repeated or
    missing post_id are scored each by its own text.
    """
    text = post_text(F.col(title), F.col(body))
    rows = posts.select("post_id", text.alias("_text")).withColumn("_words", words_with_case(F.col("_text")))
    known = lex.where(F.col("valence").isNotNull()).groupBy("word").agg(F.max("valence").alias("valence"))
    # all lexicon words of the rows of an id: rows that share one share the map, which changes no score
    found = rows.select("post_id", F.explode(F.array_distinct(F.transform("_words", F.lower))).alias("word"))
    found = (join_checked(found, known, "word").groupBy("post_id")
             .agg(F.map_from_entries(F.collect_set(F.struct("word", "valence"))).alias("_hits")))
    found = found.withColumnRenamed("post_id", "_id")
    hits = F.coalesce("_hits", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    return rows.join(found, F.col("post_id").eqNullSafe(F.col("_id")), "left").select(
        "post_id", F.when(F.col("_text") != "", compound(F.col("_text"), F.col("_words"), hits)).alias("compound"))
