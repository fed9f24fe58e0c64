"""Scalar column functions (all built-in expressions, inside codegen).

Each function takes and returns ``Column`` objects, so callers compose them in
one projection; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import DAY_NAMES, SHOWCASE_SIGNALS


def _lit_regex(s: str) -> str:
    """Quote a literal for Java regex."""
    return "\\Q" + s + "\\E"


# H1 -------------------------------------------------------------------------
def split_title_body(text: Column, sep: str = ": ") -> tuple[Column, Column]:
    """Title = text before the first ``sep``; body = the rest, '' if none.

    NULL text gives a NULL title and '' body.
    """
    parts = F.split(text, _lit_regex(sep), 2)
    return F.get(parts, 0), F.coalesce(F.get(parts, 1), F.lit(""))


# H2 -------------------------------------------------------------------------
def word_count(c: Column) -> Column:
    """Whitespace-separated word count; NULL or empty text counts 0."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\S+")).cast("int")


# H3 -------------------------------------------------------------------------
BRACKET_TAG = r"\[[^\]]+\]"


def post_mechanism(title: Column, has_media: Column) -> Column:
    """question if the title asks, showcase if tagged or with media, else statement."""
    t = F.coalesce(title, F.lit(""))
    return (F.when(t.contains("?"), F.lit("question"))
            .when(t.rlike(BRACKET_TAG) | F.coalesce(has_media, F.lit(False)), F.lit("showcase"))
            .otherwise(F.lit("statement")))


# H4 -------------------------------------------------------------------------
def request_mechanism(text: Column, category: Column) -> Column:
    """question / showcase / statement (only with a category) / NULL for a request."""
    t = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    showcase = None
    for sig in SHOWCASE_SIGNALS:
        c = low.contains(sig)
        showcase = c if showcase is None else (showcase | c)
    return (F.when(t == "", F.lit(None).cast("string"))
            .when(t.contains("?"), F.lit("question"))
            .when(showcase, F.lit("showcase"))
            .when(category.isNotNull(), F.lit("statement")))


# H5 -------------------------------------------------------------------------
LOCATION_RE = r"\b(?:in|near)\s+([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)?)"


def location(text: Column) -> Column:
    """Capitalised place after 'in' / 'near' (up to two words), else NULL."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), LOCATION_RE, 1), F.lit(""))


# H6 -------------------------------------------------------------------------
def normalize_label(c: Column) -> Column:
    """lower, strip quotes/markdown/punctuation, '&' -> 'and', collapse spaces."""
    s = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    s = F.btrim(s, F.lit("`*\"' \t\r\n"))
    s = F.btrim(s, F.lit(".,!?:;"))
    s = F.replace(s, F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


# H8 / H9 --------------------------------------------------------------------
def clean_text(c: Column) -> Column:
    return F.lower(c)


def tokens(c: Column) -> Column:
    """Lower-case word tokens ``[a-z']+`` (emotion tokenizer)."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z']+"), 0)


# B5 / B6 --------------------------------------------------------------------
def flag_deleted(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\[deleted\]|\[removed\]"), F.lit(False))


def has_media(url: Column, body: Column) -> Column:
    """True if the url or the body links an image host; never NULL."""
    def hit(c: Column) -> Column:
        return F.coalesce(c.contains("i.redd.it") | c.contains("imgur"), F.lit(False))
    return hit(url) | hit(body)


# H20-H23 --------------------------------------------------------------------
def hour_of_day(ts: Column) -> Column:
    return F.hour(ts).cast("int")


def day_of_week(ts: Column) -> Column:
    """Sunday = 0 ... Saturday = 6."""
    return (F.dayofweek(ts) - 1).cast("int")


def day_of_week_monday0(ts: Column) -> Column:
    """Monday = 0 ... Sunday = 6 (the median variant)."""
    return F.weekday(ts).cast("int")


def _day_map() -> Column:
    return F.create_map(*[x for i, n in enumerate(DAY_NAMES) for x in (F.lit(i), F.lit(n))])


def day_name(d: Column) -> Column:
    """Day name for Sunday=0; an unknown integer prints itself."""
    return F.coalesce(F.try_element_at(_day_map(), d.cast("int")), d.cast("int").cast("string"))


def parse_timestamp(c: Column) -> Column:
    return F.try_to_timestamp(c.cast("string")).cast("timestamp_ntz")


# H30-H32, H35 ---------------------------------------------------------------
def guarded_log1p(x: Column) -> Column:
    """ln(x + 1), NULL where x <= -1."""
    return F.when(x > -1, F.log1p(x.cast("double")))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0 or NULL."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def min_max(x: Column, mn: Column, mx: Column) -> Column:
    """(x - min) / (max - min); NULL for a constant column."""
    return (x - mn) / F.nullif(mx - mn, F.lit(0.0))


def pct_lift(a: Column, b: Column) -> Column:
    """Percent difference of a over b; NULL if either is missing or b is 0."""
    return F.when(b != 0, (a - b) / F.abs(b) * 100.0)
