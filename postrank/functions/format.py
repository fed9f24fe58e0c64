"""Text templates as column expressions (H10-H15, R1 reason).

Numbers are formatted the way Python's ``format`` does: ``format_number``
rounds half-even on the exact binary value (as Python does) and ``bround``
does the same for whole numbers, so a percentile of 2.5 prints "2".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import N_HIGH, N_LOW, R2_HIGH, R2_LOW
from .text import day_name


def fmt0(x: Column) -> Column:
    """'{x:.0f}' (half-even, no thousands separator)."""
    return F.bround(x, 0).cast("bigint").cast("string")


def fmt_fixed(x: Column, d: int) -> Column:
    """'{x:.<d>f}': half-even on the exact binary value, without thousands separators."""
    return F.replace(F.format_number(x, d), F.lit(","), F.lit(""))


def fmt_thousands(n: Column) -> Column:
    """'{n:,}' for an integer."""
    return F.format_string("%,d", n.cast("bigint"))


# H10 ------------------------------------------------------------------------
def _day_range(lo: Column, hi: Column) -> Column:
    a = day_name(lo.cast("int"))
    b = day_name(hi.cast("int"))
    return F.when(a == b, a).otherwise(F.concat(a, F.lit(" to "), b))


def range_text(feature: Column, lo: Column, hi: Column) -> Column:
    """Display text of a feature range: words, hours UTC or day names."""
    words = F.concat(fmt0(lo), F.lit("-"), fmt0(hi), F.lit(" words"))
    hours = F.concat(fmt0(lo), F.lit(":00-"), fmt0(hi), F.lit(":00 UTC"))
    return (F.when(feature == "hour_of_day", hours)
            .when(feature == "day_of_week", _day_range(lo, hi))
            .otherwise(words))


# R1 / H14 -------------------------------------------------------------------
def confidence_tier(r2: Column, n: Column) -> Column:
    """high / low / none; NaN R2 counts as missing."""
    r = F.nanvl(r2, F.lit(None).cast("double"))
    return (F.when(r.isNull() | n.isNull(), "none")
            .when((r >= R2_HIGH) & (n >= N_HIGH), "high")
            .when((r >= R2_LOW) & (n >= N_LOW), "low")
            .otherwise("none"))


def confidence_reason(r2: Column, n: Column) -> Column:
    r = F.nanvl(r2, F.lit(None).cast("double"))
    summary = F.concat(F.lit("R² of "), fmt_fixed(r, 2), F.lit(" on "), fmt_thousands(n), F.lit(" posts"))
    return (F.when(r.isNull() | n.isNull(), F.lit("no model metrics available for this segment"))
            .when((r >= R2_HIGH) & (n >= N_HIGH), F.concat(summary, F.lit(" (above baseline)")))
            .when((r >= R2_LOW) & (n >= N_LOW), F.concat(summary, F.lit(" (positive but weak signal)")))
            .when(r < R2_LOW, F.concat(summary, F.lit(" (worse than predicting the average)")))
            .otherwise(F.concat(summary, F.lit(" (sample too small for a reliable estimate)"))))


# H11 ------------------------------------------------------------------------
def guidance(mode: Column, subreddit: Column, best_hour: Column, best_day: Column,
             top_features: Column) -> Column:
    """Per-recommendation guidance; 'technical' uses the analytical template."""
    timing = F.when(best_day.isNotNull() & best_hour.isNotNull(),
                    F.concat(best_day, F.lit(" around "), best_hour.cast("string"), F.lit(":00")))
    feats = F.array_join(F.slice(top_features, 1, 3), ", ")
    expert = F.concat_ws(" ", F.array_compact(F.array(
        F.when(F.size(top_features) > 0,
               F.concat(F.lit("For this segment the model weights "), feats, F.lit(" most heavily."))),
        F.when(timing.isNotNull(), F.concat(F.lit("Post on "), timing, F.lit("."))),
        F.lit("Structure your post with those factors in mind."))))
    experienced = F.concat_ws(" ", F.array_compact(F.array(
        F.concat(F.lit("r/"), subreddit, F.lit(" works well for this topic.")),
        F.when(timing.isNotNull(), F.concat(F.lit("Aim for "), timing, F.lit(" for better visibility."))),
        F.lit("Keep your post specific and genuine rather than promotional."))))
    newbie = F.when(timing.isNotNull(),
                    F.concat(F.lit("r/"), subreddit, F.lit(" is a good fit. Try posting on "), timing, F.lit(".")))\
              .otherwise(F.concat(F.lit("r/"), subreddit, F.lit(" is a good fit.")))
    return (F.when(mode == "technical", expert)
            .when(mode == "experienced", experienced)
            .otherwise(newbie))


# H12 ------------------------------------------------------------------------
def advice(level: Column, category: Column, n_subreddits: Column, avg_score: Column,
           best_day: Column, best_hour: Column, has_facts: Column) -> Column:
    """Segment advice sentence; '' when the segment has no prediction rows."""
    cat = F.coalesce(F.nullif(category, F.lit("")), F.lit("this topic"))
    when_ = F.when(best_day.isNotNull() & best_hour.isNotNull(),
                   F.concat(best_day, F.lit(" around "), best_hour.cast("string"), F.lit(":00 UTC")))
    technical = F.concat_ws(" ", F.array_compact(F.array(
        F.concat(F.lit("Across "), F.coalesce(n_subreddits, F.lit(0)).cast("string"),
                 F.lit(" subreddits in "), cat, F.lit(", this segment averages a predicted virality of "),
                 fmt_fixed(F.coalesce(avg_score, F.lit(0.0)), 1), F.lit(".")),
        F.when(when_.isNotNull(), F.concat(F.lit("The strongest slot in the grid is "), when_, F.lit("."))))))
    other = F.when(when_.isNotNull(),
                   F.concat(F.lit("For "), cat, F.lit(" posts like yours, the data favors posting "), when_, F.lit(".")))\
             .otherwise(F.concat(F.lit("For "), cat, F.lit(" posts like yours, start with the ranked subreddits above.")))
    return (F.when(~F.coalesce(has_facts, F.lit(False)), F.lit(""))
            .when(level == "technical", technical)
            .otherwise(other))


# H13 ------------------------------------------------------------------------
def ranges_sentence(ranges: Column, limit: int = 2) -> Column:
    """'Target a <label> of <text> and a ...' from the first two ranges, '' if none."""
    parts = F.transform(F.slice(ranges, 1, limit),
                        lambda r: F.concat(F.lit("a "), r["label"], F.lit(" of "), r["text"]))
    return F.when(F.size(ranges) > 0,
                  F.concat(F.lit("Target "), F.array_join(parts, " and "), F.lit("."))).otherwise(F.lit(""))


# H15 ------------------------------------------------------------------------
def location_note(loc: Column) -> Column:
    return F.when(loc.isNotNull(), F.concat(
        F.lit("You mentioned "), loc,
        F.lit(". Our data isn't geographic, so this is general guidance, not specific to that area.")))
