"""Quality rules: a decision list learned from labelled statistics, applied as Spark conditionals.

Every text's statistics are SQL expressions (no Python on executors). Rules for the low-quality
class are learned by sequential covering on a bounded sample of labelled statistics: a conjunction
of thresholds is grown on one part of the sample by information gain, pruned on the other part, kept if
it is precise there, and the rows that it covers are set aside for the next rule. The list becomes
an ordered CASE WHEN over the statistics' columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log2
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_columns, let, quoted

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8  # words
LABELLED = 20_000  # labelled rows that the rules are learned from
CUTS = 24  # thresholds tried per feature, at quantiles of the sample
RULES, CONDITIONS = 12, 4  # longest list, longest conjunction
PRECISION = 0.9  # of a rule on the part that prunes
SUPPORT = 3  # rows that a rule covers there at least
FEATURES = ("n_words", "mean_word_chars", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *FEATURES[1:])


def repeated_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more, first included.

    Windows are compared by 64-bit hashes. Only a text with equal windows sorts them: each window
    with an equal neighbour adds its words, less those that the next such window adds.
    """
    at = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda x, i: (
            x["h"].eqNullSafe(F.get(s, i - 1)["h"]) | x["h"].eqNullSafe(F.get(s, i + 1)["h"]))))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        shares = let(starts, lambda p: F.transform(p, lambda x, i: F.least(
            F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(shares, F.lit(0), lambda a, x: a + x)

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def statistics(text: Column) -> Column:
    """A struct of STATS for a whole text (null: no words)."""
    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        words = F.filter(F.split(t, SPACE + "+", -1), lambda x: x != "")
        return let(words, lambda w: let(lines, lambda x: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            repeated_words(w).cast("bigint").alias("n_repeat_words"),
            F.size(x).alias("n_lines"),
            F.size(F.array_distinct(w)).alias("n_distinct"))))

    return let(F.coalesce(text.cast("string"), F.lit("")), of)


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns STATS; a statistic replaces an input column of its name. A text without
    words has rates of 0 and fails the base rules."""
    keep = kept_columns(df, STATS)
    s = df.select(*[quoted(c) for c in keep], statistics(quoted(text)).alias("__stats"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    n = F.col("__stats.n_words")
    rate = lambda part, whole: F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))
    return s.select(
        *[quoted(c) for c in keep], *[F.col(f"__stats.{c}") for c in base],
        ((n < 20) | (100 * F.col("__stats.n_repeat_words") > 30 * n)).alias("base_failed"),
        rate(F.col("__stats.word_chars"), n).alias("mean_word_chars"),
        rate(F.col("__stats.n_symbols"), n).alias("symbol_rate"),
        rate(F.col("__stats.n_dup_lines"), F.col("__stats.n_lines")).alias("dup_line_rate"),
        rate(F.col("__stats.n_repeat_words"), n).alias("repeat_rate"),
        rate(F.col("__stats.n_distinct"), n).alias("distinct_rate"))


class Condition(NamedTuple):
    feature: str
    above: bool  # value > cut, else value <= cut
    cut: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.cut if self.above else c <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


class Rule(NamedTuple):
    conditions: tuple[Condition, ...]
    precision: float  # on the pruning part

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions)) + f" -> low ({self.precision:.3f})"


def learn(rows: Sequence[tuple], low: Sequence[bool]) -> list[Rule]:
    """Rules for the rows marked ``low``. Sets of rows are integers with a bit per row."""
    total = len(rows)
    masks: dict[Condition, int] = {}
    for f, name in enumerate(FEATURES):
        values = sorted(float(r[f]) for r in rows)
        cuts = sorted({values[i * (total - 1) // CUTS] for i in range(CUTS + 1)}) if total else []
        for cut in cuts:
            above = 0
            for i, r in enumerate(rows):
                if r[f] > cut:
                    above |= 1 << i
            masks[Condition(name, True, cut)] = above
            masks[Condition(name, False, cut)] = ((1 << total) - 1) & ~above
    positive = sum(1 << i for i in range(total) if low[i])
    prune_part = sum(1 << i for i in range(0, total, 3))
    left, out = (1 << total) - 1, []
    while len(out) < RULES and (positive & left & ~prune_part):
        rule = prune(grow(masks, positive, left & ~prune_part), masks, positive, left & prune_part)
        covered = left & intersection(rule, masks)
        n, hit = (covered & prune_part).bit_count(), (covered & prune_part & positive).bit_count()
        if not rule or n < SUPPORT or hit < PRECISION * n:
            break
        out.append(Rule(tuple(rule), hit / n))
        left &= ~covered
    return out


def intersection(conditions: Sequence[Condition], masks: dict[Condition, int]) -> int:
    out = -1
    for c in conditions:
        out &= masks[c]
    return out


def grow(masks: dict[Condition, int], positive: int, part: int) -> list[Condition]:
    """Adds the condition of the highest information gain until no negative is left."""
    rule: list[Condition] = []
    while len(rule) < CONDITIONS:
        p, n = (part & positive).bit_count(), part.bit_count()
        if not p or p == n:
            break
        best, most = None, 0.0
        for c, m in masks.items():
            got = part & m
            k = (got & positive).bit_count()
            if k:
                gain = k * (log2(k / got.bit_count()) - log2(p / n))
                if gain > most + 1e-9:
                    best, most = c, gain
        if best is None:
            break
        rule.append(best)
        part &= masks[best]
    return rule


def prune(rule: list[Condition], masks: dict[Condition, int], positive: int, part: int) -> list[Condition]:
    """Drops conditions from the end while (covered low - covered other) / covered does not fall."""
    def worth(r: list[Condition]) -> float:
        got = part & intersection(r, masks)
        n = got.bit_count()
        return (2 * (got & positive).bit_count() - n) / n if n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def fit(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> list[Rule]:
    """Rules from the statistics of LABELLED labelled rows at most, drawn by a hash of the key.

    A row is low if any of its labels is 0; null labels and keys are left out. Rows that the base rules
    reject teach nothing. No labelled rows or no low ones: no rules, and all other rows are kept.
    """
    marked = (labels.where(quoted(label).isNotNull() & quoted(key).isNotNull())
              .groupBy(quoted(key).alias("__key")).agg(F.min(quoted(label)).alias("__label"))
              .orderBy(F.xxhash64("__key"), "__key").limit(LABELLED))
    # LABELLED rows of two numbers: a bounded broadcast, so texts are not shuffled
    sample = (df.select(quoted(key).alias("__key"), quoted(text).alias("text")).join(F.broadcast(marked), "__key")
              .groupBy("__key", "__label").agg(F.max("text").alias("text")))
    rows = (with_statistics(sample).where(~F.col("base_failed")).orderBy(F.xxhash64("__key"), "__key")
            .select(*FEATURES, "__label").collect())
    return learn([tuple(r)[:-1] for r in rows], [r["__label"] == 0 for r in rows])


def apply(df: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """``df`` with STATS, rule (number of the first rule that holds, from 1; 0 for none) and kept (neither the
    base rules nor a learned rule rejects). Null and empty texts fail the base rules; a result replaces
    an input column of its name. One pass, no shuffle."""
    out = with_statistics(df.drop("rule", "kept"), text)
    verdict = F.lit(0)
    for i, r in reversed(list(enumerate(rules, 1))):
        verdict = F.when(r.column(), i).otherwise(verdict)
    return out.withColumn("rule", verdict).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
