"""Matching-block similarity of two strings as a column expression.

The longest common block is found, then the parts before it and after it are compared in the same way, and so on; the
ratio is twice the letters of all blocks over the letters of both strings. Strings are tokens or short labels: the work
of a pair grows with the square of their lengths.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REGION = "struct<a:string,b:string>"


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def longest_block(a: Column, b: Column) -> Column:
    """Struct (i, j, k): the longest block that both strings have, of those the first in ``a``, then the first in ``b``;
    positions from 1. NULL if they have no letter in common."""
    shorter = F.least(F.length(a), F.length(b))
    # all pieces of a that fit into b, the longest first, then from the left
    pieces = F.flatten(F.transform(
        F.when(shorter > 0, F.sequence(shorter, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")),
        lambda k: F.transform(F.sequence(F.lit(1), F.length(a) - k + 1),
                              lambda i: F.struct(i.alias("i"), F.position(a.substr(i, k), b).alias("j"), k.alias("k")))))
    return F.get(F.filter(pieces, lambda p: p["j"] > 0), 0)


def matched_letters(a: Column, b: Column) -> Column:
    """Letters of all matching blocks of ``a`` and ``b``. A fold with a list of the parts still to compare: every step takes
    one, and there are no more than two for each letter of the shorter string, and one."""
    none = F.array().cast(f"array<{REGION}>")

    def region(x: Column, y: Column) -> Column:
        """A list of the one region, or of none if either part is empty."""
        return F.when((F.length(x) > 0) & (F.length(y) > 0), F.array(F.struct(x.alias("a"), y.alias("b")))).otherwise(none)

    def step(state: Column, _: Column) -> Column:
        def compare(r: Column) -> Column:
            rest = F.slice(state["todo"], 2, F.size(state["todo"]))

            def split(m: Column) -> Column:
                before = region(r["a"].substr(F.lit(1), m["i"] - 1), r["b"].substr(F.lit(1), m["j"] - 1))
                after = region(r["a"].substr(m["i"] + m["k"], F.length(r["a"])), r["b"].substr(m["j"] + m["k"], F.length(r["b"])))
                return F.when(m.isNull(), F.struct(rest.alias("todo"), state["n"].alias("n"))).otherwise(
                    F.struct(F.concat(before, after, rest).alias("todo"), (state["n"] + m["k"]).alias("n")))
            return _bind(longest_block(r["a"], r["b"]), split)

        return F.when(F.size(state["todo"]) == 0, state).otherwise(_bind(F.get(state["todo"], 0), compare))

    start = F.struct(region(a, b).alias("todo"), F.lit(0).alias("n"))
    steps = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)) * 2)
    return F.aggregate(steps, start, step, lambda s: s["n"])


def block_ratio(a: Column, b: Column) -> Column:
    """2 * matched letters / letters of both, 1.0 for two empty strings, NULL if either is NULL. Not symmetric: among
    blocks of equal length the first in ``a`` is taken."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(2.0) * matched_letters(a, b) / total)
