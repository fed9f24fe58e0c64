"""Join helpers with an explicit broadcast size check.

A side is broadcast only when its size is proven: either it is a fixed
dimension from :mod:`postrank.dims` (size set in code), or it is counted here
and found under ``max_rows``. Beyond the bound the join falls back to a
shuffle join, where AQE's skew-join handling splits hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 1_000_000


def fits_broadcast(small: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> tuple[DataFrame, bool]:
    """Cache ``small`` and decide once whether it may be broadcast."""
    small = small.cache()
    return small, small.count() <= max_rows


def join_sized(big: DataFrame, small: DataFrame, small_ok: bool, on, how: str = "inner") -> DataFrame:
    """Join with a broadcast decision already made by :func:`fits_broadcast`."""
    return big.join(F.broadcast(small) if small_ok else small, on, how)


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "inner",
                 max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Join ``big`` to ``small``, broadcasting ``small`` only if it is small.

    ``small`` is cached and counted once (it is an aggregate or a serving
    table, so this touches only its own rows).
    """
    small = small.cache()
    n = small.count()
    if n <= max_rows:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL (segments with a missing key stay segments).

    ``how`` is 'left' or 'inner'; the key columns come from ``left``. No broadcast hint: Spark
    decides from sizes at run time.
    """
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_right_{k}" for k in keys])


SEGMENT_ROWS = 100_000  # rows of a table per segment that may be broadcast: some tens of megabytes at most


def join_segments(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner", max_rows: int = SEGMENT_ROWS) -> DataFrame:
    """:func:`join_keys` of many ``rows`` with a table of one row per segment, where it is always the table that is sent.

    Sizes known before a run take rows that are spread over their segments for the smaller side, and an inner join would
    then broadcast those. ``table`` is counted; beyond ``max_rows`` both sides are sorted and merged.
    """
    table, ok = fits_broadcast(table, max_rows)
    return join_keys(rows, F.broadcast(table) if ok else table.hint("merge"), keys, how)


def join_dim(big: DataFrame, dim: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join to a fixed-size dimension table (size set in code): broadcast."""
    return big.join(F.broadcast(dim), on, how)
