"""Keyword categories against a keyword table of any size (C7 for a large dimension).

The fixed keyword list is tested in one projection (:func:`postrank.operators.parse.keyword_category_expr`), which costs one
search per keyword and text. Here the keywords come as a table (ordinal, keyword, category). They are dealt by hash into
blocks of a bounded number of keywords; each block becomes an automaton that reads a text once, however many
keywords it holds. Texts stay in their partitions: a block adds one column of hits per category, and the winner is
picked from all of them in SQL functions. A table beyond one block costs one more pass of Python per block.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 200_000  # keywords of one automaton: a broadcast of some tens of megabytes
MAX_LETTERS = 200  # letters of a keyword, which bounds the broadcast in bytes too

HITS = T.ArrayType(T.StructType([T.StructField("c", T.StringType()), T.StructField("h", T.LongType()),
                                 T.StructField("f", T.LongType())]))
ARROW_HITS = pa.list_(pa.struct([("c", pa.string()), ("h", pa.int64()), ("f", pa.int64())]))


def _automaton(rows: list[tuple[str, int, str]]) -> ahocorasick.Automaton:
    """Keyword to its rows (number in ``rows``, ordinal, category)."""
    found: dict[str, list[tuple[int, int, str]]] = {}
    for i, (keyword, ordinal, category) in enumerate(rows):
        found.setdefault(keyword, []).append((i, ordinal, category))
    out = ahocorasick.Automaton()
    for keyword, of in found.items():
        out.add_word(keyword, of)
    if found:
        out.make_automaton()
    return out


def _hits(automaton: ahocorasick.Automaton, text: str) -> list[tuple[str, int, int]]:
    """Category, number of keyword rows that the text contains, and the least of their ordinals."""
    seen, per = set(), {}
    for _, of in automaton.iter(text) if len(automaton) else ():
        if of[0][0] in seen:
            continue
        for i, ordinal, category in of:
            seen.add(i)
            h, f = per.get(category, (0, ordinal))
            per[category] = (h + 1, min(f, ordinal))
    return [(c, h, f) for c, (h, f) in per.items()]


def _with_hits(df: DataFrame, text: str, out: str, rows: list[tuple[str, int, str]]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(rows)
    at = df.columns.index(text)

    def run(batches):
        automaton = _automaton(shared.value)
        for b in batches:
            hits = [[dict(zip("chf", h)) for h in _hits(automaton, t)] if t else [] for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, ARROW_HITS)], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, HITS)]))


def _winner(hits: Column) -> Column:
    """Most hits, ties to the category of the least ordinal, then to the larger name; NULL without hits."""
    def total(c: Column) -> Column:
        mine = F.filter(hits, lambda x: x["c"] == c)
        return F.struct(F.aggregate(mine, F.lit(0).cast("bigint"), lambda s, x: s + x["h"]).alias("h"),
                        (-F.array_min(F.transform(mine, lambda x: x["f"]))).alias("f"), c.alias("c"))

    return F.array_max(F.transform(F.array_distinct(F.transform(hits, lambda x: x["c"])), total))["c"]


def category_by_keywords(df: DataFrame, keywords: DataFrame, text: str = "text", out: str = "category",
                         block: int = BLOCK) -> DataFrame:
    """C7 with a keyword table: ``df`` and the category with the most keywords that the lower-cased text contains.

    ``keywords``: ordinal, keyword (lower case), category. Every row counts once per text, also one of a keyword that
    another row has too. Rows with a missing or empty keyword, ordinal or category count for nothing; one of more than
    MAX_LETTERS letters is an error. A missing or empty text and an empty table give NULL. A column named like the result is replaced.
    """
    known = (keywords.select("keyword", F.col("ordinal").cast("bigint").alias("ordinal"), "category")
             .where((F.col("keyword") != "") & F.col("ordinal").isNotNull() & F.col("category").isNotNull()))
    size = known.agg(F.count("*").alias("n"), F.max(F.length("keyword")).alias("longest")).first()
    if (size["longest"] or 0) > MAX_LETTERS:
        raise ValueError(f"a keyword has more than {MAX_LETTERS} letters")
    kept = [c for c in df.columns if c != out]
    lower = F.lower(F.col(text)).alias("__low")
    rows = df.select(lower, *kept)
    # beyond one block a hash deals blocks of about half the bound, so uneven ones stay below it
    blocks = 1 if size["n"] <= block else -(-2 * size["n"] // block)
    names = [f"__hits{b}" for b in range(blocks)]
    for b, name in enumerate(names):
        mine = known if blocks == 1 else known.where(F.pmod(F.xxhash64("keyword", "ordinal", "category"), F.lit(blocks)) == b)
        rows = _with_hits(rows, "__low", name, [tuple(r) for r in mine.toLocalIterator()])
    return rows.select(*kept, _winner(F.flatten(F.array(*names))).alias(out))
