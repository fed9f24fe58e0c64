"""Benchmark decontamination with a generalised suffix automaton.

The normalised benchmark items are put into one automaton over words. Document
words are streamed through it; the state keeps the longest run of words, ending
here, that occurs in some item. Where that run is at least a window long, the
window's words are hit and the state names the items that hold it.

Words that no item has, and neighbours that no item has side by side, end every
run, so whole batches are first cut down to the stretches worth streaming.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, quoted, scratch, shared, worker_cache

WINDOW = 13  # words; an item of fewer words is one window
BLOCK_BYTES = 1 << 20  # of item text in one automaton; larger benchmarks take several, one after another
CHUNK_BYTES = 4 << 20  # of document text that is split into words at once
PAIR_BITS = 20

# A word is a run of bytes that are ASCII digits or letters (lower-cased) or not ASCII at all.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # the same words in text of either case
BREAK = b"!"  # stands between documents; never a word


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split()


class Automaton:
    """Generalised suffix automaton of word lists, with the items of each state."""

    def __init__(self, items: Iterable[tuple[str | None, str]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        lists = []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            if ids:
                lists.append((item, ids))
                state = 0
                for c in ids:
                    state = self._extend(state, c)
        self.shortest = min([window, *(len(ids) for _, ids in lists)])
        self.pairs = np.zeros(1 << PAIR_BITS, dtype=bool)
        self.items: list[set] = [set() for _ in self.next]
        self.short: list[list[tuple[int, str | None]]] = [[] for _ in self.next]
        for item, ids in lists:
            a = np.array(ids, dtype=np.int64)
            self.pairs[pair_slot(a[:-1], a[1:])] = True
            state = 0
            for c in ids:
                state = up = self.next[state][c]
                while up > 0 and item not in self.items[up]:
                    self.items[up].add(item)
                    up = self.link[up]
            if len(ids) < window:
                self.short[state].append((len(ids), item))
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short[v] = self.short[v] + self.short[self.link[v]]

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = self._state({}, self.length[last] + 1, 0)
        while last >= 0 and c not in self.next[last]:
            self.next[last][c] = new
            last = self.link[last]
        if last >= 0:
            q = self.next[last][c]
            self.link[new] = q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _state(self, following: dict[int, int], length: int, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def stream(self, ids: Sequence[int], at: int, spans: list[tuple[int, int]], found: set) -> None:
        """Streams words that begin at position ``at`` of their document; adds the hit spans
        (position of the first word, one past the last) and the items."""
        v = matched = 0
        for i, c in enumerate(ids, at + 1):
            while v and c not in self.next[v]:
                v = self.link[v]
                matched = self.length[v]
            if c in self.next[v]:
                v = self.next[v][c]
                matched += 1
            reach = 0
            for n, item in self.short[v]:
                if n <= matched:
                    reach = max(reach, n)
                    found.add(item)
            if matched >= self.window:
                reach = self.window
                u = v
                while self.length[self.link[u]] >= self.window:
                    u = self.link[u]
                found |= self.items[u]
            if reach:
                if spans and i - reach <= spans[-1][1]:
                    s = i - reach
                    while spans and s <= spans[-1][1]:
                        s = min(s, spans.pop()[0])
                    spans.append((s, i))
                else:
                    spans.append((i - reach, i))


def pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * 1_000_003 + b) * 2_654_435_761 >> 7) & ((1 << PAIR_BITS) - 1)


def scan(automaton: Automaton, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set]]:
    """For normalised texts: number of words, hit spans in words, items found."""
    tokens = (b" " + BREAK + b" ").join([b"", *texts, b""]).split()
    ids = np.fromiter(map(automaton.vocabulary.get, tokens, [-1] * len(tokens)), dtype=np.int64, count=len(tokens))
    unknown = np.flatnonzero(ids < 0)
    breaks = np.array([i for i in unknown.tolist() if tokens[i] == BREAK], dtype=np.int64)
    out = [(int(n), [], set()) for n in np.diff(breaks) - 1]
    known = ids >= 0
    joined = known[:-1] & known[1:]
    joined[joined] = automaton.pairs[pair_slot(ids[:-1][joined], ids[1:][joined])]
    # stretches of known words whose neighbours all stand side by side in some item
    start = known & ~np.concatenate(([False], joined))
    end = known & ~np.concatenate((joined, [False]))
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    worth = e - s >= automaton.shortest
    s, e = s[worth], e[worth]
    doc = np.searchsorted(breaks, s) - 1
    for d, a, b in zip(doc.tolist(), s.tolist(), e.tolist()):
        automaton.stream(ids[a:b].tolist(), a - int(breaks[d]) - 1, out[d][1], out[d][2])
    return out


def automaton_of(key: str, items: list[tuple[str | None, str]], window: int) -> Automaton:
    """The automaton, built once per Python worker (the last one stays)."""
    kept = worker_cache("decontam")
    if key not in kept:
        kept.clear()
        kept[key] = Automaton(items, window)
    return kept[key]


def _factory(sent, key: str, window: int):
    def make():
        automaton = automaton_of(key, sent.value, window)

        def function(column: pa.Array) -> list:
            counts, spans, items = [], [], []
            for chunk in chunks(column):
                for n, hit, found in scan(automaton, chunk):
                    counts.append(n)
                    spans.append([x for pair in hit for x in pair])
                    items.append(sorted(x for x in found if x is not None))
            return [counts, spans, items]

        return function

    return make


def chunks(column: pa.Array) -> Iterable[list[bytes]]:
    """Normalised texts (null: empty), some megabytes at a time."""
    part: list[bytes] = []
    size = 0
    for x in column.cast(pa.binary()):
        b = (x.as_py() or b"").translate(NORMAL)
        part.append(b)
        size += len(b)
        if size >= CHUNK_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of about BLOCK_BYTES of text each: written once by block, then read one block at a time."""
    rows = (benchmark.select(quoted(item).cast("string").alias("item"), quoted(text).cast("string").alias("text"))
            .where(F.col("text").isNotNull()).distinct())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    at = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    if n > 1:
        path = scratch(benchmark.sparkSession, "items")
        rows.withColumn("block", at).repartition("block").write.partitionBy("block").parquet(path)
        rows = benchmark.sparkSession.read.parquet(path)
    for b in range(n):
        block = rows.where(F.col("block") == b) if n > 1 else rows
        yield sorted(((r["item"], r["text"]) for r in block.collect()), key=lambda r: (r[0] is not None, r))


def _merged(parts: list[Column]) -> Column:
    """Number of different words under the spans of several automata."""
    def positions(p: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), (F.size(p) / 2).cast("int") - 1),
                            lambda i: F.sequence(F.get(p, 2 * i), F.get(p, 2 * i + 1) - 1))
        return F.when(F.size(p) > 0, F.flatten(pairs)).otherwise(F.array().cast("array<int>"))

    each = [positions(p) for p in parts]
    return F.size(F.array_distinct(F.concat(*each))).cast("bigint")


def hits(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
         window: int = WINDOW, coverage: float = 20.0) -> DataFrame:
    """``df`` with n_words, n_hit (words inside any occurrence of a window), n_items, items (ids as
    strings, sorted), spans (hit spans in words, start and end in turn, one array per automaton) and
    contaminated (n_hit > 0 and ``coverage`` * n_hit >= n_words).

    A null or empty text has no words and is clean; an empty benchmark hits nothing; an item without
    an id hits words but is not named; repeated items count once per id; a result column replaces
    an input column of its name. One pass over the documents per block of items, no shuffle.
    """
    fields = T.StructType([T.StructField("n_words", T.LongType()),
                           T.StructField("__spans", T.ArrayType(T.IntegerType())),
                           T.StructField("__items", T.ArrayType(T.StringType()))])
    results = {"n_words", "n_hit", "n_items", "items", "spans", "contaminated"}
    out = df.select(*[quoted(c) for c in df.columns if c.lower() not in results])
    keep, spans, items = out.columns, [], []
    sc = df.sparkSession.sparkContext
    for b, block in enumerate(blocks(benchmark, item, item_text)):
        sent = shared(df.sparkSession, block)
        out = map_text(out, text, fields, _factory(sent, f"{sc.applicationId}-{sent._jbroadcast.id()}", window))
        spans.append(f"__spans{b}")
        items.append(f"__items{b}")
        out = out.withColumnsRenamed({"__spans": spans[-1], "__items": items[-1]})
    n_hit = _merged([F.col(s) for s in spans]) if len(spans) > 1 else F.coalesce(F.aggregate(
        F.transform(F.col(spans[0]), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)),
        F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint"))
    found = F.array_sort(F.array_distinct(F.concat(*[F.col(i) for i in items])))
    out = out.select(*[quoted(c) for c in keep], "n_words", n_hit.alias("n_hit"), found.alias("items"),
                     F.array(*[F.col(s) for s in spans]).alias("spans"))
    return (out.withColumn("n_items", F.size("items").cast("bigint"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words"))))


def remove_spans(found: DataFrame, text: str = "text", min_words: int = WINDOW) -> DataFrame:
    """The result of :func:`hits` with hit spans of at least ``min_words`` words cut out of the text,
    from the first word's start to the last word's end. Null and clean texts stay as they are."""
    keep = found.columns
    flat = F.transform(F.flatten(F.col("spans")), lambda x: x.cast("string"))
    body = F.concat(F.array_join(flat, ","), F.lit("\n"), F.coalesce(quoted(text), F.lit("")))

    def make():
        def function(column: pa.Array) -> list:
            return [[cut(*x.split("\n", 1), min_words) for x in column.to_pylist()]]
        return function

    out = map_text(found.withColumn("__body", body), "__body",
                   T.StructType([T.StructField("__cut", T.StringType())]), make)
    clean = F.when(F.size(flat) > 0, F.col("__cut")).otherwise(quoted(text))
    return out.withColumn(text, clean).select(*[quoted(c) for c in keep])


def cut(spans: str, text: str, min_words: int) -> str:
    if not spans:
        return text
    at = [int(x) for x in spans.split(",")]
    places = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for s, e in sorted(zip(at[::2], at[1::2])):
        if e - s >= min_words:
            out.append(text[last:max(last, places[s][0])])
            last = max(last, places[e - 1][1])
    return "".join([*out, text[last:]])
