"""Byte-level BPE encoding and decoding.

A text is split into words by the published pattern. A word is a string with a character for the id of each byte, and
ranked merges are folded over it: the neighbours of the lowest rank merge, leftmost first, until no neighbours have a rank.

Every distinct word of the whole texts is folded once, by Spark higher-order functions with the merges as a
literal of the plan. Texts go in blocks of a bounded number of distinct words: a block numbers its words, its texts
become numbers, and its words are sent to the fold by a hash. The words' ids come back to their block, where
the ids of its texts are put together. Decoding concatenates the ids' bytes.

The fold copies a word's parts at every merge, so its time grows with the square of a word's length. Words beyond
LONG bytes go through the same merges with a heap, in the pass that numbers the words.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEPT, TEXT, arrow_type, kept_columns, let, map_text, quoted, shared, worker_cache
from .token_count import Splitter

BLOCK = 400_000  # distinct words at which a block of texts ends
BLOCK_WORDS = 4_000_000  # words at which it ends as well
LONG = 1024  # bytes of a word up to which Spark folds it
NO_RANK = 2**31 - 1
SURROGATES = 0xD800, 0x800  # the first code point that no character has, and how many there are
EDGE, ZERO = "\U0010ffff", "\U0010fffe"  # no ids


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Table:
    """A literal hash table: an array of small maps, one per slot of a key's hash."""

    def __init__(self, entries: dict[str, object], kind: str):
        self.kind, self.slots = kind, 1024
        while 2 * self.slots < len(entries):
            self.slots *= 2
        self.maps: list[dict | None] = [None] * self.slots
        for key, value in entries.items():
            slot = xxhash.xxh64_intdigest(key.encode("utf-8"), seed=42) & (self.slots - 1)  # as F.xxhash64
            self.maps[slot] = (self.maps[slot] or {}) | {key: value}

    def literal(self) -> Column:
        """Parsed once, when the plan is optimised."""
        return F.from_json(F.lit(json.dumps(self.maps)), f"array<map<string,{self.kind}>>")

    def find(self, table: Column, key: Column) -> Column:
        """The value of ``key`` in the bound literal, or null."""
        return table[F.xxhash64(key).bitwiseAND(F.lit(self.slots - 1))][key]


class Vocabulary:
    """Ranks by their bytes, the pattern that splits texts, and the merges as a literal table. There an id is a
    character, its code point the id (past the surrogates), so that characters sort as ranks do."""

    def __init__(self, ranks: dict[bytes, int], published: str):
        self.ranks, self.published = ranks, published
        if not all(bytes([i]) in ranks for i in range(256)) or max(ranks.values()) + SURROGATES[1] >= ord(ZERO):
            raise ValueError("every byte needs a rank, and ranks have to stay below the number of code points")
        self.width = 2 if max(ranks.values()) < SURROGATES[0] else 4  # bytes of an id
        self.charset = {2: "UTF-16BE", 4: "UTF-32"}[self.width]
        merges = {chars([ranks[t[:i]], ranks[t[i:]]]): chars([r]) for t, r in ranks.items()
                  for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        # entries that merges don't reach: a word like them is one token nevertheless; three bytes or more, so no pair's key
        self.whole = {chars([ranks[t[i:i + 1]] for i in range(len(t))]): chars([r]) for t, r in ranks.items() if merged(t, ranks) != [r]}
        self.table = Table(merges | self.whole, "string")


def chars(ids: list[int]) -> str:
    first, n = SURROGATES
    return "".join([chr(i if i < first else i + n) for i in ids])


def bound(value: Column, state: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body(state, value)`` with ``value`` evaluated once and, other than by ``let``, no copy of the state."""
    return F.aggregate(F.array(value), state, body)


def fold_chars(word: Column, vocabulary: Vocabulary, table: Column) -> Column:
    """The ids of a word as characters: ranked merges folded over its bytes."""
    def find(key: Column) -> Column:
        return vocabulary.table.find(table, key)

    def merge(state: Column, _: Column) -> Column:
        """The state: parts (one character each, after EDGE), and what each merges to with the next one."""
        def lowest(state: Column, least: Column) -> Column:
            def at(state: Column, p: Column) -> Column:
                def with_merged(state: Column, parts: Column) -> Column:
                    two = F.array(find(parts.substr(p - 1, F.lit(2))), find(parts.substr(p, F.lit(2))))
                    to = F.flatten(F.array(F.slice(state["to"], F.lit(1), p - 2), two, F.slice(state["to"], p + 2, F.lit(LONG + 1))))
                    return F.struct(parts.alias("parts"), to.alias("to"))
                return bound(F.overlay(state["parts"], least, p, F.lit(2)), state, with_merged)
            # one character an element: the place in the string is the place in the array
            place = F.call_function("instr", F.array_join(state["to"], "", EDGE), least)
            return F.when(least.isNull(), state).otherwise(bound(place, state, at))
        return bound(F.array_min(state["to"]), state, lowest)

    def of(parts: Column) -> Column:
        to = F.transform(F.sequence(F.lit(1), F.length(parts)), lambda i: find(parts.substr(i, F.lit(2))))
        steps = F.sequence(F.lit(2), F.length(parts))
        last = F.aggregate(steps, F.struct(parts.alias("parts"), to.alias("to")), merge)["parts"].substr(F.lit(2), F.lit(LONG))
        return F.coalesce(find(parts.substr(F.lit(2), F.lit(LONG))), last) if vocabulary.whole else last

    of_bytes = [vocabulary.ranks[bytes([i])] for i in range(256)]
    to = "".join([chars([i]) if i else ZERO for i in of_bytes])  # translate takes "\0" for a character to leave out
    parts = F.translate(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "".join(map(chr, range(256))), to)
    return let(F.concat(F.lit(EDGE), F.replace(parts, F.lit(ZERO), F.lit("\0"))), of)


def fold(word: Column, vocabulary: Vocabulary, table: Column) -> Column:
    """The ids of a word of up to LONG bytes, as an array."""
    def of(parts: Column) -> Column:
        points = F.transform(F.sequence(F.lit(1), F.length(parts)), lambda i: F.conv(F.hex(F.encode(parts.substr(i, F.lit(1)), "UTF-32")), 16, 10).cast("int"))
        return F.transform(points, lambda x: F.when(x < SURROGATES[0], x).otherwise(x - SURROGATES[1]))
    return let(fold_chars(word, vocabulary, table), of)


class Block:
    """Some texts as the numbers of their words, distinct words numbered as they come."""

    def __init__(self, part: int, n: int):
        self.part, self.n, self.n_words = part, n, 0
        self.numbers: defaultdict[str, int] = defaultdict(count().__next__)
        self.codes: list[bytes] = []
        self.kept: list[pa.Array] = []

    def see(self, words: list[str]) -> None:
        """Adds words whose numbers aren't needed yet: only the order counts."""
        self.n_words += len(words)
        self.numbers.update(dict.fromkeys(words))

    def code(self, words: list[str]) -> np.ndarray:
        self.n_words += len(words)
        return np.fromiter(map(self.numbers.__getitem__, words), "<u4", len(words))

    def clear(self) -> None:
        """Lets go of everything: the next block is made while a loop still holds this one."""
        self.numbers.clear()
        self.codes, self.kept = [], []

    def words(self) -> pa.Array:
        """The distinct words by their numbers."""
        return pa.array(list(self.numbers), pa.string())

    def key(self, words: pa.Array) -> int:
        """Of the place and the words: a second reading that finds other rows gets another key."""
        ends, data = buffers(words)
        hashed = xxhash.xxh64(f"{self.part} {self.n} ".encode())
        hashed.update(ends.data)
        hashed.update(data.data)
        return hashed.intdigest() - 2**63


def buffers(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``words`` begins (and the last one ends), and their bytes, of an array that is no slice."""
    if not len(words):
        return np.zeros(1, np.int32), np.zeros(0, np.uint8)
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int32, len(words) + 1)
    return ends, np.frombuffer(data, np.uint8, ends[-1])


def blocks(batches: Iterator[pa.RecordBatch], split: Callable[[str], list[str]], size: int, packed: bool) -> Iterator[Block]:
    """The texts (last column) in blocks, which end by the texts alone, wherever batches end. With ``packed``, they hold
    their texts' numbers and the first column, copied: a slice would keep its whole batch with the texts."""
    part = TaskContext.get().partitionId()
    block = Block(part, 0)

    def copied(rows: pa.Array, start: int, end: int) -> pa.Array:
        return rows.take(pa.array(np.arange(start, end)))

    for b in batches:
        start = 0
        for i, x in enumerate(b.column(b.num_columns - 1)):
            words = split(x.as_py()) if x.is_valid else []
            if packed:
                block.codes.append(pack(block.code(words)))
            else:
                block.see(words)
            if len(block.numbers) > size or block.n_words > BLOCK_WORDS:
                if packed:
                    block.kept.append(copied(b.column(0), start, i + 1))
                yield block
                block, start = Block(part, block.n + 1), i + 1
        if packed and start < b.num_rows:
            block.kept.append(copied(b.column(0), start, b.num_rows))
    yield block


def pack(codes: np.ndarray) -> bytes:
    """Numbers of words by planes of their bytes, compressed."""
    planes = np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 4).T)
    return len(codes).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:4], "little")
    planes = pa.decompress(packed[4:], decompressed_size=4 * n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of ``values``, one after another."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def folded_words(texts: DataFrame, vocabulary: Vocabulary, size: int = BLOCK) -> DataFrame:
    """block, numbers, sizes, ids: for the words of each block of ``texts`` (only column: the text), their numbers, how many
    ids they have, and these, each in the vocabulary's ``width`` of bytes. Every distinct word up to LONG bytes is folded
    once, where a hash of it leads; a block sends each of its words once."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    published, lists = vocabulary.published, pa.list_(pa.int32())

    def row_batch(block: Block) -> pa.RecordBatch:
        words = block.words()
        key = block.key(words)
        shares = np.fromiter((zlib.crc32(w.encode()) % n for w in block.numbers), np.int32, len(words))
        order = np.argsort(shares, kind="stable").astype(np.int32)
        order = order[np.diff(buffers(words)[0])[order] <= LONG]
        starts, joined = buffers(words.take(pa.array(order)))
        found, first = np.unique(shares[order], return_index=True)
        ends = [*first[1:].tolist(), len(order)]
        spans = list(zip(first.tolist(), ends))
        return pa.RecordBatch.from_arrays(
            [pa.array(found), pa.array([key] * len(found), pa.int64()),
             pa.array([joined[starts[i]:starts[j]].tobytes() for i, j in spans], pa.binary()),
             pa.array([starts[i:j + 1] - starts[i] for i, j in spans], lists), pa.array([order[i:j] for i, j in spans], lists)],
            names=["share", "block", "joined", "starts", "numbers"])

    def run(batches):
        worker_cache("byte_bpe")  # nothing is kept; what another operator has kept goes
        for block in blocks(batches, Splitter(published), size, packed=False):
            out = row_batch(block)
            block.clear()
            yield out

    def pairs(joined: Column) -> Column:  # bound once: a row's binary column is copied whenever it is read
        def pair(i: Column) -> Column:
            start = F.get("starts", i - 1)
            word = joined.substr(start + 1, F.get("starts", i) - start)
            return F.struct(word.cast("string").alias("word"), F.get("numbers", i - 1).alias("number"))
        return F.transform(F.sequence(F.lit(1), F.size("numbers")), pair)

    sent = texts.mapInArrow(run, "share int, block bigint, joined binary, starts array<int>, numbers array<int>")
    words = sent.repartitionById(n, "share").select("share", "block", F.inline(let(F.col("joined"), pairs)))
    once = words.groupBy("share", "word").agg(F.collect_list(F.struct("block", "number")).alias("at"))
    ids = let(vocabulary.table.literal(), lambda t: fold_chars(F.col("word"), vocabulary, t))
    back = once.select("share", ids.alias("ids"), "at").select("share", "ids", F.inline("at"))
    # two lists of the same order (nothing in them is null): a struct for every word would take half as much memory again
    tables = back.groupBy("share", "block").agg(F.collect_list("number").alias("numbers"), F.collect_list("ids").alias("words"))
    return tables.select("block", "numbers", F.transform("words", F.length).alias("sizes"),
                         F.encode(F.array_join("words", ""), vocabulary.charset).alias("ids"))


def encoded(df: DataFrame, vocabulary: Vocabulary, text: str, size: int, fields: T.StructType,
            results: Callable[[dict[bytes, int]], Callable[[list[np.ndarray]], list]], keep: list[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``; by default all) with columns that a function makes from the ids of some texts.

    Texts are read twice: once for their words, once for their words' numbers. The rows of ``df`` have to come in the same
    order both times, as they do from files; where they don't, the query fails. Blocks of texts, as numbers, are
    shuffled to their words' ids; a task holds one block's table at a time."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keep = kept_columns(df, fields.names, keep)
    inner = df.select(F.struct(F.lit(True).alias("__row"), *[quoted(c) for c in keep]).alias(KEPT),
                      quoted(text).cast("string").alias(TEXT))
    kept = T.StructField(KEPT, inner.schema[KEPT].dataType)
    ranks, published, width = shared(spark, vocabulary.ranks), vocabulary.published, vocabulary.width
    table = [T.StructField("numbers", T.ArrayType(T.IntegerType())), T.StructField("sizes", T.ArrayType(T.IntegerType())),
             T.StructField("ids", T.BinaryType())]
    types = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]

    def numbered(batches):
        worker_cache("byte_bpe")
        for block in blocks(batches, Splitter(published), size, packed=True):
            key, at = block.key(block.words()), 0
            for w in block.numbers:
                if len(w) > LONG // 4 and len(x := w.encode()) > LONG:
                    ids = heap_merge(x, ranks.value)
                    row = [block.numbers[w]], [len(ids)], chars(ids).encode({2: "utf-16-be", 4: "utf-32-be"}[width])
                    yield row_batch(pa.nulls(1, block.kept[0].type), key, [None], [pa.array([c], t) for c, t in zip(row, types)])
            for rows in block.kept:
                yield row_batch(rows, key, block.codes[at:at + len(rows)], [pa.nulls(len(rows), t) for t in types])
                at += len(rows)
            block.clear()

    def row_batch(rows, key, codes, columns):
        return pa.RecordBatch.from_arrays([rows, pa.array([key] * len(rows), pa.int64()), pa.array(codes, pa.binary()), *columns],
                                          names=schema.names)

    schema = T.StructType([kept, T.StructField("block", T.LongType()), T.StructField("codes", T.BinaryType()), *table])
    rows = inner.mapInArrow(numbered, schema).unionByName(
        folded_words(inner.select(TEXT), vocabulary, size), allowMissingColumns=True)
    laid = rows.repartition(n, "block").sortWithinPartitions("block", F.col("codes").isNotNull())
    arrow = [arrow_type(f.dataType) for f in fields.fields]

    def run(batches):
        function, words = results(ranks.value), Words(None, width)
        for b in batches:
            ids = []
            for i, (key, codes) in enumerate(zip(b.column(1).to_pylist(), b.column(2))):
                if key != words.key:
                    words = Words(key, width)
                if codes.is_valid:
                    ids.append(words.ids(unpack(codes.as_py())))
                else:
                    words.add(b.column(3)[i].values.to_numpy(), b.column(4)[i].values.to_numpy(), b.column(5)[i].as_py())
            if ids:
                out = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(function(ids), arrow)]
                yield pa.RecordBatch.from_arrays([b.column(0).filter(b.column(2).is_valid()), *out], names=[KEPT, *fields.names])

    out = laid.mapInArrow(run, T.StructType([kept, *fields.fields]))
    return out.select(*[F.col(KEPT).getField(c).alias(c) for c in keep], *[F.col(c) for c in fields.names])


class Words:
    """The ids of a block's words, by their numbers."""

    def __init__(self, key: int | None, width: int):
        self.key, self.width, self.parts, self.table = key, width, [], None

    def add(self, numbers: np.ndarray, sizes: np.ndarray, ids: bytes) -> None:
        self.parts.append((numbers, sizes, np.frombuffer(ids, np.uint8)))

    def ids(self, codes: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(0, "<u4")
        if self.table is None:
            self.table, self.parts = self.joined(), []
        starts, sizes, ids = self.table
        if codes.max() >= len(sizes) or not (of := sizes[codes]).all():
            raise RuntimeError("a block lacks words: its rows came in another order when they were read again")
        return gathered(ids, starts[codes], of)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each number begin, how many there are, and all ids."""
        numbers, sizes, packed = map(np.concatenate, zip((np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint8)), *self.parts))
        ids = packed.view(f">u{self.width}").astype("<u4")
        ids[ids >= sum(SURROGATES)] -= SURROGATES[1] if self.width == 4 else 0
        by_number = np.zeros((2, numbers.max(initial=-1) + 1), np.int64)
        by_number[0, numbers], by_number[1, numbers] = np.cumsum(sizes, dtype=np.int64) - sizes, sizes
        return by_number[0], by_number[1], ids


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", size: int = BLOCK, packed: bool = False) -> DataFrame:
    """``df`` with ids: the token ids of each whole text as an array, or ``packed`` in binary as
    little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Repeated rows each get theirs; a column named ids is replaced. A block
    of texts ends at ``size`` distinct words; see :func:`encoded`.
    """
    def results(_):
        def function(ids: list[np.ndarray]) -> list:
            if packed:
                return [[x.tobytes() for x in ids]]
            starts = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            return [pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(ids).astype(np.int32)))]
        return function

    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    return encoded(df, vocabulary, text, size, T.StructType([T.StructField("ids", kind)]), results)


def round_trip(df: DataFrame, vocabulary: Vocabulary, text: str = "text", size: int = BLOCK, keep: list[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``; by default all) with packed ids as of :func:`encode` and bytes, decoded from them as
    of :func:`decode`. A null or empty text has no ids and no bytes; columns named ids or bytes are replaced."""
    def results(ranks: dict[bytes, int]):
        pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, r in ranks.items():
            pieces[r] = b
        sizes = np.array([len(x) for x in pieces], np.int64)
        starts, values = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(pieces), np.uint8)

        def function(ids: list[np.ndarray]) -> list:
            return [[x.tobytes() for x in ids], [gathered(values, starts[x], sizes[x]).tobytes() for x in ids]]
        return function

    fields = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("bytes", T.BinaryType())])
    return encoded(df, vocabulary, text, size, fields, results, keep)


def list_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranked merges of a word, in the plain form that the others are tested against."""
    return [ranks[word]] if word in ranks else merged(word, ranks)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    rank = ranks.get
    parts = [word[i:i + 1] for i in range(len(word))]
    pairs = [rank(word[i:i + 2], NO_RANK) for i in range(len(word) - 1)]
    while pairs and (least := min(pairs)) != NO_RANK:
        i = pairs.index(least)
        parts[i:i + 2] = [both := parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = rank(both + parts[i + 1], NO_RANK)
        if i:
            pairs[i - 1] = rank(parts[i - 1] + both, NO_RANK)
    return [ranks[p] for p in parts]


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranked merges of a long word: a heap of neighbours by rank and position."""
    n = len(word)
    if word in ranks:
        return [ranks[word]]
    end = list(range(1, n + 1))  # end of the part that starts here; 0 once it is merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)

    def push(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i:end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    while heap:
        _, i, j = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or middle >= j or end[middle] != j:
            continue  # one of the two has changed since
        end[i], end[middle] = j, 0
        if j < n:
            before[j] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``df`` with ``out``: the bytes of packed ids, concatenated. Null ids give null; an id that the
    vocabulary lacks is an error. A column named like ``out`` is replaced."""
    pieces = [b""] * (max(vocabulary.ranks.values(), default=-1) + 1)
    for b, r in vocabulary.ranks.items():
        pieces[r] = b
    table = shared(df.sparkSession, pieces)

    def make():
        piece = table.value.__getitem__

        def function(column: pa.Array) -> list:
            return [[b"".join(map(piece, np.frombuffer(x.as_py(), dtype="<u4").tolist())) if x.is_valid else None
                     for x in column]]
        return function

    return map_text(df, ids, T.StructType([T.StructField(out, T.BinaryType())]), make, kind="binary")
