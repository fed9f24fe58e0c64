"""N-gram Jaccard self-join by a prefix tree.

A document's set holds its distinct word shingles as 64-bit tokens. Tokens have one global order:
by frequency class (from the shingles that tasks meet often), then by hash, so that rare ones come
first. Two sets of Jaccard similarity t share a token among their first n - ceil(t n) + 1; sets
that share such a token are joined in a trie of their ordered tokens. A set walks the trie with one
overlap count for all sets below a node and leaves a subtree when the overlap so far and what remains of
both cannot reach the threshold, or when everything below is already in its own component.

Equal sets are one node from the start. Sets stay in a group only if its lengths and the place of the token leave them a
possible partner; the others are not shipped there. Large groups are cut into blocks of bounded size, linked
block by block, then through one set per component; what is still unconnected is compared block against
block. Links are a spanning forest: every pair of similar sets ends in one component, and no list of pairs
is made. Components come from contracting the links in Spark. The number of all links of each document
is counted apart, in the same groups: a pair counts in that of the first token that both sets have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, most, quoted, shared, small, written

SHINGLE = 5  # words
NUM, DEN = 4, 5  # similarity of at least NUM / DEN
BLOCK = 1 << 19  # tokens of one block; a unit of work joins two at most
SEEN = 1 << 22  # shingles that a task counts at once to find frequent ones
OFTEN = 3  # times that a shingle must be met there
FREQUENT = 200_000  # shingles of a frequency class above 0, the most frequent: a bounded broadcast
HASH_BITS = 58  # of a token; the class stands above
CHUNK = 1 << 20  # bytes of texts that are hashed together


SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
                    dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C55


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_BASE, -k, 1 << 64))])


_POWERS = _Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a text and where they start: differences of one running sum over the
    bytes, so that no word is touched one by one."""
    a = np.frombuffer(body, dtype=np.uint8)
    edge = np.ones(len(a) + 2, dtype=bool)
    edge[1:-1] = SPACES[a]
    at = np.flatnonzero(edge[1:] != edge[:-1])
    starts, ends = at[::2], at[1::2]
    _POWERS.to(len(a) + 1)
    total = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(a * _POWERS.up[:len(a)], out=total[1:])
    h = (total[ends] - total[starts]) * _POWERS.down[starts]
    return mixed(h ^ (ends - starts).astype(np.uint64) * _FACTORS[0]), starts


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes (HASH_BITS bits) of its shingles; fewer words are one
    shingle. Texts are hashed together, some at a time."""
    factors = np.array([int(_FACTORS[k % 5]) * (2 * (k // 5) + 1) % (1 << 64) for k in range(size)], dtype=np.uint64)
    at = 0
    while at < len(texts):
        bodies, total = [], 0
        while at < len(texts) and (not bodies or total + len(texts[at] or "") < CHUNK):
            bodies.append((texts[at] or "").encode("utf-8", "surrogatepass").lower())
            total += len(bodies[-1]) + 1
            at += 1
        w, starts = word_hashes(b" ".join(bodies))
        first = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in bodies)]))
        windows = max(0, len(w) - size + 1)
        h = np.zeros(windows, dtype=np.uint64)
        for k in range(size):
            h += w[k:k + windows] * factors[k]
        h = mixed(h) >> np.uint64(64 - HASH_BITS)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= size:
                yield np.unique(h[a:b - size + 1])
            elif b > a:
                few = (w[a:b] * factors[:b - a]).sum(keepdims=True) + np.uint64(b - a)
                yield mixed(few) >> np.uint64(64 - HASH_BITS)
            else:
                yield np.zeros(0, dtype=np.uint64)


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def similar(overlap: int, a: int, b: int) -> bool:
    """overlap / (a + b - overlap) >= NUM / DEN."""
    return (NUM + DEN) * overlap >= NUM * (a + b)


def ordered(s: np.ndarray, frequent: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Tokens of a set in the global order."""
    if not len(frequent):
        return s
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    c = np.where(frequent[at] == s, classes[at], 0).astype(np.uint64)
    return np.sort(s | c << np.uint64(HASH_BITS))


# --- passes over the documents -----------------------------------------------------------------------

def _members(docs: DataFrame, size: int) -> DataFrame:
    """One row per document (sid null for an empty set), and rows of shingles that a task met often."""
    schema = docs.select("doc_id", F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("sid"),
                         F.lit(0).cast("bigint").alias("shingle"), F.lit(0).cast("bigint").alias("seen")).schema
    for f in schema.fields:
        f.nullable = True

    def run(batches):
        held, total = [], 0
        for b in batches:
            n, ids = [], []
            for s in shingle_sets(b.column(1).to_pylist(), size):
                n.append(len(s))
                ids.append(set_id(s) if len(s) else None)
                held.append(s)
                total += len(s)
                if total >= SEEN:
                    yield often(held, b)
                    held, total = [], 0
            empty = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(ids, pa.int64()), empty, empty],
                                             names=schema.names)
        if held:
            yield often(held, b)

    def often(held, b):
        values, times = np.unique(np.concatenate(held), return_counts=True)
        some = times >= OFTEN
        k = int(some.sum())
        return pa.RecordBatch.from_arrays(
            [pa.nulls(k, b.column(0).type), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()),
             pa.array(values[some].astype(np.int64)), pa.array(times[some].astype(np.int64))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _tokens(docs: DataFrame, size: int, order, whole: bool) -> DataFrame:
    """sid, n and ordered tokens (all or the prefix) of the documents' sets. Equal sets come once."""
    def run(batches):
        frequent, classes = order.value
        for b in batches:
            ids, n, out = [], [], []
            for s in shingle_sets(b.column(0).to_pylist(), size):
                if len(s):
                    t = ordered(s, frequent, classes)
                    ids.append(set_id(s))
                    n.append(len(s))
                    out.append((t if whole else t[:prefix_length(len(t))]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(out, pa.binary())],
                                             names=["sid", "n", "tokens"])

    rows = docs.select("text").mapInArrow(run, "sid bigint, n int, tokens binary")
    return rows.groupBy("sid").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))


def _explode_prefixes(sets: DataFrame) -> DataFrame:
    """token, sid, n and room: if the token is the first that two sets have, they overlap in what is left of either at
    most, so the other one must not have more than ``room`` tokens."""
    def run(batches):
        for b in batches:
            lists = [np.frombuffer(x.as_py(), dtype=np.int64) for x in b.column(2)]
            times = [len(x) for x in lists]
            n = np.repeat(b.column(1).to_numpy(zero_copy_only=False).astype(np.int64), times)
            at = np.arange(len(n)) - np.repeat(np.cumsum([0, *times])[:-1], times)
            room = ((NUM + DEN) * (n - at) - NUM * n) // NUM
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64), pa.int64()),
                 pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), times), pa.int64()),
                 pa.array(n, pa.int32()), pa.array(room, pa.int32())],
                names=["token", "sid", "n", "room"])

    return sets.select("sid", "n", "tokens").mapInArrow(run, "token bigint, sid bigint, n int, room int")


def least_rooms(n: np.ndarray, room: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For the distinct lengths ``n`` (ascending) of a group, the largest room of each and how many sets have it: the least
    room with which a set of that length has a partner, one of another length that has room for it in turn, or one
    of its own length (its room is not looked at)."""
    widest = np.maximum.accumulate(room)
    first = np.searchsorted(widest, n)
    for i in np.flatnonzero(first == np.arange(len(n))):  # the first with room enough is the length itself
        after = np.flatnonzero(room[i + 1:] >= n[i])
        first[i] = i + 1 + after[0] if len(after) else len(n)
    other = np.r_[n, np.iinfo(np.int32).max][first]
    return np.where(times > 1, np.minimum(other, n), other)


def _with_partners(groups: DataFrame) -> DataFrame:
    """The rows of ``groups`` (token, sid, n, room and others) that may have a partner in their group by the lengths and what
    is left behind the token. Only one row per token and length is looked at together."""
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lengths = groups.groupBy("token", "n").agg(F.max("room").alias("room"), F.count("*").alias("times"))
    laid = lengths.select("token", "n", "room", "times").repartition(tasks, "token").sortWithinPartitions("token", "n")

    def run(batches):
        held = None
        for b in batches:
            rows = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            last = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0  # of the last token there may be more
            if last:
                yield found([x[:last] for x in held])
                held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            yield found(held)

    def found(rows):
        token, n, room, times = rows
        bounds = np.r_[np.flatnonzero(np.r_[True, token[1:] != token[:-1]]), len(token)]
        least = [least_rooms(n[a:b], room[a:b], times[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(n), pa.array(np.concatenate(least).astype(np.int32))],
                                          names=["token", "n", "least"])

    return groups.join(laid.mapInArrow(run, "token bigint, n int, least int"), ["token", "n"]).where(F.col("room") >= F.col("least"))


# --- the trie ----------------------------------------------------------------------------------------

class Forest:
    """Union-find over a unit's sets; sets of one component start out joined."""

    def __init__(self, components: list[int]):
        first: dict[int, int] = {}
        self.up = [first.setdefault(c, i) for i, c in enumerate(components)]

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


class Node:
    """An edge of tokens and what hangs below it."""

    __slots__ = ("edge", "children", "ends", "low", "high", "one")

    def __init__(self, edge: np.ndarray, low: int, high: int, one: int | None):
        self.edge, self.children, self.ends = edge, {}, []
        self.low, self.high, self.one = low, high, one  # lengths of the sets below; a set if all are in its component


class Trie:
    """Path-compressed trie of ordered token sequences (whole sets, or prefixes of sets of known length)."""

    def __init__(self, sequences: list[np.ndarray], lengths: list[int], forest: Forest, size: int):
        self.sequences, self.lengths, self.forest = sequences, lengths, forest
        self.root = Node(np.zeros(0, np.int32), 1 << 60, 0, None)
        self.mark = np.zeros(size, dtype=bool)

    def insert(self, i: int) -> None:
        s, n, node, at = self.sequences[i], self.lengths[i], self.root, 0
        self._cover(node, i, n)
        while at < len(s):
            child = node.children.get(first := int(s[at]))
            if child is None:
                child = node.children[first] = Node(s[at:], n, n, i)
                child.ends.append(i)
                return
            k = min(len(child.edge), len(s) - at)
            differ = child.edge[:k] != s[at:at + k]
            same = int(differ.argmax()) if differ.any() else k
            if same < len(child.edge):
                upper = Node(child.edge[:same], child.low, child.high, child.one)
                child.edge = child.edge[same:]
                upper.children[int(child.edge[0])] = child
                node.children[first] = child = upper
            self._cover(child, i, n)
            node, at = child, at + same
        node.ends.append(i)

    def _cover(self, node: Node, i: int, n: int) -> None:
        fresh = not node.children and not node.ends
        node.low, node.high = min(node.low, n), max(node.high, n)
        if fresh:
            node.one = i
        elif node.one is not None and self.forest.find(node.one) != self.forest.find(i):
            node.one = None

    def _apart(self, node: Node, i: int) -> bool:
        """Whether something below the node may be in another component than set ``i``."""
        find = self.forest.find
        if node.one is None and not node.ends:
            roots = {find(c.one) if c.one is not None else None for c in node.children.values()}
            if len(roots) == 1 and None not in roots:
                node.one = next(iter(node.children.values())).one
        return node.one is None or find(node.one) != find(i)

    @staticmethod
    def _reachable(overlap: int, rest: int, depth: int, n: int, low: int, high: int) -> bool:
        """Whether some set of low to high tokens, ``depth`` of them behind us, can still be similar."""
        t = min(max(depth + rest, low), high)
        return similar(overlap + min(rest, t - depth), n, t)

    def walk(self, i: int, whole: bool, found: Callable[[int], None]) -> None:
        """Calls ``found`` for each set of another component that is similar to set ``i`` (``whole``), or that
        the bounds do not rule out (prefixes)."""
        s, n, mark = self.sequences[i], self.lengths[i], self.mark
        mark[s] = True
        last = int(s[-1])
        stack = [(self.root, 0, 0)]
        while stack:
            node, depth, overlap = stack.pop()
            for j in node.ends:
                t = self.lengths[j]
                if self.forest.find(i) != self.forest.find(j):
                    rest = 0 if whole else min(t - depth, n - int(np.searchsorted(s, self.sequences[j][-1], "right")))
                    if similar(overlap + rest, n, t):
                        found(j)
            for child in node.children.values():
                if DEN * child.high < NUM * n or NUM * child.low > DEN * n or not self._apart(child, i):
                    continue
                edge = child.edge
                if not whole and int(edge[-1]) > last:
                    # the sets below go on where this prefix ends: nothing more is known of this set
                    cut = int(np.searchsorted(edge, last, "right"))
                    if self._reachable(overlap + int(mark[edge[:cut]].sum()), n - len(s), depth + cut, n, child.low, child.high):
                        for j in self._below(child):
                            if self.forest.find(i) != self.forest.find(j):
                                found(j)
                    continue
                o, d = overlap + int(mark[edge].sum()), depth + len(edge)
                rest = n - int(np.searchsorted(s, edge[-1], "right"))
                if self._reachable(o, rest, d, n, child.low, child.high):
                    stack.append((child, d, o))
        mark[s] = False

    def _below(self, node: Node) -> Iterator[int]:
        stack = [node]
        while stack:
            x = stack.pop()
            yield from x.ends
            stack += x.children.values()


def join_unit(ids: list[int], lengths: list[int], components: list[int], tokens: list[bytes], whole: bool) -> Iterator[tuple[int, int]]:
    """Links (whole sets) or sets with a possible partner, as (id, id), of one unit."""
    lists = [np.frombuffer(t, dtype=np.int64) for t in tokens]
    values, local = np.unique(np.concatenate(lists), return_inverse=True)
    sequences = np.split(local.astype(np.int32), np.cumsum([len(x) for x in lists])[:-1])
    forest = Forest(components)
    trie = Trie(sequences, lengths, forest, len(values))
    kept: set[int] = set()
    single = len(set(components)) == len(components)
    for i in sorted(range(len(ids)), key=lambda i: (lengths[i], ids[i])):
        if whole:
            links: list[int] = []

            def link(j: int, i: int = i, links: list[int] = links) -> None:
                if forest.join(i, j):
                    links.append(j)

            trie.walk(i, True, link)
            yield from ((ids[i], ids[j]) for j in links)
        else:
            def possible(j: int, i: int = i) -> None:
                kept.update((i, j))
                if single:  # all that hangs together is kept already and needs no second look
                    forest.join(i, j)

            trie.walk(i, False, possible)
        trie.insert(i)
    yield from ((ids[i], ids[i]) for i in sorted(kept))


def count_unit(token: int, ids: list[int], lengths: list[int], blocks: list[int], weights: list[int], tokens: list[bytes],
               across: bool) -> Iterator[tuple[int, int]]:
    """(id, weight of the similar sets) of one unit's whole sets, zeros left out. A pair counts where ``token`` is the
    first that both have, and in a unit of two blocks (``across``) only between them, so once in all units."""
    lists = [np.frombuffer(t, dtype=np.int64) for t in tokens]
    values, local, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    n, block, weight = np.array(lengths), np.array(blocks), np.array(weights)
    owner = np.repeat(np.arange(len(lists)), n)
    order = np.argsort(local, kind="stable")
    having = np.split(owner[order], np.cumsum(times)[:-1])
    first = int(np.searchsorted(values, token))
    for i, own in enumerate(np.split(local, np.cumsum(n)[:-1])):
        own = own[times[own] > 1]
        earlier = own[own < first]
        overlap = np.bincount(np.concatenate([having[k] for k in own[len(earlier):]]), minlength=len(lists))
        found = (NUM + DEN) * overlap >= NUM * (n + n[i])
        found[i] = False
        if across:
            found &= block != block[i]
        for k in earlier:
            found[having[k]] = False
        if found.any():
            yield ids[i], int(weight[found].sum())


def _join_units(units: DataFrame, sets: DataFrame, whole: bool) -> DataFrame:
    """``units``: token, b1, b2, sid, comp. Rows (token, a, b) as :func:`join_unit` finds them."""
    def work(key, ids, lengths, components, tokens):
        return join_unit(ids, lengths, components, tokens, whole)

    return _each_unit(units, sets, ["sid", "n", "comp", "tokens"], work)


def _count_units(units: DataFrame, sets: DataFrame) -> DataFrame:
    """``units``: token, b1, b2, sid, block; ``sets`` with their weight. Rows (token, a, b): b is the weight that
    :func:`count_unit` finds for set a."""
    def work(key, ids, lengths, blocks, weights, tokens):
        return count_unit(key[0], ids, lengths, blocks, weights, tokens, key[1] != key[2])

    return _each_unit(units, sets, ["sid", "n", "block", "weight", "tokens"], work)


def _each_unit(units: DataFrame, sets: DataFrame, columns: list[str], work: Callable[..., Iterator[tuple[int, int]]]) -> DataFrame:
    """Rows (token, a, b): what ``work`` finds from the key (token, b1, b2) and the columns of each unit's sets."""
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = small(written(units, "units"))
    rows = (sets.join(units, "sid").select("token", "b1", "b2", *columns)
            .repartition(n, "token", "b1", "b2").sortWithinPartitions("token", "b1", "b2"))

    def run(batches):
        key, held = None, []
        for b in batches:
            out = []
            columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for t, b1, b2, *row in zip(*columns):
                if (t, b1, b2) != key:
                    out += joined(key, held)
                    key, held = (t, b1, b2), []
                held.append(row)
            if out:
                yield batch(out)
        if out := joined(key, held):
            yield batch(out)

    def joined(key, held):
        if len(held) < 2:
            return []
        return [(key[0], a, b) for a, b in work(key, *map(list, zip(*held)))]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["token", "a", "b"])

    return rows.mapInArrow(run, "token bigint, a bigint, b bigint")


def _units(rows: DataFrame, diagonal: bool) -> DataFrame:
    """``rows`` (token, sid, w, comp) dealt into units (token, b1, b2) of two blocks at most, each of about BLOCK
    tokens. A component that fills half a block has blocks of its own, which are never joined with one
    another; smaller ones share blocks. ``diagonal``: only blocks with themselves."""
    sizes = rows.groupBy("token", "comp").agg(F.sum("w").alias("wc"))
    totals = sizes.groupBy("token").agg(F.sum("wc").alias("wt"), F.count("*").alias("parts")).where(F.col("parts") > 1)
    fitting = totals.where(F.col("wt") <= BLOCK).select("token")
    one = rows.join(fitting, "token").select("token", F.lit(0).cast("bigint").alias("b1"), F.lit(0).cast("bigint").alias("b2"), "sid", "comp")
    large = totals.where(F.col("wt") > BLOCK).select("token", "wt")
    dealt = (rows.join(large, "token").join(sizes, ["token", "comp"])
             .withColumn("pure", (F.col("wc") > BLOCK // 2) & F.lit(not diagonal))
             .withColumn("block", F.when(F.col("pure"), F.xxhash64("comp", F.pmod(F.xxhash64("sid"), F.ceil(F.col("wc") / BLOCK))))
                         .otherwise(F.pmod(F.xxhash64("comp" if not diagonal else "sid"), F.ceil(F.col("wt") / BLOCK)))))
    if diagonal:
        return one.unionByName(dealt.select("token", F.col("block").alias("b1"), F.col("block").alias("b2"), "sid", "comp"))
    blocks = dealt.groupBy("token", "block").agg(F.max(F.when(F.col("pure"), F.col("comp"))).alias("own"))
    other = blocks.select("token", F.col("block").alias("other"), F.col("own").alias("other_own"))
    pairs = (blocks.join(other, "token").where(~F.coalesce(F.col("own") == F.col("other_own"), F.lit(False)))
             .select("token", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2")))
    return one.unionByName(dealt.join(pairs, ["token", "block"]).select("token", "b1", "b2", "sid", "comp"))


def _pair_units(rows: DataFrame) -> DataFrame:
    """``rows`` (token, sid, w) dealt into units (token, b1, b2) of one block or two, each of about BLOCK tokens, so that
    every two sets of a group meet."""
    parts = rows.groupBy("token").agg(F.ceil(F.sum("w") / BLOCK).alias("parts"), F.count("*").alias("m")).where(F.col("m") > 1)
    dealt = rows.join(parts, "token").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("parts")))
    return (dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
            .select("token", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "sid", "block"))


# --- components --------------------------------------------------------------------------------------

def connected(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component) for the nodes of ``edges`` (a, b).

    Every node hooks on to its smallest neighbour; pointers are doubled until they are flat, edges are
    taken over to the roots, and what is left is contracted again: a logarithmic number of rounds.
    """
    edges = written(edges.where(F.col("a") != F.col("b")).distinct(), "edges")
    out = None
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "next")
        up = written(both.groupBy("node").agg(F.min("next").alias("m"))
                     .select("node", F.least("node", "m").alias("up")), "up")
        while True:
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            higher = written(up.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "up")
            up = higher.select("node", "up")
            if not higher.where("moved").limit(1).count():
                break
        out = up if out is None else out.join(
            up.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left").select(
            "node", F.coalesce("top", "up").alias("up"))
        a, b = (up.select(F.col("node").alias(c), F.col("up").alias(f"r{c}")) for c in "ab")
        left = (edges.join(a, "a").join(b, "b").where(F.col("ra") != F.col("rb"))
                .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        edges = written(left, "edges")
        if not edges.limit(1).count():
            return written(out.select("node", F.col("up").alias("comp")), "comp")


def _with_components(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return rows.withColumn("comp", F.col("sid"))
    return (rows.join(comp.withColumnRenamed("node", "sid"), "sid", "left")
            .withColumn("comp", F.coalesce("comp", "sid")))


def _grouped(docs: DataFrame, members: DataFrame, size: int) -> tuple:
    """The order of tokens, the sets' prefixes, and the groups (token, sid, m, w) of sets that share a prefix token. Every
    two sets that share some are together in the group of the first that they share."""
    often = (members.where(F.col("seen").isNotNull()).groupBy("shingle").agg(F.sum("seen").alias("seen"))
             .where(F.col("seen") >= 4 * OFTEN))
    often = most(often, F.col("seen"), FREQUENT).toArrow()
    frequent, seen = (often.column(c).to_numpy() for c in ("shingle", "seen"))
    at = np.argsort(frequent, kind="stable")
    classes = np.minimum(31, np.frexp(seen[at].astype(np.float64))[1])  # the number of bits
    order = shared(docs.sparkSession, (frequent[at].astype(np.uint64), classes.astype(np.uint64)))

    prefixes = written(_tokens(docs, size, order, whole=False), "prefixes")
    # one shuffle of all postings, whose counts stay beside them
    postings = _explode_prefixes(prefixes).withColumn("m", F.count("*").over(Window.partitionBy("token")))
    postings = written(postings.where(F.col("m") > 1), "postings")
    # tokens with the same members need joining once: they agree in number, sum and extremes of the ids
    alike = (postings.groupBy("token", "m").agg(F.sum(F.shiftright(F.xxhash64("sid"), 20)).alias("s"), F.min("sid").alias("low"),
                                                F.max("sid").alias("high"))
             .groupBy("m", "s", "low", "high").agg(F.min("token").alias("token")).select("token"))
    postings = written(postings.join(small(written(alike, "alike")), "token"), "postings")
    # if the token before is the same for all members of a group, that one's group holds every pair of this
    # one, which is left out
    before = postings.withColumn("prev", F.lag("token").over(Window.partitionBy("sid").orderBy("token")))
    needed = (before.groupBy("token", "m").agg(F.count("prev").alias("k"), F.min("prev").alias("low"), F.max("prev").alias("high"))
              .where((F.col("k") < F.col("m")) | (F.col("low") < F.col("high"))).select("token"))
    groups = _with_partners(postings.join(small(written(needed, "needed")), "token"))
    groups = written(groups.select("token", "sid", "m", F.col("n").alias("w")), "groups")
    return order, prefixes, groups


def link_classes(docs: DataFrame, members: DataFrame, size: int) -> DataFrame | None:
    """node, comp of the classes of equal sets that are linked with another; None if there are none."""
    order, prefixes, groups = _grouped(docs, members, size)

    # 1. every set in the largest of its groups, block by block; in groups of several blocks then one set
    # per component, until nothing more is linked. This connects large groups of copies.
    rows = written(groups.groupBy("sid").agg(F.max(F.struct("m", "token")).alias("best"), F.first("w").alias("w"))
                   .select("sid", "w", F.col("best.token").alias("token")), "own")
    links, comp = [], None
    while rows.limit(1).count():
        found = _linked(_with_components(rows, comp), True, docs, members, prefixes, size, order)
        if found is None:
            break
        links.append(found)
        comp = connected(_union(links))
        several = rows.groupBy("token").agg(F.sum("w").alias("wt")).where(F.col("wt") > BLOCK).select("token")
        rows = written(_with_components(rows.join(several, "token"), comp).groupBy("token", "comp").agg(
            F.min(F.struct("sid", "w")).alias("x")).select("token", F.col("x.sid").alias("sid"), F.col("x.w").alias("w")), "leaders")

    # 2. all groups that hold several components
    found = _linked(_with_components(groups, comp), False, docs, members, prefixes, size, order)
    if found is not None:
        links.append(found)
        comp = connected(_union(links))
    return comp


def _linked(rows: DataFrame, diagonal: bool, docs: DataFrame, members: DataFrame, prefixes: DataFrame, size: int, order) -> DataFrame | None:
    """Links (a, b) between components inside the groups of ``rows`` (token, sid, w, comp): prefixes tell which sets
    may have a partner, and those are compared as a whole. None if there are none."""
    possible = _possible(rows, diagonal, prefixes)
    if possible is None:
        return None
    whole = _whole(possible, docs, members, size, order)
    found = written(_join_units(_units(rows.join(small(possible), ["token", "sid"], "left_semi"), diagonal), whole, True), "links")
    return found.select("a", "b") if found.limit(1).count() else None


def _possible(rows: DataFrame, diagonal: bool, prefixes: DataFrame) -> DataFrame | None:
    """The sets (token, sid) that may have a partner by their prefixes. None if there are none."""
    short = rows.withColumn("w", F.ceil(F.col("w") * (DEN - NUM) / DEN) + 1)
    possible = written(_join_units(_units(short, diagonal), prefixes, False).select("token", F.col("a").alias("sid")).distinct(), "possible")
    return possible if possible.limit(1).count() else None


def _whole(possible: DataFrame, docs: DataFrame, members: DataFrame, size: int, order) -> DataFrame:
    """The whole sets of ``possible``."""
    # the sets from one document each, and from all documents without an id
    sids = small(written(possible.select("sid").distinct(), "sids"))
    wanted = written(members.join(sids, "sid").groupBy("sid").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "wanted")
    chosen = docs.where(F.col("doc_id").isNotNull()).join(small(wanted), "doc_id", "left_semi")
    chosen = chosen.unionByName(docs.where(F.col("doc_id").isNull()))
    return written(_tokens(chosen, size, order, whole=True).join(sids, "sid", "left_semi"), "whole")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def components(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest doc_id that links reach.

    A null, empty or wordless text has an empty set, links with nothing and is its own component.
    Rows with equal sets, repeated rows among them, are linked. A null key counts for nothing among
    others; rows whose component has no key at all get null. An empty table gives no rows; other columns
    are left out. Tokens are hashes of HASH_BITS bits and sets go by hashes of 64.
    """
    docs = df.select(quoted(key).alias("doc_id"), quoted(text).cast("string").alias("text"))
    both = written(_members(docs, size), "members")
    members = both.where(F.col("n").isNotNull()).select("doc_id", "n", "sid")
    comp = link_classes(docs, both, size)
    classes = _with_components(members.where(F.col("sid").isNotNull()).groupBy("sid").agg(F.min("doc_id").alias("low")), comp)
    lowest = classes.groupBy("comp").agg(F.min("low").alias("component"))
    classes = classes.join(lowest, "comp").select("sid", "component")
    out = members.join(classes, "sid", "left")
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"),
                      F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def link_counts(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles and n_links, the number of other rows whose sets are similar to its own.

    Every pair of similar sets counts, not only those that :func:`components` needs; equal sets, repeated rows and rows
    without a key among them, count by rows. A null, empty or wordless text has no links. Sums per set
    are made, no list of pairs. Work grows with the square of a large group, spread over its units.
    """
    docs = df.select(quoted(key).alias("doc_id"), quoted(text).cast("string").alias("text"))
    both = written(_members(docs, size), "members")
    members = both.where(F.col("n").isNotNull()).select("doc_id", "n", "sid")
    classes = written(members.where(F.col("sid").isNotNull()).groupBy("sid").agg(F.count("*").alias("weight")), "classes")
    order, prefixes, groups = _grouped(docs, both, size)
    possible = _possible(groups.withColumn("comp", F.col("sid")), False, prefixes)
    links = F.col("weight") - 1
    if possible is not None:
        whole = _whole(possible, docs, members, size, order).join(classes, "sid")
        units = _pair_units(groups.join(small(possible), ["token", "sid"], "left_semi"))
        found = written(_count_units(units, whole).groupBy(F.col("a").alias("sid")).agg(F.sum("b").alias("more")), "counts")
        classes = classes.join(found, "sid", "left")
        links = links + F.coalesce("more", F.lit(0))
    return (members.join(classes.select("sid", links.alias("links")), "sid", "left")
            .select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("links", F.lit(0).cast("bigint")).alias("n_links")))


def linked(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, sid (its set's id, null for an empty set) and comp, equal for the rows that links
    reach and null for an empty set. Repeated and missing keys are rows like others."""
    docs = df.select(quoted(key).alias("doc_id"), quoted(text).cast("string").alias("text"))
    both = written(_members(docs, size), "members")
    members = both.where(F.col("n").isNotNull()).select("doc_id", "sid")
    return _with_components(members, link_classes(docs, both, size)).select("doc_id", "sid", "comp")


def with_set_ids(df: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``df`` with sid as in :func:`linked`."""
    def make():
        return lambda column: [[set_id(s) if len(s) else None for s in shingle_sets(column.to_pylist(), size)]]

    return map_text(df, text, T.StructType([T.StructField("sid", T.LongType())]), make)
