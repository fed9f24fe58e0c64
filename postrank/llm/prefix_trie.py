"""Prefix trie of conversations in double arrays.

A turn is known by a digest of its role and text, and a conversation by the digests of its turns in order (16 bytes a turn;
no text is shuffled). Equal conversations are one sequence from the start, with their number and smallest id.

Sequences are dealt out by their beginnings: a shard is a prefix whose sequences fit a task; prefixes with more are upper
nodes, and their next turns are tried. A task numbers the turns of its shards densely, packs their tries into the
arrays BASE and CHECK (the child of state s by turn t is the slot BASE[s] + t, if CHECK says that it belongs to s) and
walks every sequence through them to sum up its nodes. What shards found below the upper nodes that they
share is then merged globally, once for all depths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, written

WIDTH = 16  # bytes of a turn's digest
SHARD = 1_000_000  # turns of a shard at most, if it holds several sequences; a task packs shards up to that together
LEAST_SHARD = 1024  # a shard may have so many turns, however many tasks there are
IDS = 8192  # ids whose decimals travel in one row
TRIES = 64  # free slots at which a node's children are tried before they go to the end
SMALL = 500_000  # rows of a narrow table that may be broadcast


def sequences(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, path (digests of its turns, by turn, null first) and chars (code points of their texts).

    Null roles and texts count as empty, rows without a conversation are left out, and rows with equal turns come in
    the order of their digests. Other columns are left out."""
    said, spoken = (F.coalesce(quoted(c).cast("string"), F.lit("")) for c in (role, text))
    rows = df.where(quoted(conv).isNotNull()).select(
        quoted(conv).cast("bigint").alias("conv_id"), quoted(turn).alias("turn"),
        F.md5(F.concat(F.length(said).cast("string"), F.lit(":"), said, spoken).cast("binary")).alias("digest"), F.length(spoken).alias("chars"))
    turns = F.sort_array(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "digest", "chars")))
    return rows.groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id", F.unhex(F.array_join(F.col("turns.digest"), "")).alias("path"), F.col("turns.chars").alias("chars"))


def prefix(path: Column, depth: Column | int) -> Column:
    return F.substring(path, 1, depth * WIDTH) if isinstance(depth, int) else F.substring(path, F.lit(1), depth * WIDTH)


def shared_heads(rows: DataFrame, every: int = 100, longest: int = 6) -> DataFrame:
    """``rows`` of :func:`sequences` rebuilt: the first h turns of conversation c are those of conversation
    c - c % ``every`` (all if it has fewer, none if there is none), h = crc32(decimal c) % ``longest``."""
    base = rows.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), prefix(F.col("path"), longest - 1).alias("head"), F.slice("chars", 1, longest - 1).alias("head_chars"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest).cast("int")
    each = rows.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(base, "base", "left")
    head = F.coalesce(prefix(F.col("head"), F.col("h")), F.lit(b""))
    tail = F.substring("path", F.col("h") * WIDTH + 1, F.octet_length("path"))
    head_chars = F.coalesce(F.slice("head_chars", F.lit(1), F.col("h")), F.array().cast("array<int>"))
    return each.select("conv_id", F.concat(head, tail).alias("path"),
                       F.concat(head_chars, F.slice("chars", F.col("h") + 1, F.size("chars"))).alias("chars"))


# --- sequences and their members ---------------------------------------------------------------------

def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def member_digests(members: DataFrame) -> DataFrame:
    """key, ends: the digest of the ascending ``conv_id`` of each ``key`` in decimal, joined by commas. Ids are
    sorted by ranges over all tasks and their decimals joined there; only those pieces meet, in order, in one task."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches):
        for b in batches:
            keys, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            out, start = [], 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start] or i - start == IDS:
                    out.append((keys[start], ids[start], ",".join(map(str, ids[start:i]))))
                    start = i
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "first", "piece"), x)) for x in out], schema=piece)

    def digests(batches):
        key, sha = None, None
        for b in batches:
            out = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k == key:
                    sha.update(b",")
                else:
                    if sha:
                        out.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256()
                sha.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in out], pa.string()) for i in (0, 1)], names=["key", "ends"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha.hexdigest()])], names=["key", "ends"])

    piece = pa.schema([("key", pa.string()), ("first", pa.int64()), ("piece", pa.string())])
    sorted_ids = members.select("key", "conv_id").repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    joined = sorted_ids.mapInArrow(pieces, "key string, first bigint, piece string")
    laid = joined.repartition(n, "key").sortWithinPartitions("key", "first").select("key", "piece")
    return laid.mapInArrow(digests, "key string, ends string")


def distinct_sequences(rows: DataFrame) -> DataFrame:
    """path, chars, low (smallest conversation), n (conversations) and ends (digest of their ids) of each distinct sequence."""
    classes = written(rows.groupBy("path").agg(F.min("conv_id").alias("low"), F.count("*").alias("n"), F.first("chars").alias("chars"))
                      .withColumn("key", F.md5("path")), "sequences")
    several = classes.where(F.col("n") > 1).select("key")
    members = rows.select(F.md5("path").alias("key"), "conv_id").join(_small(several), "key", "left_semi")
    own = F.sha2(F.col("low").cast("string").cast("binary"), 256)
    out = classes.join(member_digests(members), "key", "left").withColumn("ends", F.coalesce("ends", own))
    return written(out.select("path", "chars", "low", "n", "ends", F.size("chars").alias("depth")), "classes")


# --- shards ------------------------------------------------------------------------------------------

def dealt(classes: DataFrame, limit: int) -> DataFrame:
    """``classes`` with cut, the depth of the shard's first node: the least at which its prefix has ``limit``
    turns at most, or one sequence only. Sequences that end above it have a depth below cut."""
    out, level = classes.withColumn("cut", F.lit(1)), 1
    while True:
        at = out.where((F.col("cut") == level) & (F.col("depth") >= level))
        large = (at.groupBy(prefix(F.col("path"), level).alias("large")).agg(F.sum("depth").alias("turns"), F.count("*").alias("m"))
                 .where((F.col("turns") > limit) & (F.col("m") > 1)).select("large"))
        large = written(large, "large-prefixes")
        if not large.limit(1).count():
            return out
        out = (out.withColumn("large", F.when(F.col("depth") >= level, prefix(F.col("path"), level)))
               .join(_small(large.withColumn("is_large", F.lit(True))), "large", "left")
               .withColumn("cut", F.when(F.col("is_large") & (F.col("cut") == level), level + 1).otherwise(F.col("cut")))
               .drop("large", "is_large"))
        level += 1


class DoubleArray:
    """A trie over dense ids (from 1) in the arrays ``base`` and ``check``; state 0 is the root. An unused slot's check is -1."""

    def __init__(self, size: int):
        self.base = np.zeros(size + 1, np.int64)
        self.check = np.full(size + 1, -1, np.int64)
        self.check[0] = 0
        self.top = 1  # all slots from here on are unused

    def _reserve(self, size: int) -> None:
        if size > len(self.base):
            more = max(size, 2 * len(self.base)) - len(self.base)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _place(self, state: int, ids: np.ndarray, free: np.ndarray) -> None:
        """The children of ``state`` at the first of some free slots where all fit, or behind all others."""
        base = self.top - int(ids[0])
        for slot in free[:TRIES].tolist():
            at = slot - int(ids[0]) + ids
            if at[-1] < self.top and (self.check[at] < 0).all():
                base = slot - int(ids[0])
                break
        self._reserve(base + int(ids[-1]) + 1)
        self.base[state] = base
        self.check[base + ids] = state
        self.top = max(self.top, base + int(ids[-1]) + 1)

    def add(self, states: np.ndarray, ids: np.ndarray) -> None:
        """Children of states that have none yet, as distinct pairs sorted by state and id."""
        first = np.flatnonzero(np.r_[True, states[1:] != states[:-1]])
        counts = np.diff(np.r_[first, len(states)])
        several = np.flatnonzero(counts > 1)
        for g in several[np.argsort(-counts[several], kind="stable")].tolist():
            self._place(int(states[first[g]]), ids[first[g]:first[g] + counts[g]], np.flatnonzero(self.check[:self.top] < 0)[:TRIES])
        single = first[counts == 1]
        holes = np.flatnonzero(self.check[:self.top] < 0)[:len(single)]
        slots = np.r_[holes, np.arange(self.top, self.top + len(single) - len(holes))]
        self._reserve(self.top + len(single))
        self.base[states[single]] = slots - ids[single]
        self.check[slots] = states[single]
        self.top = max(self.top, int(slots.max(initial=0)) + 1)

    def step(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The children of ``states`` by ``ids``, -1 where there is none."""
        at = self.base[states] + ids
        inside = (at > 0) & (at < len(self.check))
        at = np.where(inside, at, 0)
        return np.where(inside & (self.check[at] == states), at, -1)


def dense(digests: np.ndarray) -> np.ndarray:
    """Numbers from 1 of 16-byte digests (rows of two integers), equal for equal ones."""
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    new = np.r_[True, (digests[order[1:]] != digests[order[:-1]]).any(axis=1)] if len(order) else np.zeros(0, bool)
    out = np.zeros(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def packed(shard: np.ndarray, starts: np.ndarray, lengths: np.ndarray, turns: np.ndarray) -> tuple[DoubleArray, list[tuple[np.ndarray, np.ndarray]]]:
    """The double array of some shards, and for each level the sequences that reach it and their states. ``shard`` numbers
    them from 0; a sequence's turns below its shard's node are ``turns`` from ``starts`` on, ``lengths`` many."""
    shards = int(shard.max(initial=-1)) + 1
    trie = DoubleArray(len(turns) + shards + 1)
    alive, states, level, walked = np.arange(len(shard)), np.zeros(len(shard), np.int64), 0, []
    while len(alive):
        # the root's children are the shards, numbered behind the turns
        ids = shard + 1 + int(turns.max(initial=0)) if level == 0 else turns[starts[alive] + level - 1]
        order = np.lexsort((ids, states))
        new = np.r_[True, (states[order[1:]] != states[order[:-1]]) | (ids[order[1:]] != ids[order[:-1]])]
        trie.add(states[order][new], ids[order][new])
        states = trie.step(states, ids)
        walked.append((alive, states))
        more = lengths[alive] > level
        alive, states, level = alive[more], states[more], level + 1
    return trie, walked


def pack_nodes(paths: list[bytes], chars: list[list[int]], low: np.ndarray, n: np.ndarray, ends: list[str], cut: np.ndarray) -> dict[str, list]:
    """The nodes of whole shards (sequences sorted by shard), as columns of :data:`NODES`."""
    digests = np.frombuffer(b"".join(paths), "<i8").reshape(-1, 2)
    depth = np.array([len(c) for c in chars], np.int64)
    offsets = np.r_[0, np.cumsum(depth)[:-1]]
    heads = [p[:c * WIDTH] for p, c in zip(paths, cut.tolist())]
    shard = np.cumsum([0, *(a != b for a, b in zip(heads[1:], heads[:-1]))])
    trie, walked = packed(shard, offsets + cut, depth - cut, dense(digests))
    size, last = trie.top, np.concatenate([np.array(c, np.int64) for c in chars])
    count, least, level_of, text, own = (np.zeros(size, np.int64) for _ in range(5))
    least[:], own[:], first = np.iinfo(np.int64).max, -1, np.zeros(size, np.int64)
    for level, (alive, states) in enumerate(walked):
        np.add.at(count, states, n[alive])
        np.minimum.at(least, states, low[alive])
        level_of[states] = cut[alive] + level
        text[states] = last[offsets[alive] + cut[alive] + level - 1]
        first[states] = alive
        at_end = depth[alive] == cut[alive] + level
        own[states[at_end]] = alive[at_end]
    parent = trie.check[:size]
    used = np.flatnonzero(parent >= 0)[1:]  # without the root
    children = np.bincount(parent[used], minlength=size)
    leaves, saved = (children == 0).astype(np.int64), (count - 1) * text
    for _, states in walked[:0:-1]:  # from the deepest level up to the second
        nodes = np.unique(states)
        np.add.at(leaves, parent[nodes], leaves[nodes])
        np.add.at(saved, parent[nodes], saved[nodes])
    top = parent[used] == 0
    above = [(paths[i][:(int(cut[i]) - 1) * WIDTH], chars[i][:int(cut[i]) - 1]) if t else (None, None) for i, t in zip(first[used].tolist(), top)]
    return {"conv_id": least[used], "depth": level_of[used], "parent_conv_id": pa.array(np.where(top, 0, least[parent[used]]), mask=top),
            "n_convs": count[used], "n_children": children[used], "n_leaves": leaves[used], "saved_tokens": saved[used],
            "ends": [ends[i] if i >= 0 else None for i in own[used].tolist()], "above": [a for a, _ in above], "above_chars": [c for _, c in above]}


NODES = pa.schema([*((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")),
                   ("ends", pa.string()), ("above", pa.binary()), ("above_chars", pa.list_(pa.int32()))])


def shard_nodes(classes: DataFrame, pack: int) -> DataFrame:
    """The nodes from each shard's first one down. Of the first ones the parent is known by ``above``, its sequence."""
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = classes.where(F.col("depth") >= F.col("cut")).withColumn("head", F.substring("path", F.lit(1), F.col("cut") * WIDTH))
    laid = rows.repartition(n, "head").sortWithinPartitions("head").select("head", "path", "chars", "low", "n", "ends", "cut")

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, turns = [], 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                if turns >= pack and row[0] != held[-1][0]:
                    yield from found(held)
                    held, turns = [], 0
                held.append(row)
                turns += len(row[2])
        if held:
            yield from found(held)

    def found(held):
        _, paths, chars, low, n, ends, cut = zip(*held)
        columns = pack_nodes(list(paths), list(chars), np.array(low), np.array(n), list(ends), np.array(cut, np.int64))
        table = pa.Table.from_arrays([pa.array(columns[f.name], f.type) for f in NODES], schema=NODES)
        yield from table.to_batches(max_chunksize=65_536)

    return laid.mapInArrow(run, ", ".join(f"{f.name} bigint" for f in NODES if f.type == pa.int64())
                           + ", ends string, above binary, above_chars array<int>")


def upper_nodes(shards: DataFrame, classes: DataFrame) -> DataFrame:
    """The nodes above the shards, from the first nodes of ``shards`` and the sequences of ``classes`` that end there. Every one of
    them adds to all nodes above it at once; their number grows with that of shards, not of turns."""
    firsts = shards.where(F.col("above").isNotNull()).select("above", "above_chars", "conv_id", "n_convs", "n_leaves", "saved_tokens",
                                                             F.lit(1).alias("child"), F.lit(None).cast("string").alias("ends"))
    zero = F.lit(0).cast("bigint")
    ending = classes.where(F.col("depth") < F.col("cut")).select(
        F.col("path").alias("above"), F.col("chars").alias("above_chars"), F.col("low").alias("conv_id"), F.col("n").alias("n_convs"),
        zero.alias("n_leaves"), zero.alias("saved_tokens"), F.lit(0).alias("child"), "ends")
    size = F.size("above_chars")
    each = firsts.unionByName(ending).withColumn("depth", F.explode(F.sequence(F.lit(0), size)))
    here = F.col("depth") == size
    nodes = (each.groupBy(F.substring("above", F.lit(1), F.col("depth") * WIDTH).alias("node"), "depth").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved"), F.sum(F.when(here, F.col("child")).otherwise(0)).alias("firsts"),
        F.max(F.when(here, F.col("ends"))).alias("ends"), F.max(F.get("above_chars", F.col("depth") - 1)).alias("chars")))
    nodes = written(nodes, "upper")
    up = F.substring("node", F.lit(1), (F.col("depth") - 1) * WIDTH)
    inner = (nodes.where(F.col("depth") > 0).groupBy(up.alias("node"), (F.col("depth") - 1).alias("depth"))
             .agg(F.count("*").alias("inner")))
    own = nodes.select("node", "depth", ((F.col("n_convs") - 1) * F.coalesce("chars", F.lit(0))).alias("own"))
    below = (own.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("depth"))))
             .groupBy(F.substring("node", F.lit(1), F.col("at") * WIDTH).alias("node"), F.col("at").alias("depth")).agg(F.sum("own").alias("below")))
    parents = nodes.select(F.col("node").alias("up"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    n_children = F.col("firsts") + F.coalesce("inner", F.lit(0))
    return (nodes.join(inner, ["node", "depth"], "left").join(below, ["node", "depth"])
            .withColumn("up", F.when(F.col("depth") > 0, up)).join(parents, ["up", "depth"], "left")
            .select("node", "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs",
                    n_children.cast("bigint").alias("n_children"), F.when(n_children == 0, 1).otherwise(F.col("n_leaves")).cast("bigint").alias("n_leaves"),
                    (F.col("saved") + F.col("below")).cast("bigint").alias("saved_tokens"), "ends"))


def trie(rows: DataFrame, shard: int = SHARD, least: int = LEAST_SHARD) -> DataFrame:
    """One row per node of the trie of ``rows`` (conv_id, path and chars, as :func:`sequences` gives them; conv_id is not repeated).

    A node is a distinct sequence of the first ``depth`` turns; the root has none. conv_id is its smallest member, a
    conversation that begins with it; parent_conv_id that of its parent (root: null); n_convs its members; n_children; n_leaves, the
    nodes without children in its subtree, itself included; saved_tokens, summed over the subtree, (members - 1) x
    code points of the last turn's text; ends_sha256, the digest of the ids of the conversations that end there.
    Conversations without turns belong to the root alone. An empty table has no nodes. A task holds one
    conversation's digests whole (20 bytes a turn), no texts.
    """
    rows = written(rows.select("conv_id", "path", "chars"), "sequences")
    classes = distinct_sequences(rows)
    turns = classes.agg(F.sum("depth")).first()[0] or 0
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes = dealt(classes, min(shard, max(least, turns // tasks)))
    shards = written(shard_nodes(classes, shard), "nodes")
    upper = written(upper_nodes(shards, classes), "upper-nodes")
    parents = upper.select(F.col("node").alias("above"), F.col("conv_id").alias("above_conv_id"))
    first = shards.where(F.col("above").isNotNull()).join(_small(parents), "above").withColumn("parent_conv_id", F.col("above_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    out = shards.where(F.col("above").isNull()).select(columns).unionByName(first.select(columns)).unionByName(upper.select(columns))
    none = hashlib.sha256(b"").hexdigest()
    return out.select(*columns[:-1], F.coalesce("ends", F.lit(none)).alias("ends_sha256"))
