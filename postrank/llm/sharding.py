"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards with weights. A key descends from the root:
at each node every child draws ``-ln(u) / weight`` with ``u`` hashed from the key
and the child's name, and the smallest draw wins. A child that gains weight only
draws smaller, so keys move only into it (out of it when it loses weight); draws
elsewhere do not change, and movement stays inside the subtrees whose weights
changed. A new region therefore takes keys only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, written

HASH_BITS = 52  # 13 hexadecimal digits of md5: exact in a double


@dataclass(frozen=True)
class Node:
    """A node of the tree: a leaf has a shard number, any other node has children."""

    name: str
    weight: float = 1.0
    children: tuple[Node, ...] = ()
    shard: int = -1

    @property
    def total(self) -> float:
        """The weight with which the node draws: its own for a leaf, else its leaves' sum."""
        return sum(c.total for c in self.children) if self.children else self.weight


def uniform_tree(regions: int = 2, racks: int = 2, shards: int = 2) -> Node:
    """``regions * racks * shards`` shards of equal weight, numbered from 0."""
    return Node("root", children=tuple(
        Node(f"region{r}", children=tuple(
            Node(f"region{r}/rack{k}", children=tuple(
                Node(f"region{r}/rack{k}/shard{s}", shard=(r * racks + k) * shards + s)
                for s in range(shards)))
            for k in range(racks)))
        for r in range(regions)))


def leaves(node: Node) -> list[Node]:
    return [x for c in node.children for x in leaves(c)] if node.children else [node]


def grow(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and rack of its own."""
    n = len(leaves(tree))
    name = f"region-of-{n}"
    leaf = Node(f"{name}/rack0/shard0", weight, shard=n)
    return replace(tree, children=(*tree.children, Node(name, children=(Node(f"{name}/rack0", children=(leaf,)),))))


def draw(key: Column, node: Node) -> Column:
    """The node's exponential draw for a key; a node without weight never wins."""
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + node.name)).cast("binary")), 1, HASH_BITS // 4), 16, 10)
    u = (h.cast("double") + 0.5) / float(2**HASH_BITS)
    return -F.log(u) / node.total if node.total > 0 else F.lit(float("inf"))


def assign(key: Column, node: Node) -> Column:
    """The shard that ``key`` (a string) reaches from ``node``. Equal draws: the first child."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return assign(key, node.children[0])
    win = F.array_min(F.array(*[F.struct(draw(key, c).alias("d"), F.lit(i).alias("i"))
                                for i, c in enumerate(node.children)]))["i"]
    out = assign(key, node.children[-1])
    for i, c in reversed(list(enumerate(node.children[:-1]))):
        out = F.when(win == i, assign(key, c)).otherwise(out)
    return out


def shard(df: DataFrame, tree: Node, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its shard and its slot there.

    Returns doc_id, size (UTF-8 bytes of the text plus 1; null text: 1), text_crc32 (null text: 0),
    shard, grown_shard (the shard after :func:`grow`) and slot, which counts the shard's rows from 0
    in the order of key, checksum. A null key is the key ``"null"``; repeated rows go to the
    same shard and take slots of their own; an empty table gives no rows; other columns are left out.

    Slots need no shard in one task: rows are range-partitioned by shard and key and written with
    the number of their partition; each (shard, partition) piece is numbered on its own and shifted
    by the sizes of the pieces before it.
    """
    k = F.coalesce(quoted(key).cast("string"), F.lit("null"))
    body = F.coalesce(quoted(text).cast("string"), F.lit("")).cast("binary")
    rows = df.select(
        quoted(key).alias("doc_id"),
        (F.length(body).cast("bigint") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        assign(k, tree).cast("int").alias("shard"),
        assign(k, grow(tree)).cast("int").alias("grown_shard"),
        F.monotonically_increasing_id().alias("__tie"))  # splits repeated rows over range partitions
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(rows.repartitionByRange(n, "shard", "doc_id", "text_crc32", "__tie")
                   .withColumn("__part", F.spark_partition_id()), "sharding")
    pieces = rows.groupBy("shard", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("shard", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("shard", "__part").orderBy("doc_id", "text_crc32", "__tie")
    return (rows.withColumn("__at", F.row_number().over(within))
            .join(pieces, ["shard", "__part"])
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("__before") + F.col("__at") - 1).alias("slot"), "grown_shard"))
