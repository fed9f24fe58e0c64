"""Near duplicates among vectors: random-hyperplane hashing in several tables, exact cosines, connected components.

A table's hash of a vector is the signs of its products with some random hyperplanes; two vectors at angle a agree
in one sign with probability 1 - a / pi. Bits grow with the logarithm of the number of vectors, so that buckets
keep their expected size, and the number of tables follows from the chance of a miss at the threshold.

Equal vectors are one class from the start. Vectors that share a bucket are first compared by a sketch of 128
more signs, which travels in the vectors' place; only those with a possible partner are shipped and compared by exact
cosine, in blocks of bounded size. A pair that shares several tables counts in the first. A unit of work gives each
vector's number of links and a spanning forest, never a list of its pairs; components come from contracting the forests
in Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, written
from .jaccard_join import connected

THRESHOLD = 0.95
MISS = 0.001  # chance that a pair just at the threshold shares no table
BUCKET = 512  # vectors that unrelated ones would make in a bucket, about
LEAST_BITS = 8
SKETCH = 128  # signs of the sketch
SLIPS = 6.0  # standard deviations of a sketch's differences that a pair may be beyond the mean
BLOCK = 4096  # vectors of a block; a unit of work compares two at most
CELLS = 1 << 20  # comparisons held at once
SEED = 20_240
SMALL = 500_000  # rows of a narrow table that may be broadcast: some tens of bytes each


def design(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits of a hash and number of tables for ``n`` vectors."""
    bits = min(30, max(LEAST_BITS, math.ceil(math.log2(max(1, n) / BUCKET)))) if n else LEAST_BITS
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - same)))


def allowance(threshold: float = THRESHOLD) -> int:
    """Differences of two sketches beyond which the cosine is under the threshold but for SLIPS standard deviations."""
    p = math.acos(threshold) / math.pi
    return math.ceil(SKETCH * p + SLIPS * math.sqrt(SKETCH * p * (1 - p)))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; by their largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def packed_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, and v: the vector's doubles packed, null unless all are finite and one is not zero."""
    rows = df.select(quoted(key).alias("vec_id"), quoted(vector).cast("array<double>").alias("x"))
    fine = (F.forall("x", lambda c: F.coalesce((c > float("-inf")) & (c < float("inf")), F.lit(False)))
            & F.exists("x", lambda c: c != 0))
    rows = rows.select("vec_id", F.when(fine, F.col("x")).alias("x"))

    def run(batches):
        for b in batches:
            out = [None if not x.is_valid else x.values.to_numpy(zero_copy_only=False).tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return rows.mapInArrow(run, T.StructType([rows.schema["vec_id"], T.StructField("v", T.BinaryType())]))


def hashed(rows: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """``rows`` (w, v and others) with hashes, an array of one integer per table, and the sketch as two integers."""
    schema = T.StructType([*rows.schema.fields, T.StructField("hashes", T.ArrayType(T.IntegerType())),
                           T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType())])
    place = rows.columns.index("v")

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            body = [x.as_buffer() for x in b.column(place)]
            dims = np.array([x.size // 8 for x in body], dtype=np.int64)
            hashes, sketch = np.zeros((len(body), tables), np.int32), np.zeros((len(body), 2), np.int64)
            for dim in np.unique(dims).tolist():
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits + SKETCH))
                at = np.flatnonzero(dims == dim)
                x = unit_rows(np.stack([np.frombuffer(body[i]) for i in at]))
                signs = x @ planes[dim] >= 0
                hashes[at] = signs[:, :tables * bits].reshape(-1, tables, bits) @ (1 << np.arange(bits))
                sketch[at] = np.packbits(signs[:, tables * bits:], axis=1).view(np.int64)
            offsets = np.arange(len(body) + 1, dtype=np.int32) * tables
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.ravel())),
                 pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def units(classes: DataFrame) -> DataFrame:
    """cid, s1, s2 dealt into units (bucket, b1, b2) of one block or two: every two vectors of a bucket meet. The
    bucket tells the table, the number of components and the hash. Buckets of one vector are left out."""
    rows = classes.select("cid", "s1", "s2", "dim", F.posexplode("hashes").alias("table", "hash")).select(
        (F.shiftleft(F.col("table").cast("bigint"), 50) + F.shiftleft(F.pmod("dim", F.lit(1 << 18)).cast("bigint"), 32)
         + F.col("hash").cast("bigint")).alias("bucket"), "cid", "s1", "s2")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("m"))
    large = written(sizes.where(F.col("m") > BLOCK).select("bucket", F.ceil(F.col("m") / BLOCK).alias("parts")), "large-buckets")
    dealt = (rows.join(_small(large), "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
             .withColumn("block", F.pmod(F.xxhash64("cid"), "parts"))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))))
    return dealt.select("bucket", F.least("block", "other").cast("int").alias("b1"), F.greatest("block", "other").cast("int").alias("b2"),
                        F.col("block").cast("int").alias("block"), "cid", "s1", "s2")


def each_unit(rows: DataFrame, schema: str, work: Callable[[tuple, dict[str, pa.Array]], Iterator[dict]]) -> DataFrame:
    """What ``work`` yields for each unit of ``rows``, from its key (bucket, b1, b2) and its columns. A task holds one unit."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["bucket", "b1", "b2"]
    laid = rows.repartition(n, *keys).sortWithinPartitions(*keys)
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(c).to_numpy() for c in keys])
            cuts = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
            if held and any(held[-1].column(c)[held[-1].num_rows - 1] != b.column(c)[0] for c in keys):
                yield from results(held)
                held = []
            bounds = [0, *cuts.tolist(), b.num_rows]
            for start, end in zip(bounds[:-1], bounds[1:]):
                if start:
                    yield from results(held)
                    held = []
                held.append(b.slice(start, end - start))
        if held:
            yield from results(held)

    def results(held):
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows > 1:
            key = tuple(table.column(c)[0].as_py() for c in keys)
            columns = {c: table.column(c).combine_chunks() for c in table.column_names if c not in keys}
            for out in work(key, columns):
                yield pa.RecordBatch.from_arrays([pa.array(out[c]) for c in names], names=names)

    return laid.mapInArrow(batched(run, names), schema)


def batched(run, names):
    """Small record batches put together, some thousands of rows at a time."""
    def together(batches):
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= 8192:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    return together


def sides(key: tuple, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a unit on either side of its comparisons: all against all, or one block against another."""
    if key[1] == key[2]:
        both = np.arange(len(block))
        return both, both
    return np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])


def sieve(rows: DataFrame, allowed: int) -> DataFrame:
    """The rows of :func:`units` that may have a partner in their unit by their sketches."""
    def work(key, columns):
        block, cid = columns["block"].to_numpy(), columns["cid"].to_numpy()
        s1, s2 = (columns[c].to_numpy().view(np.uint64) for c in ("s1", "s2"))  # bits of a signed one are those of its amount
        left, right = sides(key, block)
        found = np.zeros(len(cid), dtype=bool)
        step = max(1, CELLS // max(1, len(right)))
        for at in range(0, len(left), step):
            i = left[at:at + step]
            near = (np.bitwise_count(s1[i, None] ^ s1[right]).astype(np.uint8) + np.bitwise_count(s2[i, None] ^ s2[right])) <= allowed
            if left is right:
                near[np.arange(len(i)), np.arange(at, at + len(i))] = False
            found[i] |= near.any(axis=1)
            found[right] |= near.any(axis=0)
        if some := int(found.sum()):
            yield {"bucket": np.full(some, key[0]), "b1": np.full(some, key[1], np.int32), "b2": np.full(some, key[2], np.int32),
                   "block": block[found], "cid": cid[found]}

    return each_unit(rows, "bucket bigint, b1 int, b2 int, block int, cid bigint", work)


def links(possible: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b, n) from the exact cosines of every unit: n linked vectors of class a (b null), or an edge of the
    unit's spanning forest from a to b (n null)."""
    rows = classes.select("cid", "v", "hashes", "w").join(possible, "cid")

    def work(key, columns):
        table = key[0] >> 50
        cid, weight = columns["cid"].to_numpy(), columns["w"].to_numpy()
        earlier = columns["hashes"].flatten().to_numpy().reshape(len(cid), -1)[:, :table]
        body = [x.as_buffer() for x in columns["v"]]
        for size in {x.size for x in body}:
            of_size = np.array([x.size == size for x in body])
            x = np.zeros((len(cid), size // 8))
            x[of_size] = unit_rows(np.stack([np.frombuffer(b) for b, yes in zip(body, of_size) if yes]))
            left, right = (s[of_size[s]] for s in sides(key, columns["block"].to_numpy()))
            if len(left) and len(right):
                yield from compared(x, cid, weight, earlier, left, right, key[1] == key[2], threshold)

    return each_unit(rows, "a bigint, b bigint, n bigint", work)


def compared(x, cid, weight, earlier, left, right, same, threshold) -> Iterator[dict]:
    linked = np.zeros((len(left), len(right)), dtype=bool)
    step = max(1, CELLS // len(right))
    for at in range(0, len(left), step):
        i = left[at:at + step]
        near = x[i] @ x[right].T >= threshold
        if same:
            near[np.arange(len(i)), np.arange(at, at + len(i))] = False
        for t in range(earlier.shape[1] if near.any() else 0):  # counted in the first table that both share
            near &= earlier[i, t][:, None] != earlier[right, t]
        linked[at:at + step] = near
    n = np.zeros(len(cid), np.int64)
    n[left] += linked @ weight[right]
    if not same:
        n[right] += linked.T @ weight[left]
    if some := np.flatnonzero(n).tolist():
        yield {"a": pa.array(cid[some]), "b": pa.nulls(len(some), pa.int64()), "n": pa.array(n[some])}
        edges = list(forest(linked, left, right))
        yield {"a": pa.array(cid[[e[0] for e in edges]]), "b": pa.array(cid[[e[1] for e in edges]]),
               "n": pa.nulls(len(edges), pa.int64())}


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that join what ``linked`` joins: a search that meets every row and every column once."""
    column_of = {int(j): k for k, j in enumerate(right)}
    row_of = {int(i): k for k, i in enumerate(left)}
    fresh_rows, fresh_columns = np.ones(len(left), bool), np.ones(len(right), bool)

    def reached(node: int) -> Iterator[int]:
        """Vertices not met before that hang on ``node``."""
        new = []
        if node in row_of:
            hits = np.flatnonzero(linked[row_of[node]] & fresh_columns)
            new += right[hits].tolist()
        if node in column_of and left is not right:
            hits = np.flatnonzero(linked[:, column_of[node]] & fresh_rows)
            new += left[hits].tolist()
        for v in new:
            meet(v)
        yield from new

    def meet(v: int) -> None:
        if v in row_of:
            fresh_rows[row_of[v]] = False
        if v in column_of:
            fresh_columns[column_of[v]] = False

    for start in left[linked.any(axis=1)].tolist():
        if not fresh_rows[row_of[start]]:
            continue
        meet(start)
        stack = [start]
        while stack:
            node = stack.pop()
            for v in reached(node):
                yield node, v
                stack.append(v)


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, miss: float = MISS,
                    seed: int = SEED) -> DataFrame:
    """One row per vector: vec_id, n_links (other rows with a cosine of ``threshold`` or more), component_id (the smallest
    vec_id that links reach) and kept (vec_id = component_id).

    A pair just at the threshold is missed with probability ``miss``, closer ones less; a pair below is never linked.
    A vector that is null, empty, zero or has null, infinite or NaN components links with nothing, and vectors of
    different lengths don't link. Repeated rows and equal vectors are linked and count by rows. A null id counts for
    nothing among others; where no id is known component_id is null, and a row without an id is not
    kept. An empty table gives no rows; other columns are left out. The work of a unit is bounded; a group of g different
    vectors that are all similar takes g^2 comparisons, spread over its units.
    """
    rows = packed_rows(df, key, vector).select("vec_id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"))
    bits, tables = design(df.count(), threshold, miss)
    distinct = (rows.where(F.col("v").isNotNull()).groupBy("k1", "k2")
                .agg(F.first("v").alias("v"), F.count("*").alias("w"), F.min("vec_id").alias("lead")))
    distinct = distinct.select(F.monotonically_increasing_id().alias("cid"), "k1", "k2", "lead", "w", "v",
                               (F.octet_length("v") / 8).cast("int").alias("dim"))
    classes = written(hashed(distinct, bits, tables, seed), "classes")  # ids hold from here on
    possible = written(sieve(units(classes), allowance(threshold)), "possible")
    found = written(links(possible, classes, threshold), "links")
    counts = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("more"))
    comp = connected(found.where(F.col("b").isNotNull()).select(F.col("a"), F.col("b"))).withColumnRenamed("node", "cid")
    facts = (classes.select("cid", "k1", "k2", "lead", "w").join(counts, "cid", "left").join(comp, "cid", "left")
             .withColumn("comp", F.coalesce("comp", "cid")))
    lowest = facts.where(F.col("more").isNotNull()).groupBy("comp").agg(F.min("lead").alias("lowest"))
    facts = (facts.where((F.col("w") > 1) | F.col("more").isNotNull()).join(lowest, "comp", "left")
             .select("k1", "k2", (F.col("w") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"),
                     F.coalesce("lowest", "lead").alias("component")))
    known = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.col("k1")).alias("k1"), F.when(F.col("v").isNotNull(), F.col("k2")).alias("k2"))
    out = known.join(facts, ["k1", "k2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
