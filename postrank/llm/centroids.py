"""Centroid clustering with zone maps along a space-filling curve.

Vectors of whole numbers are laid out along a Hilbert curve over their leading principal axes and cut into blocks.
A block keeps the least box, in rotated coordinates, around its vectors. In a round the distances from the box bound
those of all vectors inside: a centroid whose least distance to the box is above another's largest cannot be the nearest
for any of them. Only the block's remaining candidates are compared with its vectors, in whole numbers.

The blocks are written once and read in every round. A round shuffles one row of sums per task, cluster and component;
the driver sees the sums of each cluster, never vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, written

BLOCK = 256  # vectors of a block
AXES, BITS = 8, 8  # principal axes of the curve and bits of each: a key of 64 bits
SPREAD = 3.0  # standard deviations that an axis covers to either side
LARGEST = 1 << 27  # components beyond would overflow a distance of 64 bits
EXACT = 1 << 22  # up to this, products of doubles are whole numbers below 2^53
SLACK = 1e-9  # of a bound, for the rounding of the rotation


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of points (rows of ``cells``, ``bits`` bits per axis), by Skilling's transform."""
    x = cells.astype(np.uint64).copy()
    axes = x.shape[1]
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        low = q - np.uint64(1)
        for i in range(axes):
            high = (x[:, i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, axes - 1] & np.uint64(1 << level), np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turn[:, None]
    key = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << np.uint64(1) | (x[:, i] >> np.uint64(level)) & np.uint64(1)
    return key


def whole_vectors(df: DataFrame, key: str, vector: str, dim: int, scale: int) -> DataFrame:
    """vec_id and v, the components floor(``scale`` * x), of the rows whose vector has ``dim`` finite components."""
    rows = df.select(quoted(key).alias("vec_id"), quoted(vector).cast("array<double>").alias("x")).where(F.size("x") == dim)
    finite = F.forall("x", lambda c: F.coalesce((c > float("-inf")) & (c < float("inf")), F.lit(False)))
    return rows.where(finite).select("vec_id", F.transform("x", lambda c: F.floor(c * float(scale))).alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """An Arrow column of lists of ``dim`` integers as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def moments(rows: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance of the vectors: sums per task, added up in Spark."""
    def run(batches):
        n, s, g = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            x = matrix(b.column(0), dim).astype(float)
            n, s, g = n + len(x), s + x.sum(axis=0), g + x.T @ x
        flat = np.concatenate([[n], s, g.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["at", "value"])

    got = rows.select("v").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(1 + dim + dim * dim)
    for r in got:
        flat[r["at"]] = r["value"]
    n = int(flat[0])
    mean = flat[1:1 + dim] / max(1, n)
    return n, mean, flat[1 + dim:].reshape(dim, dim) / max(1, n) - np.outer(mean, mean)


def first_centroids(rows: DataFrame, n: int, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest hashes, in their order. Only rows below a hash that
    leaves about as many as needed are sorted; the bound is raised until enough are found."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    share = (k + 6 * k ** 0.5 + 10) / max(1, n)
    while True:
        below = rows.withColumn("digest", digest)
        if share < 1:
            below = below.where(F.substring("digest", 1, 12) <= format(int(share * 16**12), "012x"))
        got = below.orderBy("digest", "v").limit(k).collect()
        if len(got) >= min(k, n) or share >= 1:
            return np.array([r["v"] for r in got], dtype=np.int64)
        share *= 4


def blocks(rows: DataFrame, dim: int, mean: np.ndarray, covariance: np.ndarray, block: int) -> tuple[DataFrame, np.ndarray]:
    """The vectors in blocks along the curve (ids, packed components, low and high corner of the box), and the
    rotation of the boxes. Equal keys are spread by a hash, so that copies of one vector don't meet in one task."""
    values, axes = np.linalg.eigh(covariance)
    rotation = axes[:, ::-1].copy()
    used = min(AXES, dim)
    sd = np.sqrt(np.maximum(values[::-1][:used], 1e-12))

    def keys(batches):
        for b in batches:
            v = matrix(b.column(1), dim)
            if len(v) and np.abs(v).max() >= LARGEST:
                raise ValueError(f"a component is beyond {LARGEST}: its distances do not fit 64 bits")
            y = (v - mean) @ rotation[:, :used] / sd
            cells = np.clip((y + SPREAD) / (2 * SPREAD) * (1 << BITS), 0, (1 << BITS) - 1)
            at = (hilbert(cells.astype(np.uint64), BITS) ^ np.uint64(1 << 63)).view(np.int64)
            packed = [row.tobytes() for row in v.astype("<i8")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at), pa.array(packed, pa.binary())], names=["vec_id", "at", "v"])

    def cut(batches):
        ids, packed = [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            packed += b.column(1).to_pylist()
            while len(ids) >= block:
                yield one(ids[:block], packed[:block], b.column(0).type)
                ids, packed = ids[block:], packed[block:]
        if ids:
            yield one(ids, packed, b.column(0).type)

    def one(ids, packed, kind):
        body = b"".join(packed)
        y = np.frombuffer(body, "<i8").reshape(-1, dim) @ rotation
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(kind)), pa.array([body], pa.binary()),
             pa.array([y.min(axis=0)], pa.list_(pa.float64())), pa.array([y.max(axis=0)], pa.list_(pa.float64()))],
            names=["ids", "v", "low", "high"])

    kind = rows.schema["vec_id"].dataType
    keyed = rows.mapInArrow(keys, T.StructType([T.StructField("vec_id", kind), T.StructField("at", T.LongType()),
                                                T.StructField("v", T.BinaryType())]))
    salted = keyed.withColumn("salt", F.xxhash64("vec_id", F.monotonically_increasing_id()))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = salted.repartitionByRange(n, "at", "salt").sortWithinPartitions("at", "salt").select("vec_id", "v")
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("v", T.BinaryType()),
                           T.StructField("low", T.ArrayType(T.DoubleType())), T.StructField("high", T.ArrayType(T.DoubleType()))])
    return written(laid.mapInArrow(cut, schema), "blocks"), rotation


def candidates(low: np.ndarray, high: np.ndarray, rotated: np.ndarray) -> np.ndarray:
    """The centroids (rows of ``rotated``) that may be the nearest for a point of the box: the nearest
    that one can be must not be beyond the farthest that another can be."""
    below, above = low - rotated, rotated - high
    least = (np.maximum(0, np.maximum(below, above)) ** 2).sum(axis=1)
    most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=1).min()
    return np.flatnonzero(least * (1 - SLACK) <= most * (1 + SLACK) + SLACK)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest centroid of each vector and its squared distance, in whole numbers."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        x, c = v.astype(float), centroids.astype(float)
        d = ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    else:
        d = np.stack([((v - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(v)), at]


def assigned(batches, dim: int, centroids: np.ndarray, rotation: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of each block: ids, vectors, clusters, distances and how many centroids its box left."""
    rotated = centroids @ rotation
    for b in batches:
        low, high = (matrix(b.column(i), dim) for i in (2, 3))
        for i in range(b.num_rows):
            v = np.frombuffer(b.column(1)[i].as_buffer(), "<i8").reshape(-1, dim)
            some = candidates(low[i], high[i], rotated)
            at, d = nearest(v, centroids[some])
            yield b.column(0)[i].values, v, some[at], d, len(some)


def moved(table: DataFrame, dim: int, centroids: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor of the mean of each cluster's vectors; an empty one stays."""
    k = len(centroids)

    def run(batches):
        n, s = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for _, v, at, _, _ in assigned(batches, dim, centroids, rotation):
            n += np.bincount(at, minlength=k)
            np.add.at(s, at, v)
        some = np.flatnonzero(n)
        flat = pa.array(np.concatenate([n[some, None], s[some]], axis=1).ravel())
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.FixedSizeListArray.from_arrays(flat, dim + 1).cast(pa.list_(pa.int64()))],
                                         names=["cluster", "sums"])

    sums = table.mapInArrow(run, "cluster int, sums array<bigint>").select("cluster", F.posexplode("sums").alias("at", "value"))
    out = [None] * k
    for r in sums.groupBy("cluster", "at").agg(F.sum("value").alias("value")).collect():
        out[r["cluster"]] = out[r["cluster"]] or [0] * (dim + 1)
        out[r["cluster"]][r["at"]] = r["value"]
    means = [c if s is None else [x // s[0] for x in s[1:]] for c, s in zip(centroids.tolist(), out)]
    return np.array(means, dtype=np.int64).reshape(-1, dim)


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = 64, k: int = 40, rounds: int = 5,
            scale: int = 256, salt: str = "2:", block: int = BLOCK) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared, to its centroid), cluster_inertia, inertia (distances
    summed over the cluster and over all) and centroid_sha256 (of the final components, joined by commas).

    Vectors with exactly ``dim`` finite components are kept, as whole numbers floor(``scale`` * x); a null vector
    or one with null, infinite or NaN components gives no row. Start centroids are the vectors of
    the ``k`` smallest hashes of ``salt`` and id (a null id: of ``salt`` alone; equal hashes: by components); fewer vectors
    are fewer centroids. Distances tie to the smaller number. Repeated rows count as often as they occur. An empty
    table gives no rows; other columns are left out. A component of 2^27 or more is an error.
    """
    rows = whole_vectors(df, key, vector, dim, scale)
    kind = rows.schema["vec_id"].dataType
    n, mean, covariance = moments(rows, dim)
    centroids = first_centroids(rows, n, k, salt).reshape(-1, dim)
    table, rotation = blocks(rows, dim, mean, covariance, block)
    for _ in range(rounds):
        centroids = moved(table, dim, centroids, rotation)

    def run(batches):
        for ids, v, at, d, _ in assigned(batches, dim, centroids, rotation):
            yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    schema = T.StructType([T.StructField("vec_id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    out = written(table.mapInArrow(run, schema), "clusters")
    sums = {r["cluster"]: r["d"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    total = sum(sums.values())
    if total >= 1 << 63:
        raise OverflowError("the inertia does not fit 64 bits")
    facts = df.sparkSession.createDataFrame(
        [(c, d, total, ",".join(map(str, centroids[c].tolist()))) for c, d in sums.items()],
        "cluster int, cluster_inertia bigint, inertia bigint, components string")
    return (out.join(F.broadcast(facts), "cluster")  # at most k rows
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                    F.sha2(F.col("components").cast("binary"), 256).alias("centroid_sha256")))
