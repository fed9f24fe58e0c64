import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postrank.llm import centroids as C

SCHEMA = "vec_id bigint, embedding array<double>, cluster string"


def plain(rows, dim, k, rounds):
    """Lloyd's rounds in whole numbers, one vector at a time."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centers = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(centers)), key=lambda c: (dist(v, centers[c]), c))
    for _ in range(rounds):
        at = [near(v) for _, v in kept]
        for c in range(len(centers)):
            if members := [v for (_, v), a in zip(kept, at) if a == c]:
                centers[c] = [sum(x) // len(members) for x in zip(*members)]
    out = [(i, near(v), dist(v, centers[near(v)])) for i, v in kept]
    per = {c: sum(d for _, a, d in out if a == c) for c in range(len(centers))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, d, per[c], sum(per.values()), sha[c]) for i, c, d in out), key=repr)


def found(df, **how):
    out = C.cluster(df, **how)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, out.collect()), key=repr)


def test_equals_plain_rounds_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 2, (6, 5))
    rows = [(i, (centers[i % 6] + rng.normal(0, .2, 5)).tolist(), "x") for i in range(150)]
    rows += [(200 + i, rows[3][1], "copy") for i in range(90)]  # a large group of copies
    rows += [(7, rows[7][1], "again"), (7, rows[7][1], "again"), (None, rows[9][1], None), (None, rows[10][1], None)]
    rows += [(300, None, "x"), (301, [1.0, None, 0.0, 0.0, 0.0], "x"), (302, [math.nan] * 5, "x"), (303, [math.inf] * 5, "x"),
             (304, [1.0] * 4, "x"), (305, [1.0] * 6, "x"), (306, [], "x")]
    for block in (7, 256):
        got = found(spark.createDataFrame(rows, SCHEMA).repartition(3), dim=5, k=8, rounds=3, block=block)
        assert got == plain(rows, 5, 8, 3)


def test_fewer_vectors_than_centroids_ties_and_an_empty_table(spark):
    rows = [(1, [0.0, 0.0], "a"), (2, [0.0, 0.0], "b"), (3, [1.0, 0.0], "c")]
    assert found(spark.createDataFrame(rows, SCHEMA), dim=2, k=5, rounds=2) == plain(rows, 2, 5, 2)
    assert found(spark.createDataFrame([], SCHEMA), dim=2, k=5, rounds=2) == []
    assert found(spark.createDataFrame([(1, None, "a")], SCHEMA), dim=2) == []


def test_large_components_stay_exact_and_too_large_ones_are_an_error(spark):
    rows = [(i, [(i * 7919 % 101 - 50) * 9973.0, i * 3001.0], "a") for i in range(60)]
    assert max(abs(256 * x) for _, v, _ in rows for x in v) > C.EXACT
    assert found(spark.createDataFrame(rows, SCHEMA), dim=2, k=4, rounds=2, block=9) == plain(rows, 2, 4, 2)
    with pytest.raises(Exception, match="do not fit 64 bits"):
        found(spark.createDataFrame([(1, [1e12, 0.0], "a")], SCHEMA), dim=2)


def test_the_curve_visits_every_cell_by_single_steps():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = np.argsort(C.hilbert(cells, 3))
    assert sorted(C.hilbert(cells, 3).tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_boxes_leave_out_only_centroids_that_cannot_be_nearest():
    rng = np.random.default_rng(2)
    left = []
    for _ in range(200):
        centers, middle = rng.normal(0, 3, (12, 4)), rng.normal(0, 3, 4)
        v = middle + rng.normal(0, .3, (50, 4))
        some = C.candidates(v.min(axis=0), v.max(axis=0), centers)
        assert set(((v[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)) <= set(some.tolist())
        left.append(len(some))
    assert np.mean(left) < 6  # and they do leave out some


def test_blocks_hold_all_vectors_once(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, (rng.integers(-500, 500, 3)).tolist()) for i in range(500)], "vec_id bigint, v array<bigint>")
    n, mean, covariance = C.moments(rows, 3)
    table, _ = C.blocks(rows, 3, mean, covariance, 32)
    assert n == 500 and sorted(r[0] for r in table.select(F.explode("ids")).collect()) == list(range(500))
    assert table.agg(F.max(F.size("ids"))).first()[0] == 32
