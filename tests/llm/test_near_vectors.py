import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postrank.llm import near_vectors as N

SCHEMA = "vec_id bigint, embedding array<double>, kept string"


def plain(rows, threshold=0.95):
    """All pairs, then the smallest id that links reach."""
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, float) / max(abs(y) for y in v)
        return x / np.sqrt((x * x).sum())

    u, n = [unit(r[1]) for r in rows], len(rows)
    near = [[j for j in range(n) if j != i and u[i] is not None and u[j] is not None and len(u[i]) == len(u[j])
             and float(u[i] @ u[j]) >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, stack = {i}, [i]
        while stack:
            for j in near[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), low, rows[i][0] is not None and rows[i][0] == low))
    return sorted(out, key=repr)


def found(spark, rows, **how):
    out = N.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), **how)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, out.collect()), key=repr)


def planted(rng, n=240, dim=24):
    rows = [(i, rng.normal(size=dim).tolist(), "x") for i in range(n)]
    at = n
    for i in range(0, 60, 3):  # chains and groups of near copies
        v = np.array(rows[i][1])
        for _ in range(1 + i % 4):
            v = v + rng.normal(size=dim) * 0.05 * np.linalg.norm(v) / math.sqrt(dim)
            rows.append((at, v.tolist(), "near"))
            at += 1
    return rows


def test_equals_all_pairs_with_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = planted(rng)
    rows += [(1000 + i, rows[5][1], "copy") for i in range(40)] + [(8, rows[8][1], "again"), (8, [-x for x in rows[8][1]], "other way")]
    rows += [(1100, [x * 1e200 for x in rows[9][1]], "huge"), (1101, [x * 1e-200 for x in rows[9][1]], "tiny")]
    rows += [(2000, None, "x"), (2001, [], "x"), (2002, [0.0] * 24, "x"), (2003, [None] + [1.0] * 23, "x"), (2004, [math.nan] + [1.0] * 23, "x"),
             (2005, [math.inf] + [1.0] * 23, "x"), (2006, [1.0, 2.0], "short"), (2007, [2.0, 4.0], "short"), (2008, [1.0, -2.0], "short")]
    rows += [(None, rows[0][1], "x"), (None, [9.0, 9.0, 1.0], "x"), (None, [9.0, 9.0, 1.1], "x"), (None, None, "x")]
    assert found(spark, rows) == plain(rows)


def test_large_buckets_are_compared_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = rng.normal(size=24)
    rows = planted(rng, 60) + [(5000 + i, (base + rng.normal(size=24) * 0.02).tolist(), "hot") for i in range(90)]
    got = found(spark, rows)
    assert got == plain(rows) and max(r[1] for r in got) >= 89


def test_an_empty_table_and_one_without_links(spark):
    assert found(spark, []) == []
    rows = [(1, [1.0, 0.0], "x"), (2, [0.0, 1.0], "x"), (3, None, "x")]
    assert found(spark, rows) == plain(rows)


def test_pairs_at_the_threshold_share_a_table_and_pass_the_sieve(spark):
    """Just above 0.95, where most would be missed: at least 0.99 are found; just below, none are linked."""
    rng = np.random.default_rng(6)
    rows, wanted = [], 0
    for i in range(0, 800, 2):
        a = rng.normal(size=32)
        a /= np.linalg.norm(a)
        b = rng.normal(size=32)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.9501 if i % 4 else 0.9499
        rows += [(i, a.tolist(), "x"), (i + 1, (c * a + math.sqrt(1 - c * c) * b).tolist(), "x")]
        wanted += 2 * (c > 0.95)
    got = found(spark, rows)
    assert sum(r[1] for r in got if r[0] % 4 < 2) == 0 and sum(r[1] for r in got) >= 0.99 * wanted


@pytest.mark.parametrize("n", [0, 500, 50_000, 10**9])
def test_design_keeps_the_miss_at_every_size(n):
    bits, tables = N.design(n)
    same = (1 - math.acos(0.95) / math.pi) ** bits
    assert (1 - same) ** tables <= N.MISS and n / 2**bits <= N.BUCKET


def test_forest_joins_what_is_linked():
    rng = np.random.default_rng(7)
    for same in (True, False):
        linked = rng.random((30, 30)) < 0.04
        left, right = np.arange(30), np.arange(30) if same else np.arange(30, 60)
        if same:
            linked |= linked.T
            np.fill_diagonal(linked, False)
            right = left
        pairs = {(int(left[i]), int(right[j])) for i, j in zip(*np.nonzero(linked))}
        edges = list(N.forest(linked, left, right))

        def components(pairs):
            up = list(range(60))

            def find(i):
                while up[i] != i:
                    i = up[i]
                return i
            for a, b in pairs:
                up[find(a)] = find(b)
            return {tuple(i for i in range(60) if find(i) == r) for r in set(map(find, range(60)))}

        assert components(edges) == components(pairs) and len(edges) == 60 - len(components(pairs))


def test_sketch_travels_in_the_vectors_place(spark):
    rows = spark.createDataFrame(planted(np.random.default_rng(8)), SCHEMA)
    packed = N.packed_rows(rows, "vec_id", "embedding").select(F.col("vec_id").alias("cid"), "v", F.lit(24).alias("dim"))
    classes = N.hashed(packed, 8, 5, 1)
    assert N.units(classes).columns == ["bucket", "b1", "b2", "block", "cid", "s1", "s2"]
    assert N.sieve(N.units(classes), N.allowance()).select("cid").distinct().count() < 150  # unrelated vectors are not shipped
