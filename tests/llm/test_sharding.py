import math
import zlib
from hashlib import md5

from pyspark.sql import functions as F

from postrank.llm import sharding as S


def plain(key, node):
    while node.children:
        draws = []
        for c in node.children:
            u = (int(md5(f"{key}|{c.name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            draws.append(-math.log(u) / c.total if c.total else math.inf)
        node = node.children[draws.index(min(draws))]
    return node.shard


def test_shards_slots_and_growth(spark, make_docs):
    rows = [(i, f"text {i} é") for i in range(3000)] + [(None, None), (None, ""), (5, "again"), (5, "again")]
    tree = S.uniform_tree()
    got = S.shard(make_docs(rows).withColumn("shard", F.lit(99)), tree).collect()
    assert len(got) == len(rows)
    for r in got:
        key = "null" if r["doc_id"] is None else str(r["doc_id"])
        assert r["shard"] == plain(key, tree) and r["grown_shard"] == plain(key, S.grow(tree))
        assert r["grown_shard"] in (r["shard"], 8)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[7]["size"] == len("text 7 é".encode()) + 1 and by_id[7]["text_crc32"] == zlib.crc32("text 7 é".encode())
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] is None} == {(1, 0)}
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
        assert 250 < sum(r["shard"] == s for r in got) < 500
    assert S.shard(make_docs([]), tree).count() == 0


def test_a_weight_moves_keys_only_into_its_subtree():
    tree = S.uniform_tree()
    heavy = S.Node("root", children=(tree.children[0], S.Node("region1", children=(
        tree.children[1].children[0], S.Node("region1/rack1", children=(
            tree.children[1].children[1].children[0], S.Node("region1/rack1/shard1", 3.0, shard=7)))))))
    moved = [(a, b) for k in range(3000) if (a := plain(k, tree)) != (b := plain(k, heavy))]
    assert moved and all(b >= 4 for _, b in moved)  # never between shards of region 0
    assert all(b in (6, 7) for a, b in moved if a >= 4)  # inside region 1: only into rack 1
    assert all(b == 7 for a, b in moved if a == 6)


def test_a_shard_without_weight_gets_nothing():
    tree = S.Node("root", children=(S.Node("a", 0.0, shard=0), S.Node("b", 2.0, shard=1)))
    assert {plain(k, tree) for k in range(50)} == {1}
