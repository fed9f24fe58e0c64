import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from postrank.llm import prefix_trie as P

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string"


def plain(rows):
    """Rebuilt conversations and their nodes, one prefix at a time."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    members, children = defaultdict(list), defaultdict(set)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
            if d:
                children[tuple(ts[:d - 1])].add(tuple(ts[:d]))

    def below(node):
        yield node
        for x in children[node]:
            yield from below(x)

    out = []
    for node, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(node))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children[node]),
                    sum(not children[x] for x in below(node)), sum((len(members[x]) - 1) * len(x[-1][1]) for x in below(node) if x),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = P.trie(P.shared_heads(P.sequences(df)), **how)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, out.collect()), key=repr)


def conversations(seed, ids=range(0, 420, 3), most=7):
    rng, rows = random.Random(seed), []
    for c in ids:
        for t in range(rng.randint(1, most)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice("abc") * rng.randint(1, 2) + "é", "x"))
    return rows


@pytest.mark.parametrize("limit", [3, 40, 100_000])
def test_equals_plain_nodes_at_every_shard_size(spark, limit):
    rows = conversations(1) + [(1000 + i, t, "user", f"t{t}", "copy") for i in range(60) for t in range(8)]
    rows += [(None, 0, "user", "nobody", "x"), (700, None, "user", "no turn", "x"), (700, 1, None, None, "x"), (700, 2, "user", "", "x"),
             (701, 0, "user", "again", "x"), (701, 0, "user", "again", "x"), (701, 0, "assistant", "tie", "x"), (702, None, None, None, "x"),
             (-105, 0, "user", "below zero", "x"), (-100, 0, "user", "base", "x"), (-100, 1, "user", "base 1", "x")]
    rows += [(3000 + i, t, "user", f"long {t}", "x") for i in (0, 1) for t in range(300)]
    assert found(spark, rows, shard=limit, least=3) == plain(rows)


def test_turnless_and_missing_conversations(spark):
    one = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 3)
    rows = [(one, 0, "user", "only", "x")]  # its first turn is gone, and there is no conversation 0
    assert found(spark, rows) == plain(rows) == [(one, 0, None, 1, 0, 1, 0, hashlib.sha256(str(one).encode()).hexdigest())]
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x", "x")]) == []


def test_very_long_texts_and_extra_columns(spark):
    rows = [(0, 0, "user", "word " * 300_000, "x"), (0, 1, "user", "b", "x"), (1, 0, "user", "word " * 300_000, "y")]
    assert found(spark, rows) == plain(rows)


def test_double_array_finds_what_was_added_and_nothing_else():
    rng = np.random.default_rng(9)
    turns, lengths = rng.integers(1, 30, 3000), rng.integers(0, 12, 400)
    starts = rng.integers(0, 2900, 400)
    shard = np.sort(rng.integers(0, 9, 400))
    shard = np.unique(shard, return_inverse=True)[1]
    array, walked = P.packed(shard, starts, lengths, turns)
    at = {}
    for level, (alive, states) in enumerate(walked):
        for i, s in zip(alive.tolist(), states.tolist()):
            assert s > 0 and at.setdefault(s, (shard[i], *turns[starts[i]:starts[i] + level])) == (shard[i], *turns[starts[i]:starts[i] + level])
    assert len(set(at.values())) == len(at) == (array.check[:array.top] >= 0).sum() - 1
    states, ids = map(np.array, zip(*((s, t) for s in at for t in range(1, 30))))
    got = array.step(states, ids)
    wanted = {v: s for s, v in at.items()}
    assert got.tolist() == [wanted.get((*at[s], t), -1) for s, t in zip(states.tolist(), ids.tolist())]
    assert len(at) / array.top > 0.9  # the arrays are dense


def test_ids_of_a_large_group_travel_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(P, "IDS", 7)
    rows = [(f"k{i % 3}", i * 37 % 1009) for i in range(1009)]
    got = dict(map(tuple, P.member_digests(spark.createDataFrame(rows, "key string, conv_id bigint").repartition(5)).collect()))
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(c for x, c in rows if x == k))).encode()).hexdigest() for k in ("k0", "k1", "k2")}
