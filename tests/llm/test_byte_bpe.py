import hashlib
import random

import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from postrank.llm import byte_bpe  # noqa: E402
from postrank.llm.common import let  # noqa: E402


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary(byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_merges_equal_the_library(vocabulary, library):
    r = random.Random(1)
    for _ in range(300):
        word = "".join(r.choice("abeinrst") for _ in range(r.randint(1, 60)))
        want = library.encode_ordinary(word)
        assert byte_bpe.heap_merge(word.encode(), vocabulary.ranks) == want
        assert byte_bpe.list_merge(word.encode(), vocabulary.ranks) == want


def test_fold_equals_the_library(spark, vocabulary, library):
    r = random.Random(3)
    words = ["a", "ab", " the", "unabhängigkeit", "日本", "😀", "\x00", *("".join(r.choice("abeinrst é") for _ in range(12)) for _ in range(60))]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    out = rows.select("w", let(vocabulary.table.literal(), lambda t: byte_bpe.fold(F.col("w"), vocabulary, t)).alias("ids"))
    for x in out.collect():
        assert list(x["ids"]) == library._encode_single_piece(x["w"]), x["w"]


@pytest.mark.parametrize("size", [0, 50])
def test_ids_equal_the_library_and_round_trip(spark, make_docs, vocabulary, library, size):
    r = random.Random(2)
    texts = ["", "a", "Hello  world\n\n x ", "it's 12345 <|endoftext|>!!", "\x85b  c　 d", "é日本語 😀😀 ñandú", " " * 300 + "x",
             "z" * 900 + " ok", "don't'll 'S", "\r\n\t tab", "unabhängigkeitserklärungen", "\u0000nul",
             *("".join(r.choice("abeinrst é!1") for _ in range(60)) for _ in range(30))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(99, None), (1, "a")]
    docs = make_docs(rows).withColumn("ids", F.lit("clash"))
    back = byte_bpe.decode(byte_bpe.encode(docs, vocabulary, size=size, packed=True).withColumn("bytes", F.lit(0)), vocabulary)
    arrays = byte_bpe.encode(back.withColumnRenamed("ids", "le"), vocabulary, size=size)
    got = arrays.select("doc_id", "text", "ids", "le", F.col("bytes").alias("back")).collect()
    assert len(got) == len(rows)
    for x in got:
        ids = library.encode_ordinary(x["text"] or "")
        assert list(x["ids"]) == ids, x["text"]
        assert bytes(x["back"]).decode() == (x["text"] or "")
        assert bytes(x["le"]) == b"".join(i.to_bytes(4, "little") for i in ids)
    both = byte_bpe.round_trip(docs.withColumn("bytes", F.lit(0)), vocabulary, size=size).collect()
    assert sorted((x["text"] or "", bytes(x["ids"]), bytes(x["bytes"])) for x in both) == sorted((x["text"] or "", bytes(x["le"]), bytes(x["back"])) for x in got)
    assert byte_bpe.encode(docs.limit(0), vocabulary).count() == 0


def test_every_distinct_word_is_folded(spark, vocabulary, library):
    r = random.Random(4)
    rare = [" " + "".join(r.choice("abeinrst") for _ in range(n)) for n in (33, 40, 60, 1000)] + [f" rare{i}x" for i in range(50)]
    texts = [(f"the{w} the",) for w in rare] + [(None,), ("",), (" once" + "z" * byte_bpe.LONG,)]
    rows = byte_bpe.folded_words(spark.createDataFrame(texts, "text string").coalesce(1), vocabulary).collect()
    words = sorted({p for t, in texts if t for p in byte_bpe.Splitter(P.PATTERN)(t) if len(p) <= byte_bpe.LONG})
    assert len({x["block"] for x in rows}) == 1
    assert sum(len(x["numbers"]) for x in rows) == len({n for x in rows for n in x["numbers"]}) == len(words)
    found = []
    for x in rows:
        ids = [int.from_bytes(x["ids"][i:i + vocabulary.width]) for i in range(0, len(x["ids"]), vocabulary.width)]
        for n in x["sizes"]:
            found.append(tuple(ids[:n]))
            del ids[:n]
        assert not ids
    assert sorted(found) == sorted(tuple(library._encode_single_piece(w)) for w in words)


def test_words_beyond_the_fold_and_blocks_equal_the_library(spark, make_docs, library, vocabulary):
    r = random.Random(5)
    long = ["".join(r.choice("abeinrst") for _ in range(n)) for n in (byte_bpe.LONG - 1, byte_bpe.LONG, byte_bpe.LONG + 1, 5000)]
    texts = [None, "", *long, "é" * byte_bpe.LONG, long[3] + " the " + long[3], "z" * 40000]
    docs = make_docs([(i // 2, t) for i, t in enumerate(texts)]).coalesce(1)
    for size in (2, byte_bpe.BLOCK):
        got = byte_bpe.round_trip(docs, vocabulary, size=size, keep=["doc_id"])
        assert got.columns == ["doc_id", "ids", "bytes"]
        want = [(i // 2, b"".join(k.to_bytes(4, "little") for k in library.encode_ordinary(t or "")), (t or "").encode()) for i, t in enumerate(texts)]
        assert sorted((x[0], bytes(x[1]), bytes(x[2])) for x in got.collect()) == sorted(want)


def test_rows_in_another_order_are_an_error():
    import numpy as np

    words = byte_bpe.Words(1, 2)
    words.add(np.array([1, 0], np.int32), np.array([1, 2], np.int32), bytes([0, 7, 1, 0, 0, 9]))
    assert words.ids(np.array([0, 1, 0])).tolist() == [256, 9, 7, 256, 9]
    with pytest.raises(RuntimeError):
        words.ids(np.array([0, 2]))
    with pytest.raises(RuntimeError):
        byte_bpe.Words(2, 2).ids(np.array([0]))


def test_documents_equal_the_library(spark, library):
    from postrank.llm.queries import op10_byte_bpe

    sf = "/root/testdata/sf0.001"
    texts = dict(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    for r in op10_byte_bpe(spark, sf).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_fold_of_a_vocabulary_with_unreachable_entries_and_wide_ids(spark):
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 0xD800 - 1, b"ab": 0xD800, b"abcd": 70000, b"xyz": 0xE000, b"cd": 256}
    v, own = byte_bpe.Vocabulary(ranks, P.PATTERN), tiktoken.Encoding("small", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert v.width == 4 and len(v.whole) == 1
    words = ["xyz", "xyzx", "abcd", "abc", "aabcab", "\x00", "a\x00b", "é", "bcd", "d" * 5, "ab" * 9]
    docs = spark.createDataFrame(list(enumerate([*words, " ".join(words)])), "doc_id int, text string").coalesce(1)
    folded = spark.createDataFrame([(w,) for w in words], "w string").select(
        "w", let(v.table.literal(), lambda t: byte_bpe.fold(F.col("w"), v, t)).alias("ids"))
    for x in folded.collect():
        assert list(x["ids"]) == own._encode_single_piece(x["w"]), x["w"]
    for x in byte_bpe.encode(docs, v).collect():
        assert list(x["ids"]) == own.encode_ordinary(x["text"]), x["text"]
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary({b"a": 0}, P.PATTERN)


def test_blocks_hold_no_batch_and_are_let_go(monkeypatch):
    import pyarrow as pa

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(byte_bpe, "TaskContext", Task)
    kept = pa.StructArray.from_arrays([pa.array([f"{i:04}" * 50 for i in range(1000)])], ["k"])
    batch = pa.RecordBatch.from_arrays([kept, pa.array([f"w{i}" for i in range(1000)])], names=["kept", "text"])
    seen = []
    for block in byte_bpe.blocks(iter([batch, batch]), str.split, 99, packed=True):
        for rows in block.kept:
            seen += [x["k"] for x in rows.to_pylist()]
            assert rows.get_total_buffer_size() < 2 * rows.nbytes + 1000 < kept.nbytes / 4
        block.clear()
        assert not block.numbers and not block.codes and not block.kept
    assert seen == [x["k"] for x in kept.to_pylist()] * 2
