import random
import re

from pyspark.sql import functions as F

from postrank.llm import decontam

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(text, items, window):
    w = WORDS.findall(lower(text))
    hit, found = set(), set()
    for item, body in items:
        b = WORDS.findall(lower(body))
        n = min(window, len(b))
        for s in range(len(b) - n + 1) if b else ():
            for i in range(len(w) - n + 1):
                if w[i:i + n] == b[s:s + n]:
                    hit.update(range(i, i + n))
                    found.add(item)
    return len(w), len(hit), sorted(found)


def test_scan_equals_brute_force():
    r = random.Random(3)
    for _ in range(300):
        vocabulary = [f"w{i}" for i in range(r.choice((2, 3, 6, 30)))] + ["É", "é"]
        text = lambda n: " ".join(r.choice(vocabulary) for _ in range(r.randint(0, n)))
        window = r.choice((1, 2, 3, 5))
        items = [(str(i), text(12)) for i in range(r.randint(0, 6))]
        docs = [text(40) for _ in range(4)]
        a = decontam.Automaton(items, window)
        got = decontam.scan(a, [d.encode().translate(decontam.NORMAL) for d in docs])
        for d, (n, spans, found) in zip(docs, got):
            assert (n, sum(e - s for s, e in spans), sorted(found)) == plain(d, items, window)


def test_hits_on_edge_rows_and_in_blocks(spark, make_docs, monkeypatch):
    passage = " ".join(f"word{i}" for i in range(20))
    items = spark.createDataFrame([(1, passage), (2, "short one"), (2, "short one"), (None, "nameless item"), (3, None), (4, "")],
                                  "item_id long, text string")
    rows = [(1, None), (2, ""), (3, "lead " + passage.upper() + " tail"), (4, "a Short-One b"), (5, "nameless item"),
            (6, " ".join(["pad"] * 100) + " short one"), (6, " ".join(["pad"] * 100) + " short one"),
            (7, " ".join(f"word{i}" for i in range(12)))]
    docs = make_docs(rows).withColumn("n_hit", F.lit(9))
    want = {i: plain(t, [("1", passage), ("2", "short one"), (None, "nameless item")], 13) for i, t in rows if i != 5}
    for size in (decontam.BLOCK_BYTES, 60):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        found = decontam.hits(docs, items)
        got = {r["doc_id"]: r for r in found.collect()}
        for i, (n, hit, names) in want.items():
            assert (got[i]["n_words"], got[i]["n_hit"], list(got[i]["items"])) == (n, hit, names), i
        assert got[5]["n_hit"] == 2 and got[5]["n_items"] == 0
        assert [i for i, r in sorted(got.items()) if r["contaminated"]] == [3, 4, 5]
    cut = {r["doc_id"]: r["text"] for r in decontam.remove_spans(decontam.hits(docs, items)).collect()}
    assert cut[3] == "lead  tail" and cut[4] == "a Short-One b" and cut[1] is None
    assert decontam.hits(docs.limit(0), items).count() == 0
    assert decontam.hits(docs, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
