import random
import re

from pyspark.sql import functions as F

from postrank.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i:i + 8]), []).append(i)
    repeated = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated),
            n < 20 or 100 * len(repeated) > 30 * n)


def test_statistics_equal_a_plain_pass(spark, make_docs):
    r = random.Random(6)
    texts = [None, "", " \t\x0b\x0c\r\n", "a" * 100_000, "x " * 30, "one two three four five six seven eight " * 2, "  　 é😀"]
    for _ in range(120):
        texts.append("".join(r.choice(["a ", "b ", "c d ", "\n", "#", "<|", "e\t", "é\n"]) for _ in range(r.randint(1, 80))))
    texts += [texts[9], texts[9]]
    docs = make_docs(list(enumerate(texts))).withColumn("n_words", F.lit("clash"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for row in Q.apply(docs, []).collect():
        assert tuple(row[c] for c in names) == plain(row["text"]), row["text"]
        assert row["kept"] == (not row["base_failed"]) and row["rule"] == 0
    assert Q.apply(docs.limit(0), []).count() == 0


def test_learns_planted_thresholds():
    r = random.Random(9)
    rows, low = [], []
    for _ in range(3000):
        x = (r.randint(20, 500), r.uniform(3, 8), r.choice([0.0, 0.0, r.uniform(0, 0.2)]), 0.0, 0.0, r.uniform(0.2, 1))
        rows.append(x)
        low.append(x[2] > 0.1 or (x[5] < 0.3 and x[0] > 100))
    rules = Q.learn(rows, low)
    value = {f: i for i, f in enumerate(Q.FEATURES)}

    def holds(rule, x):
        return all((x[value[c.feature]] > c.cut) == c.above for c in rule.conditions)

    got = [any(holds(rule, x) for rule in rules) for x in rows]
    assert sum(g == w for g, w in zip(got, low)) > 0.95 * len(rows)
    assert sum(g and not w for g, w in zip(got, low)) < 0.03 * len(rows)
    assert Q.learn([], []) == [] and Q.learn(rows, [False] * len(rows)) == []


def test_rules_on_documents_are_native_and_keep_good_ones(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = Q.apply(docs, Q.fit(docs, labels.union(labels.limit(0))))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
    got = out.join(labels, "doc_id").where(~F.col("base_failed")).groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    assert n.get((0, False), 0) >= 0.8 * (n.get((0, False), 0) + n.get((0, True), 0))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.fit(docs, none) == []
