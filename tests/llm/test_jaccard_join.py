import random

from pyspark.sql import functions as F

from postrank.llm import jaccard_join as J
from plain import components as plain, shingle_set

def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def near_copies(seed, groups, copies, words, edits):
    r = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{r.randint(0, 10**6)}" for _ in range(r.randint(1, words))]
        for _ in range(r.randint(1, copies)):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w))] = f"x{r.randint(0, 10**6)}"
            if r.random() < 0.3:
                w = w[:max(1, len(w) - r.randint(0, len(w) // 4))]
            out.append(" ".join(w))
    r.shuffle(out)
    return list(enumerate(out))


def test_links_equal_brute_force(spark, make_docs):
    rows = near_copies(1, 60, 12, 120, 4) + [(5000, None), (5001, ""), (5002, " \n "), (5003, "One two"), (5004, "one  TWO")]
    assert got(J.components(make_docs(rows))) == plain(rows)


def test_blocks_and_chains_equal_brute_force(spark, make_docs, monkeypatch):
    """Blocks of a few sets, and chains whose ends are far apart."""
    monkeypatch.setattr(J, "BLOCK", 300)
    monkeypatch.setattr(J, "OFTEN", 2)
    base = [f"w{i}" for i in range(60)]
    chain = [(9000 + k, " ".join([*(f"y{i}" for i in range(k)), *base[k:]])) for k in range(40)]
    rows = near_copies(2, 4, 120, 70, 6) + chain
    assert got(J.components(make_docs(rows))) == plain(rows)


def test_short_texts_count_every_word(spark, make_docs):
    """Texts of one to four words that share all words but one, or their words in another order."""
    texts = ["click here to subscribe", "click here for help", "click here to Subscribe", "here click to subscribe", "click there to subscribe",
             "click here to", "click here for", "here to click", "click here", "here click", "click", "here", "click here to subscribe now"]
    rows = list(enumerate(texts))
    assert got(J.components(make_docs(rows))) == plain(rows)
    for size in (5, 8):  # longer shingles leave longer short texts
        for n in range(1, size):
            words = [f"w{i}" for i in range(n)]
            changed = [" ".join([*words[:i], "other", *words[i + 1:]]) for i in range(n)]
            sets = [tuple(s) for s in J.shingle_sets([" ".join(words), *changed], size)]
            assert all(len(s) == 1 for s in sets) and len(set(sets)) == n + 1


def test_chunks_of_a_few_words(spark, make_docs):
    """Batches of 0 to 5 words in all, and a short text that closes a chunk before a very long one."""
    for n in range(6):
        text = " ".join(f"w{i}" for i in range(n))
        assert [len(s) for s in J.shingle_sets([text])] == [min(n, 1)]
        assert [len(s) for s in J.shingle_sets([None, text, ""])] == [0, min(n, 1), 0]
        assert [len(s) for s in J.shingle_sets([*"a" * n])] == [1] * n
    long = "v" * J.CHUNK + " " + " ".join(f"v{i}" for i in range(9))
    assert [len(s) for s in J.shingle_sets([long, "one two three", long, "one two three"])] == [6, 1, 6, 1]
    assert got(J.components(make_docs([(1, "one two three")]))) == {1: (1, 1)}


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(J.components(docs)) == plain([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_repeated_rows_null_ids_and_clashing_columns(spark, make_docs):
    text = " ".join(f"w{i}" for i in range(30))
    docs = make_docs([(7, text), (7, text), (3, text), (None, text), (None, "alone here"), (9, None), (9, None)])
    rows = J.components(docs.withColumn("component_id", F.lit(1)).withColumn("n", F.lit(1))).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in rows) == [(-1, -1), (-1, 3), (3, 3), (7, 3), (7, 3), (9, 9), (9, 9)]
    assert J.components(docs.limit(0)).count() == 0


def brute_links(rows):
    """doc_id -> number of other rows with a similar set."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    return sorted((i, len(s), sum(k != j and bool(s) and 100 * len(s & o) >= 80 * len(s | o) for j, (_, o) in enumerate(sets)))
                  for k, (i, s) in enumerate(sets))


def test_every_link_counts(spark, make_docs, monkeypatch):
    """All links of groups and chains, of copies and of rows that repeat an id; groups of one block and of several."""
    count = lambda rows: sorted(tuple(r) for r in J.link_counts(make_docs(rows)).collect())
    base = [f"w{i}" for i in range(60)]
    chain = [(9000 + k, " ".join([*(f"y{i}" for i in range(k)), *base[k:]])) for k in range(40)]
    rows = near_copies(3, 30, 12, 120, 1) + chain + [(9100, None), (9101, ""), (9102, "one two"), (9102, "One  two"), (9103, "one two three")]
    assert sum(n for *_, n in brute_links(chain)) > 2 * (len(chain) - 1)  # more than a spanning forest has
    assert count(rows) == brute_links(rows)
    monkeypatch.setattr(J, "BLOCK", 300)
    monkeypatch.setattr(J, "OFTEN", 2)
    rows = near_copies(4, 3, 60, 70, 2) + chain
    assert count(rows) == brute_links(rows)
    assert count([(1, "one two"), (2, "another text")]) == [(1, 1, 0), (2, 1, 0)]


def test_components_of_a_long_path(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(100, 99), (5, 5)]))
    assert {tuple(r) for r in J.connected(edges).collect()} == {(i, 0) for i in range(61)} | {(99, 99), (100, 99)}


def test_sets_without_a_possible_partner_leave_their_group():
    """Against every pair: a set goes only if no other one of the group can be similar to it."""
    import random

    import numpy as np

    r, gone = random.Random(12), 0
    for _ in range(400):
        sets = []
        for _ in range(r.randint(2, 9)):
            n = r.choice((r.randint(1, 12), r.randint(30, 60)))
            at = r.randint(0, J.prefix_length(n) - 1)
            sets.append((n, n - at, ((J.NUM + J.DEN) * (n - at) - J.NUM * n) // J.NUM))
        lengths = sorted({s[0] for s in sets})
        room = [max(s[2] for s in sets if s[0] == n) for n in lengths]
        least = dict(zip(lengths, J.least_rooms(np.array(lengths), np.array(room), np.array([sum(s[0] == n for s in sets) for n in lengths])).tolist()))
        for i, (n, left, own) in enumerate(sets):
            fits = any(J.similar(min(left, b), n, m) for j, (m, b, _) in enumerate(sets) if j != i)
            assert own >= least[n] or not fits
            gone += own < least[n]
    assert gone > 300
