import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as C  # noqa: E402

import plain  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted toxic words, copies, near copies, benchmark passages and personal data."""
    r = random.Random(12)
    vocabulary = [f"word{i}" for i in range(500)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(f"q{i}x{k}" for k in range(20))) for i in range(5)]
    docs, labels = [], []
    for i in range(700):
        w = text(60)
        bad = i % 5 == 0
        if bad:
            w[r.randrange(60)] = r.choice(["scumbag", "moronic"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    for i in range(700, 730):
        docs.append((i, docs[i - 699][1] + (" tail" if i % 2 else "")))
    for i in range(730, 740):
        docs.append((i, " ".join(text(30)) + " " + items[i % 5][1] + " " + " ".join(text(30))))
    docs += [(740, "write to ann@example.org " + " ".join(text(30))), (741, None), (742, ""), (743, "two words"), (744, None), (None, "no id")]
    docs.append((745, " ".join(text(700)) + " " + " ".join(items[0][1].split()[:13])))
    docs.append((1, docs[1][1]))
    path = str(tmp_path_factory.mktemp("pipeline"))
    rows = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, labels, items


def test_each_stage_does_its_work_on_all_rows(spark, folder):
    path, docs, labels, items = folder
    rows = spark.read.parquet(f"{path}/documents.parquet")
    columns = rows.columns
    stages = dict(C.STAGES)
    assert list(stages) == ["toxicity", "jaccard_join", "decontamination", "personal_data", "byte_bpe"]

    kept = stages["toxicity"](spark, rows, path)
    assert kept.columns == columns
    ids = {x["doc_id"] for x in kept.collect()}
    bad = {i for i, t in labels if t}
    assert not ids & bad and ids >= {i for i, _ in docs} - bad - {i for i in range(700, 730) if i - 699 in bad}

    sample = rows.where("doc_id is null or doc_id % 5 != 0 or doc_id >= 700")
    got = [tuple(x) for x in stages["jaccard_join"](spark, sample, path).select("doc_id", "text").collect()]
    given = [(x["doc_id"], x["text"]) for x in sample.collect()]
    groups = plain.components([g for g in dict(given).items() if g[0] is not None])
    want = [(i, t) for i, t in dict(given).items() if i is None or groups[i][1] == i]
    assert sorted(got, key=str) == sorted(want, key=str)

    got = {x["doc_id"] for x in stages["decontamination"](spark, rows, path).collect()}
    assert {i for i, _ in docs} - got == set(range(730, 740))

    got = {x["doc_id"]: x for x in stages["personal_data"](spark, rows, path).collect()}
    assert got[740]["text"].startswith("write to [EMAIL] ") and got[740]["n_chars"] == len(got[740]["text"])
    assert all(got[i]["text"] == t for i, t in docs if i != 740) and got[741]["n_chars"] is None

    out = stages["byte_bpe"](spark, rows, path)
    assert out.count() == len(docs) and out.where("not round_trip").count() == 0


def test_near_duplicates_go_by_row(spark, make_docs):
    """Rows that only share an id stay; linked rows are reduced to one, without an id too."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(20)) for x in "abcd")
    rows = [(1, a), (1, b), (2, a), (2, c), (3, c), (4, c + " tail"), (None, a), (None, d), (None, d.upper()), (5, None), (5, ""), (None, None), (None, ""),
            (6, "click here to subscribe"), (7, "click here for help")]
    for given in (rows, rows[::-1]):
        got = C.drop_near_duplicates(spark, make_docs(given).repartition(3), "").select("doc_id", "text").collect()
        got = sorted(((x["doc_id"], (x["text"] or "").lower()) for x in got), key=str)
        assert got == sorted([(1, a), (1, b), (2, c), (None, d), (5, ""), (5, ""), (None, ""), (None, ""), (6, rows[-2][1]), (7, rows[-1][1])], key=str)


def test_run_applies_all_stages_and_empty_tables_pass(spark, folder, tmp_path):
    path = folder[0]
    out = C.run(spark, path)
    ids = {x["doc_id"] for x in out.select("doc_id").collect()}
    assert not ids & set(range(0, 700, 5)) and not ids & set(range(730, 740)) and {740, 741, 742, 743, 745, None} <= ids
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_texts_are_not_shuffled_beside_their_numbers(spark, make_docs, monkeypatch):
    made = []
    round_trip = C.byte_bpe.round_trip

    def seen(*a, **b):
        made.append(round_trip(*a, **b))
        return made[0]

    monkeypatch.setattr(C.byte_bpe, "round_trip", seen)
    docs = make_docs([(1, "a b"), (1, "a b"), (2, None), (3, "")]).select("doc_id", "text", *[C.F.lit(None).cast("string").alias(c) for c in ("lang", "source")])
    got = sorted((x["doc_id"], x["n_tokens"], x["round_trip"]) for x in C.tokenize(spark, docs, "").collect())
    assert got == [(1, 2, True), (1, 2, True), (2, 0, True), (3, 0, True)]
    assert "text" not in made[0].columns
    monkeypatch.setattr(C.byte_bpe, "round_trip", lambda *a, **b: round_trip(*a, **b).withColumn("bytes", C.F.lit(b"a c")))
    assert {x["round_trip"] for x in C.tokenize(spark, docs, "").collect()} == {False}
