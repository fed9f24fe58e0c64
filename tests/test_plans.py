"""Split exactness, streaming equals batch, driver contract and plan shape."""

from pyspark.sql import functions as F

from fixtures import SF
from postrank.operators.dataset import check_split, global_rank, temporal_split
from postrank.plans import stages as G
from postrank.sources import adapters as A


def test_temporal_split_sizes_and_order(spark):
    ep = A.event_posts(spark, SF)
    n = ep.count()
    sp = temporal_split(ep)
    c = {r.split: r["count"] for r in sp.groupBy("split").count().collect()}
    assert c["train"] == int(n * 0.70) and c["train"] + c["val"] == int(n * 0.85) and sum(c.values()) == n
    assert check_split(sp).first().ordered


def test_global_rank_is_exact(spark):
    ep = A.event_posts(spark, SF)
    r = global_rank(ep, ["posted_at_local", "post_id"], "rk").select("post_id", "rk").collect()
    got = [x.post_id for x in sorted(r, key=lambda x: x.rk)]
    want = [x.post_id for x in ep.orderBy("posted_at_local", "post_id").select("post_id").collect()]
    assert got == want and sorted(x.rk for x in r) == list(range(1, len(r) + 1))


def test_no_single_partition_exchange_on_posts(spark):
    from postrank.operators.labels import engagement_index
    plan = engagement_index(A.event_posts(spark, SF))._jdf.queryExecution().executedPlan().toString()
    # the min / max are partial aggregates: only their one-row results may meet in one partition
    assert "Window" not in plan


def test_stream_equals_batch_over_restarts_and_many_batches(spark):
    """More micro-batches than the query keeps progress of, in two runs over one checkpoint."""
    import tempfile
    from postrank.operators.posts import filter_communities
    from postrank.streaming.collect import collected, progress_counts, start_collect
    d = tempfile.mkdtemp(prefix="postrank-stream-")
    raw = G.raw(spark, SF)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        for part in range(2):
            raw.filter(F.col("post_id") % 2 == part).repartition(4).write.mode("append").parquet(f"{d}/src")
            q = start_collect(spark, f"{d}/src", f"{d}/out", f"{d}/ckpt", f"{d}/progress", max_files_per_trigger=1)
            q.awaitTermination()
            assert len(q.recentProgress) <= 2
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    out, batch = collected(spark, f"{d}/out"), filter_communities(raw)
    assert out.columns == raw.columns and out.count() == batch.count()
    assert out.select("post_id").subtract(batch.select("post_id")).count() == 0
    assert tuple(progress_counts(spark, f"{d}/progress").first()) == (raw.count(), batch.count())


def test_segments_with_a_missing_key_are_in_every_serving_table(spark):
    from postrank.operators.segments import KEYS
    t = G.serving(spark, SF)
    keys = {n: {tuple(r) for r in df.select(*KEYS).distinct().collect()} for n, df in t.items()}
    assert keys["model_metadata"] == keys["optimal_ranges"] == keys["predictions"]
    assert any(None in k for k in keys["predictions"])
    missing = t["model_metadata"].filter("has_media is null and category = 'ALL' and engagement_mechanism = 'ALL'").first()
    assert missing.sample_size > 0 and missing.test_rmse is not None


def test_rows_with_a_missing_feature_are_scored(spark):
    from pyspark.ml import Pipeline
    from postrank.operators import model as M
    ms = G.model_split(spark, SF)
    holes = ms.withColumn("readability", F.when(F.col("post_id") % 3 != 0, F.col("readability")))
    data = M.prepare(holes)
    assert data.filter(F.col("readability") == M.MISSING).count() >= ms.filter("post_id % 3 = 0").count() > 0
    assert Pipeline(stages=M.assemble_stages()).fit(data).transform(data).count() == ms.count()


def test_numbers_have_no_thousands_separator(spark):
    from postrank.functions.format import fmt_fixed
    got = spark.createDataFrame([(-1234.5,), (0.125,), (2.675,), (1e6,)], "x double").select(fmt_fixed(F.col("x"), 2).alias("t"))
    assert [r.t for r in got.collect()] == [f"{x:.2f}" for x in (-1234.5, 0.125, 2.675, 1e6)]


def test_recommendations_are_ranked_with_a_missing_score_as_zero(spark):
    from postrank.operators.recommend import rank_items
    items = [("a", None), ("b", 2.0), ("c", 0.0), ("d", float("nan")), ("e", 5.0), ("f", -1.0)]
    df = spark.createDataFrame([(items,)], "x array<struct<subreddit:string,predicted_score:double>>")
    got = df.select(rank_items(F.col("x")).alias("x")).first().x
    assert [(r.subreddit, r["rank"]) for r in got] == [("e", 1), ("b", 2), ("a", 3), ("c", 4), ("d", 5), ("f", 6)]


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "subreddit" in df.columns
    qs, ors = E.queries(), E.oracle_sql()
    assert set(ors) <= set(qs)


def test_checked_join_falls_back_to_shuffle(spark):
    from postrank.operators.joins import join_checked
    big = spark.range(0, 2000).withColumn("k", F.col("id") % 7)
    small = spark.range(0, 7).withColumnRenamed("id", "k").withColumn("v", F.col("k") * 10)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # only our own decision counts here
    try:
        a = join_checked(big, small, "k", "left")
        b = join_checked(big, small, "k", "left", max_rows=0)
        plan_a = a._jdf.queryExecution().executedPlan().toString()
        plan_b = b._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan_a and "BroadcastHashJoin" not in plan_b
        assert sorted(a.collect()) == sorted(b.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_recommend_streams_requests_through_broadcasts(spark):
    from fixtures import contract_tables, requests
    from postrank.operators import recommend as R
    meta, preds, ranges = contract_tables(spark)
    req = requests(spark, [("Food & Cooking", None, "question", "technical")] * 3)
    plan = R.recommend(req, meta, preds, ranges)._jdf.queryExecution().executedPlan().toString()
    # only the facts, one row per segment, may be joined by a shuffle; requests never are
    shuffled = [x for x in plan.split("\n") if "SortMergeJoin" in x or "ShuffledHashJoin" in x]
    assert all("_right_" in x for x in shuffled)
    assert plan.count("BroadcastHashJoin") >= 10


def test_prediction_grid_against_brute_force(spark):
    """M7 on the ALL/ALL/ALL segment equals a direct pandas computation."""
    import itertools

    from postrank.operators.segments import prediction_grid
    lab = G.event_labelled(spark, SF).select("subreddit", "hour_of_day", "day_of_week", "virality_index",
                                              "category", "has_media", "engagement_mechanism")
    pdf = lab.toPandas()
    got = {(r.subreddit, r.hour_of_day, r.day_of_week): r.predicted_viral_score for r in
           prediction_grid(lab).filter("category = 'ALL' AND has_media = 'ALL' AND engagement_mechanism = 'ALL'")
           .collect()}
    comm = pdf.groupby("subreddit")["virality_index"].mean()
    cell = pdf.groupby(["subreddit", "hour_of_day", "day_of_week"])["virality_index"].agg(["sum", "count"])
    assert len(got) == len(comm) * 168
    for sub, h, d in itertools.product(comm.index, range(24), range(7)):
        s, n = (cell.loc[(sub, h, d)].tolist() if (sub, h, d) in cell.index else (0.0, 0))
        want = min(max((s + 5.0 * comm[sub]) / (n + 5.0), 0.0), 100.0)
        assert abs(got[(sub, h, d)] - want) < 1e-9


def test_optimal_ranges_against_brute_force(spark):
    import numpy as np

    from postrank.operators.segments import optimal_ranges
    lab = G.event_labelled(spark, SF)
    row = optimal_ranges(lab).filter("category = 'ALL' AND has_media = 'ALL' AND engagement_mechanism = 'ALL'") \
        .first()
    pdf = lab.select("virality_index", "hour_of_day", "day_of_week").toPandas()
    y = pdf["virality_index"].round(2)
    top = pdf[y >= np.percentile(y, 75)]
    for f in ("hour_of_day", "day_of_week"):
        assert abs(row[f"{f}_opt_min"] - np.percentile(top[f], 25)) < 1e-9
        assert abs(row[f"{f}_opt_max"] - np.percentile(top[f], 75)) < 1e-9
    assert row["title_length_opt_min"] is None


def test_segment_ridge_recovers_linear_label(spark):
    import random

    from postrank.dims import EMOTIONS
    from postrank.operators.model import segment_models
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        h, d, t = rnd.randrange(24), rnd.randrange(7), rnd.randrange(1, 40)
        y = 10.0 + 1.5 * h + 2.0 * d + 0.5 * t
        rows.append((i, y, h, d, i % 2 == 0, t * 3, 0.1, *[0.0] * 8, 50.0, t, t * 2,
                     f"c{i % 5}", "Gaming", "statement", ["train", "val", "test"][i % 3]))
    schema = ("post_id long, virality_index double, hour_of_day int, day_of_week int, has_media boolean, "
              "post_length_proxy long, vader_compound double, " + ", ".join(f"nrc_{e} double" for e in EMOTIONS)
              + ", readability double, title_length int, body_length int, subreddit string, category string, "
              "engagement_mechanism string, split string")
    m = segment_models(spark.createDataFrame(rows, schema), lam=1e-6)
    g = m.filter("category = 'ALL' AND has_media = 'ALL' AND engagement_mechanism = 'ALL'").first()
    assert g.sample_size == 600 and g.test_r2 > 0.999 and g.test_rmse < 0.1
    assert g.hour_of_day_shap > g.nrc_joy_shap


def test_split_with_hot_timestamp(spark):
    """A third of the rows share one timestamp: the rank stays exact (ties by post_id)."""
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base if i % 3 == 0 else base + dt.timedelta(minutes=i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "post_id long, posted_at_local timestamp_ntz")
    sp = temporal_split(df)
    c = {r.split: r["count"] for r in sp.groupBy("split").count().collect()}
    assert (c["train"], c["val"], c["test"]) == (2100, 450, 450)
    want = [r.post_id for r in df.orderBy("posted_at_local", "post_id").collect()]
    got = {r.post_id: r.split for r in sp.collect()}
    assert [got[p] for p in want] == ["train"] * 2100 + ["val"] * 450 + ["test"] * 450


def test_gbt_permutation_importance_finds_the_signal(spark):
    import random

    from postrank.dims import EMOTIONS
    from postrank.operators.model import permutation_importance, train_gbt
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        h = rnd.randrange(24)
        rows.append((i, 4.0 * h + rnd.random(), h, rnd.randrange(7), i % 2 == 0, rnd.randrange(50), 0.0,
                     *[rnd.random() for _ in EMOTIONS], 50.0, rnd.randrange(20), rnd.randrange(20),
                     f"c{i % 4}", "Gaming", "statement", ["train", "train", "val", "test"][i % 4]))
    schema = ("post_id long, virality_index double, hour_of_day int, day_of_week int, has_media boolean, "
              "post_length_proxy long, vader_compound double, " + ", ".join(f"nrc_{e} double" for e in EMOTIONS)
              + ", readability double, title_length int, body_length int, subreddit string, category string, "
              "engagement_mechanism string, split string")
    df = spark.createDataFrame(rows, schema)
    model = train_gbt(df, max_iter=15, max_depth=3, step=0.3)
    imp = {r.feature: r.importance for r in
           permutation_importance(model, df.filter("split = 'test'")).collect()}
    assert max(imp, key=imp.get) == "hour_of_day" and imp["hour_of_day"] > 0.5
    assert abs(imp["nrc_joy"]) < 0.1


def test_stream_source_files_follow_the_documents(spark, monkeypatch):
    """More documents make more files, not larger ones, and still a few micro-batches."""
    import os
    import tempfile

    from postrank.plans import catalog as C
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.range(90).select(F.col("id").alias("doc_id"), F.lit("One. two").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("src"), F.col("id") % 20).alias("source")).write.parquet(f"{d}/documents.parquet")
    spark.range(90).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"),
                           F.lit(2.0).alias("value")).write.parquet(f"{d}/events.parquet")
    monkeypatch.setattr(C, "STREAM_FILE_ROWS", 10)
    run = C._stream_run(spark, d)
    source, run = (p.removeprefix("file:") for p in (C._scratch(spark, d, "s_source"), run))
    assert sum(f.endswith(".parquet") for f in os.listdir(source)) == 9
    assert len([f for f in os.listdir(f"{run}/progress") if f.startswith("batch=")]) == 3
    assert spark.read.parquet(f"{run}/progress/batch=*").agg(F.sum("checked")).first()[0] == 90
