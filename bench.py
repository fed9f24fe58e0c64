"""Benchmark the headline queries.

Runs each headline job over the whole tables of ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": ..., "value": total seconds, "unit": "sec", "queries": {...}, "sf": ...}.
Each job is forced with a no-op write (every row computed, nothing collected to the
driver). An untimed run over the smallest tables warms the JVM up; the shared
stages are written before the jobs that read them and timed on their own.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postrank.operators import dataset as DS  # noqa: E402
from postrank.plans import catalog as C  # noqa: E402
from postrank.plans import stages as G  # noqa: E402
from postrank.session import get_spark  # noqa: E402


def registered(name: str):
    return lambda spark, sf: C.QUERIES[name](spark, sf)


HEADLINE = [
    ("processed_posts", lambda spark, sf: G.processed(spark, sf)),  # written here, read by later jobs
    ("engagement_index", registered("h33_engagement_index")),
    ("segment_cube", registered("d17_segment_cube")),
    ("temporal_split", lambda spark, sf: DS.temporal_split(G.event_labelled(spark, sf))),
    ("event_split", lambda spark, sf: G.event_split(spark, sf)),  # the split, written for the serving tables
    ("segment_metadata", lambda spark, sf: G.build_serving(spark, sf, "model_metadata")),
    ("prediction_grid", lambda spark, sf: G.build_serving(spark, sf, "predictions")),
    ("optimal_ranges", lambda spark, sf: G.build_serving(spark, sf, "optimal_ranges")),
    ("serving_write", registered("m6_segment_metadata")),  # builds and writes all three serving tables
    ("top_communities", registered("d4_top_communities")),
    ("recommend", registered("r4_recommend")),
    ("parse_requests", registered("r2_parse_requests")),
    ("nlp_features", registered("n4_nlp_features")),
]


def run(spark, sf: str) -> dict[str, float]:
    times: dict[str, float] = {}
    for label, job in HEADLINE:
        t0 = time.time()
        job(spark, sf).write.format("noop").mode("overwrite").save()
        times[label] = round(time.time() - t0, 3)
    return times


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        run(spark, small)
    times = run(spark, sf)
    rows = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("documents", "events")}
    sf_name = os.path.basename(sf.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf_name, "rows": rows}))
    G._WRITTEN.clear()


if __name__ == "__main__":
    main()
