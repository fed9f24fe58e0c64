"""Continuous collection (S1, S2) with Structured Streaming.

A file stream of raw posts is filtered to the allow-listed communities (a
left-semi join against the broadcast 50-row dimension) and written as Parquet, one
folder per micro-batch, with a checkpoint, so a restarted query resumes where it
stopped. Rows checked and kept are observed while a batch is written, not counted in
a second pass, and go to a progress table, one row per batch. Both writes replace
the batch's own folder, so a batch that runs again after a failure counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.posts import filter_communities

PROGRESS = "batch_id long, checked long, matched long"


def start_collect(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str, progress_dir: str,
                  dim: DataFrame | None = None, available_now: bool = True,
                  max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Stream raw posts from ``source_dir`` into ``out_dir`` (Parquet, by batch) and each batch's counts
    into ``progress_dir``."""
    reader = spark.readStream.schema(schemas.RAW_POSTS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def save(batch: DataFrame, batch_id: int) -> None:
        checked, matched = Observation(), Observation()
        rows = F.count(F.lit(1)).alias("rows")
        kept = filter_communities(batch.observe(checked, rows), dim).observe(matched, rows)
        kept.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")
        (batch.sparkSession.createDataFrame([(batch_id, checked.get["rows"], matched.get["rows"])], PROGRESS)
         .coalesce(1).write.mode("overwrite").parquet(f"{progress_dir}/batch={batch_id}"))

    w = reader.parquet(source_dir).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def collected(spark: SparkSession, out_dir: str) -> DataFrame:
    """The posts that all batches have kept."""
    return spark.read.schema(schemas.RAW_POSTS).parquet(f"{out_dir}/batch_id=*")


def progress_counts(spark: SparkSession, progress_dir: str) -> DataFrame:
    """One row: rows checked and kept over all batches, those before a restart included."""
    rows = spark.read.schema(PROGRESS).parquet(f"{progress_dir}/batch=*")
    return rows.agg(F.sum("checked").alias("checked"), F.sum("matched").alias("matched"))
