"""Sources and sinks (A1-A7): Parquet / CSV readers with explicit schemas,
table writers, and the serving-table registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

SERVING_TABLES = ("model_metadata", "predictions", "optimal_ranges")


def read_posts(spark: SparkSession, path: str, schema: T.StructType = schemas.RAW_POSTS) -> DataFrame:
    """A1: Parquet with an explicit schema (no inference, pruning and pushdown intact)."""
    return spark.read.schema(schema).parquet(path)


def read_posts_csv(spark: SparkSession, path: str, schema: T.StructType = schemas.RAW_POSTS) -> DataFrame:
    """A2: CSV with header, quoted multi-line text and an explicit schema."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').option("mode", "FAILFAST")
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(path))


def write_posts_csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(path))


def materialize(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """A4 / A5: write (replace) a table as Parquet and read it back (lineage cut)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


export = materialize


def stage(df: DataFrame, path: str, name: str) -> DataFrame:
    """A3: write the raw table and report (table_name, n_rows); rows are counted while they are written."""
    seen = Observation()
    materialize(df.observe(seen, F.count(F.lit(1)).alias("n_rows")), path)
    return df.sparkSession.createDataFrame([(name, seen.get["n_rows"])], "table_name string, n_rows long")


def load_serving(spark: SparkSession, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Register the serving tables as temp views (cached: they are small
    and read by every request). Querying an unregistered name raises
    ``AnalysisException``."""
    out = {}
    for name, df in tables.items():
        if name not in SERVING_TABLES:
            raise ValueError(f"unknown serving table: {name}")
        df = df.cache()
        df.createOrReplaceTempView(name)
        out[name] = df
    return out


def read_serving(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """A6 from a folder of Parquet tables named after the serving tables."""
    return load_serving(spark, {n: spark.read.parquet(f"{directory}/{n}") for n in SERVING_TABLES})


def describe_schema(df: DataFrame) -> DataFrame:
    """One row per column (position, name, type) plus the row and column counts."""
    spark = df.sparkSession
    cols = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(df.dtypes)],
                                 "position int, column_name string, data_type string")
    n = df.select(F.count("*")).scalar()
    return cols.withColumn("n_rows", n).withColumn("n_cols", F.lit(len(df.columns)))
