"""Tables bucketed by their join key.

Post-sized tables that are joined on post_id again and again are written once in the same number of buckets, each
one file, sorted by the key. Joins of such tables on the key need no exchange, however often they run: the one
shuffle is that of the writing. Files lie in the shared folder; the session's catalog holds their names only.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def buckets_for(spark: SparkSession) -> int:
    """The default number of buckets: the session's shuffle partitions, so other joins fit too."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_bucketed(df: DataFrame, name: str, path: str, key: str = "post_id", buckets: int | None = None) -> DataFrame:
    """``df`` as the table ``name`` in ``path``, bucketed and sorted by ``key``; an earlier one is replaced.

    Rows are first dealt by the same hash that numbers the buckets, so each bucket is written by one task into one file.
    Rows without a key share a bucket. ``name`` is letters, digits and underscores.
    """
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"not a table name: {name}")
    n = buckets or buckets_for(df.sparkSession)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    (df.repartition(n, F.col(key)).write.format("parquet").mode("overwrite").bucketBy(n, key).sortBy(key)
       .option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)


def write_together(tables: dict[str, DataFrame], directory: str, key: str = "post_id", buckets: int | None = None,
                   tag: str = "") -> dict[str, DataFrame]:
    """Several tables in the same number of buckets, so that any of them join without an exchange."""
    return {n: write_bucketed(df, f"{n}{tag}", f"{directory}/{n}", key, buckets) for n, df in tables.items()}


def drop_bucketed(spark: SparkSession, names: Sequence[str]) -> None:
    """Takes the names out of the catalog; the files stay."""
    for n in names:
        spark.sql(f"DROP TABLE IF EXISTS {n}")
