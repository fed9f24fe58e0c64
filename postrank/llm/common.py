"""Helpers shared by the operators of this subpackage.

``map_text`` runs a function of whole texts over Arrow batches; ``written`` cuts
lineage with a Parquet table in the shared folder; ``shared`` broadcasts a bounded value that ``release``
takes back from the executors; ``most`` keeps the rows of the largest amounts without sorting; ``let`` binds an
expression once inside a projection, so that a lambda does not evaluate it again per element.
"""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

TEXT, KEPT = "__text", "__kept"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS = 1000  # texts of an Arrow batch; some kilobytes each, held by the JVM and by Python


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of TEXTS rows for this session, unless it has a setting of its own (the default is 10,000)."""
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, str(TEXTS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return read(spark, sf_dir, "documents")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder ``spark.checkpoint.dir``. Only a local session without
    that setting gets a folder of its own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.sparkContext.getCheckpointDir() or checkpoint_dir(spark)
    return f"{base}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SMALL = 500_000  # rows of narrow tables that may be broadcast: a bounded number of some tens of bytes


def small(df: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has SMALL rows at most."""
    return F.broadcast(df) if df.count() <= SMALL else df


_SHARED: weakref.WeakSet[Broadcast] = weakref.WeakSet()


def shared(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast of ``value``, whose size the caller bounds."""
    out = spark.sparkContext.broadcast(value)
    _SHARED.add(out)
    return out


def release() -> None:
    """Takes what :func:`shared` sent out back from the executors, once what was made of it is written. A result
    not written yet stays right: its tasks fetch the value again."""
    for x in list(_SHARED):
        x.unpersist()
    _SHARED.clear()


_WORKER: dict = {"owner": None, "kept": {}}


def worker_cache(owner: str) -> dict:
    """What a Python worker keeps from one task to the next for one operator; that of another operator is dropped."""
    if _WORKER["owner"] != owner:
        _WORKER["owner"], _WORKER["kept"] = owner, {}
    return _WORKER["kept"]


def most(df: DataFrame, by: Column, k: int, more: bool = False) -> DataFrame:
    """The rows of ``df`` with the largest amounts ``by`` (0 or more): at most ``k``, or with ``more`` at least ``k`` as far
    as there are. The bound comes from a histogram (16 steps an octave), so nothing is sorted and no task reports rows
    of its own; rows of one step stay or go together. ``df`` is written once, as it is read twice."""
    step = F.floor(F.log2(by + 1) * 16).cast("int")
    rows = written(df.withColumn("__step", step), "amounts")
    bound, kept = 1 << 30, 0
    for r in sorted(rows.groupBy("__step").count().collect(), key=lambda r: -r["__step"]):
        if kept >= k or (not more and kept + r["count"] > k):
            break
        bound, kept = r["__step"], kept + r["count"]
    return rows.where(F.col("__step") >= bound).drop("__step")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def kept_columns(df: DataFrame, results: Sequence[str], keep: Sequence[str] | None = None) -> list[str]:
    """The input columns that stay: those of ``keep`` (all by default) whose names do not clash
    with a result's; a result replaces an input column of its name."""
    taken = {r.lower() for r in results}
    return [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]


def map_text(df: DataFrame, text: str, fields: T.StructType,
             factory: Callable[[], Callable[[pa.Array], list]], keep: Sequence[str] | None = None, kind: str = "string") -> DataFrame:
    """``df`` with columns that a function computes from whole texts (or a column of another ``kind``),
    one Arrow batch at a time.

    ``factory`` runs once per task and returns the function; that takes the batch's text column
    and returns one list or array per field. No shuffle: rows stay in their partitions.
    """
    keep = kept_columns(df, fields.names, keep)
    inner = df.select(F.struct(F.lit(True).alias("__row"), *[quoted(c) for c in keep]).alias(KEPT),
                      quoted(text).cast(kind).alias(TEXT))
    schema = T.StructType([inner.schema[KEPT], *fields.fields])
    types = [arrow_type(f.dataType) for f in fields.fields]

    def run(batches):
        function = factory()
        for b in batches:
            arrays = [x if isinstance(x, pa.Array) and x.type == t else pa.array(x, type=t)
                      for x, t in zip(function(b.column(1)), types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=schema.names)

    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(KEPT).getField(c).alias(c) for c in keep],
                      *[F.col(c) for c in fields.names])


def arrow_type(t: T.DataType) -> pa.DataType:
    simple = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
              "boolean": pa.bool_(), "binary": pa.binary()}
    if isinstance(t, T.ArrayType):
        return pa.list_(arrow_type(t.elementType))
    return simple[t.simpleString()]


def in_held_out_fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 = 2; a row without an id is in no fold (false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
