"""Spark session helpers.

Everything runs with the session time zone pinned to UTC (posting hours are
reported as UTC) and ANSI mode left on (Spark 4 default), so operators use
``try_*`` / ``nullif`` / ``get`` where a value may be missing.
"""

from __future__ import annotations

import os
import tempfile
import weakref

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def _local_heap() -> str:
    """Driver heap for local mode: 60% of physical memory, between 1 and 16 GiB."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
        gib = int(total * 0.6 / 2**30)
    except (ValueError, OSError, AttributeError):
        gib = 4
    return f"{max(1, min(16, gib))}g"


def get_spark(master: str | None = None, app: str = "postrank",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the project defaults.

    On a cluster ``master`` is left to spark-submit; tests pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app)
    conf = dict(DEFAULT_CONF)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            conf.setdefault("spark.driver.memory", _local_heap())
            conf.setdefault("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # Settings that are runtime-modifiable are re-applied for a reused session.
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
        spark.conf.set(k, conf[k])
    return spark


_CHECKPOINTS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    On a cluster this is ``spark.checkpoint.dir`` as configured by the
    operator (a shared file system). Only when it is unset in a local session
    -- tests -- a fresh scratch folder is created and registered.
    """
    sc = spark.sparkContext
    if sc in _CHECKPOINTS:
        return _CHECKPOINTS[sc]
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="postrank-ckpt-")
    sc.setCheckpointDir(d)
    _CHECKPOINTS[sc] = sc.getCheckpointDir() or d
    return _CHECKPOINTS[sc]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for a written table."""
    return os.path.join(checkpoint_dir(spark), name)
