"""Session helpers for tests, the bench and local runs.

The library itself never creates a session: every report takes the
DataFrames it is given.  These helpers only set what a local run needs
and leave anything a cluster already configured untouched.
"""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings a report run relies on.  AQE re-plans joins and shuffle sizes at
# runtime from real statistics; the session zone only matters for sources with
# zoned timestamps (the driver tables read as TIMESTAMP_NTZ).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Coalesce shuffle partitions to the advisory size rather than keeping
    # one per core: fewer, right-sized reduce tasks (Spark's advice for busy
    # clusters; about 15% faster on the local bench).
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "opslens") -> SparkSession:
    """A local session with the library's settings (tests, bench)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("OPSLENS_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.ui.retainedExecutions", "20000")  # tests count them; beyond this many the oldest go
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there and it is used as is.  Only a
    local session without the setting (tests) gets a fresh scratch folder; a
    cluster session without it is an error, since a machine-local folder
    would not survive the loss of that machine.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint folder
        if current:
            return current
        raise ValueError("set spark.checkpoint.dir on the server to materialise rollups") from None
    if current:
        sc.setCheckpointDir(current)
        return current
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder (HDFS, object store) to materialise rollups")
    path = tempfile.mkdtemp(prefix="opslens-ckpt-")
    sc.setCheckpointDir(path)  # spark.checkpoint.dir itself cannot change at runtime
    return sc.getCheckpointDir() or path
