"""Incremental variants of audit reports for an audit feed read as a stream.

An audit log is an append-only feed, so two of the reports can run as
Structured Streaming queries instead of re-scanning on every load:

* :func:`denial_feed` -- the access-anomaly report (denied-access events)
  as a stateless filter/projection of the stream (append mode);
* :func:`audit_daily_counts` -- events per day, user and action in
  event-time windows of one day, with a watermark bounding the state kept
  for late events (append mode emits a day once the watermark passes it).

Both take a streaming DataFrame with the ``access_audit`` columns, e.g.
``spark.readStream.schema(...).parquet(folder)`` or a Kafka source mapped to
those columns.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.vocab import DENIAL_ACTIONS
from ..session import ensure_checkpoint_dir
from ..sources import field


def denial_feed(audit: DataFrame) -> DataFrame:
    """Denied-access events with user, action, target, time and source IP."""
    return audit.filter(F.col("action_name").isin(list(DENIAL_ACTIONS))).select(
        "user_name",
        "action_name",
        field(audit, "request_params", "full_name_arg").alias("target_object"),
        "event_time",
        "source_ip_address",
    )


def audit_daily_counts(audit: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Events per (day, user, action), finalised once the watermark passes.

    Watermarks need a zoned timestamp: a ``timestamp_ntz`` event time is
    read in the session time zone (days are that zone's days) and the day
    start is returned in the input's type."""
    dtype = audit.schema["event_time"].dataType
    return (
        audit.withColumn("__ts", F.col("event_time").cast("timestamp"))
        .withWatermark("__ts", watermark)
        .groupBy(F.window("__ts", "1 day").alias("day"), "user_name", "action_name")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.min("event_time").alias("first_seen"),
            F.max("event_time").alias("last_seen"),
        )
        .select(
            F.col("day.start").cast(dtype).alias("day_start"),
            "user_name",
            "action_name",
            "events",
            "first_seen",
            "last_seen",
        )
    )


def start(df: DataFrame, name: str, fmt: str = "parquet", path: str | None = None, mode: str = "append",
          checkpoint: str | None = None, trigger: dict | None = None):
    """Start ``df`` as a streaming query whose progress and state live under
    the session's ``spark.checkpoint.dir`` (a shared folder on a cluster), so
    a restarted driver or lost executors resume where the stream left off."""
    location = checkpoint or f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/streams/{name}"
    writer = df.writeStream.format(fmt).outputMode(mode).queryName(name).option("checkpointLocation", location)
    if path is not None:
        writer = writer.option("path", path)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()
