"""Daily rollups shared by the reports of a panel load.

Five cost/health reports read the same billing usage.  Rolling it up once
per (date, SKU, cluster, job, run-as) -- the only keys those reports group
or filter on -- and re-binding ``billing_usage`` to the rollup lets each of
them read a table that is orders of magnitude smaller than raw usage.  Dates
stay keys, so distinct-date counts stay exact, and sums of sums equal the
raw sums (exactly for decimal quantities).  Likewise five audit reports
(active users, top users by queries and by tables, inactive users, most read
tables) read one audit rollup per (date, user, action, object).

A rollup is cut from its lineage by writing it under the session's
``spark.checkpoint.dir`` (a shared folder on a cluster), so a lost executor
recomputes nothing upstream of it.
"""
from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import now, parse_as_of, since, wall_clock
from ..operators import asc, desc, of_actions, top_n
from ..params import AsOf, InvalidParams
from ..session import ensure_checkpoint_dir
from ..sources import ACCESS_AUDIT, BILLING_USAGE, Sources, field
from .vocab import QUERY_ACTIONS, TABLE_ACCESS_ACTIONS, TABLE_READ_ACTIONS

KEYS = ("usage_date", "sku_name", "cluster_name", "cluster_id", "job_id", "run_as")


def usage_daily(src: Sources, days: int, *, as_of: AsOf = None) -> DataFrame:
    """Usage summed per date and reporting key over the last ``days``."""
    a = src.as_of(BILLING_USAGE, as_of)
    u = src.recent(BILLING_USAGE, "usage_date", a, days=days)
    return u.groupBy(
        "usage_date",
        "sku_name",
        field(u, "custom_tags", "cluster_name").alias("cluster_name"),
        field(u, "usage_metadata", "cluster_id").alias("cluster_id"),
        field(u, "usage_metadata", "job_id").alias("job_id"),
        field(u, "identity_metadata", "run_as").alias("run_as"),
    ).agg(F.sum("usage_quantity").alias("usage_quantity"), F.count(F.lit(1)).alias("usage_rows"))


def as_usage(rollup: DataFrame) -> DataFrame:
    """The rollup as a ``billing_usage`` source: its keys stay top-level
    columns, which the reports read in place of the map lookups."""
    return rollup.select("usage_date", "sku_name", "usage_quantity", *KEYS[2:])


def with_usage_rollup(src: Sources, days: int, *, as_of: AsOf = None, materialize: bool = True) -> Sources:
    """``src`` with ``billing_usage`` re-bound to its daily rollup.

    Reports over it with a look-back of at most ``days`` give the raw
    reports' results.  With ``materialize`` the rollup is checkpointed
    (written once to the checkpoint folder, lineage cut)."""
    rollup = usage_daily(src, days, as_of=as_of)
    if materialize:
        ensure_checkpoint_dir(rollup.sparkSession)
        rollup = rollup.checkpoint(eager=True)
    return src.bind(BILLING_USAGE, as_usage(rollup), as_of=src.as_of(BILLING_USAGE, as_of))


# ---------------------------------------------------------------------------
# Daily audit rollup: one scan of the audit log feeds five audit reports
# ---------------------------------------------------------------------------

AUDIT_KEYS = ("event_date", "user_name", "action_name", "object_name")


@dataclass(frozen=True)
class AuditRollup:
    """Audit events counted per (date, user, action, object) with the first
    and last event time of each group, over ``days`` before ``as_of``.

    Users, objects and dates are keys, so distinct counts stay exact; counts
    are sums of counts; first/last seen are min/max of min/max.  A look-back
    of at most ``days`` days from ``as_of`` selects whole dates exactly when
    ``as_of`` is midnight, which :func:`audit_daily` therefore requires."""

    df: DataFrame
    as_of: datetime
    days: int

    def window(self, days: int) -> DataFrame:
        if days > self.days:
            raise ValueError(f"the rollup covers {self.days} days, {days} requested")
        first = (self.as_of - timedelta(days=days)).date().isoformat()
        return self.df.filter(F.col("event_date") >= F.lit(first).cast("date"))


def audit_daily(src: Sources, days: int, *, as_of: AsOf = None, materialize: bool = True) -> AuditRollup:
    """Roll the last ``days`` of audit events up per date and reporting key.

    Needs an explicit ``as_of`` at midnight (whole dates).  With
    ``materialize`` the rollup is checkpointed once (lineage cut)."""
    a = wall_clock(parse_as_of(src.as_of(ACCESS_AUDIT, as_of)), src[ACCESS_AUDIT].sparkSession)
    if a is None or a.time() != datetime.min.time():
        raise ValueError("the audit rollup needs an as_of at midnight (whole dates)")
    ev = src.recent(ACCESS_AUDIT, "event_time", a, days=days)
    rollup = ev.groupBy(
        F.to_date("event_time").alias("event_date"),
        "user_name",
        "action_name",
        field(ev, "request_params", "full_name_arg").alias("object_name"),
    ).agg(
        F.count(F.lit(1)).alias("events"),
        F.min("event_time").alias("first_seen"),
        F.max("event_time").alias("last_seen"),
    )
    if materialize:
        ensure_checkpoint_dir(rollup.sparkSession)
        rollup = rollup.checkpoint(eager=True)
    return AuditRollup(rollup, a, days)


def active_users_from(r: AuditRollup, days: int = 7) -> DataFrame:
    """``health_active_users`` from the rollup."""
    w = r.window(days).filter(F.col("user_name").isNotNull())
    return w.agg(F.countDistinct("user_name").alias("active_users"))


def top_by_queries_from(r: AuditRollup, days: int = 30, limit: int | None = 20) -> DataFrame:
    """``users_top_by_queries`` from the rollup."""
    w = of_actions(r.window(days), QUERY_ACTIONS).filter(F.col("user_name").isNotNull())
    per_user = w.groupBy("user_name").agg(
        F.sum("events").alias("total_events"),
        F.countDistinct("event_date").alias("active_days"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    return top_n(per_user, desc("total_events") + asc("user_name"), limit)


def top_by_tables_from(r: AuditRollup, days: int = 30, limit: int | None = 20) -> DataFrame:
    """``users_top_by_tables_accessed`` from the rollup."""
    w = (
        of_actions(r.window(days), TABLE_ACCESS_ACTIONS)
        .filter(F.col("user_name").isNotNull())
        .filter(F.col("object_name").isNotNull())
    )
    per_user = w.groupBy("user_name").agg(
        F.countDistinct("object_name").alias("distinct_tables"),
        F.sum("events").alias("total_accesses"),
    )
    return top_n(per_user, desc("distinct_tables") + asc("user_name"), limit)


def inactive_from(r: AuditRollup, days: int = 30, lookback_days: int = 90) -> DataFrame:
    """``users_inactive`` (NULL users ignored) from the rollup."""
    if lookback_days <= days:
        raise InvalidParams("lookback_days must be longer than days")
    last = (
        r.window(lookback_days)
        .filter(F.col("user_name").isNotNull())
        .groupBy("user_name")
        .agg(F.max("last_seen").alias("last_seen"))
    )
    dtype = last.schema["last_seen"].dataType
    idle = last.filter(F.col("last_seen") < since(r.as_of, dtype, days=days))
    return idle.select(
        "user_name",
        "last_seen",
        F.datediff(now(r.as_of, dtype), F.col("last_seen")).cast("long").alias("days_inactive"),
    ).orderBy(*desc("days_inactive"), *asc("user_name"))


def most_accessed_from(r: AuditRollup, days: int = 30, limit: int | None = 20) -> DataFrame:
    """``catalog_most_accessed`` from the rollup."""
    w = of_actions(r.window(days), TABLE_READ_ACTIONS).filter(F.col("object_name").isNotNull())
    per_table = w.groupBy(F.col("object_name").alias("table_name")).agg(
        F.sum("events").alias("access_count"),
        F.countDistinct("user_name").alias("distinct_users"),
    )
    return top_n(per_table, desc("access_count") + asc("table_name"), limit)


# ---------------------------------------------------------------------------
# A persisted rollup, refreshed incrementally
# ---------------------------------------------------------------------------


def refresh_usage_rollup(src: Sources, path: str, days: int, *, as_of: AsOf = None) -> str:
    """Recompute the last ``days`` of the daily usage rollup and write them
    to ``path`` partitioned by ``usage_date``.

    Dynamic partition overwrite replaces only the dates written, so a daily
    job refreshes the recent window (late usage included) and leaves older
    dates as they are; readers bind the folder with :func:`stored_usage`."""
    rollup = usage_daily(src, days, as_of=as_of)
    (
        rollup.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("usage_date")
        .parquet(path)
    )
    return path


def stored_usage(src: Sources, spark, path: str) -> Sources:
    """``src`` with ``billing_usage`` bound to a persisted rollup folder (its
    date partitions are pruned by the reports' look-backs)."""
    return src.bind(BILLING_USAGE, as_usage(spark.read.parquet(path)), as_of=src.as_of(BILLING_USAGE))


def refresh_audit_rollup(src: Sources, path: str, days: int, *, as_of: AsOf = None) -> str:
    """Recompute the last ``days`` of the daily audit rollup and replace
    those date partitions under ``path`` (dynamic partition overwrite)."""
    r = audit_daily(src, days, as_of=as_of, materialize=False)
    (
        r.df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date")
        .parquet(path)
    )
    return path


def stored_audit(spark, path: str, as_of: AsOf, days: int) -> AuditRollup:
    """A persisted audit rollup as an :class:`AuditRollup` covering ``days``
    before ``as_of`` (midnight); its date partitions are pruned by the
    reports' windows."""
    a = parse_as_of(as_of)
    if a is None or a.time() != datetime.min.time():
        raise ValueError("the audit rollup needs an as_of at midnight (whole dates)")
    return AuditRollup(spark.read.parquet(path), a, days)
