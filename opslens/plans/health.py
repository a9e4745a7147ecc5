"""Health panel: usage today, active users, failed jobs, table count, trend."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import now, since
from ..operators import asc, fill_daily_gaps, scope
from ..params import AsOf
from ..sources import ACCESS_AUDIT, BILLING_USAGE, CATALOG_TABLES, JOB_RUNS, Sources
from .vocab import BASE_TABLE, FAILED


def health_dbu_today(src: Sources, *, as_of: AsOf = None) -> DataFrame:
    """Usage on the ``as_of`` date, rounded to 2; 0 when there is none."""
    u = src[BILLING_USAGE]
    a = src.as_of(BILLING_USAGE, as_of)
    today = u.filter(F.col("usage_date") == now(a, u.schema["usage_date"].dataType))
    return today.agg(F.coalesce(F.round(F.sum("usage_quantity"), 2), F.lit(0)).alias("dbu_today"))


def health_active_users(src: Sources, days: int = 7, *, as_of: AsOf = None, approx: bool = False) -> DataFrame:
    """Distinct non-NULL users with an audit event in the last ``days``.

    ``approx=True`` uses HyperLogLog++ (``approx_count_distinct``): constant
    memory per partition instead of a shuffle of the distinct users."""
    a = src.as_of(ACCESS_AUDIT, as_of)
    ev = src.recent(ACCESS_AUDIT, "event_time", a, days=days).filter(F.col("user_name").isNotNull())
    count = F.approx_count_distinct("user_name") if approx else F.countDistinct("user_name")
    return ev.agg(count.alias("active_users"))


def health_failed_jobs(src: Sources, hours: int = 24, *, as_of: AsOf = None) -> DataFrame:
    """Runs in state FAILED started in the last ``hours``."""
    a = src.as_of(JOB_RUNS, as_of)
    runs = src.recent(JOB_RUNS, "run_start_time", a, hours=hours).filter(F.col("result_state") == FAILED)
    return runs.agg(F.count(F.lit(1)).alias("failed_jobs"))


def health_table_count(src: Sources, catalogs: tuple[str, ...] = (), *, as_of: AsOf = None) -> DataFrame:
    """Number of base tables, optionally within ``catalogs``."""
    t = scope(src[CATALOG_TABLES].filter(F.col("table_type") == BASE_TABLE), catalogs)
    return t.agg(F.count(F.lit(1)).alias("total_tables"))


def health_dbu_trend(src: Sources, days: int = 14, *, as_of: AsOf = None, fill_gaps: bool = False) -> DataFrame:
    """Daily usage (rounded to 2) over the last ``days``, oldest first.

    Dates without usage are absent; ``fill_gaps=True`` adds them with 0."""
    a = src.as_of(BILLING_USAGE, as_of)
    u = src[BILLING_USAGE]
    daily = (
        src.recent(BILLING_USAGE, "usage_date", a, days=days)
        .groupBy("usage_date")
        .agg(F.round(F.sum("usage_quantity"), 2).alias("dbu"))
    )
    if fill_gaps:
        dtype = u.schema["usage_date"].dataType
        daily = fill_daily_gaps(daily, "usage_date", since(a, dtype, days=days), now(a, dtype), {"dbu": 0})
    return daily.orderBy(*asc("usage_date"))
