"""Panel KPIs, derived in Spark from the uncapped reports.

Each KPI frame has the columns ``panel, metric, value, display, severity,
status``: ``value`` is a double, ``display`` the compact text, ``severity``
one of neutral / good / warning / critical, ``status`` ``ok``.  A KPI whose
source is not bound is a row with NULL value and status ``unavailable``
(built by :func:`unavailable`), never a silent 0.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compact_number, ratio_half_up
from ..params import AsOf
from ..sources import JOB_RUNS, SourceUnavailable, Sources
from . import catalog, cost, governance, health
from .vocab import SUCCEEDED

NEUTRAL, GOOD, WARNING, CRITICAL = "neutral", "good", "warning", "critical"
KPI_SCHEMA = "panel string, metric string, value double, display string, severity string, status string"


def _kpi(
    panel: str, metric: str, value: Column, display: Column | None = None, severity: Column | str = NEUTRAL
) -> list[Column]:
    v = value.cast("double")
    return [
        F.lit(panel).alias("panel"),
        F.lit(metric).alias("metric"),
        v.alias("value"),
        (display if display is not None else compact_number(v)).alias("display"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        F.lit("ok").alias("status"),
    ]


def _count_text(v: Column) -> Column:
    return F.format_string("%d", v.cast("long"))


def _above_zero(v: Column, bad: str = CRITICAL, fine: str = GOOD) -> Column:
    return F.when(v > 0, F.lit(bad)).otherwise(F.lit(fine))


def unavailable(spark: SparkSession, panel: str, metric: str) -> DataFrame:
    return spark.createDataFrame([(panel, metric, None, None, None, "unavailable")], KPI_SCHEMA)


def _safe(
    spark: SparkSession, panel: str, metrics: str | tuple[str, ...], build: Callable[[], DataFrame]
) -> DataFrame:
    """The KPI rows, or an unavailable row for each metric if a source is not bound."""
    try:
        return build()
    except SourceUnavailable:
        names = (metrics,) if isinstance(metrics, str) else metrics
        return _union([unavailable(spark, panel, m) for m in names])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _spark(src: Sources) -> SparkSession:
    return SparkSession.active()


def kpis_health(src: Sources, days: int = 30, catalogs: tuple[str, ...] = (), *, as_of: AsOf = None) -> DataFrame:
    """Usage today, active users (``days``), failed runs (24 h), base tables."""
    spark = _spark(src)
    frames = [
        _safe(spark, "health", "dbu_today", lambda: health.health_dbu_today(src, as_of=as_of).select(
            *_kpi("health", "dbu_today", F.col("dbu_today")))),
        _safe(spark, "health", "active_users", lambda: health.health_active_users(src, days, as_of=as_of).select(
            *_kpi("health", "active_users", F.col("active_users")))),
        _safe(spark, "health", "failed_jobs", lambda: health.health_failed_jobs(src, 24, as_of=as_of).select(
            *_kpi("health", "failed_jobs", F.col("failed_jobs"), _count_text(F.col("failed_jobs")),
                  _above_zero(F.col("failed_jobs"))))),
        _safe(spark, "health", "total_tables", lambda: health.health_table_count(src, catalogs, as_of=as_of).select(
            *_kpi("health", "total_tables", F.col("total_tables")))),
    ]
    return _union(frames)


def kpis_cost(src: Sources, days: int = 30, *, as_of: AsOf = None) -> DataFrame:
    """Total, average daily and projected monthly usage (one burn-rate pass,
    unpivoted with ``stack``)."""
    spark = _spark(src)

    def build() -> DataFrame:
        burn = cost.cost_burn_rate(src, days, as_of=as_of)
        long = burn.select(
            F.expr(
                "stack(3, 'total_dbu', CAST(total_dbu AS DOUBLE), 'neutral', "
                "'avg_daily_dbu', CAST(avg_daily_dbu AS DOUBLE), 'neutral', "
                "'projected_monthly_dbu', CAST(projected_monthly_dbu AS DOUBLE), 'warning') AS (metric, v, sev)"
            )
        )
        return long.select(
            F.lit("cost").alias("panel"),
            "metric",
            F.col("v").cast("double").alias("value"),
            compact_number(F.col("v").cast("double")).alias("display"),
            F.col("sev").alias("severity"),
            F.lit("ok").alias("status"),
        )

    return _safe(spark, "cost", ("total_dbu", "avg_daily_dbu", "projected_monthly_dbu"), build)


def kpis_catalog(src: Sources, catalogs: tuple[str, ...] = (), *, as_of: AsOf = None) -> DataFrame:
    """Total base tables: the sum over all schemas (no schema cap)."""
    spark = _spark(src)
    return _safe(spark, "catalog", "total_tables", lambda: catalog.catalog_tables_by_schema(src, catalogs).agg(
        F.coalesce(F.sum("table_count"), F.lit(0)).alias("n")).select(*_kpi("catalog", "total_tables", F.col("n"))))


def kpis_jobs(src: Sources, days: int = 30, *, as_of: AsOf = None) -> DataFrame:
    """Success rate (SUCCEEDED / all runs x 100, HALF_UP 1 decimal; 0 with no
    runs; good >= 95, warning >= 80, else critical) and total runs, from one
    conditional aggregate."""
    spark = _spark(src)

    def build() -> DataFrame:
        runs = src.recent(JOB_RUNS, "run_start_time", as_of, days=days)
        agg = runs.agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("result_state") == SUCCEEDED).alias("ok_runs"),
        )
        rate = F.when(F.col("total") > 0, ratio_half_up(F.col("ok_runs") * F.lit(100), F.col("total"), 1)).otherwise(
            F.lit(0.0)
        )
        sev = F.when(rate >= 95, F.lit(GOOD)).when(rate >= 80, F.lit(WARNING)).otherwise(F.lit(CRITICAL))
        text = F.when(F.col("total") > 0, F.format_string("%.1f%%", rate)).otherwise(F.lit("0%"))
        rows = F.array(*[
            F.struct(*_kpi("jobs", metric, *values))
            for metric, values in (("success_rate", (rate, text, sev)), ("total_runs", (F.col("total"),)))
        ])
        return agg.select(F.inline(rows))

    return _safe(spark, "jobs", ("success_rate", "total_runs"), build)


def kpis_governance(
    src: Sources, days: int = 30, catalogs: tuple[str, ...] = (), *, as_of: AsOf = None
) -> DataFrame:
    """Counts of ownerless tables, PII-like columns and access denials over
    the full (uncapped) reports."""
    spark = _spark(src)

    def counted(metric: str, report: Callable[[], DataFrame], sev: Callable[[Column], Column]) -> DataFrame:
        def build() -> DataFrame:
            n = report().agg(F.count(F.lit(1)).alias("n"))
            return n.select(*_kpi("governance", metric, F.col("n"), _count_text(F.col("n")), sev(F.col("n"))))

        return _safe(spark, "governance", metric, build)

    return _union([
        counted("tables_without_owners",
                lambda: governance.governance_tables_without_owners(src, catalogs, None, as_of=as_of), _above_zero),
        counted("pii_columns", lambda: governance.governance_pii_columns(src, catalogs, None, as_of=as_of),
                lambda n: F.lit(WARNING)),
        counted("access_denials", lambda: governance.governance_access_anomalies(src, days, None, as_of=as_of),
                _above_zero),
    ])


KPIS = {
    "health": kpis_health,
    "cost": kpis_cost,
    "catalog": kpis_catalog,
    "jobs": kpis_jobs,
    "governance": kpis_governance,
}
