"""Every report and derivation bound to the driver tables of one scale factor.

Each entry is ``(spark, sf_dir) -> DataFrame`` and runs over the whole
tables with the report's default parameters (as the panels call them,
except ``users_inactive`` with ``days=7``, whose default window would
cover all of the fixture data).
"""
from __future__ import annotations

import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import preview
from ..operators import flag_rows, trend_glyphs
from ..sources import BILLING_USAGE, JOB_RUNS, QUERY_HISTORY, Sources
from ..sources.fixtures import bind_driver_tables
from . import REPORTS, catalog, custom, kpis, rollups

Query = Callable[[SparkSession, str], DataFrame]

CUSTOM_SQL = """
SELECT user_name, COUNT(*) AS cnt FROM access_audit GROUP BY user_name
ORDER BY cnt DESC NULLS LAST, user_name ASC NULLS FIRST
"""

SCOPED_CATALOGS = ("PROMO", "SMALL")

REPORT_ARGS = {"users_inactive": {"days": 7, "lookback_days": 90}}


# Sources bound once per session and folder, as a user binds them once and
# then runs many reports.  Only lazy plans are kept: every run re-reads the
# Parquet files, nothing is cached in memory.
_BOUND: "weakref.WeakKeyDictionary[SparkSession, dict[str, Sources]]" = weakref.WeakKeyDictionary()


def bound(spark: SparkSession, sf_dir: str) -> Sources:
    per_session = _BOUND.setdefault(spark, {})
    key = sf_dir.rstrip("/")
    if key not in per_session:
        per_session[key] = bind_driver_tables(spark, key)
    return per_session[key]


def _report(name: str) -> Query:
    fn = REPORTS[name]
    args = REPORT_ARGS.get(name, {})
    return lambda spark, sf_dir: fn(bound(spark, sf_dir), **args)


def _trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = bound(spark, sf_dir)
    daily = (
        src.recent(BILLING_USAGE, "usage_date", days=14)
        .groupBy("sku_name", "usage_date")
        .agg(F.round(F.sum("usage_quantity"), 2).alias("dbu"))
    )
    return trend_glyphs(daily, ["sku_name"], "usage_date", "dbu")


def _flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = bound(spark, sf_dir)[JOB_RUNS].select("run_id", "result_state")
    return flag_rows(runs, "result_state")


def _preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = bound(spark, sf_dir)[QUERY_HISTORY]
    return q.select("start_time", "user_name", preview("statement_text", 80).alias("preview"))


def _custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return custom.custom_report(spark, bound(spark, sf_dir), CUSTOM_SQL, limit=500)


def _variant(name: str, **kwargs) -> Query:
    fn = REPORTS[name]
    return lambda spark, sf_dir: fn(bound(spark, sf_dir), **kwargs)


def _rolled(name: str) -> Query:
    """A usage report fed by the daily usage rollup, which each call checkpoints."""
    fn = REPORTS[name]
    return lambda spark, sf_dir: fn(rollups.with_usage_rollup(bound(spark, sf_dir), ROLLUP_DAYS))


ROLLUP_DAYS = 30
AUDIT_ROLLUP_DAYS = 90  # the longest audit look-back a panel uses (inactive users)


def _audit_rolled(fn: Callable, **kwargs) -> Query:
    """An audit report computed from the daily audit rollup."""
    return lambda spark, sf_dir: fn(rollups.audit_daily(bound(spark, sf_dir), AUDIT_ROLLUP_DAYS), **kwargs)


QUERIES: dict[str, Query] = {name: _report(name) for name in REPORTS}
DERIVATIONS = (
    "kpis_health", "kpis_cost", "kpis_catalog", "kpis_jobs", "kpis_governance",
    "custom_report", "flag_rows", "trend_glyphs", "preview", "scope",
)
QUERIES.update(
    {
        "kpis_health": lambda spark, d: kpis.kpis_health(bound(spark, d)),
        "kpis_cost": lambda spark, d: kpis.kpis_cost(bound(spark, d)),
        "kpis_catalog": lambda spark, d: kpis.kpis_catalog(bound(spark, d)),
        "kpis_jobs": lambda spark, d: kpis.kpis_jobs(bound(spark, d)),
        "kpis_governance": lambda spark, d: kpis.kpis_governance(bound(spark, d)),
        "custom_report": _custom,
        "flag_rows": _flag,
        "trend_glyphs": _trend,
        "preview": _preview,
        "scope": lambda spark, d: catalog.catalog_tables_by_schema(bound(spark, d), SCOPED_CATALOGS),
        # report options
        "health_dbu_trend_filled": _variant("health_dbu_trend", fill_gaps=True, as_of="2001-11-08"),
        "cost_daily_by_sku_all_prices": _variant("cost_daily_by_sku", price_dedup="all"),
        "users_inactive_null_aware": _variant(
            "users_inactive", days=7, lookback_days=90, null_aware=True, as_of="2024-02-10 00:00:00"
        ),
        "governance_pii_columns_whole_token": _variant("governance_pii_columns", whole_token=True),
        # usage reports over the shared daily rollup
        "health_dbu_today_rollup": _rolled("health_dbu_today"),
        "health_dbu_trend_rollup": _rolled("health_dbu_trend"),
        "cost_daily_by_sku_rollup": _rolled("cost_daily_by_sku"),
        "cost_top_clusters_rollup": _rolled("cost_top_clusters"),
        "cost_top_jobs_rollup": _rolled("cost_top_jobs"),
        "cost_top_users_by_dbu_rollup": _rolled("cost_top_users_by_dbu"),
        "cost_burn_rate_rollup": _rolled("cost_burn_rate"),
        # audit reports over the shared daily audit rollup
        "health_active_users_rollup": _audit_rolled(rollups.active_users_from, days=7),
        "users_top_by_queries_rollup": _audit_rolled(rollups.top_by_queries_from),
        "users_top_by_tables_accessed_rollup": _audit_rolled(rollups.top_by_tables_from),
        "users_inactive_rollup": _audit_rolled(rollups.inactive_from, days=7, lookback_days=90),
        "catalog_most_accessed_rollup": _audit_rolled(rollups.most_accessed_from),
    }
)

# The benchmarked set: the 31 reports and the 10 derivations.
HEADLINE = (*REPORTS, *DERIVATIONS)
