"""The 31 reports, grouped by panel, as ``(Sources, params) -> DataFrame``.

Every report is lazy: it returns a DataFrame whose plan Catalyst optimises
as a whole, and never collects.  Orderings are total (explicit tie-breaks and
NULL placement), so a ``limit`` cuts the same rows on every run.
"""
from __future__ import annotations

from .catalog import (
    catalog_column_count,
    catalog_most_accessed,
    catalog_stale_tables,
    catalog_table_inventory,
    catalog_tables_by_schema,
)
from .cost import cost_burn_rate, cost_daily_by_sku, cost_top_clusters, cost_top_jobs, cost_top_users_by_dbu
from .governance import (
    governance_access_anomalies,
    governance_pii_columns,
    governance_schema_changes,
    governance_tables_without_owners,
)
from .health import health_active_users, health_dbu_today, health_dbu_trend, health_failed_jobs, health_table_count
from .jobs import jobs_daily_run_volume, jobs_longest_runs, jobs_success_rate, jobs_top_failures
from .queries import queries_error_summary, queries_most_expensive, queries_slowest, queries_top_users
from .users import users_inactive, users_permission_changes, users_top_by_queries, users_top_by_tables_accessed

REPORTS = {
    f.__name__: f
    for f in (
        health_dbu_today,
        health_active_users,
        health_failed_jobs,
        health_table_count,
        health_dbu_trend,
        cost_daily_by_sku,
        cost_top_clusters,
        cost_top_jobs,
        cost_top_users_by_dbu,
        cost_burn_rate,
        users_top_by_queries,
        users_top_by_tables_accessed,
        users_inactive,
        users_permission_changes,
        catalog_table_inventory,
        catalog_tables_by_schema,
        catalog_stale_tables,
        catalog_column_count,
        catalog_most_accessed,
        jobs_success_rate,
        jobs_top_failures,
        jobs_longest_runs,
        jobs_daily_run_volume,
        queries_slowest,
        queries_most_expensive,
        queries_top_users,
        queries_error_summary,
        governance_tables_without_owners,
        governance_pii_columns,
        governance_access_anomalies,
        governance_schema_changes,
    )
}

__all__ = ["REPORTS", *REPORTS]
