"""Panels: the reports a panel shows, with the panel's parameters and caps.

``run_panel`` builds every report of a panel lazily and returns them with a
status frame; nothing runs until the caller acts on a DataFrame (show, write,
collect at the edge).  Each report stands alone: one whose source is not bound
is ``unavailable``, one whose parameters do not fit (the inactive-users window
once ``days >= inactive_days``) ``invalid``, one that fails otherwise (bad
custom SQL, a frame of another schema) ``error`` with the message; all others
are built.  Status also gives each report's effective window, its rows before
the display cap, and whether that cap cut it; a batch that writes whole reports
takes the rows from the very write (``PanelResult.run``).
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import parse_as_of
from ..operators import flag_rows, trend_glyphs
from ..params import InvalidParams, Params
from ..sources import ACCESS_AUDIT, BILLING_USAGE, SourceUnavailable, Sources
from . import catalog, cost, custom, governance, health, jobs, kpis, queries, rollups, users

STATUS_SCHEMA = (
    "panel string, report string, status string, message string, window_days int, cap int, "
    "total_rows long, truncated boolean"
)

# The column that marks alert rows in some panel reports.
FLAGGED = {
    "users_permission_changes": "action_name",
    "jobs_success_rate": "result_state",
    "governance_access_anomalies": "action_name",
    "governance_schema_changes": "action_name",
}

Build = Callable[[Sources, Params], DataFrame]


def _capped(df: DataFrame, cap: int | None) -> DataFrame:
    return df.limit(cap) if cap is not None else df


def _windows(p: Params) -> dict[str, int]:
    """Look-back in days of the reports whose window is not ``days``."""
    statements = min(p.days, p.statement_days)
    return {
        "health_dbu_today": 0, "health_failed_jobs": 1, "health_dbu_trend": min(p.days, p.trend_days),
        "health_dbu_trend_glyphs": min(p.days, p.trend_days), "users_inactive": min(3 * p.days, p.inactive_days),
        "queries_slowest": statements, "queries_most_expensive": statements, "queries_top_users": statements,
        "queries_error_summary": statements, "catalog_stale_tables": 90,
    }


def _glyphs(trend: DataFrame) -> DataFrame:
    return trend_glyphs(trend.withColumn("series", F.lit("dbu")), ["series"], "usage_date", "dbu")


def _panel_reports(p: Params) -> dict[str, dict[str, tuple[Build, int | None]]]:
    """Report builders and the row cap (fixed values) a panel displays of each."""
    d, cats = p.days, p.catalogs
    w = _windows(p)
    qd, trend, idle = w["queries_slowest"], w["health_dbu_trend"], w["users_inactive"]
    return {
        "health": {
            "health_dbu_today": (lambda s, p: health.health_dbu_today(s, as_of=p.as_of), 1),
            "health_active_users": (lambda s, p: health.health_active_users(s, d, as_of=p.as_of), 1),
            "health_failed_jobs": (lambda s, p: health.health_failed_jobs(s, 24, as_of=p.as_of), 1),
            "health_table_count": (lambda s, p: health.health_table_count(s, cats, as_of=p.as_of), 1),
            "health_dbu_trend": (lambda s, p: health.health_dbu_trend(s, trend, as_of=p.as_of), p.row_limit),
            "health_dbu_trend_glyphs": (
                lambda s, p: _glyphs(health.health_dbu_trend(s, trend, as_of=p.as_of)), p.row_limit),
        },
        "cost": {
            "cost_burn_rate": (lambda s, p: cost.cost_burn_rate(s, d, as_of=p.as_of), 1),
            "cost_daily_by_sku": (lambda s, p: cost.cost_daily_by_sku(s, d, as_of=p.as_of), p.row_limit),
            "cost_top_clusters": (lambda s, p: cost.cost_top_clusters(s, d, 10, as_of=p.as_of), 10),
            "cost_top_jobs": (lambda s, p: cost.cost_top_jobs(s, d, 10, as_of=p.as_of), 10),
            "cost_top_users_by_dbu": (lambda s, p: cost.cost_top_users_by_dbu(s, d, 10, as_of=p.as_of), 10),
        },
        "users": {
            "users_top_by_queries": (lambda s, p: users.users_top_by_queries(s, d, 20, as_of=p.as_of), 20),
            "users_top_by_tables_accessed": (
                lambda s, p: users.users_top_by_tables_accessed(s, d, 20, as_of=p.as_of), 20),
            "users_inactive": (lambda s, p: users.users_inactive(s, d, idle, as_of=p.as_of), 20),
            "users_permission_changes": (lambda s, p: users.users_permission_changes(s, d, 50, as_of=p.as_of), 30),
        },
        "catalog": {
            "catalog_tables_by_schema": (lambda s, p: catalog.catalog_tables_by_schema(s, cats, as_of=p.as_of), 100),
            "catalog_stale_tables": (lambda s, p: catalog.catalog_stale_tables(s, 90, cats, as_of=p.as_of), 50),
            "catalog_most_accessed": (lambda s, p: catalog.catalog_most_accessed(s, d, 20, as_of=p.as_of), 20),
            "catalog_column_count": (lambda s, p: catalog.catalog_column_count(s, cats, 50, as_of=p.as_of), 30),
        },
        "jobs": {
            "jobs_success_rate": (lambda s, p: jobs.jobs_success_rate(s, d, as_of=p.as_of), p.row_limit),
            "jobs_top_failures": (lambda s, p: jobs.jobs_top_failures(s, d, 20, as_of=p.as_of), 20),
            "jobs_longest_runs": (lambda s, p: jobs.jobs_longest_runs(s, d, 20, as_of=p.as_of), 20),
            "jobs_daily_run_volume": (lambda s, p: jobs.jobs_daily_run_volume(s, d, as_of=p.as_of), p.row_limit),
        },
        "queries": {
            "queries_slowest": (lambda s, p: queries.queries_slowest(s, qd, 20, as_of=p.as_of), 20),
            "queries_most_expensive": (lambda s, p: queries.queries_most_expensive(s, qd, 20, as_of=p.as_of), 20),
            "queries_top_users": (lambda s, p: queries.queries_top_users(s, qd, 20, as_of=p.as_of), 20),
            "queries_error_summary": (lambda s, p: queries.queries_error_summary(s, qd, 30, as_of=p.as_of), 20),
        },
        "governance": {
            "governance_tables_without_owners": (
                lambda s, p: governance.governance_tables_without_owners(s, cats, 100, as_of=p.as_of), 50),
            "governance_pii_columns": (
                lambda s, p: governance.governance_pii_columns(s, cats, 200, as_of=p.as_of), 100),
            "governance_access_anomalies": (
                lambda s, p: governance.governance_access_anomalies(s, d, 50, as_of=p.as_of), 30),
            "governance_schema_changes": (
                lambda s, p: governance.governance_schema_changes(s, d, 50, as_of=p.as_of), 30),
        },
    }


def _panel_kpis(panel: str, src: Sources, p: Params) -> DataFrame | None:
    if panel == "health":
        return kpis.kpis_health(src, p.days, p.catalogs, as_of=p.as_of)
    if panel == "cost":
        return kpis.kpis_cost(src, p.days, as_of=p.as_of)
    if panel == "catalog":
        return kpis.kpis_catalog(src, p.catalogs, as_of=p.as_of)
    if panel == "jobs":
        return kpis.kpis_jobs(src, p.days, as_of=p.as_of)
    if panel == "governance":
        return kpis.kpis_governance(src, p.days, p.catalogs, as_of=p.as_of)
    return None


@dataclass
class PanelResult:
    """``status`` counts the rows of each report by running it; ``run`` counts
    them on the way while the reports are written, shown or counted anyway."""

    panel: str
    reports: dict[str, DataFrame]
    kpis: DataFrame | None
    status: DataFrame
    notes: "_Status"

    def run(self, act: Callable[[str, DataFrame], object]) -> DataFrame:
        """Call ``act(name, frame)``, one action, on every report, whole: no
        display cap.  Returns the status frame (windows, caps and totals as in
        ``status``), made of what the actions saw, so no report runs twice.  A
        report that fails gets an ``error`` row and the others go on."""
        rows = list(self.notes.rows)
        for name, (df, cap, message) in self.notes.whole.items():
            seen = Observation()
            window = self.notes.windows.get(name, self.notes.p.days)
            try:
                act(name, df.observe(seen, F.count(F.lit(1)).alias("total_rows")))
                total = seen.get.get("total_rows", 0)
                rows.append((self.panel, name, "ok", message, window, cap, total, cap is not None and total > cap))
            except Exception as e:  # of this report alone
                rows.append((self.panel, name, "error", f"{type(e).__name__}: {str(e)[:500]}", window, None, None, None))
        return self.notes.spark.createDataFrame(rows, STATUS_SCHEMA)


def _shared(panel: str, src: Sources, p: Params, defs: dict) -> tuple[Sources, dict]:
    """Swap in rollup-fed builders: the panel's usage reports read one
    checkpointed daily usage rollup, its audit reports one audit rollup, so
    the raw tables are scanned once per panel load instead of once per report.
    Falls back to the raw reports where a rollup does not apply (no source, or
    an ``as_of`` that is not at midnight for the audit rollup)."""
    d = p.days
    if panel in ("health", "cost") and src.has(BILLING_USAGE):
        src = rollups.with_usage_rollup(src, d, as_of=p.as_of)
    audit_days = {"health": d, "users": max(d, min(3 * d, p.inactive_days)), "catalog": d}.get(panel)
    if audit_days is None or not src.has(ACCESS_AUDIT):
        return src, defs
    a = parse_as_of(src.as_of(ACCESS_AUDIT, p.as_of))
    if a is None or a.time() != datetime.min.time():
        return src, defs
    r = rollups.audit_daily(src, audit_days, as_of=a)
    swaps = {
        "health_active_users": lambda s, p: rollups.active_users_from(r, d),
        "users_top_by_queries": lambda s, p: rollups.top_by_queries_from(r, d, 20),
        "users_top_by_tables_accessed": lambda s, p: rollups.top_by_tables_from(r, d, 20),
        "users_inactive": lambda s, p: rollups.inactive_from(r, d, min(3 * d, p.inactive_days)),
        "catalog_most_accessed": lambda s, p: rollups.most_accessed_from(r, d, 20),
    }
    out = {k: (swaps.get(k, b), cap) for k, (b, cap) in defs.items()}
    return src, out


class _Status:
    """Status rows of a panel; row totals are counted when the frame is."""

    def __init__(self, spark: SparkSession, panel: str, p: Params):
        self.spark, self.panel, self.p, self.rows, self.counts = spark, panel, p, [], []
        self.whole: dict[str, tuple[DataFrame, int | None, str | None]] = {}
        self.windows = _windows(p)

    def build(self, report: str, make: Callable[[], DataFrame], cap: int | None, message: str | None = None):
        """The report's frame, or None with the reason in a status row."""
        try:
            df = make()
            df.schema  # analysis errors show here
        except SourceUnavailable as e:
            return self._note(report, "unavailable", f"source {e} is not bound")
        except InvalidParams as e:
            return self._note(report, "invalid", str(e))
        except Exception as e:  # of this report alone; the others go on
            return self._note(report, "error", f"{type(e).__name__}: {str(e)[:500]}")
        if report in FLAGGED:
            df = flag_rows(df, FLAGGED[report])
        self.whole[report] = (df, cap, message)
        total = F.count(F.lit(1))
        window = self.windows.get(report, self.p.days)
        self.counts.append(df.agg(total.alias("total_rows")).select(
            F.lit(self.panel).alias("panel"), F.lit(report).alias("report"), F.lit("ok").alias("status"),
            F.lit(message).cast("string").alias("message"), F.lit(window).alias("window_days"),
            F.lit(cap).cast("int").alias("cap"), "total_rows",
            F.coalesce(F.col("total_rows") > F.lit(cap).cast("int"), F.lit(False)).alias("truncated"),
        ))
        return _capped(df, cap)

    def _note(self, report: str, status: str, message: str) -> None:
        self.rows.append((self.panel, report, status, message, self.windows.get(report, self.p.days), None, None, None))

    def frame(self) -> DataFrame:
        out = self.spark.createDataFrame(self.rows, STATUS_SCHEMA)
        for counted in self.counts:
            out = out.unionByName(counted)
        return out


def run_panel(
    spark: SparkSession,
    panel: str,
    src: Sources,
    params: Params | None = None,
    shared_scans: bool = False,
    display_caps: bool = True,
) -> PanelResult:
    """All reports of ``panel`` and its KPIs; with ``display_caps`` cut to the
    rows that the panel shows, else whole.

    ``shared_scans=True`` first materialises the daily rollups the panel's
    reports can share (see :mod:`opslens.plans.rollups`); results are equal."""
    p = params or Params()
    defs = _panel_reports(p)
    if panel not in defs:
        if panel in {c.title for c in p.custom_panels}:
            return run_custom_panel(spark, src, p, panel, display_caps)
        raise ValueError(f"unknown panel {panel!r}")
    panel_defs = defs[panel]
    status = _Status(spark, panel, p)
    if shared_scans:
        try:
            src, panel_defs = _shared(panel, src, p, panel_defs)
        except Exception as e:  # the raw reports still stand
            status._note("_shared_scans", "error", f"{type(e).__name__}: {str(e)[:500]}")
    reports = {}
    for name, (build, cap) in panel_defs.items():
        df = status.build(name, lambda: build(src, p), cap if display_caps else None)
        if df is not None:
            reports[name] = df
    try:
        kpi_rows = _panel_kpis(panel, src, p)
    except Exception as e:
        kpi_rows = status._note("_kpis", "error", f"{type(e).__name__}: {str(e)[:500]}")
    return PanelResult(panel, reports, kpi_rows, status.frame(), status)


def run_custom_panel(
    spark: SparkSession, src: Sources, params: Params, title: str, display_caps: bool = True
) -> PanelResult:
    """A configured SQL panel; displays are cut to ``row_limit``."""
    cfg = {c.title: c for c in params.custom_panels}[title]
    status = _Status(spark, title, params)
    cap = params.row_limit if display_caps else None
    df = status.build(title, lambda: custom.custom_report(spark, src, cfg.sql), cap, cfg.description or None)
    return PanelResult(title, {} if df is None else {title: df}, None, status.frame(), status)


def run_all(
    spark: SparkSession,
    src: Sources,
    params: Params | None = None,
    shared_scans: bool = False,
    display_caps: bool = True,
) -> dict[str, PanelResult]:
    """Every panel. Without ``as_of`` the session's time is taken once, for
    all sources that have no clock of their own."""
    p = params or Params()
    if p.as_of is None:
        zone = ZoneInfo(spark.conf.get("spark.sql.session.timeZone"))
        src = src.pinned(datetime.now(zone).replace(tzinfo=None))
    out = {name: run_panel(spark, name, src, p, shared_scans, display_caps) for name in p.panels}
    for c in p.custom_panels:
        out[c.title] = run_custom_panel(spark, src, p, c.title, display_caps)
    return out
