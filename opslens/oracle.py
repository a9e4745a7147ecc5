"""DuckDB oracle SQL for every registered query.

Each statement reads the driver's views (``events``, ``lineitem`` ...)
through CTEs that spell out the same fixture bindings as
:mod:`opslens.sources.fixtures`, then computes the report in plain SQL, in
the shape of the original report (joins before aggregates, ``NOT IN`` /
``NOT EXISTS``), so it is an independent check of the Spark formulation.

Parity rules: counts and integer sums are cast to BIGINT; rounded ratios use
integer HALF_UP (``(2*n*10^s + d) // (2*d)``); NULL ordering and full
tie-breaks are written out wherever a LIMIT follows.
"""
from __future__ import annotations

from .sources.fixtures import (
    ADHOC_EVERY,
    AS_OF,
    AUDIT_ACTIONS,
    COLUMN_KINDS,
    PRICE_PER_BRAND_NUMBER,
    PRICE_PERIODS,
    QUIET_FROM,
    UNPRICED_SKU,
)

# Written out here, apart from the lists the reports use, so that a slip there shows.
QUERY_ACTIONS = "commandFinish runCommand commandSubmit queries databricksSqlPermissionsDenied".split()
TABLE_ACCESS_ACTIONS = "getTable getTableData commandFinish".split()
TABLE_READ_ACTIONS = "getTable getTableData".split()
PERMISSION_ACTIONS = "updatePermissions grantPermissions revokePermissions changeOwner".split()
DENIAL_ACTIONS = "databricksSqlPermissionsDenied unauthorizedAccess accessDenied".split()
DDL_ACTIONS = (
    "createTable deleteTable alterTable createSchema deleteSchema addColumns dropColumns renameColumn"
).split()
PII_TOKENS = (
    "email phone mobile ssn social_security dob birth_date passport national_id tax_id credit_card card_number "
    "salary iban address postcode zipcode gender race religion"
).split()

AUDIT_NOW = f"TIMESTAMP '{AS_OF['access_audit']}'"
USAGE_TODAY = f"DATE '{AS_OF['billing_usage']}'"
RUNS_NOW = f"TIMESTAMP '{AS_OF['job_runs']}'"
CATALOG_NOW = f"TIMESTAMP '{AS_OF['catalog_tables']}'"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _case(expr: str, values) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {whens} END"


_TARGET = "CASE WHEN event_id % 7 <> 0 THEN concat('main.s', event_id % 5, '.t', event_id % 97) END"

CTES = {
    "access_audit": f"""
  SELECT ts AS event_time,
         CASE WHEN acting % 25 <> 0 THEN concat('user_', acting) END AS user_name,
         CASE event_id % 16 {" ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(AUDIT_ACTIONS))}
              WHEN {len(AUDIT_ACTIONS)} THEN event_type END AS action_name,
         {_TARGET} AS full_name_arg,
         {_TARGET} AS securable_full_name,
         props AS changes,
         concat('10.0.', user_id % 256, '.1') AS source_ip_address
  FROM (SELECT *, user_id + CAST(user_id % 10 = 3 AND ts >= TIMESTAMP '{QUIET_FROM}' AS INTEGER) AS acting
        FROM events)""",
    "billing_usage": """
  SELECT CAST(l.l_shipdate AS DATE) AS usage_date,
         p.p_brand AS sku_name,
         l.l_quantity AS usage_quantity,
         s.s_name AS cluster_name,
         CASE WHEN l.l_linestatus = 'O' THEN concat('c-', l.l_suppkey) END AS cluster_id,
         CASE WHEN l.l_returnflag = 'R' THEN concat('j-', l.l_partkey) END AS job_id,
         CASE WHEN l.l_returnflag <> 'N' THEN concat('user_', l.l_suppkey) END AS run_as
  FROM lineitem l
  JOIN part p ON p.p_partkey = l.l_partkey
  JOIN supplier s ON s.s_suppkey = l.l_suppkey""",
    "list_prices": f"""
  SELECT b.sku_name, pp.price_start_time,
         CASE WHEN b.sku_name = '{UNPRICED_SKU}' THEN pp.price_start_time + INTERVAL 1 DAY
              ELSE pp.price_end_time END AS price_end_time,
         CAST(regexp_extract(b.sku_name, '#(\\d+)$', 1) AS DOUBLE) * CAST({PRICE_PER_BRAND_NUMBER} AS DOUBLE)
           * CAST(pp.factor AS DOUBLE) AS price_default
  FROM (SELECT DISTINCT p_brand AS sku_name FROM part) b
  CROSS JOIN (VALUES {", ".join(
        f"(TIMESTAMP '{s}', {f'TIMESTAMP {chr(39)}{e}{chr(39)}' if e else 'CAST(NULL AS TIMESTAMP)'}, {f})"
        for s, e, f in PRICE_PERIODS)}) pp(price_start_time, price_end_time, factor)""",
    "job_runs": f"""
  SELECT o_orderkey AS run_id,
         concat(CASE WHEN o_orderkey % {ADHOC_EVERY} = 0 THEN 'adhoc-' ELSE 'j-' END, o_custkey) AS job_id,
         CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'SUCCEEDED' WHEN 'P' THEN 'CANCELED' END
           AS result_state,
         o_orderdate AS run_start_time,
         CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + to_seconds(o_orderkey % 7200) END AS run_end_time
  FROM orders""",
    "jobs": """
  SELECT concat('j-', c_custkey) AS job_id, c_name AS name FROM customer""",
    "query_history": f"""
  SELECT CASE WHEN e.user_id % 25 <> 0 THEN concat('user_', e.user_id) END AS user_name,
         CAST(floor(e.value * 1000) AS BIGINT) AS duration,
         CAST(floor(e.value * 4000) AS BIGINT) AS total_task_duration_ms,
         e.event_id * 1000 AS rows_produced_count,
         CASE WHEN e.event_type = 'error' THEN 'FAILED' WHEN e.event_type = 'signup' THEN 'CANCELED'
              ELSE 'FINISHED' END AS status,
         d.text AS statement_text,
         CASE WHEN e.event_type = 'error' AND e.event_id % 3 <> 0
              THEN concat('E', e.event_id % 11, ': ', d.source) END AS error_message,
         e.ts AS start_time,
         concat('w-', e.event_id % 4) AS warehouse_id
  FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT max(doc_id) + 1 FROM documents)""",
    "catalog_tables": """
  SELECT p.p_type AS table_catalog, p.p_brand AS table_schema, concat('t_', p.p_partkey) AS table_name,
         CASE WHEN p.p_partkey % 10 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type,
         CAST(DATE '1995-01-01' + p.p_size AS TIMESTAMP) AS created,
         m.last_altered
  FROM part p
  LEFT JOIN (SELECT l_partkey, max(l_shipdate) AS last_altered FROM lineitem GROUP BY l_partkey) m
    ON m.l_partkey = p.p_partkey""",
    "catalog_columns": f"""
  SELECT p.p_type AS table_catalog, p.p_brand AS table_schema, concat('t_', p.p_partkey) AS table_name,
         concat(n.n_name, '_', {_case("(p.p_partkey + n.n_nationkey) % 6", [k for k, _ in COLUMN_KINDS])})
           AS column_name,
         {_case("(p.p_partkey + n.n_nationkey) % 6", [t for _, t in COLUMN_KINDS])} AS data_type
  FROM part p JOIN nation n ON n.n_nationkey < p.p_size % 25 + 1""",
    "table_privileges": """
  SELECT p_type AS table_catalog, p_brand AS table_schema, concat('t_', p_partkey) AS table_name,
         CASE WHEN p_partkey % 3 = 0 THEN 'SELECT' ELSE 'OWNERSHIP' END AS privilege_type
  FROM part""",
}


def with_sources(body: str, *names: str) -> str:
    """``WITH <bindings> <body>``; a body starting with ``, name AS (...)``
    adds its own CTEs after the bindings."""
    ctes = ",\n".join(f"{n} AS ({CTES[n]}\n)" for n in names)
    return f"WITH {ctes}\n{body.strip()}"


def _half_up(num: str, den: str, scale: int) -> str:
    k = 10**scale
    return (
        f"(CAST(sign({num}) * ((abs(CAST({num} AS HUGEINT)) * {2 * k} + ({den})) // (2 * ({den}))) AS DOUBLE)"
        f" / {float(k)})"
    )


def _compact(v: str) -> str:
    d = f"CAST({v} AS DECIMAL(38,6))"
    return (
        f"CASE WHEN {d} IS NULL THEN NULL "
        f"WHEN abs({d}) >= 1000000 THEN printf('%.1fM', CAST(round_even({d}, -5) / 1000000 AS DOUBLE)) "
        f"WHEN abs({d}) >= 1000 THEN printf('%.1fK', CAST(round_even({d}, -2) / 1000 AS DOUBLE)) "
        f"WHEN {d} = floor({d}) THEN printf('%d', CAST({d} AS BIGINT)) "
        f"ELSE format('{{:,.2f}}', CAST(round_even({d}, 2) AS DOUBLE)) END"
    )


def _lb(now: str, days: int) -> str:
    return f"{now} - INTERVAL {days} DAY"


NAMES_ASC = "table_catalog ASC NULLS FIRST, table_schema ASC NULLS FIRST, table_name ASC NULLS FIRST"

# ---------------------------------------------------------------------------
# The 31 reports with the parameters registered in __spark_entry__.py
# ---------------------------------------------------------------------------

Q = {}

Q["health_dbu_today"] = with_sources(f"""
SELECT COALESCE(ROUND(SUM(usage_quantity), 2), 0) AS dbu_today
FROM billing_usage WHERE usage_date = {USAGE_TODAY}""", "billing_usage")

Q["health_active_users"] = with_sources(f"""
SELECT COUNT(DISTINCT user_name) AS active_users
FROM access_audit WHERE event_time >= {_lb(AUDIT_NOW, 7)} AND user_name IS NOT NULL""", "access_audit")

Q["health_failed_jobs"] = with_sources(f"""
SELECT COUNT(*) AS failed_jobs FROM job_runs
WHERE result_state = 'FAILED' AND run_start_time >= {RUNS_NOW} - INTERVAL 24 HOUR""", "job_runs")

Q["health_table_count"] = with_sources("""
SELECT COUNT(*) AS total_tables FROM catalog_tables WHERE table_type = 'BASE TABLE'""", "catalog_tables")

Q["health_dbu_trend"] = with_sources(f"""
SELECT usage_date, ROUND(SUM(usage_quantity), 2) AS dbu FROM billing_usage
WHERE usage_date >= {_lb(USAGE_TODAY, 14)} GROUP BY usage_date ORDER BY usage_date""", "billing_usage")

_DAILY = f"""
, daily AS (
  SELECT usage_date, sku_name, SUM(usage_quantity) AS dbu FROM billing_usage
  WHERE usage_date >= {_lb(USAGE_TODAY, 30)} GROUP BY usage_date, sku_name),
priced AS (
  SELECT d.*, p.price_default, p.price_start_time
  FROM daily d LEFT JOIN list_prices p
    ON d.sku_name = p.sku_name AND d.usage_date >= p.price_start_time
   AND d.usage_date < coalesce(p.price_end_time, TIMESTAMP '9999-01-01'))"""

Q["cost_daily_by_sku"] = with_sources(f"""{_DAILY}
SELECT usage_date, sku_name, ROUND(any_value(dbu), 3) AS dbu,
       ROUND(any_value(dbu) * arg_max(price_default, price_start_time), 2) AS est_usd
FROM priced GROUP BY usage_date, sku_name""", "billing_usage", "list_prices")

Q["cost_top_clusters"] = with_sources(f"""
SELECT cluster_name, cluster_id, ROUND(SUM(usage_quantity), 2) AS total_dbu,
       COUNT(DISTINCT usage_date) AS active_days
FROM billing_usage WHERE usage_date >= {_lb(USAGE_TODAY, 30)} AND cluster_id IS NOT NULL
GROUP BY cluster_name, cluster_id
ORDER BY total_dbu DESC NULLS LAST, cluster_id ASC NULLS FIRST, cluster_name ASC NULLS FIRST LIMIT 10""",
    "billing_usage")

Q["cost_top_jobs"] = with_sources(f"""
SELECT job_id, ROUND(SUM(usage_quantity), 2) AS total_dbu, COUNT(DISTINCT usage_date) AS active_days
FROM billing_usage WHERE usage_date >= {_lb(USAGE_TODAY, 30)} AND job_id IS NOT NULL
GROUP BY job_id ORDER BY total_dbu DESC NULLS LAST, job_id ASC NULLS FIRST LIMIT 10""", "billing_usage")

Q["cost_top_users_by_dbu"] = with_sources(f"""
SELECT run_as AS run_as_user, ROUND(SUM(usage_quantity), 2) AS total_dbu
FROM billing_usage WHERE usage_date >= {_lb(USAGE_TODAY, 30)} AND run_as IS NOT NULL
GROUP BY run_as ORDER BY total_dbu DESC NULLS LAST, run_as_user ASC NULLS FIRST LIMIT 10""", "billing_usage")

Q["cost_burn_rate"] = with_sources(f"""
SELECT ROUND(SUM(usage_quantity), 2) AS total_dbu,
       ROUND(SUM(usage_quantity) / 30, 2) AS avg_daily_dbu,
       ROUND(SUM(usage_quantity) / 30 * 30, 2) AS projected_monthly_dbu,
       COUNT(DISTINCT usage_date) AS active_days
FROM billing_usage WHERE usage_date >= {_lb(USAGE_TODAY, 30)}""", "billing_usage")

Q["users_top_by_queries"] = with_sources(f"""
SELECT user_name, COUNT(*) AS total_events, COUNT(DISTINCT CAST(event_time AS DATE)) AS active_days,
       MIN(event_time) AS first_seen, MAX(event_time) AS last_seen
FROM access_audit
WHERE event_time >= {_lb(AUDIT_NOW, 30)} AND user_name IS NOT NULL AND action_name IN {_in(QUERY_ACTIONS)}
GROUP BY user_name ORDER BY total_events DESC NULLS LAST, user_name ASC NULLS FIRST LIMIT 20""", "access_audit")

Q["users_top_by_tables_accessed"] = with_sources(f"""
SELECT user_name, COUNT(DISTINCT full_name_arg) AS distinct_tables, COUNT(*) AS total_accesses
FROM access_audit
WHERE event_time >= {_lb(AUDIT_NOW, 30)} AND user_name IS NOT NULL
  AND action_name IN {_in(TABLE_ACCESS_ACTIONS)} AND full_name_arg IS NOT NULL
GROUP BY user_name ORDER BY distinct_tables DESC NULLS LAST, user_name ASC NULLS FIRST LIMIT 20""", "access_audit")

def _inactive(now: str, where: str) -> str:
    """Users by their last event: seen within 90 days, but not within 7."""
    return with_sources(f"""
, seen AS (
  SELECT user_name, max(event_time) AS last_seen FROM access_audit
  WHERE event_time >= {_lb(now, 90)} GROUP BY user_name)
SELECT user_name, last_seen, CAST(datediff('day', last_seen, {now}) AS BIGINT) AS days_inactive
FROM seen WHERE last_seen < {_lb(now, 7)} AND {where}""", "access_audit")


Q["users_inactive"] = _inactive(AUDIT_NOW, "user_name IS NOT NULL")

Q["users_permission_changes"] = with_sources(f"""
SELECT event_time, user_name AS changed_by, action_name, securable_full_name AS target_object,
       changes AS changes_detail
FROM access_audit WHERE event_time >= {_lb(AUDIT_NOW, 30)} AND action_name IN {_in(PERMISSION_ACTIONS)}
ORDER BY event_time DESC NULLS LAST, changed_by ASC NULLS FIRST, action_name ASC NULLS FIRST,
         target_object ASC NULLS FIRST, changes_detail ASC NULLS FIRST LIMIT 50""", "access_audit")

Q["catalog_table_inventory"] = with_sources(f"""
SELECT table_catalog, table_schema, table_name, table_type, created, last_altered,
       CAST(datediff('day', last_altered, {CATALOG_NOW}) AS BIGINT) AS days_since_altered
FROM catalog_tables WHERE table_type = 'BASE TABLE'
ORDER BY last_altered DESC NULLS LAST, {NAMES_ASC} LIMIT 500""", "catalog_tables")

Q["catalog_tables_by_schema"] = with_sources("""
SELECT table_catalog, table_schema, COUNT(*) AS table_count
FROM catalog_tables WHERE table_type = 'BASE TABLE' GROUP BY table_catalog, table_schema""", "catalog_tables")

Q["catalog_stale_tables"] = with_sources(f"""
SELECT table_catalog, table_schema, table_name, last_altered,
       CAST(datediff('day', last_altered, {CATALOG_NOW}) AS BIGINT) AS days_stale
FROM catalog_tables
WHERE table_type = 'BASE TABLE' AND last_altered < {_lb(CATALOG_NOW, 90)}""", "catalog_tables")

Q["catalog_column_count"] = with_sources(f"""
SELECT table_catalog, table_schema, table_name, COUNT(*) AS column_count
FROM catalog_columns GROUP BY table_catalog, table_schema, table_name
ORDER BY column_count DESC NULLS LAST, {NAMES_ASC} LIMIT 50""", "catalog_columns")

Q["catalog_most_accessed"] = with_sources(f"""
SELECT full_name_arg AS table_name, COUNT(*) AS access_count, COUNT(DISTINCT user_name) AS distinct_users
FROM access_audit
WHERE event_time >= {_lb(AUDIT_NOW, 30)} AND action_name IN {_in(TABLE_READ_ACTIONS)}
  AND full_name_arg IS NOT NULL
GROUP BY full_name_arg ORDER BY access_count DESC NULLS LAST, table_name ASC NULLS FIRST LIMIT 20""",
    "access_audit")

Q["jobs_success_rate"] = with_sources(f"""
SELECT result_state, COUNT(*) AS run_count,
       {_half_up("COUNT(*) * 100", "SUM(COUNT(*)) OVER ()", 1)} AS pct
FROM job_runs WHERE run_start_time >= {_lb(RUNS_NOW, 30)} GROUP BY result_state""", "job_runs")

Q["jobs_top_failures"] = with_sources(f"""
, failures AS (
  SELECT job_id, COUNT(*) AS failure_count, MAX(run_start_time) AS last_failure FROM job_runs
  WHERE result_state = 'FAILED' AND run_start_time >= {_lb(RUNS_NOW, 30)} GROUP BY job_id),
names AS (SELECT job_id, max(name) AS job_name FROM jobs GROUP BY job_id)
SELECT job_id, job_name, failure_count, last_failure FROM failures LEFT JOIN names USING (job_id)
ORDER BY failure_count DESC NULLS LAST, job_id ASC NULLS FIRST LIMIT 20""", "job_runs", "jobs")

Q["jobs_longest_runs"] = with_sources(f"""
, names AS (SELECT job_id, max(name) AS job_name FROM jobs GROUP BY job_id),
timed AS (
  SELECT job_id, run_id, result_state, run_start_time,
         {_half_up("(epoch_us(run_end_time) - epoch_us(run_start_time))", "60000000", 1)} AS duration_min
  FROM job_runs WHERE run_end_time IS NOT NULL AND run_start_time >= {_lb(RUNS_NOW, 30)})
SELECT job_id, job_name, run_id, result_state, duration_min, run_start_time
FROM timed LEFT JOIN names USING (job_id)
ORDER BY duration_min DESC NULLS LAST, run_id ASC NULLS FIRST LIMIT 20""", "job_runs", "jobs")

Q["jobs_daily_run_volume"] = with_sources(f"""
SELECT CAST(run_start_time AS DATE) AS run_date, COUNT(*) AS total_runs,
       CAST(SUM(CASE WHEN result_state = 'SUCCEEDED' THEN 1 ELSE 0 END) AS BIGINT) AS succeeded,
       CAST(SUM(CASE WHEN result_state = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed
FROM job_runs WHERE run_start_time >= {_lb(RUNS_NOW, 30)} GROUP BY CAST(run_start_time AS DATE)""", "job_runs")

Q["queries_slowest"] = with_sources(f"""
SELECT user_name, {_half_up("duration", "1000", 1)} AS duration_sec, status,
       left(statement_text, 120) AS sql_preview, start_time, warehouse_id
FROM query_history WHERE start_time >= {_lb(AUDIT_NOW, 7)} AND status = 'FINISHED'
ORDER BY duration DESC NULLS LAST, start_time ASC NULLS FIRST, user_name ASC NULLS FIRST,
         warehouse_id ASC NULLS FIRST, sql_preview ASC NULLS FIRST LIMIT 20""", "query_history")

Q["queries_most_expensive"] = with_sources(f"""
SELECT user_name, {_half_up("total_task_duration_ms", "1000", 1)} AS task_sec,
       {_half_up("rows_produced_count", "1000000", 2)} AS rows_m, status,
       left(statement_text, 120) AS sql_preview, start_time
FROM query_history WHERE start_time >= {_lb(AUDIT_NOW, 7)}
ORDER BY total_task_duration_ms DESC NULLS LAST, start_time ASC NULLS FIRST, user_name ASC NULLS FIRST,
         status ASC NULLS FIRST, rows_m ASC NULLS FIRST, sql_preview ASC NULLS FIRST LIMIT 20""", "query_history")

Q["queries_top_users"] = with_sources(f"""
SELECT user_name, COUNT(*) AS query_count,
       CASE WHEN COUNT(duration) > 0
            THEN {_half_up("SUM(duration)", "COUNT(duration) * 1000", 1)} END AS avg_duration_sec,
       COUNT(CASE WHEN status = 'FAILED' THEN 1 END) AS error_count
FROM query_history WHERE start_time >= {_lb(AUDIT_NOW, 7)}
GROUP BY user_name ORDER BY query_count DESC NULLS LAST, user_name ASC NULLS FIRST LIMIT 20""", "query_history")

Q["queries_error_summary"] = with_sources(f"""
SELECT left(error_message, 200) AS error, COUNT(*) AS occurrences, COUNT(DISTINCT user_name) AS affected_users,
       MAX(start_time) AS last_seen
FROM query_history
WHERE start_time >= {_lb(AUDIT_NOW, 7)} AND status = 'FAILED' AND error_message IS NOT NULL
GROUP BY left(error_message, 200) ORDER BY occurrences DESC NULLS LAST, error ASC NULLS FIRST LIMIT 30""",
    "query_history")

Q["governance_tables_without_owners"] = with_sources(f"""
, owned AS (
  SELECT DISTINCT table_catalog, table_schema, table_name FROM table_privileges WHERE privilege_type = 'OWNERSHIP')
SELECT table_catalog, table_schema, table_name, created, last_altered
FROM catalog_tables ANTI JOIN owned USING (table_catalog, table_schema, table_name)
WHERE table_type = 'BASE TABLE'
ORDER BY last_altered ASC NULLS FIRST, {NAMES_ASC} LIMIT 100""", "catalog_tables", "table_privileges")

Q["governance_pii_columns"] = with_sources(f"""
SELECT table_catalog, table_schema, table_name, column_name, data_type
FROM catalog_columns WHERE regexp_matches(lower(column_name), '({"|".join(PII_TOKENS)})')
ORDER BY {NAMES_ASC}, column_name ASC NULLS FIRST, data_type ASC NULLS FIRST LIMIT 200""", "catalog_columns")

def _anomalies(days: int) -> str:
    return with_sources(f"""
SELECT user_name, action_name, full_name_arg AS target_object, event_time, source_ip_address
FROM access_audit WHERE event_time >= {_lb(AUDIT_NOW, days)} AND action_name IN {_in(DENIAL_ACTIONS)}
ORDER BY event_time DESC NULLS LAST, user_name ASC NULLS FIRST, action_name ASC NULLS FIRST,
         target_object ASC NULLS FIRST, source_ip_address ASC NULLS FIRST LIMIT 50""", "access_audit")


Q["governance_access_anomalies"] = _anomalies(7)

Q["governance_schema_changes"] = with_sources(f"""
SELECT event_time, user_name, action_name, full_name_arg AS object_name, changes AS change_detail
FROM access_audit WHERE event_time >= {_lb(AUDIT_NOW, 30)} AND action_name IN {_in(DDL_ACTIONS)}
ORDER BY event_time DESC NULLS LAST, user_name ASC NULLS FIRST, action_name ASC NULLS FIRST,
         object_name ASC NULLS FIRST, change_detail ASC NULLS FIRST LIMIT 50""", "access_audit")


def _kpi_row(panel: str, metric: str, value: str, display: str | None = None, severity: str = "'neutral'") -> str:
    v = f"CAST({value} AS DOUBLE)"
    return (
        f"SELECT '{panel}' AS panel, '{metric}' AS metric, {v} AS value, "
        f"{display if display is not None else _compact(v)} AS display, {severity} AS severity, 'ok' AS status"
    )


def _count_text(v: str) -> str:
    return f"printf('%d', CAST({v} AS BIGINT))"


def _sub(name: str) -> str:
    """Report ``name`` as a subquery (its CTEs inlined)."""
    return f"({Q[name]})"


# ---------------------------------------------------------------------------
# Derivations over the reports (registered parameters: days=30, no scope)
# ---------------------------------------------------------------------------

Q["kpis_health"] = with_sources(f"""
SELECT * FROM (
  {_kpi_row("health", "dbu_today", "dbu_today")} FROM {_sub("health_dbu_today")} a
  UNION ALL
  {_kpi_row("health", "active_users", "n")} FROM (
    SELECT COUNT(DISTINCT user_name) AS n FROM access_audit
    WHERE event_time >= {_lb(AUDIT_NOW, 30)} AND user_name IS NOT NULL) b
  UNION ALL
  {_kpi_row("health", "failed_jobs", "failed_jobs", _count_text("failed_jobs"),
            "CASE WHEN failed_jobs > 0 THEN 'critical' ELSE 'good' END")} FROM {_sub("health_failed_jobs")} c
  UNION ALL
  {_kpi_row("health", "total_tables", "total_tables")} FROM {_sub("health_table_count")} d
)""", "access_audit")

Q["kpis_cost"] = f"""
SELECT 'cost' AS panel, metric, CAST(v AS DOUBLE) AS value, {_compact("v")} AS display, sev AS severity,
       'ok' AS status
FROM (
  SELECT 'total_dbu' AS metric, total_dbu AS v, 'neutral' AS sev FROM {_sub("cost_burn_rate")} a
  UNION ALL SELECT 'avg_daily_dbu', avg_daily_dbu, 'neutral' FROM {_sub("cost_burn_rate")} b
  UNION ALL SELECT 'projected_monthly_dbu', projected_monthly_dbu, 'warning' FROM {_sub("cost_burn_rate")} c
)"""

Q["kpis_catalog"] = f"""
{_kpi_row("catalog", "total_tables", "n")}
FROM (SELECT COALESCE(SUM(table_count), 0) AS n FROM {_sub("catalog_tables_by_schema")} s)"""

_RATE = _half_up("ok_runs * 100", "total", 1)
Q["kpis_jobs"] = with_sources(f"""
, agg AS (
  SELECT COUNT(*) AS total, COUNT(CASE WHEN result_state = 'SUCCEEDED' THEN 1 END) AS ok_runs
  FROM job_runs WHERE run_start_time >= {_lb(RUNS_NOW, 30)}),
rated AS (SELECT total, CASE WHEN total > 0 THEN {_RATE} ELSE 0.0 END AS rate FROM agg)
{_kpi_row("jobs", "success_rate", "rate",
          "CASE WHEN total > 0 THEN printf('%.1f%%', rate) ELSE '0%' END",
          "CASE WHEN rate >= 95 THEN 'good' WHEN rate >= 80 THEN 'warning' ELSE 'critical' END")} FROM rated
UNION ALL
{_kpi_row("jobs", "total_runs", "total")} FROM rated""", "job_runs")


def _uncapped(name_or_sql: str) -> str:
    body = Q.get(name_or_sql, name_or_sql)
    return body[: body.rindex("ORDER BY")]


Q["kpis_governance"] = f"""
{_kpi_row("governance", "tables_without_owners", "n", _count_text("n"),
          "CASE WHEN n > 0 THEN 'critical' ELSE 'good' END")}
FROM (SELECT COUNT(*) AS n FROM ({_uncapped("governance_tables_without_owners")}) x) a
UNION ALL
{_kpi_row("governance", "pii_columns", "n", _count_text("n"), "'warning'")}
FROM (SELECT COUNT(*) AS n FROM ({_uncapped("governance_pii_columns")}) x) b
UNION ALL
{_kpi_row("governance", "access_denials", "n", _count_text("n"), "CASE WHEN n > 0 THEN 'critical' ELSE 'good' END")}
FROM (SELECT COUNT(*) AS n FROM ({_uncapped(_anomalies(30))}) x) c"""

Q["custom_report"] = with_sources("""
SELECT user_name, COUNT(*) AS cnt FROM access_audit GROUP BY user_name
ORDER BY cnt DESC NULLS LAST, user_name ASC NULLS FIRST LIMIT 500""", "access_audit")

Q["flag_rows"] = with_sources("""
SELECT run_id, result_state, COALESCE(regexp_matches(upper(result_state), 'FAIL|ERROR|DENIED'), false) AS is_alert
FROM job_runs""", "job_runs")

Q["trend_glyphs"] = with_sources(f"""
, daily AS (
  SELECT sku_name, usage_date, COALESCE(CAST(ROUND(SUM(usage_quantity), 2) AS DOUBLE), 0.0) AS v
  FROM billing_usage WHERE usage_date >= {_lb(USAGE_TODAY, 14)} GROUP BY sku_name, usage_date),
rng AS (
  SELECT sku_name, MIN(v) AS lo, MAX(v) AS hi, COUNT(*) AS points, bool_and(v = 0) AS all_zero
  FROM daily GROUP BY sku_name)
SELECT r.sku_name, r.points,
       CASE WHEN r.all_zero THEN '▁▁▁▁▁▁▁▁▁▁'
            ELSE string_agg(substr('▁▂▃▄▅▆▇█',
                   CAST(least(7, floor((d.v - r.lo) / CASE WHEN r.hi - r.lo = 0 THEN 1.0 ELSE r.hi - r.lo END
                                       * 7.0)) AS INTEGER) + 1, 1), '' ORDER BY d.usage_date) END AS trend
FROM daily d JOIN rng r ON r.sku_name = d.sku_name
GROUP BY r.sku_name, r.points, r.all_zero""", "billing_usage")

Q["preview"] = with_sources("""
SELECT start_time, user_name,
       CASE WHEN statement_text IS NULL THEN ''
            WHEN length(statement_text) > 80 THEN concat(left(statement_text, 80), '…')
            ELSE statement_text END AS preview
FROM query_history""", "query_history")

Q["scope"] = with_sources("""
SELECT table_catalog, table_schema, COUNT(*) AS table_count
FROM catalog_tables WHERE table_type = 'BASE TABLE' AND table_catalog IN ('PROMO', 'SMALL')
GROUP BY table_catalog, table_schema""", "catalog_tables")


# ---------------------------------------------------------------------------
# Report options and rollup-fed reports
# ---------------------------------------------------------------------------

_LATER = "DATE '2001-11-08'"  # past the last usage, so dates are missing
Q["health_dbu_trend_filled"] = with_sources(f"""
, daily AS (
  SELECT usage_date, ROUND(SUM(usage_quantity), 2) AS dbu FROM billing_usage
  WHERE usage_date >= {_lb(_LATER, 14)} GROUP BY usage_date),
calendar AS (
  SELECT CAST(d AS DATE) AS usage_date
  FROM generate_series({_lb(_LATER, 14)}, CAST({_LATER} AS TIMESTAMP), INTERVAL 1 DAY) g(d))
SELECT COALESCE(c.usage_date, t.usage_date) AS usage_date, COALESCE(t.dbu, 0.0) AS dbu
FROM calendar c FULL OUTER JOIN daily t ON t.usage_date = c.usage_date""", "billing_usage")

Q["cost_daily_by_sku_all_prices"] = with_sources(f"""{_DAILY}
SELECT usage_date, sku_name, ROUND(SUM(dbu), 3) AS dbu, ROUND(SUM(dbu * price_default), 2) AS est_usd
FROM priced GROUP BY usage_date, sku_name""", "billing_usage", "list_prices")

# Nobody is active in the week before this moment, so NOT IN keeps the NULL user too.
Q["users_inactive_null_aware"] = _inactive("TIMESTAMP '2024-02-10 00:00:00'", "true")

Q["governance_pii_columns_whole_token"] = with_sources(f"""
SELECT table_catalog, table_schema, table_name, column_name, data_type
FROM catalog_columns WHERE regexp_matches(lower(column_name), '(^|_)({"|".join(PII_TOKENS)})(_|$)')
ORDER BY {NAMES_ASC}, column_name ASC NULLS FIRST, data_type ASC NULLS FIRST LIMIT 200""", "catalog_columns")

for _name in ("health_dbu_today", "health_dbu_trend", "cost_daily_by_sku", "cost_top_clusters", "cost_top_jobs",
              "cost_top_users_by_dbu", "cost_burn_rate", "health_active_users", "users_top_by_queries",
              "users_top_by_tables_accessed", "users_inactive", "catalog_most_accessed"):
    Q[f"{_name}_rollup"] = Q[_name]


def oracle_sql() -> dict[str, str]:
    return dict(Q)
