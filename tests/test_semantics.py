"""One inline micro-fixture per semantic decision (NULLs, overlaps, ties,
empty input, window edges)."""
from __future__ import annotations

from datetime import date, datetime

import pytest

from opslens import plans
from opslens.sources import (
    ACCESS_AUDIT,
    BILLING_USAGE,
    CATALOG_COLUMNS,
    CATALOG_TABLES,
    JOB_RUNS,
    JOBS,
    LIST_PRICES,
    TABLE_PRIVILEGES,
    SchemaMismatch,
    Sources,
)

AUDIT = "event_time timestamp_ntz, user_name string, action_name string, " \
        "request_params map<string,string>, source_ip_address string"
USAGE = "usage_date date, sku_name string, usage_quantity double, custom_tags map<string,string>, " \
        "usage_metadata map<string,string>, identity_metadata map<string,string>"
PRICES = "sku_name string, price_start_time timestamp_ntz, price_end_time timestamp_ntz, pricing struct<default:double>"
RUNS = "run_id long, job_id string, result_state string, run_start_time timestamp_ntz, run_end_time timestamp_ntz"
JOBDEF = "job_id string, name string"
TABLES = "table_catalog string, table_schema string, table_name string, table_type string, " \
         "created timestamp_ntz, last_altered timestamp_ntz"
COLUMNS = "table_catalog string, table_schema string, table_name string, column_name string, data_type string"
PRIVS = "table_catalog string, table_schema string, table_name string, privilege_type string"

NOW = datetime(2024, 1, 31)


def ts(day, hour=0, minute=0, second=0):
    return datetime(2024, 1, day, hour, minute, second)


def usage_row(d, sku, qty, cluster=None, job=None, run_as=None):
    return (d, sku, qty, {"cluster_name": "c"}, {"cluster_id": cluster, "job_id": job}, {"run_as": run_as})


def test_overlapping_prices_and_missing_price(spark):
    usage = spark.createDataFrame(
        [usage_row(date(2024, 1, 10), "A", 3.0), usage_row(date(2024, 1, 10), "B", 2.0)], USAGE
    )
    prices = spark.createDataFrame(
        [("A", ts(1), None, (1.0,)), ("A", ts(5), None, (2.0,))], PRICES
    )
    src = Sources().bind(BILLING_USAGE, usage).bind(LIST_PRICES, prices)
    got = {r["sku_name"]: (r["dbu"], r["est_usd"]) for r in
           plans.cost_daily_by_sku(src, 30, as_of="2024-01-10").collect()}
    assert got == {"A": (3.0, 6.0), "B": (2.0, None)}
    fanned = {r["sku_name"]: (r["dbu"], r["est_usd"]) for r in
              plans.cost_daily_by_sku(src, 30, as_of="2024-01-10", price_dedup="all").collect()}
    assert fanned == {"A": (6.0, 9.0), "B": (2.0, None)}


def test_price_validity_edges(spark):
    """start <= date < end: a price ending on a date no longer applies to it."""
    usage = spark.createDataFrame([usage_row(date(2024, 1, 10), "A", 1.0)], USAGE)
    prices = spark.createDataFrame(
        [("A", ts(1), ts(10), (1.0,)), ("A", ts(10), None, (5.0,))], PRICES
    )
    src = Sources().bind(BILLING_USAGE, usage).bind(LIST_PRICES, prices)
    assert plans.cost_daily_by_sku(src, 30, as_of="2024-01-10").first()["est_usd"] == 5.0


def test_run_duration_minutes_and_open_runs(spark):
    runs = spark.createDataFrame(
        [(1, "j1", "SUCCEEDED", ts(30), ts(30, 0, 1, 30)), (2, "j1", "FAILED", ts(30), None)], RUNS
    )
    src = Sources().bind(JOB_RUNS, runs).bind(JOBS, spark.createDataFrame([("j1", "daily")], JOBDEF))
    rows = plans.jobs_longest_runs(src, 30, as_of=NOW).collect()
    assert [(r["run_id"], r["duration_min"], r["job_name"]) for r in rows] == [(1, 1.5, "daily")]


def _audit(spark, rows):
    return spark.createDataFrame(
        [(t, u, a, {"full_name_arg": tgt, "securable_full_name": tgt, "changes": None}, "1.1.1.1")
         for t, u, a, tgt in rows],
        AUDIT,
    )


def test_inactive_users_null_semantics(spark):
    rows = [(ts(30), None, "x", None), (ts(29), "u1", "x", None), (ts(20), "u2", "x", None)]
    src = Sources().bind(ACCESS_AUDIT, _audit(spark, rows))
    default = plans.users_inactive(src, 7, 90, as_of=NOW).collect()
    assert [(r["user_name"], r["days_inactive"]) for r in default] == [("u2", 11)]
    assert plans.users_inactive(src, 7, 90, as_of=NOW, null_aware=True).collect() == []
    # nobody active at all: NOT IN over an empty set keeps the NULL user too
    quiet = Sources().bind(ACCESS_AUDIT, _audit(spark, [(ts(1), None, "x", None), (ts(2), "u2", "x", None)]))
    got = {r["user_name"] for r in plans.users_inactive(quiet, 7, 90, as_of=NOW, null_aware=True).collect()}
    assert got == {None, "u2"}


def test_inactive_window_must_be_longer(spark):
    src = Sources().bind(ACCESS_AUDIT, _audit(spark, [(ts(1), "u", "x", None)]))
    with pytest.raises(ValueError):
        plans.users_inactive(src, 90, 90, as_of=NOW)


def test_duplicate_job_definitions_do_not_fan_out(spark):
    runs = spark.createDataFrame(
        [(i, "j1", "FAILED", ts(30, i), None) for i in range(3)], RUNS
    )
    defs = spark.createDataFrame([("j1", "old name"), ("j1", "new name")], JOBDEF)
    src = Sources().bind(JOB_RUNS, runs).bind(JOBS, defs)
    rows = plans.jobs_top_failures(src, 30, as_of=NOW).collect()
    assert len(rows) == 1 and rows[0]["failure_count"] == 3
    dated = spark.createDataFrame(
        [("j1", "old name", ts(1)), ("j1", "new name", ts(2))], JOBDEF + ", change_time timestamp_ntz"
    )
    rows = plans.jobs_top_failures(src.bind(JOBS, dated), 30, as_of=NOW).collect()
    assert len(rows) == 1 and rows[0]["job_name"] == "new name"


def test_lookback_includes_first_date_and_future(spark):
    usage = spark.createDataFrame(
        [usage_row(date(2024, 1, 1), "A", 1.0), usage_row(date(2023, 12, 31), "A", 10.0),
         usage_row(date(2024, 2, 5), "A", 100.0)],
        USAGE,
    )
    src = Sources().bind(BILLING_USAGE, usage)
    burn = plans.cost_burn_rate(src, 30, as_of="2024-01-31").first()
    assert burn["total_dbu"] == 101.0 and burn["active_days"] == 2  # Jan 1 in, Dec 31 out, future in
    trend = plans.health_dbu_trend(src, 30, as_of="2024-01-31", fill_gaps=True).collect()
    assert len(trend) == 32 and trend[0]["usage_date"] == date(2024, 1, 1) and trend[1]["dbu"] == 0.0
    assert trend[-1]["usage_date"] == date(2024, 2, 5) and trend[-1]["dbu"] == 100.0  # future row kept


def test_empty_usage(spark):
    src = Sources().bind(BILLING_USAGE, spark.createDataFrame([], USAGE))
    assert plans.health_dbu_today(src, as_of="2024-01-31").first()["dbu_today"] == 0
    burn = plans.cost_burn_rate(src, 30, as_of="2024-01-31").first()
    assert burn["total_dbu"] is None and burn["avg_daily_dbu"] is None and burn["active_days"] == 0


def test_pii_match_modes(spark):
    cols = spark.createDataFrame(
        [("c", "s", "t", n, "string") for n in ("ip_address", "trace_id", "email", "amount")], COLUMNS
    )
    src = Sources().bind(CATALOG_COLUMNS, cols)
    loose = {r["column_name"] for r in plans.governance_pii_columns(src).collect()}
    strict = {r["column_name"] for r in plans.governance_pii_columns(src, whole_token=True).collect()}
    assert loose == {"ip_address", "trace_id", "email"}
    assert strict == {"ip_address", "email"}


def test_null_last_altered_ordering(spark):
    t = spark.createDataFrame(
        [("c", "s", "t1", "BASE TABLE", ts(1), None), ("c", "s", "t2", "BASE TABLE", ts(1), datetime(2023, 1, 1)),
         ("c", "s", "t3", "BASE TABLE", ts(1), ts(30))],
        TABLES,
    )
    src = Sources().bind(CATALOG_TABLES, t).bind(TABLE_PRIVILEGES, spark.createDataFrame([], PRIVS))
    assert [r["table_name"] for r in plans.governance_tables_without_owners(src, as_of=NOW).collect()] == [
        "t1", "t2", "t3"]
    assert [r["table_name"] for r in plans.catalog_stale_tables(src, as_of=NOW).collect()] == ["t2"]
    assert [r["table_name"] for r in plans.catalog_table_inventory(src, as_of=NOW).collect()] == ["t3", "t2", "t1"]


def test_ownership_anti_join_and_scope(spark):
    t = spark.createDataFrame(
        [("main", "s", "owned", "BASE TABLE", ts(1), ts(2)), ("main", "s", "free", "BASE TABLE", ts(1), ts(2)),
         ("dev", "s", "free", "BASE TABLE", ts(1), ts(2)), ("main", "s", "v", "VIEW", ts(1), ts(2))],
        TABLES,
    )
    p = spark.createDataFrame([("main", "s", "owned", "OWNERSHIP"), ("main", "s", "free", "SELECT")], PRIVS)
    src = Sources().bind(CATALOG_TABLES, t).bind(TABLE_PRIVILEGES, p)
    got = {(r["table_catalog"], r["table_name"]) for r in plans.governance_tables_without_owners(src).collect()}
    assert got == {("main", "free"), ("dev", "free")}
    scoped = plans.governance_tables_without_owners(src, catalogs=("main",)).collect()
    assert [(r["table_catalog"], r["table_name"]) for r in scoped] == [("main", "free")]
    assert plans.health_table_count(src).first()["total_tables"] == 3


def test_ties_at_the_cap_are_deterministic(spark):
    rows = [(ts(30, 1), f"u{i % 7}", "accessDenied", f"t{i % 3}") for i in range(40)]
    df = _audit(spark, rows)
    a = plans.governance_access_anomalies(Sources().bind(ACCESS_AUDIT, df.repartition(1)), 7, 10, as_of=NOW)
    b = plans.governance_access_anomalies(Sources().bind(ACCESS_AUDIT, df.repartition(7)), 7, 10, as_of=NOW)
    assert a.collect() == b.collect()
    assert [r["user_name"] for r in a.collect()] == ["u0"] * 6 + ["u1"] * 4


def test_failed_jobs_hours_window(spark):
    runs = spark.createDataFrame(
        [(1, "j", "FAILED", datetime(2024, 1, 30, 0, 0), None), (2, "j", "FAILED", datetime(2024, 1, 29, 23, 59), None),
         (3, "j", "SUCCEEDED", datetime(2024, 1, 30, 12), None)],
        RUNS,
    )
    src = Sources().bind(JOB_RUNS, runs)
    assert plans.health_failed_jobs(src, 24, as_of=NOW).first()["failed_jobs"] == 1


def test_success_rate_shares(spark):
    runs = spark.createDataFrame(
        [(i, "j", s, ts(30), None) for i, s in enumerate(["SUCCEEDED"] * 2 + ["FAILED"])], RUNS
    )
    src = Sources().bind(JOB_RUNS, runs)
    got = {r["result_state"]: (r["run_count"], r["pct"]) for r in plans.jobs_success_rate(src, as_of=NOW).collect()}
    assert got == {"SUCCEEDED": (2, 66.7), "FAILED": (1, 33.3)}
    from opslens.plans.kpis import kpis_jobs

    k = {r["metric"]: r for r in kpis_jobs(src, as_of=NOW).collect()}
    assert k["success_rate"]["value"] == 66.7 and k["success_rate"]["display"] == "66.7%"
    assert k["success_rate"]["severity"] == "critical" and k["total_runs"]["display"] == "3"


def test_bind_validates_schema(spark):
    with pytest.raises(SchemaMismatch):
        Sources().bind(JOBS, spark.createDataFrame([("j",)], "job_id string"))


def test_missing_source_is_unavailable(spark):
    from opslens.plans.kpis import kpis_health

    runs = spark.createDataFrame([(1, "j", "FAILED", ts(30), None)], RUNS)
    k = {r["metric"]: r for r in kpis_health(Sources().bind(JOB_RUNS, runs), as_of=NOW).collect()}
    assert k["failed_jobs"]["status"] == "ok" and k["failed_jobs"]["value"] == 1.0
    assert k["failed_jobs"]["severity"] == "critical"
    assert k["dbu_today"]["status"] == "unavailable" and k["dbu_today"]["value"] is None


def test_approx_active_users_close_to_exact(src_small):
    exact = plans.health_active_users(src_small, 30).first()["active_users"]
    approx = plans.health_active_users(src_small, 30, approx=True).first()["active_users"]
    assert exact > 0 and abs(approx - exact) <= max(1, 0.1 * exact)


def test_latest_per_key(spark):
    from opslens.operators import latest_per_key

    df = spark.createDataFrame(
        [("j1", "old", ts(1)), ("j1", "new", ts(2)), ("j2", "only", ts(1))], "job_id string, name string, at timestamp_ntz"
    )
    got = {r["job_id"]: r["name"] for r in latest_per_key(df, "job_id", "name", order="at").collect()}
    assert got == {"j1": "new", "j2": "only"}
    assert {r["job_id"]: r["name"] for r in latest_per_key(df, "job_id", "name").collect()}["j1"] == "old"


def test_decimal_quantities_stay_exact(spark):
    from decimal import Decimal

    schema = USAGE.replace("usage_quantity double", "usage_quantity decimal(38,18)")
    usage = spark.createDataFrame(
        [(date(2024, 1, 30), "A", Decimal("0.1"), {"cluster_name": "c"}, {"cluster_id": "k", "job_id": "j"},
          {"run_as": "u"}),
         (date(2024, 1, 30), "A", Decimal("0.2"), {"cluster_name": "c"}, {"cluster_id": "k", "job_id": "j"},
          {"run_as": "u"})],
        schema,
    )
    prices = spark.createDataFrame([("A", ts(1), None, (Decimal("0.1"),))],
                                   PRICES.replace("struct<default:double>", "struct<default:decimal(10,4)>"))
    src = Sources().bind(BILLING_USAGE, usage).bind(LIST_PRICES, prices)
    assert plans.health_dbu_today(src, as_of="2024-01-30").first()["dbu_today"] == Decimal("0.30")
    row = plans.cost_daily_by_sku(src, 30, as_of="2024-01-31").first()
    assert row["dbu"] == Decimal("0.300") and row["est_usd"] == Decimal("0.03")
    burn = plans.cost_burn_rate(src, 30, as_of="2024-01-31").first()
    assert burn["total_dbu"] == Decimal("0.30") and burn["active_days"] == 1
    assert plans.cost_top_clusters(src, 30, as_of="2024-01-31").first()["total_dbu"] == Decimal("0.30")
    from opslens.plans.kpis import kpis_cost

    k = {r["metric"]: r["display"] for r in kpis_cost(src, 30, as_of="2024-01-31").collect()}
    assert k["total_dbu"] == "0.30"
