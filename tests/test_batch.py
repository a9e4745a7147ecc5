"""Panels as a batch job: isolation, whole results, clocks, flags, partitions."""
from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from opslens import Params, Sources, plans
from opslens.__main__ import main
from opslens.params import CustomPanel, InvalidParams
from opslens.plans import rollups
from opslens.plans.panels import run_all, run_panel
from opslens.sources import ACCESS_AUDIT, JOB_RUNS
from opslens.sources.fixtures import bind_driver_tables

RUNS = "run_id long, job_id string, result_state string, run_start_time {0}, run_end_time {0}"
AUDIT = (
    "event_time {0}, user_name string, action_name string, request_params map<string,string>, source_ip_address string"
)


def test_one_bad_panel_leaves_the_others(spark, src_small):
    p = Params(panels=("jobs",), custom_panels=(CustomPanel("broken", "SELECT nothing FROM nowhere"),
                                                CustomPanel("fine", "SELECT count(*) AS n FROM job_runs")))
    out = run_all(spark, src_small, p)
    assert out["fine"].reports["fine"].first()["n"] > 0 and out["jobs"].reports["jobs_success_rate"].count() > 0
    (row,) = out["broken"].status.collect()
    assert row["status"] == "error" and "nowhere" in row["message"] and not out["broken"].reports


def test_wrong_schema_is_an_error_and_bad_window_invalid(spark, src_small):
    src = src_small.bind(JOB_RUNS, lambda: spark.range(3))
    st = {r["report"]: r["status"] for r in run_panel(spark, "jobs", src).status.collect()}
    assert set(st.values()) == {"error"}
    with pytest.raises(InvalidParams):
        Params(statement_days=0)


def test_without_sources_everything_is_unavailable(spark):
    r = run_panel(spark, "jobs", Sources())
    assert {x["status"] for x in r.status.collect()} == {"unavailable"}
    assert {x["metric"] for x in r.kpis.collect()} == {"success_rate", "total_runs"}
    cost = run_panel(spark, "cost", Sources()).kpis.collect()
    assert len(cost) == 3 and {x["status"] for x in cost} == {"unavailable"}


def test_display_caps_and_status(spark, src_small):
    p = Params(row_limit=5)
    capped, whole = (run_panel(spark, "cost", src_small, p, display_caps=c) for c in (True, False))
    n = whole.reports["cost_daily_by_sku"].count()
    assert capped.reports["cost_daily_by_sku"].count() == 5 < n
    row = {r["report"]: r for r in capped.status.collect()}["cost_daily_by_sku"]
    assert row["total_rows"] == n and row["truncated"] and row["cap"] == 5 and row["window_days"] == 30
    row = {r["report"]: r for r in whole.status.collect()}["cost_daily_by_sku"]
    assert row["total_rows"] == n and not row["truncated"]


def test_flags_and_glyphs(spark, src_small):
    jobs = run_panel(spark, "jobs", src_small).reports["jobs_success_rate"].collect()
    assert {r["result_state"]: r["is_alert"] for r in jobs}["FAILED"] is True
    assert not any(r["is_alert"] for r in jobs if r["result_state"] == "SUCCEEDED")
    (row,) = run_panel(spark, "health", src_small).reports["health_dbu_trend_glyphs"].collect()
    assert set(row["trend"]) <= set("▁▂▃▄▅▆▇█")


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_hours_with_a_date_partition_on_the_session_clock(spark, kind):
    hours = spark.range(1, 30).select(
        F.col("id").alias("run_id"), F.lit("j").alias("job_id"), F.lit("FAILED").alias("result_state"),
        F.expr(f"cast(localtimestamp() - make_dt_interval(0, id) as {kind})").alias("run_start_time"),
        F.lit(None).cast(kind).alias("run_end_time"),
    ).withColumn("run_date", F.to_date("run_start_time"))
    plain = Sources().bind(JOB_RUNS, hours)
    hinted = Sources().bind(JOB_RUNS, hours, date_partitions={"run_start_time": "run_date"})
    counts = [plans.health_failed_jobs(s, 24).first()[0] for s in (plain, hinted)]
    assert counts[0] == counts[1] >= 23


def test_offset_clock_with_a_date_partition_and_rollup(spark):
    rows = [(datetime(2024, 1, 29, 23, 0), "a", "getTable", {"full_name_arg": "t"}, None),
            (datetime(2024, 1, 30, 12, 0), "b", "getTable", {"full_name_arg": "t"}, None)]
    df = spark.createDataFrame(rows, AUDIT.format("timestamp")).withColumn("event_date", F.to_date("event_time"))
    as_of = "2024-01-31T00:00:00+02:00"  # 22:00 of the 30th in the session's zone, UTC
    plain = Sources().bind(ACCESS_AUDIT, df)
    hinted = Sources().bind(ACCESS_AUDIT, df, date_partitions={"event_time": "event_date"})
    counts = [plans.health_active_users(s, 1, as_of=as_of).first()[0] for s in (plain, hinted)]
    assert counts == [2, 2]
    with pytest.raises(ValueError):
        rollups.audit_daily(plain, 1, as_of=as_of)  # not at midnight here


def test_price_ties_do_not_depend_on_order(spark):
    usage = spark.createDataFrame(
        [(datetime(2024, 1, 2).date(), "A", 1.0, {}, {}, {})],
        "usage_date date, sku_name string, usage_quantity double, custom_tags map<string,string>, "
        "usage_metadata map<string,string>, identity_metadata map<string,string>",
    )
    rows = [("A", datetime(2024, 1, 1), None, {"default": x}) for x in (1.0, 2.0)]
    schema = (
        "sku_name string, price_start_time timestamp_ntz, price_end_time timestamp_ntz, pricing map<string,double>"
    )
    for order in (rows, rows[::-1]):
        src = Sources().bind("billing_usage", usage).bind("list_prices", spark.createDataFrame(order, schema))
        assert plans.cost_daily_by_sku(src, 30, as_of="2024-01-31").first()["est_usd"] == 2.0


def test_bindings_grow_with_the_tables(spark):
    small, large = (bind_driver_tables(spark, f"/root/testdata/{sf}") for sf in ("sf0.001", "sf0.01"))
    for sf, src in (("sf0.001", small), ("sf0.01", large)):
        rows = {t: spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet").count() for t in ("events", "customer", "documents")}
        assert src["access_audit"].count() == rows["events"] and src["jobs"].count() == rows["customer"]
        texts = src["query_history"].select("statement_text").distinct().count()
        assert texts > 0.8 * min(rows["documents"], rows["events"])


@pytest.mark.parametrize("name", ["jobs_success_rate", "jobs_top_failures", "jobs_longest_runs", "kpis_jobs"])
def test_one_scan_of_the_run_log(spark, src_small, name):
    from opslens.plans import REPORTS, kpis

    df = REPORTS[name](src_small) if name in REPORTS else kpis.kpis_jobs(src_small)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("o_orderkey#") and sum("Relation [o_orderkey" in line for line in plan.splitlines()) == 1


def test_usage_reports_do_not_read_orders(spark, src_small):
    for name in ("health_dbu_today", "health_dbu_trend", "cost_daily_by_sku", "cost_burn_rate"):
        assert "o_orderkey" not in plans.REPORTS[name](src_small)._jdf.queryExecution().optimizedPlan().toString()


def test_command_line(spark, tmp_path):
    runs = spark.range(30).select(
        F.col("id").alias("run_id"), F.lit("j").alias("job_id"), F.lit("FAILED").alias("result_state"),
        F.expr("timestamp_ntz'2024-01-30 00:00:00' - make_dt_interval(0, id)").alias("run_start_time"),
        F.lit(None).cast("timestamp_ntz").alias("run_end_time"),
    ).withColumn("run_date", F.to_date("run_start_time"))
    path, out = str(tmp_path / "runs"), str(tmp_path / "out")
    runs.write.partitionBy("run_date").parquet(path)
    main(["--bind", f"job_runs=parquet:{path}", "--date-partition", "job_runs.run_start_time=run_date",
          "--bind", "jobs=csv:/nowhere", "--custom", "mine=SELECT count(*) AS n FROM job_runs", "--custom", "bad=SELEC",
          "--panels", "jobs", "--as-of", "2024-01-30 00:00:00", "--out", out])
    assert spark.read.parquet(f"{out}/mine/mine").first()["n"] == 30
    assert spark.read.parquet(f"{out}/bad/_status").first()["status"] == "error"
    st = {r["report"]: r["status"] for r in spark.read.parquet(f"{out}/jobs/_status").collect()}
    assert st["jobs_success_rate"] == "ok" and st["jobs_top_failures"] == "error"


def test_reports_run_once(spark, src_small):
    """Status comes from the actions themselves: one execution a report."""
    result = run_panel(spark, "jobs", src_small, display_caps=False)
    want = sorted(map(tuple, result.status.collect()), key=str)
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before, seen = store.executionsCount(), []
    status = result.run(lambda name, df: (seen.append(name), df.write.format("noop").mode("overwrite").save()))
    bus.waitUntilEmpty()
    assert store.executionsCount() - before == len(seen) == len(result.reports) == 4
    assert sorted(map(tuple, status.collect()), key=str) == want


def test_a_failing_action_leaves_the_others(spark, src_small):
    result = run_panel(spark, "jobs", src_small)

    def act(name, df):
        if name == "jobs_top_failures":
            raise RuntimeError("the disk is full")
        df.write.format("noop").mode("overwrite").save()

    rows = {r["report"]: r for r in result.run(act).collect()}
    assert rows["jobs_top_failures"]["status"] == "error" and "disk" in rows["jobs_top_failures"]["message"]
    assert {r["status"] for n, r in rows.items() if n != "jobs_top_failures"} == {"ok"}
    assert rows["jobs_success_rate"]["total_rows"] == result.reports["jobs_success_rate"].count()
