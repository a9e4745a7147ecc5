"""Binding: validation, materialised map keys, lazy sources."""
from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from opslens.plans import REPORTS
from opslens.sources import ACCESS_AUDIT, SchemaMismatch, Sources

AUDIT_REPORTS = ["users_top_by_tables_accessed", "users_permission_changes", "catalog_most_accessed",
                 "governance_access_anomalies", "governance_schema_changes"]


@pytest.fixture(scope="module")
def flat_audit(spark, src_small):
    """The audit log stored with its hot map keys as top-level columns."""
    audit = src_small[ACCESS_AUDIT]
    flat = audit.select(
        "event_time", "user_name", "action_name", "source_ip_address",
        *[F.col("request_params")[k].alias(k) for k in ("full_name_arg", "securable_full_name", "changes")],
    )
    folder = os.path.join(tempfile.mkdtemp(prefix="opslens-flat-"), "audit")
    flat.write.parquet(folder)
    return Sources().bind(ACCESS_AUDIT, spark.read.parquet(folder), as_of="2024-01-31 00:00:00")


@pytest.mark.parametrize("name", AUDIT_REPORTS)
def test_materialised_keys_give_same_reports(src_small, flat_audit, name):
    fn = REPORTS[name]
    assert sorted(map(tuple, fn(flat_audit).collect()), key=repr) == sorted(map(tuple, fn(src_small).collect()), key=repr)


def test_materialised_keys_prune_columns(flat_audit):
    plan = REPORTS["catalog_most_accessed"](flat_audit)._jdf.queryExecution().executedPlan().toString()
    read = [line for line in plan.split("\n") if "ReadSchema" in line or "FileScan" in line]
    assert any("full_name_arg" in r for r in read)
    assert not any("securable_full_name" in r or "changes" in r for r in read)


def test_missing_keyed_column_still_rejected(spark):
    df = spark.createDataFrame([], "event_time timestamp_ntz, user_name string, action_name string, "
                                   "source_ip_address string, full_name_arg string")
    with pytest.raises(SchemaMismatch):
        Sources().bind(ACCESS_AUDIT, df)  # securable_full_name and changes missing


def test_unknown_source_and_unbound_source(spark):
    with pytest.raises(KeyError):
        Sources().bind("nope", spark.range(1))
    from opslens.sources import SourceUnavailable

    with pytest.raises(SourceUnavailable):
        Sources()[ACCESS_AUDIT]


def test_lazy_binding_builds_only_what_is_used(spark):
    built = []

    def make():
        built.append(1)
        return spark.createDataFrame([], "job_id string, name string")

    src = Sources().bind("jobs", make)
    assert built == [] and src.has("jobs")
    src["jobs"]
    src["jobs"]
    assert built == [1]


def test_zoned_timestamps_give_same_reports(spark, src_small):
    """A source with zoned TIMESTAMP columns (read in the session zone, UTC in
    tests) gives the same users and day counts as TIMESTAMP_NTZ."""
    audit = src_small[ACCESS_AUDIT]
    zoned = Sources().bind(ACCESS_AUDIT, audit.withColumn("event_time", F.col("event_time").cast("timestamp")),
                           as_of="2024-01-31 00:00:00")
    for name, cols in [("users_inactive", ["user_name", "days_inactive"]),
                       ("users_top_by_queries", ["user_name", "total_events", "active_days"]),
                       ("health_active_users", ["active_users"])]:
        fn = REPORTS[name]
        args = {"days": 7, "lookback_days": 90} if name == "users_inactive" else {}
        a = [tuple(r) for r in fn(src_small, **args).select(*cols).collect()]
        b = [tuple(r) for r in fn(zoned, **args).select(*cols).collect()]
        assert a == b and len(a) > 0, name


@pytest.fixture(scope="module")
def unclocked(spark):
    """The sf0.001 bindings without fixed clocks: reports use the session's
    current time (the default for real use)."""
    from opslens.sources.fixtures import BUILDERS, read_tables

    t = read_tables(spark, "/root/testdata/sf0.001")
    src = Sources()
    for name, build in BUILDERS.items():
        src = src.bind(name, (lambda b=build: b(t)))
    return src


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_reports_run_on_the_session_clock(unclocked, name):
    args = {"days": 7, "lookback_days": 90} if name == "users_inactive" else {}
    df = REPORTS[name](unclocked, **args)
    rows = df.collect()  # runs; the fixtures are historic, so most windows are empty
    assert isinstance(rows, list) and df.columns


@pytest.mark.parametrize(
    "name", ["health_table_count", "catalog_table_inventory", "catalog_tables_by_schema", "catalog_stale_tables",
             "catalog_column_count", "governance_tables_without_owners", "governance_pii_columns"],
)
def test_catalog_scope_equals_prefiltered_sources(src_small, name):
    from opslens.sources import CATALOG_COLUMNS, CATALOG_TABLES, TABLE_PRIVILEGES

    keep = ("PROMO", "SMALL")
    pre = src_small
    for s in (CATALOG_TABLES, CATALOG_COLUMNS, TABLE_PRIVILEGES):
        pre = pre.bind(s, src_small[s].filter(F.col("table_catalog").isin(*keep)), as_of=src_small.as_of(s))
    fn = REPORTS[name]
    scoped = fn(src_small, catalogs=keep).collect()
    assert scoped == fn(pre).collect() and len(scoped) > 0


def test_panels_on_the_session_clock_with_shared_scans(spark, unclocked):
    from opslens import Params
    from opslens.plans.panels import run_all

    for panel, result in run_all(spark, unclocked, Params(days=7), shared_scans=True).items():
        assert {r["status"] for r in result.status.collect()} <= {"ok"}, panel
        for name, df in result.reports.items():
            df.write.format("noop").mode("overwrite").save()
        if result.kpis is not None:
            assert all(r["status"] == "ok" for r in result.kpis.collect())
