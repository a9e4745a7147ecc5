"""Physical-plan checks: no nested-loop or cartesian joins, no Python UDFs,
look-backs pushed into the scans, no driver collection in the library."""
from __future__ import annotations

import os
import re

import pytest

from opslens.plans.registry import QUERIES
from tests.conftest import ROOT, SF_SMALL

FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_forbidden_nodes(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    for node in FORBIDDEN:
        assert node not in plan, f"{name}: {node}"


PUSHED = {
    "health_active_users": ("events", "ts"),
    "queries_slowest": ("events", "ts"),
    "cost_top_clusters": ("lineitem", "l_shipdate"),
    "jobs_daily_run_volume": ("orders", "o_orderdate"),
}


@pytest.mark.parametrize("name", sorted(PUSHED))
def test_lookback_reaches_the_scan(spark, name):
    table, col = PUSHED[name]
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    scans = [line for line in plan.split("\n") if f"{table}.parquet" in line or "PushedFilters" in line]
    assert any(re.search(rf"GreaterThanOrEqual\({col},", s) for s in scans), scans


def test_column_pruning_on_wide_source(spark):
    plan = _plan(QUERIES["health_failed_jobs"](spark, SF_SMALL))
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert read and all("o_totalprice" not in r and "o_orderpriority" not in r for r in read)


def test_library_never_collects():
    pattern = re.compile(r"\.(collect|toPandas|toLocalIterator|take|head|first)\(")
    offenders = []
    for base, _, files in os.walk(os.path.join(ROOT, "opslens")):
        if os.path.basename(base) == "llm":  # has its own bounds, see its tests
            continue
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(base, f), encoding="utf-8").read()
                offenders += [f"{f}: {m.group(0)}" for m in pattern.finditer(text)]
    assert offenders == []
