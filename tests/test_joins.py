"""The as-of sweep, the reducer of names and custom SQL's views."""
from __future__ import annotations

import collections
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opslens.operators import latest_for, latest_per_key, valid_on_join
from opslens.plans.custom import custom_report
from opslens.sources import Sources

DAY = date(2024, 1, 1)


def best(rows, sku, at):
    """The valid row with the greatest start, then the open or latest end, then the greatest value."""
    t = None if at is None else datetime(at.year, at.month, at.day)
    found = [r for r in rows if None not in (sku, t, r[0], r[1]) and r[0] == sku and r[1] <= t and (r[2] is None or r[2] > t)]
    rank = lambda r: (r[1], r[2] is None, r[2] or datetime.min, r[3] is not None, r[3] or 0)
    return max(found, key=rank)[3] if found else None


def sweep(spark, facts, prices):
    f = spark.createDataFrame(facts, "sku string, day date, q long")
    p = spark.createDataFrame(prices, "name string, s timestamp_ntz, e timestamp_ntz, v double")
    return valid_on_join(
        f, p.withColumnRenamed("name", "sku"), on=["sku"], at="day", values={"price": F.col("v")}, start="s", end="e",
        fact_key=["sku", "day"],
    )


@pytest.mark.parametrize("seed", range(3))
def test_sweep_with_overlaps_gaps_and_nesting(spark, seed):
    rng = random.Random(seed)
    moment = lambda: datetime(2024, 1, 1) + timedelta(hours=6 * rng.randrange(-20, 260))
    prices = []
    for _ in range(160):
        s = moment()
        e = rng.choice([None, s + timedelta(hours=6 * rng.randrange(-2, 120)), s + timedelta(days=1), moment()])
        prices.append((rng.choice(["a", "b", "c", None]), rng.choice([s, s, s, None]), e, rng.choice([None, 1.0, 2.0, rng.random()])))
    prices += prices[:10]
    facts = [(s, DAY + timedelta(days=d), d) for s in ("a", "b", "c", "none") for d in range(0, 70, 2)]
    facts += [(None, DAY, 1), ("a", None, 2)]
    got = sorted(map(tuple, sweep(spark, facts, prices).collect()), key=str)
    assert got == sorted(((s, d, q, best(prices, s, d)) for s, d, q in facts), key=str)


def test_long_history_meets_no_fact(spark):
    """10,000 prices of one SKU, each ended by the next: nothing to join."""
    start = datetime(2024, 1, 1)
    prices = [("hot", start + timedelta(minutes=i), start + timedelta(minutes=i + 1), float(i)) for i in range(10_000)]
    facts = [("hot", DAY + timedelta(days=d), d) for d in range(9)]
    out = sweep(spark, facts, prices)
    assert {r["q"]: r["price"] for r in out.collect()} == {d: (float(1440 * d) if 1440 * d < 10_000 else None) for d in range(9)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_names_of_a_cut(spark):
    defs = [(1, "old", 1), (1, "new", 2), (2, "b", 5), (2, "a", 5), (3, None, 9), (3, "was", 1), (None, "none", 1), (9, "x", 1)]
    dim = spark.createDataFrame(defs, "job_id long, name string, at int").repartition(3)
    top = spark.createDataFrame([(1, 5), (1, 5), (2, 4), (3, 3), (4, 2), (None, 1)], "job_id long, n long")
    for order in ("at", None):
        want = top.join(latest_per_key(dim, "job_id", "name", order), "job_id", "left").select("job_id", "n", "name")
        got = latest_for(top, dim, "job_id", "name", order).select("job_id", "n", "name")
        assert collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, want.collect()))


def test_definitions_are_not_shuffled(spark):
    """A cut of 20 rows is broadcast to the definitions, which are not dealt by job."""
    runs = spark.range(5000).select((F.col("id") % 700).alias("job_id")).groupBy("job_id").count()
    dim = spark.range(100_000).select(F.col("id").alias("job_id"), F.col("id").cast("string").alias("name"))
    out = latest_for(runs.orderBy(F.desc("count"), "job_id").limit(20), dim, "job_id", "name")
    assert {r["job_id"]: r["name"] for r in out.collect()} == {i: str(i) for i in range(20)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_custom_sql_leaves_views_alone(spark):
    src = Sources().bind("jobs", spark.createDataFrame([("1", "real")], "job_id string, name string"))
    spark.range(3).selectExpr("id AS mine").createOrReplaceTempView("jobs")
    try:
        got = custom_report(spark, src, "SELECT name FROM jobs")
        assert spark.table("jobs").columns == ["mine"] and [r[0] for r in got.collect()] == ["real"]
        with pytest.raises(Exception):
            custom_report(spark, src, "SELECT nothing FROM jobs")
        assert spark.table("jobs").count() == 3
    finally:
        spark.catalog.dropTempView("jobs")
    custom_report(spark, src, "SELECT * FROM jobs")
    assert not [t for t in spark.catalog.listTables() if t.name == "jobs" and t.isTemporary]
