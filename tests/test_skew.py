"""Hot keys: one user holds about a third of all audit events (derived from
the driver tables) and the reports still equal a brute-force computation in
plain Python over the same rows."""
from __future__ import annotations

from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opslens import plans
from opslens.plans.vocab import QUERY_ACTIONS, TABLE_READ_ACTIONS
from opslens.sources import ACCESS_AUDIT, Sources

AS_OF = datetime(2024, 1, 31)
HOT = "user_hot"


@pytest.fixture(scope="module")
def skewed(spark, src_small):
    audit = src_small[ACCESS_AUDIT]
    # every third event moves to one user (spread over 8 partitions)
    hot = audit.withColumn(
        "user_name",
        F.when(F.abs(F.hash("event_time", "action_name")) % 3 == 0, F.lit(HOT)).otherwise(F.col("user_name")),
    ).repartition(8)
    rows = [r.asDict() for r in hot.collect()]
    return Sources().bind(ACCESS_AUDIT, hot, as_of=AS_OF), rows


def _window(rows, days):
    bound = AS_OF - timedelta(days=days)
    return [r for r in rows if r["event_time"] >= bound]


def test_hot_user_really_is_hot(skewed):
    _, rows = skewed
    share = sum(r["user_name"] == HOT for r in rows) / len(rows)
    assert 0.25 < share < 0.45


def test_top_by_queries_brute_force(skewed):
    src, rows = skewed
    agg = defaultdict(lambda: [0, set(), None, None])
    for r in _window(rows, 30):
        if r["user_name"] is None or r["action_name"] not in QUERY_ACTIONS:
            continue
        a = agg[r["user_name"]]
        a[0] += 1
        a[1].add(r["event_time"].date())
        a[2] = min(a[2], r["event_time"]) if a[2] else r["event_time"]
        a[3] = max(a[3], r["event_time"]) if a[3] else r["event_time"]
    expected = sorted(((-v[0], u, len(v[1]), v[2], v[3]) for u, v in agg.items()))[:20]
    got = plans.users_top_by_queries(src).collect()
    assert [(r["user_name"], r["total_events"], r["active_days"], r["first_seen"], r["last_seen"]) for r in got] == [
        (u, -n, d, f, la) for n, u, d, f, la in expected
    ]
    assert got[0]["user_name"] == HOT


def test_most_accessed_brute_force(skewed):
    src, rows = skewed
    count, users = defaultdict(int), defaultdict(set)
    for r in _window(rows, 30):
        target = r["request_params"].get("full_name_arg")
        if r["action_name"] in TABLE_READ_ACTIONS and target is not None:
            count[target] += 1
            if r["user_name"] is not None:
                users[target].add(r["user_name"])
    expected = sorted((-n, t, len(users[t])) for t, n in count.items())[:20]
    got = plans.catalog_most_accessed(src).collect()
    assert [(r["table_name"], r["access_count"], r["distinct_users"]) for r in got] == [
        (t, -n, u) for n, t, u in expected
    ]


def test_active_and_inactive_brute_force(skewed):
    src, rows = skewed
    week = {r["user_name"] for r in _window(rows, 7) if r["user_name"] is not None}
    assert plans.health_active_users(src, 7).first()["active_users"] == len(week)
    last = {}
    for r in _window(rows, 90):
        u = r["user_name"]
        if u is not None:
            last[u] = max(last.get(u, r["event_time"]), r["event_time"])
    idle = sorted(((AS_OF.date() - t.date()).days * -1, u) for u, t in last.items() if u not in week)
    got = plans.users_inactive(src, 7, 90).collect()
    assert [(r["user_name"], r["days_inactive"]) for r in got] == [(u, -d) for d, u in idle]
