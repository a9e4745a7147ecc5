"""Users panel: most active users, table readers, inactive users, grants."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asc, desc, last_seen_between, of_actions, top_n
from ..params import AsOf, InvalidParams
from ..sources import ACCESS_AUDIT, Sources, field
from .vocab import PERMISSION_ACTIONS, QUERY_ACTIONS, TABLE_ACCESS_ACTIONS


def _audit(src: Sources, days: int, as_of: AsOf) -> DataFrame:
    return src.recent(ACCESS_AUDIT, "event_time", as_of, days=days)


def users_top_by_queries(src: Sources, days: int = 30, limit: int | None = 20, *, as_of: AsOf = None) -> DataFrame:
    """Per user over query-type actions: events, active dates, first and last seen."""
    ev = of_actions(_audit(src, days, as_of), QUERY_ACTIONS).filter(F.col("user_name").isNotNull())
    per_user = ev.groupBy("user_name").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.countDistinct(F.to_date("event_time")).alias("active_days"),
        F.min("event_time").alias("first_seen"),
        F.max("event_time").alias("last_seen"),
    )
    return top_n(per_user, desc("total_events") + asc("user_name"), limit)


def users_top_by_tables_accessed(
    src: Sources, days: int = 30, limit: int | None = 20, *, as_of: AsOf = None
) -> DataFrame:
    """Per user: distinct tables read and number of accesses."""
    audit = _audit(src, days, as_of)
    target = field(audit, "request_params", "full_name_arg")
    ev = (
        of_actions(audit, TABLE_ACCESS_ACTIONS)
        .filter(F.col("user_name").isNotNull())
        .select("user_name", target.alias("__target"))
        .filter(F.col("__target").isNotNull())
    )
    per_user = ev.groupBy("user_name").agg(
        F.countDistinct("__target").alias("distinct_tables"),
        F.count(F.lit(1)).alias("total_accesses"),
    )
    return top_n(per_user, desc("distinct_tables") + asc("user_name"), limit)


def users_inactive(
    src: Sources, days: int = 30, lookback_days: int = 90, *, as_of: AsOf = None, null_aware: bool = False
) -> DataFrame:
    """Users seen in the last ``lookback_days`` but not in the last ``days``,
    with their last event and the calendar days since, longest idle first.

    One aggregation pass (``max(event_time)`` per user) instead of two scans
    and a ``NOT IN``.  NULL users are ignored unless ``null_aware=True``,
    which reproduces the ``NOT IN`` semantics exactly."""
    if lookback_days <= days:
        raise InvalidParams("lookback_days must be longer than days")
    a = src.as_of(ACCESS_AUDIT, as_of)
    window = src.recent(ACCESS_AUDIT, "event_time", a, days=lookback_days)  # prunes date partitions
    idle = last_seen_between(
        window, "user_name", "event_time", inner=days, outer=lookback_days, as_of=a, null_aware=null_aware
    )
    return idle.select("user_name", "last_seen", "days_inactive").orderBy(*desc("days_inactive"), *asc("user_name"))


def users_permission_changes(src: Sources, days: int = 30, limit: int | None = 50, *, as_of: AsOf = None) -> DataFrame:
    """Newest grant / revoke / ownership events with target and change."""
    audit = _audit(src, days, as_of)
    ev = of_actions(audit, PERMISSION_ACTIONS).select(
        "event_time",
        F.col("user_name").alias("changed_by"),
        "action_name",
        field(audit, "request_params", "securable_full_name").alias("target_object"),
        field(audit, "request_params", "changes").alias("changes_detail"),
    )
    order = desc("event_time") + asc("changed_by", "action_name", "target_object", "changes_detail")
    return top_n(ev, order, limit)
