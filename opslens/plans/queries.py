"""Queries panel: slowest and most expensive statements, top authors, errors."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ratio_half_up
from ..operators import asc, desc, top_n
from ..params import AsOf
from ..sources import QUERY_HISTORY, Sources
from .vocab import FAILED, FINISHED

PREVIEW_CHARS = 120
ERROR_KEY_CHARS = 200


def _history(src: Sources, days: int, as_of: AsOf) -> DataFrame:
    return src.recent(QUERY_HISTORY, "start_time", as_of, days=days)


def _seconds(ms_col: str) -> F.Column:
    return ratio_half_up(F.col(ms_col), 1000, 1)


def queries_slowest(src: Sources, days: int = 7, limit: int | None = 20, *, as_of: AsOf = None) -> DataFrame:
    """Finished statements with the longest wall time."""
    q = _history(src, days, as_of).filter(F.col("status") == FINISHED)
    rows = q.select(
        "user_name",
        _seconds("duration").alias("duration_sec"),
        "status",
        F.left("statement_text", F.lit(PREVIEW_CHARS)).alias("sql_preview"),
        "start_time",
        "warehouse_id",
        "duration",
    )
    order = desc("duration") + asc("start_time", "user_name", "warehouse_id", "sql_preview")
    return top_n(rows, order, limit).drop("duration")


def queries_most_expensive(src: Sources, days: int = 7, limit: int | None = 20, *, as_of: AsOf = None) -> DataFrame:
    """Statements of any status with the most total task time."""
    q = _history(src, days, as_of)
    rows = q.select(
        "user_name",
        _seconds("total_task_duration_ms").alias("task_sec"),
        ratio_half_up(F.col("rows_produced_count"), 1_000_000, 2).alias("rows_m"),
        "status",
        F.left("statement_text", F.lit(PREVIEW_CHARS)).alias("sql_preview"),
        "start_time",
        "total_task_duration_ms",
    )
    order = desc("total_task_duration_ms") + asc("start_time", "user_name", "status", "rows_m", "sql_preview")
    return top_n(rows, order, limit).drop("total_task_duration_ms")


def queries_top_users(src: Sources, days: int = 7, limit: int | None = 20, *, as_of: AsOf = None) -> DataFrame:
    """Per user (statements without a user form one group): statements,
    mean duration in seconds (round 1) and failed statements."""
    q = _history(src, days, as_of)
    timed = F.count("duration")
    per_user = q.groupBy("user_name").agg(
        F.count(F.lit(1)).alias("query_count"),
        F.sum("duration").alias("__ms"),
        timed.alias("__timed"),
        F.count_if(F.col("status") == FAILED).alias("error_count"),
    )
    rows = per_user.select(
        "user_name",
        "query_count",
        F.when(
            F.col("__timed") > 0, ratio_half_up(F.col("__ms"), F.col("__timed") * F.lit(1000), 1)
        ).alias("avg_duration_sec"),
        "error_count",
    )
    return top_n(rows, desc("query_count") + asc("user_name"), limit)


def queries_error_summary(src: Sources, days: int = 7, limit: int | None = 30, *, as_of: AsOf = None) -> DataFrame:
    """Failed statements grouped on the first 200 characters of the error."""
    q = _history(src, days, as_of).filter((F.col("status") == FAILED) & F.col("error_message").isNotNull())
    per_error = q.groupBy(F.left("error_message", F.lit(ERROR_KEY_CHARS)).alias("error")).agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.countDistinct("user_name").alias("affected_users"),
        F.max("start_time").alias("last_seen"),
    )
    return top_n(per_error, desc("occurrences") + asc("error"), limit)
