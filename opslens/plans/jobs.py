"""Jobs panel: state breakdown, top failing jobs, longest runs, daily volume."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import micros_between, ratio_half_up
from ..operators import asc, desc, latest_for, latest_per_key, share_of_total, status_by_day, top_n
from ..params import AsOf
from ..sources import JOB_RUNS, JOBS, Sources
from .vocab import FAILED, SUCCEEDED


def _runs(src: Sources, days: int, as_of: AsOf) -> DataFrame:
    return src.recent(JOB_RUNS, "run_start_time", as_of, days=days)


def _with_job_names(top: DataFrame, src: Sources, limit: int | None) -> DataFrame:
    """The latest job names on an already aggregated / cut frame.

    A job defined more than once has the name with the latest
    ``change_time``, if the definitions carry that column, else the greatest
    one, so rows never fan out.  A cut frame reduces the definitions to its own
    jobs before they are grouped; a whole one joins all of them."""
    defs = src[JOBS].withColumnRenamed("name", "job_name")
    order = "change_time" if "change_time" in defs.columns else None
    if limit is not None:
        return latest_for(top, defs, "job_id", "job_name", order)
    return top.join(latest_per_key(defs, "job_id", "job_name", order), "job_id", "left")


def jobs_success_rate(src: Sources, days: int = 30, *, as_of: AsOf = None) -> DataFrame:
    """Runs per result state and their percentage of all runs (round 1)."""
    shares = share_of_total(_runs(src, days, as_of), ["result_state"], count_col="run_count", pct_col="pct")
    return shares.orderBy(*desc("run_count"), *asc("result_state"))


def jobs_top_failures(src: Sources, days: int = 30, limit: int | None = 20, *, as_of: AsOf = None) -> DataFrame:
    """Jobs with the most failed runs, with name and last failure.

    Failures are counted per job first and cut to the top ``limit``; only
    then are names joined on."""
    failed = _runs(src, days, as_of).filter(F.col("result_state") == FAILED)
    per_job = failed.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("failure_count"),
        F.max("run_start_time").alias("last_failure"),
    )
    order = desc("failure_count") + asc("job_id")
    top = top_n(per_job, order, limit)
    named = _with_job_names(top, src, limit)
    return top_n(named.select("job_id", "job_name", "failure_count", "last_failure"), order, limit)


def jobs_longest_runs(src: Sources, days: int = 30, limit: int | None = 20, *, as_of: AsOf = None) -> DataFrame:
    """Finished runs (with an end time), longest first, with job name.

    Duration is in minutes, HALF_UP to one decimal, from the exact
    microsecond difference."""
    runs = _runs(src, days, as_of).filter(F.col("run_end_time").isNotNull())
    timed = runs.select(
        "job_id",
        "run_id",
        "result_state",
        ratio_half_up(micros_between("run_start_time", "run_end_time"), 60_000_000, 1).alias("duration_min"),
        "run_start_time",
    )
    order = desc("duration_min") + asc("run_id")
    top = top_n(timed, order, limit)
    named = _with_job_names(top, src, limit)
    return top_n(
        named.select("job_id", "job_name", "run_id", "result_state", "duration_min", "run_start_time"), order, limit
    )


def jobs_daily_run_volume(src: Sources, days: int = 30, *, as_of: AsOf = None) -> DataFrame:
    """Per start date: all runs, succeeded and failed, newest first."""
    daily = status_by_day(
        _runs(src, days, as_of), "run_start_time", "result_state", {"succeeded": SUCCEEDED, "failed": FAILED}
    )
    return daily.orderBy(*desc("run_date"))
