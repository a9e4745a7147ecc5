"""Cost panel: usage by SKU with list prices, top consumers, burn rate."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asc, desc, top_n, valid_on_join
from ..params import AsOf
from ..sources import BILLING_USAGE, LIST_PRICES, Sources, field


def _usage(src: Sources, days: int, as_of: AsOf) -> DataFrame:
    a = src.as_of(BILLING_USAGE, as_of)
    return src.recent(BILLING_USAGE, "usage_date", a, days=days)


def cost_daily_by_sku(
    src: Sources, days: int = 30, *, as_of: AsOf = None, price_dedup: str = "latest"
) -> DataFrame:
    """Usage (round 3) and list-price cost (round 2) per date and SKU.

    Usage is first summed per (date, SKU), so the validity-interval join to
    the price list runs on days x SKUs rows, never on raw usage rows.  The
    price valid on a date is the one with ``start <= date < end`` (open end
    when NULL).  ``price_dedup="latest"`` keeps only the newest of several
    valid prices (usage is never counted twice); ``"all"`` reproduces a plain
    join, where overlapping prices repeat the usage.  No price -> NULL cost.
    The SKU is the usage side's."""
    daily = (
        _usage(src, days, as_of)
        .groupBy("usage_date", "sku_name")
        .agg(F.sum("usage_quantity").alias("__qty"))
    )
    prices = src[LIST_PRICES]
    priced = valid_on_join(
        daily,
        prices,
        on=["sku_name"],
        at="usage_date",
        values={"__price": field(prices, "pricing", "default")},
        start="price_start_time",
        end="price_end_time",
        fact_key=["usage_date", "sku_name"],
        dedup=price_dedup,
    )
    cost = F.col("__qty") * F.col("__price")
    if price_dedup == "latest":  # one row a date and SKU already
        out = priced.select("usage_date", "sku_name", F.round("__qty", 3).alias("dbu"), F.round(cost, 2).alias("est_usd"))
    else:
        out = priced.groupBy("usage_date", "sku_name").agg(
            F.round(F.sum("__qty"), 3).alias("dbu"), F.round(F.sum(cost), 2).alias("est_usd")
        )
    return out.orderBy(*desc("usage_date", "dbu"), *asc("sku_name"))


def cost_top_clusters(src: Sources, days: int = 30, limit: int | None = 10, *, as_of: AsOf = None) -> DataFrame:
    """Top clusters by usage with their number of active dates."""
    usage = _usage(src, days, as_of)
    cluster_id = field(usage, "usage_metadata", "cluster_id")
    per_cluster = (
        usage.filter(cluster_id.isNotNull())
        .groupBy(field(usage, "custom_tags", "cluster_name").alias("cluster_name"), cluster_id.alias("cluster_id"))
        .agg(
            F.round(F.sum("usage_quantity"), 2).alias("total_dbu"),
            F.countDistinct("usage_date").alias("active_days"),
        )
    )
    return top_n(per_cluster, desc("total_dbu") + asc("cluster_id", "cluster_name"), limit)


def cost_top_jobs(src: Sources, days: int = 30, limit: int | None = 10, *, as_of: AsOf = None) -> DataFrame:
    """Top jobs by usage with their number of active dates."""
    usage = _usage(src, days, as_of)
    job_id = field(usage, "usage_metadata", "job_id")
    per_job = (
        usage.filter(job_id.isNotNull())
        .groupBy(job_id.alias("job_id"))
        .agg(
            F.round(F.sum("usage_quantity"), 2).alias("total_dbu"),
            F.countDistinct("usage_date").alias("active_days"),
        )
    )
    return top_n(per_job, desc("total_dbu") + asc("job_id"), limit)


def cost_top_users_by_dbu(src: Sources, days: int = 30, limit: int | None = 10, *, as_of: AsOf = None) -> DataFrame:
    """Top run-as identities by usage."""
    usage = _usage(src, days, as_of)
    run_as = field(usage, "identity_metadata", "run_as")
    per_user = (
        usage.filter(run_as.isNotNull())
        .groupBy(run_as.alias("run_as_user"))
        .agg(F.round(F.sum("usage_quantity"), 2).alias("total_dbu"))
    )
    return top_n(per_user, desc("total_dbu") + asc("run_as_user"), limit)


def cost_burn_rate(src: Sources, days: int = 30, *, as_of: AsOf = None) -> DataFrame:
    """One row: total, total / days, total / days x 30 (all round 2) and the
    number of dates with usage.  The window spans ``days + 1`` dates but the
    average divides by ``days``; NULLs (not 0) when there is no usage."""
    total = F.sum("usage_quantity")
    return _usage(src, days, as_of).agg(
        F.round(total, 2).alias("total_dbu"),
        F.round(total / F.lit(days), 2).alias("avg_daily_dbu"),
        F.round(total / F.lit(days) * F.lit(30), 2).alias("projected_monthly_dbu"),
        F.countDistinct("usage_date").alias("active_days"),
    )
