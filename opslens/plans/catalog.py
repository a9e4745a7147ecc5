"""Catalog panel: inventory, tables per schema, stale tables, widest tables,
most read tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import days_between
from ..operators import asc, desc, of_actions, older_than, scope, top_n
from ..params import AsOf
from ..sources import ACCESS_AUDIT, CATALOG_COLUMNS, CATALOG_TABLES, Sources, field
from .vocab import BASE_TABLE, TABLE_READ_ACTIONS

NAMES = ("table_catalog", "table_schema", "table_name")


def _base_tables(src: Sources, catalogs) -> DataFrame:
    return scope(src[CATALOG_TABLES].filter(F.col("table_type") == BASE_TABLE), catalogs)


def catalog_table_inventory(
    src: Sources, catalogs: tuple[str, ...] = (), limit: int | None = 500, *, as_of: AsOf = None
) -> DataFrame:
    """Base tables, most recently altered first (never altered last)."""
    a = src.as_of(CATALOG_TABLES, as_of)
    t = _base_tables(src, catalogs)
    dtype = t.schema["last_altered"].dataType
    rows = t.select(
        *NAMES, "table_type", "created", "last_altered",
        days_between(a, "last_altered", dtype).alias("days_since_altered"),
    )
    return top_n(rows, desc("last_altered") + asc(*NAMES), limit)


def catalog_tables_by_schema(src: Sources, catalogs: tuple[str, ...] = (), *, as_of: AsOf = None) -> DataFrame:
    """Base-table count per catalog and schema, largest first."""
    counts = _base_tables(src, catalogs).groupBy("table_catalog", "table_schema").agg(
        F.count(F.lit(1)).alias("table_count")
    )
    return counts.orderBy(*desc("table_count"), *asc("table_catalog", "table_schema"))


def catalog_stale_tables(
    src: Sources, stale_days: int = 90, catalogs: tuple[str, ...] = (), *, as_of: AsOf = None
) -> DataFrame:
    """Base tables last altered before ``as_of - stale_days`` (never-altered
    tables are not stale), longest unchanged first."""
    a = src.as_of(CATALOG_TABLES, as_of)
    t = older_than(_base_tables(src, catalogs), "last_altered", a, stale_days)
    dtype = t.schema["last_altered"].dataType
    rows = t.select(*NAMES, "last_altered", days_between(a, "last_altered", dtype).alias("days_stale"))
    return rows.orderBy(*desc("days_stale"), *asc(*NAMES))


def catalog_column_count(
    src: Sources, catalogs: tuple[str, ...] = (), limit: int | None = 50, *, as_of: AsOf = None
) -> DataFrame:
    """Widest tables: number of columns per table."""
    counts = scope(src[CATALOG_COLUMNS], catalogs).groupBy(*NAMES).agg(F.count(F.lit(1)).alias("column_count"))
    return top_n(counts, desc("column_count") + asc(*NAMES), limit)


def catalog_most_accessed(src: Sources, days: int = 30, limit: int | None = 20, *, as_of: AsOf = None) -> DataFrame:
    """Most read tables in the audit log, with their distinct readers."""
    a = src.as_of(ACCESS_AUDIT, as_of)
    audit = src.recent(ACCESS_AUDIT, "event_time", a, days=days)
    target = field(audit, "request_params", "full_name_arg")
    reads = (
        of_actions(audit, TABLE_READ_ACTIONS)
        .select(target.alias("table_name"), "user_name")
        .filter(F.col("table_name").isNotNull())
    )
    per_table = reads.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("access_count"),
        F.countDistinct("user_name").alias("distinct_users"),
    )
    return top_n(per_table, desc("access_count") + asc("table_name"), limit)
