"""Governance panel: ownerless tables, PII-like columns, denials, DDL feed."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asc, desc, name_pattern_scan, of_actions, scope, top_n, without_match
from ..params import AsOf
from ..sources import ACCESS_AUDIT, CATALOG_COLUMNS, CATALOG_TABLES, TABLE_PRIVILEGES, Sources, field
from .vocab import BASE_TABLE, DDL_ACTIONS, DENIAL_ACTIONS, OWNERSHIP, PII_TOKENS

NAMES = ("table_catalog", "table_schema", "table_name")


def governance_tables_without_owners(
    src: Sources, catalogs: tuple[str, ...] = (), limit: int | None = 100, *, as_of: AsOf = None
) -> DataFrame:
    """Base tables with no OWNERSHIP grant, least recently altered first
    (never-altered tables first).  ``NOT EXISTS`` as a left-anti join."""
    t = scope(src[CATALOG_TABLES].filter(F.col("table_type") == BASE_TABLE), catalogs)
    ownerless = without_match(
        t.select(*NAMES, "created", "last_altered"),
        src[TABLE_PRIVILEGES],
        NAMES,
        where=F.col("privilege_type") == OWNERSHIP,
    )
    return top_n(ownerless, asc("last_altered", *NAMES), limit)


def governance_pii_columns(
    src: Sources,
    catalogs: tuple[str, ...] = (),
    limit: int | None = 200,
    *,
    as_of: AsOf = None,
    whole_token: bool = False,
) -> DataFrame:
    """Columns whose lower-cased name contains a PII token.

    The match is a substring match by default (``ip_address`` hits
    ``address``, ``trace_id`` hits ``race``); ``whole_token=True`` needs the
    token between underscores or the name's ends."""
    c = scope(src[CATALOG_COLUMNS], catalogs)
    hits = name_pattern_scan(c, "column_name", PII_TOKENS, whole_token=whole_token).select(
        *NAMES, "column_name", "data_type"
    )
    return top_n(hits, asc(*NAMES, "column_name", "data_type"), limit)


def governance_access_anomalies(
    src: Sources, days: int = 7, limit: int | None = 50, *, as_of: AsOf = None
) -> DataFrame:
    """Newest denied-access events."""
    a = src.as_of(ACCESS_AUDIT, as_of)
    audit = src.recent(ACCESS_AUDIT, "event_time", a, days=days)
    ev = of_actions(audit, DENIAL_ACTIONS).select(
        "user_name",
        "action_name",
        field(audit, "request_params", "full_name_arg").alias("target_object"),
        "event_time",
        "source_ip_address",
    )
    order = desc("event_time") + asc("user_name", "action_name", "target_object", "source_ip_address")
    return top_n(ev, order, limit)


def governance_schema_changes(src: Sources, days: int = 30, limit: int | None = 50, *, as_of: AsOf = None) -> DataFrame:
    """Newest DDL events with object and change detail."""
    a = src.as_of(ACCESS_AUDIT, as_of)
    audit = src.recent(ACCESS_AUDIT, "event_time", a, days=days)
    ev = of_actions(audit, DDL_ACTIONS).select(
        "event_time",
        "user_name",
        "action_name",
        field(audit, "request_params", "full_name_arg").alias("object_name"),
        field(audit, "request_params", "changes").alias("change_detail"),
    )
    order = desc("event_time") + asc("user_name", "action_name", "object_name", "change_detail")
    return top_n(ev, order, limit)
