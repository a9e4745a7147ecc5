"""Bindings of the driver's test tables to the logical sources.

The test data is a TPC-H-like star schema plus an ``events`` stream; these
plain expressions turn it into the shape of the operational tables the reports
read (audit log, billing usage, job runs, query history, catalog metadata).
Each binding is an ordinary lazy DataFrame, so Catalyst prunes the columns a
report does not use and pushes the report's look-back into the scans.

``AS_OF`` pins "now" per source, so reports over the fixtures are
reproducible at every scale factor.
"""
from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ACCESS_AUDIT,
    BILLING_USAGE,
    CATALOG_COLUMNS,
    CATALOG_TABLES,
    JOB_RUNS,
    JOBS,
    LIST_PRICES,
    QUERY_HISTORY,
    TABLE_PRIVILEGES,
    Sources,
)

# The "now" of each fixture source.
AS_OF = {
    ACCESS_AUDIT: "2024-01-31 00:00:00",
    QUERY_HISTORY: "2024-01-31 00:00:00",
    BILLING_USAGE: "2001-11-04",
    LIST_PRICES: "2001-11-04",
    JOB_RUNS: "2001-08-01 00:00:00",
    JOBS: "2001-08-01 00:00:00",
    CATALOG_TABLES: "2001-11-05 00:00:00",
    CATALOG_COLUMNS: "2001-11-05 00:00:00",
    TABLE_PRIVILEGES: "2001-11-05 00:00:00",
}

# Audit action by event_id % 16 (remainder 15 uses event_type).
AUDIT_ACTIONS = (
    "commandFinish",
    "runCommand",
    "commandSubmit",
    "queries",
    "databricksSqlPermissionsDenied",
    "getTable",
    "getTableData",
    "updatePermissions",
    "grantPermissions",
    "revokePermissions",
    "changeOwner",
    "unauthorizedAccess",
    "accessDenied",
    "createTable",
    "alterTable",
)

# Users with user_id % 10 == 3 go quiet from this instant on;
# their later events count for the user with the next id.
QUIET_FROM = "2024-01-15 00:00:00"

# Price validity intervals [start, end) and their price factor.
PRICE_PERIODS = (
    ("1995-01-01 00:00:00", "1998-01-01 00:00:00", 1.0),
    ("1998-01-01 00:00:00", "2001-09-01 00:00:00", 2.0),
    ("2001-09-01 00:00:00", None, 4.0),
    ("2001-10-20 00:00:00", None, 3.0),  # overlaps the one before
)
PRICE_PER_BRAND_NUMBER = 0.25
# The prices of this brand ended a day after they began, so recent usage has none.
UNPRICED_SKU = "Brand#13"

# Catalog column suffix and type by (p_partkey + n_nationkey) % 6.
COLUMN_KINDS = (
    ("email", "string"),
    ("ip_address", "string"),
    ("amount", "double"),
    ("trace_id", "string"),
    ("Phone", "string"),
    ("qty", "int"),
)

# Run result state by order status.
RUN_STATES = (("F", "FAILED"), ("O", "SUCCEEDED"), ("P", "CANCELED"))

# One run in this many belongs to a job without a definition.
ADHOC_EVERY = 11


def _s(*parts) -> Column:
    """String concatenation of literals and columns."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def _ntz(text: str | None) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _decode(col: Column, pairs) -> Column:
    """CASE col WHEN k THEN v ... END: comparisons on the result fold back
    onto ``col`` (and reach the scan), which a map lookup would not."""
    out = F.lit(None).cast("string")
    for k, v in reversed(pairs):  # nested IFs simplify branch by branch
        out = F.when(col == k, v).otherwise(out)
    return out


def _user_name(user_id: Column) -> Column:
    return F.when(user_id % 25 != 0, _s("user_", user_id))


# Footer schemas already read, per (path, mtime, size): a second read of an
# unchanged file passes its schema and skips the inference job.
_SCHEMAS: dict[tuple, object] = {}


def _file_key(path: str) -> tuple | None:
    try:
        st = os.stat(path)
    except OSError:  # not a local path: always infer
        return None
    return (path, st.st_mtime_ns, st.st_size)


class _Tables(dict):
    """Driver tables opened on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __missing__(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        key = _file_key(path)
        if key is not None and key in _SCHEMAS:
            df = self.spark.read.schema(_SCHEMAS[key]).parquet(path)
        else:
            df = self.spark.read.parquet(path)
            if key is not None:
                _SCHEMAS[key] = df.schema
        self[name] = df
        return df


def read_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return _Tables(spark, sf_dir)


def access_audit(t: dict[str, DataFrame]) -> DataFrame:
    ev = t["events"]
    eid, uid = F.col("event_id"), F.col("user_id")
    quiet = (uid % 10 == 3) & (F.col("ts") >= _ntz(QUIET_FROM))
    acting = F.when(quiet, uid + 1).otherwise(uid)
    target = F.when(eid % 7 != 0, _s("main.s", eid % 5, ".t", eid % 97))
    actions = F.create_map(
        *[x for i, a in enumerate(AUDIT_ACTIONS) for x in (F.lit(i), F.lit(a))],
        F.lit(len(AUDIT_ACTIONS)),
        F.col("event_type"),
    )
    return ev.select(
        F.col("ts").alias("event_time"),
        _user_name(acting).alias("user_name"),
        actions[(eid % 16).cast("int")].alias("action_name"),
        F.create_map(
            F.lit("full_name_arg"), target,
            F.lit("securable_full_name"), target,
            F.lit("changes"), F.col("props"),
        ).alias("request_params"),
        _s("10.0.", uid % 256, ".1").alias("source_ip_address"),
    )


def billing_usage(t: dict[str, DataFrame]) -> DataFrame:
    li = t["lineitem"].select(
        "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate"
    )
    part = t["part"].select("p_partkey", "p_brand")
    sup = t["supplier"].select("s_suppkey", "s_name")
    joined = li.join(part, li.l_partkey == part.p_partkey).join(sup, li.l_suppkey == sup.s_suppkey)
    return joined.select(
        F.to_date("l_shipdate").alias("usage_date"),
        F.col("p_brand").alias("sku_name"),
        F.col("l_quantity").alias("usage_quantity"),
        F.create_map(F.lit("cluster_name"), F.col("s_name")).alias("custom_tags"),
        F.create_map(
            F.lit("cluster_id"), F.when(F.col("l_linestatus") == "O", _s("c-", F.col("l_suppkey"))),
            F.lit("job_id"), F.when(F.col("l_returnflag") == "R", _s("j-", F.col("l_partkey"))),
        ).alias("usage_metadata"),
        F.create_map(
            F.lit("run_as"), F.when(F.col("l_returnflag") != "N", _s("user_", F.col("l_suppkey"))),
        ).alias("identity_metadata"),
    )


def list_prices(t: dict[str, DataFrame]) -> DataFrame:
    """Brands of ``part`` x the validity periods (one brand's end at once).

    The periods are a literal array exploded per brand: a generator, not a
    join, and the distinct brands are a partial-aggregated shuffle of one
    column."""
    brands = t["part"].select(F.col("p_brand").alias("sku_name")).distinct()
    periods = F.array(
        *[
            F.struct(_ntz(s).alias("start"), _ntz(e).alias("end"), F.lit(f).alias("factor"))
            for s, e, f in PRICE_PERIODS
        ]
    )
    number = F.regexp_extract("sku_name", r"#(\d+)$", 1).cast("double")
    return (
        brands.select("sku_name", F.explode(periods).alias("p"))
        .select(
            "sku_name",
            F.col("p.start").alias("price_start_time"),
            F.when(F.col("sku_name") == UNPRICED_SKU, F.col("p.start") + F.expr("INTERVAL 1 DAY"))
            .otherwise(F.col("p.end")).alias("price_end_time"),
            F.struct((number * F.lit(PRICE_PER_BRAND_NUMBER) * F.col("p.factor")).alias("default")).alias("pricing"),
        )
    )


def job_runs(t: dict[str, DataFrame]) -> DataFrame:
    o = t["orders"]
    key = F.col("o_orderkey")
    end = F.timestamp_add("SECOND", key % 7200, F.col("o_orderdate"))
    return o.select(
        key.alias("run_id"),
        F.when(key % ADHOC_EVERY == 0, _s("adhoc-", F.col("o_custkey"))).otherwise(
            _s("j-", F.col("o_custkey"))).alias("job_id"),
        _decode(F.col("o_orderstatus"), RUN_STATES).alias("result_state"),
        F.col("o_orderdate").alias("run_start_time"),
        F.when(key % 5 != 0, end).alias("run_end_time"),
    )


def jobs(t: dict[str, DataFrame]) -> DataFrame:
    c = t["customer"]
    return c.select(_s("j-", F.col("c_custkey")).alias("job_id"), F.col("c_name").alias("name"))


def query_history(t: dict[str, DataFrame]) -> DataFrame:
    ev = t["events"]
    # Statement n is the text of document n modulo the number of documents.
    docs = t["documents"].select("doc_id", "text", "source")
    n_docs = t["documents"].agg((F.max("doc_id") + 1).alias("n")).scalar()
    joined = ev.withColumn("doc", ev.event_id % n_docs).join(docs, F.col("doc") == docs.doc_id)
    eid, etype = F.col("event_id"), F.col("event_type")
    return joined.select(
        _user_name(F.col("user_id")).alias("user_name"),
        F.floor(F.col("value") * 1000).cast("long").alias("duration"),
        F.floor(F.col("value") * 4000).cast("long").alias("total_task_duration_ms"),
        (eid * 1000).alias("rows_produced_count"),
        F.when(etype == "error", "FAILED").when(etype == "signup", "CANCELED").otherwise("FINISHED").alias("status"),
        F.col("text").alias("statement_text"),
        F.when((etype == "error") & (eid % 3 != 0), _s("E", eid % 11, ": ", F.col("source"))).alias(
            "error_message"
        ),
        F.col("ts").alias("start_time"),
        _s("w-", eid % 4).alias("warehouse_id"),
    )


def _table_names(part: DataFrame) -> list[Column]:
    return [
        F.col("p_type").alias("table_catalog"),
        F.col("p_brand").alias("table_schema"),
        _s("t_", F.col("p_partkey")).alias("table_name"),
    ]


def catalog_tables(t: dict[str, DataFrame]) -> DataFrame:
    part = t["part"].select("p_partkey", "p_type", "p_brand", "p_size")
    # One partial-aggregated shuffle on l_partkey; the join below reuses that
    # hash partitioning for the part side.
    altered = t["lineitem"].groupBy("l_partkey").agg(F.max("l_shipdate").alias("last_altered"))
    joined = part.join(altered, part.p_partkey == altered.l_partkey, "left")
    return joined.select(
        *_table_names(part),
        F.when(F.col("p_partkey") % 10 == 0, "VIEW").otherwise("BASE TABLE").alias("table_type"),
        F.date_add(F.lit("1995-01-01").cast("date"), F.col("p_size")).cast("timestamp_ntz").alias("created"),
        F.col("last_altered"),
    )


def catalog_columns(t: dict[str, DataFrame]) -> DataFrame:
    """Each part has the nations with ``n_nationkey < p_size % 25 + 1``.

    Nation keys are 0..24, so the candidate keys are generated per part
    (``sequence``) and matched by an equi-join: no nested-loop join, and the
    fan-out per part is at most 25."""
    part = t["part"].select("p_partkey", "p_type", "p_brand", "p_size")
    nation = t["nation"].select("n_nationkey", "n_name")
    keyed = part.select("*", F.explode(F.sequence(F.lit(0), (F.col("p_size") % 25).cast("int"))).alias("nk"))
    joined = keyed.join(nation, keyed.nk == nation.n_nationkey)
    kind = F.create_map(*[x for i, (s, _) in enumerate(COLUMN_KINDS) for x in (F.lit(i), F.lit(s))])
    dtype = F.create_map(*[x for i, (_, d) in enumerate(COLUMN_KINDS) for x in (F.lit(i), F.lit(d))])
    k = ((F.col("p_partkey") + F.col("n_nationkey")) % 6).cast("int")
    return joined.select(
        *_table_names(part),
        _s(F.col("n_name"), "_", kind[k]).alias("column_name"),
        dtype[k].alias("data_type"),
    )


def table_privileges(t: dict[str, DataFrame]) -> DataFrame:
    part = t["part"].select("p_partkey", "p_type", "p_brand")
    return part.select(
        *_table_names(part),
        F.when(F.col("p_partkey") % 3 == 0, "SELECT").otherwise("OWNERSHIP").alias("privilege_type"),
    )


BUILDERS = {
    ACCESS_AUDIT: access_audit,
    BILLING_USAGE: billing_usage,
    LIST_PRICES: list_prices,
    JOB_RUNS: job_runs,
    JOBS: jobs,
    QUERY_HISTORY: query_history,
    CATALOG_TABLES: catalog_tables,
    CATALOG_COLUMNS: catalog_columns,
    TABLE_PRIVILEGES: table_privileges,
}


def bind_driver_tables(spark: SparkSession, sf_dir: str) -> Sources:
    """All nine logical sources over the driver tables in ``sf_dir``."""
    t = read_tables(spark, sf_dir)
    src = Sources()
    for name, build in BUILDERS.items():
        src = src.bind(name, (lambda b=build: b(t)), as_of=AS_OF[name])
    return src
