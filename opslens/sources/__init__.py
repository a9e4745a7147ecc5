"""Logical sources and their binding to Spark tables.

A report never names a physical table.  It asks a :class:`Sources` object for
a logical source (``access_audit``, ``billing_usage`` ...), which the caller
bound to any DataFrame: ``spark.table(...)``, a Parquet folder, a JDBC read or
a derived view.  Binding checks the columns once, so a missing column fails at
bind time and not in the middle of a plan.
"""
from __future__ import annotations

import re
from contextlib import contextmanager
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import AsOf

# Logical source names (S01-S09).
ACCESS_AUDIT = "access_audit"
BILLING_USAGE = "billing_usage"
LIST_PRICES = "list_prices"
JOB_RUNS = "job_runs"
JOBS = "jobs"
QUERY_HISTORY = "query_history"
CATALOG_TABLES = "catalog_tables"
CATALOG_COLUMNS = "catalog_columns"
TABLE_PRIVILEGES = "table_privileges"

STRING, INTEGRAL, NUMBER, DATE, TIMESTAMP, KEYED = "string", "integral", "number", "date", "timestamp", "keyed"

# Required columns per logical source with their type family.  "keyed" is a
# map<string,string> or a struct read with string keys.
SCHEMAS: dict[str, dict[str, str]] = {
    ACCESS_AUDIT: {
        "event_time": TIMESTAMP,
        "user_name": STRING,
        "action_name": STRING,
        "request_params": KEYED,
        "source_ip_address": STRING,
    },
    BILLING_USAGE: {
        "usage_date": DATE,
        "sku_name": STRING,
        "usage_quantity": NUMBER,
        "custom_tags": KEYED,
        "usage_metadata": KEYED,
        "identity_metadata": KEYED,
    },
    LIST_PRICES: {
        "sku_name": STRING,
        "price_start_time": TIMESTAMP,
        "price_end_time": TIMESTAMP,
        "pricing": KEYED,
    },
    JOB_RUNS: {
        "run_id": None,
        "job_id": STRING,
        "result_state": STRING,
        "run_start_time": TIMESTAMP,
        "run_end_time": TIMESTAMP,
    },
    JOBS: {"job_id": STRING, "name": STRING},
    QUERY_HISTORY: {
        "user_name": STRING,
        "duration": INTEGRAL,
        "total_task_duration_ms": INTEGRAL,
        "rows_produced_count": INTEGRAL,
        "status": STRING,
        "statement_text": STRING,
        "error_message": STRING,
        "start_time": TIMESTAMP,
        "warehouse_id": STRING,
    },
    CATALOG_TABLES: {
        "table_catalog": STRING,
        "table_schema": STRING,
        "table_name": STRING,
        "table_type": STRING,
        "created": TIMESTAMP,
        "last_altered": TIMESTAMP,
    },
    CATALOG_COLUMNS: {
        "table_catalog": STRING,
        "table_schema": STRING,
        "table_name": STRING,
        "column_name": STRING,
        "data_type": STRING,
    },
    TABLE_PRIVILEGES: {
        "table_catalog": STRING,
        "table_schema": STRING,
        "table_name": STRING,
        "privilege_type": STRING,
    },
}


# Keys the reports read from map/struct columns.  A source may carry any of
# them as top-level columns instead (e.g. generated columns of the audit
# table): Parquet then reads just those columns, where a map lookup reads the
# whole map of every row.
KEYED_FIELDS: dict[str, tuple[str, ...]] = {
    "request_params": ("full_name_arg", "securable_full_name", "changes"),
    "custom_tags": ("cluster_name",),
    "usage_metadata": ("cluster_id", "job_id"),
    "identity_metadata": ("run_as",),
    "pricing": ("default",),
}


def field(df: DataFrame, container: str, key: str) -> Column:
    """``container[key]``, or the top-level column ``key`` when the source has it."""
    return F.col(key) if key in df.columns else F.col(container)[key]


def _matches(family: str | None, dtype: T.DataType) -> bool:
    if family is None:
        return True
    if family == STRING:
        return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))
    if family == INTEGRAL:
        return isinstance(dtype, T.IntegralType) or (isinstance(dtype, T.DecimalType) and dtype.scale == 0)
    if family == NUMBER:
        return isinstance(dtype, T.NumericType)
    if family == DATE:
        return isinstance(dtype, T.DateType)
    if family == TIMESTAMP:
        return isinstance(dtype, (T.TimestampType, T.TimestampNTZType))
    if family == KEYED:
        return isinstance(dtype, (T.MapType, T.StructType))
    raise ValueError(family)


class SchemaMismatch(Exception):
    """A bound frame lacks a column of its source or has it in another type."""


class SourceUnavailable(LookupError):
    """The logical source is not bound in this environment."""


def validate(name: str, df: DataFrame) -> None:
    spec = SCHEMAS[name]
    fields = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for col, family in spec.items():
        if col not in fields and family == KEYED and all(k in fields for k in KEYED_FIELDS.get(col, (None,))):
            continue  # every key of the container is a top-level column
        if col not in fields:
            problems.append(f"missing column {col!r}")
        elif not _matches(family, fields[col]):
            problems.append(f"column {col!r} is {fields[col].simpleString()}, expected {family}")
    if problems:
        raise SchemaMismatch(f"{name}: " + "; ".join(problems))


Binding = DataFrame | Callable[[], DataFrame]


class Sources:
    """Bound logical sources, each with an optional fixed ``as_of``.

    A binding is a DataFrame or a zero-argument function returning one; a
    function is called (and its result validated) only when a report first
    asks for that source, so a report reads and analyses just the sources it
    uses.  ``as_of`` per source lets a fixture (or a replay of historic data)
    pin "now" for that source; otherwise the caller's ``as_of`` applies.
    """

    def __init__(
        self,
        tables: dict[str, Binding] | None = None,
        clocks: dict[str, AsOf] | None = None,
        partitions: dict[str, dict[str, str]] | None = None,
    ):
        self._bindings: dict[str, Binding] = dict(tables or {})
        self._frames: dict[str, DataFrame] = {}
        self.clocks: dict[str, AsOf] = dict(clocks or {})
        self.partitions: dict[str, dict[str, str]] = {k: dict(v) for k, v in (partitions or {}).items()}
        for name, b in self._bindings.items():
            if isinstance(b, DataFrame):
                validate(name, b)
                self._frames[name] = b

    def bind(
        self, name: str, df: Binding, as_of: AsOf = None, date_partitions: dict[str, str] | None = None
    ) -> "Sources":
        """Bind ``name`` to ``df``.

        ``date_partitions`` maps a time column to the date column the table is
        partitioned on (``{"event_time": "event_date"}``, the date of the
        time); look-backs on the time column then also filter the date
        column, which prunes whole partitions before any file is opened."""
        if name not in SCHEMAS:
            raise KeyError(f"unknown logical source {name!r}; known: {sorted(SCHEMAS)}")
        clocks = dict(self.clocks)
        if as_of is not None:
            clocks[name] = as_of
        partitions = dict(self.partitions)
        partitions.pop(name, None)  # hints belong to the replaced binding
        if date_partitions:
            partitions[name] = dict(date_partitions)
        out = Sources({**self._bindings, name: df}, clocks, partitions)
        out._frames.update({k: v for k, v in self._frames.items() if k != name})
        return out

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._frames:
            return self._frames[name]
        if name not in self._bindings:
            raise SourceUnavailable(name)
        df = self._bindings[name]()
        validate(name, df)
        self._frames[name] = df
        return df

    @property
    def names(self) -> list[str]:
        return list(self._bindings)

    def has(self, name: str) -> bool:
        return name in self._bindings

    def as_of(self, name: str, default: AsOf = None) -> AsOf:
        """The explicit ``default`` wins; else the source's own clock."""
        return default if default is not None else self.clocks.get(name)

    def recent(self, name: str, col: str, as_of: AsOf = None, days: int = 0, hours: int = 0) -> DataFrame:
        """Rows of ``name`` with ``col >= as_of - days - hours``.

        The bound is a constant of the column's type (a pushed Parquet
        filter); when the source declared a date partition for ``col`` the
        implied ``partition >= date(bound)`` is added for partition pruning."""
        from ..functions import since
        from ..operators import lookback

        df = self[name]
        a = self.as_of(name, as_of)
        out = lookback(df, col, a, days=days, hours=hours)
        pcol = self.partitions.get(name, {}).get(col)
        if pcol:
            # the date of the very bound that rows are filtered by
            bound = since(a, df.schema[col].dataType, days=days, hours=hours).cast("date")
            out = out.filter(F.col(pcol) >= bound.cast(df.schema[pcol].dataType))
        return out

    def pinned(self, moment: AsOf) -> "Sources":
        """The same bindings, with ``moment`` as the clock of every source that has none."""
        out = Sources(self._bindings, {n: self.clocks.get(n, moment) for n in self._bindings}, self.partitions)
        out._frames.update(self._frames)
        return out

    def register_views(self, spark, prefix: str = "", only_in: str | None = None) -> list[str]:
        """Expose bound sources as temp views (for custom SQL).

        With ``only_in`` (a SQL text) only the sources whose view name occurs
        in it as a word are built and registered, so a query touching one
        source does not open the other eight."""
        names = []
        for name in self._bindings:
            view = prefix + name
            if only_in is not None and not re.search(rf"\b{re.escape(view)}\b", only_in, re.IGNORECASE):
                continue
            self[name].createOrReplaceTempView(view)
            names.append(view)
        return names

    @contextmanager
    def views(self, spark, only_in: str):
        """``register_views`` for the length of a block; the session's own temp
        views of the same names come back after it, others leave no trace."""
        wanted = [n for n in self._bindings if re.search(rf"\b{re.escape(n)}\b", only_in, re.IGNORECASE)]
        own = {
            n: spark.table(n) for n in wanted
            if any(t.isTemporary and t.name.lower() == n.lower() for t in spark.catalog.listTables(pattern=n))
        }
        made: list[str] = []
        try:
            for name in wanted:
                made.append(name)
                self[name].createOrReplaceTempView(name)
            yield
        finally:
            for name in made:
                if name in own:
                    own[name].createOrReplaceTempView(name)
                else:
                    spark.catalog.dropTempView(name)


__all__ = [
    "ACCESS_AUDIT",
    "BILLING_USAGE",
    "CATALOG_COLUMNS",
    "CATALOG_TABLES",
    "JOBS",
    "JOB_RUNS",
    "LIST_PRICES",
    "QUERY_HISTORY",
    "SCHEMAS",
    "KEYED_FIELDS",
    "SchemaMismatch",
    "SourceUnavailable",
    "Sources",
    "TABLE_PRIVILEGES",
    "field",
    "validate",
]
