"""Reusable DataFrame -> DataFrame operators behind the reports.

Each one is a small composition of built-in DataFrame operations, chosen so
the physical plan scales: filters compare raw columns to constants (pushed
into the scan), aggregations are partial/final hash aggregates (hot keys
collapse map-side before the shuffle), top-k is ``TakeOrderedAndProject``
(per-partition heaps, no global sort), and joins are equi-joins that AQE may
turn into broadcast joins once it has measured the smaller side.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import EMPTY_TREND, alert, glyph, now, ratio_half_up, since
from ..params import AsOf, InvalidParams

# ---------------------------------------------------------------------------
# Ordering helpers: nulls placement is always spelled out (engines differ)
# ---------------------------------------------------------------------------


def desc(*cols: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in cols]


def asc(*cols: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in cols]


# ---------------------------------------------------------------------------
# Filters
# ---------------------------------------------------------------------------


def lookback(df: DataFrame, col: str, as_of: AsOf, days: int = 0, hours: int = 0) -> DataFrame:
    """Rows with ``col >= as_of - days - hours`` (lower bound only).

    The bound is a constant of the column's own type, so the predicate reaches
    the Parquet scan (``PushedFilters``) and prunes date partitions."""
    dtype = df.schema[col].dataType
    return df.filter(F.col(col) >= since(as_of, dtype, days=days, hours=hours))


def older_than(df: DataFrame, col: str, as_of: AsOf, days: int) -> DataFrame:
    """Rows with ``col < as_of - days``; NULLs drop out."""
    dtype = df.schema[col].dataType
    return df.filter(F.col(col) < since(as_of, dtype, days=days))


def scope(df: DataFrame, catalogs: Iterable[str] = (), col: str = "table_catalog") -> DataFrame:
    """Restrict to the given catalogs; no-op for an empty list."""
    cats = [c for c in catalogs if c]
    return df.filter(F.col(col).isin(cats)) if cats else df


def of_actions(df: DataFrame, actions: Sequence[str], col: str = "action_name") -> DataFrame:
    return df.filter(F.col(col).isin(list(actions)))


def name_pattern_scan(
    df: DataFrame, col: str, tokens: Sequence[str], whole_token: bool = False
) -> DataFrame:
    """Rows whose lower-cased ``col`` contains one of ``tokens``.

    ``whole_token`` requires the token to be delimited by ``_`` or the ends
    of the name (``trace_id`` then no longer matches ``race``)."""
    # a look at one character rules out most places before the tokens are tried
    firsts = "".join(sorted({re.escape(t[0]) for t in tokens}))
    alternation = f"(?=[{firsts}])(?:{'|'.join(re.escape(t) for t in tokens)})"
    pattern = f"(?:^|_){alternation}(?:_|$)" if whole_token else alternation
    return df.filter(F.lower(F.col(col)).rlike(pattern))


def flag_rows(df: DataFrame, col: str, flag: str = "is_alert") -> DataFrame:
    """Add ``flag``: the string column contains FAIL / ERROR / DENIED.

    Non-string columns are never flagged."""
    from pyspark.sql import types as T

    if isinstance(df.schema[col].dataType, T.StringType):
        return df.withColumn(flag, alert(col))
    return df.withColumn(flag, F.lit(False))


# ---------------------------------------------------------------------------
# Top-k
# ---------------------------------------------------------------------------


def top_n(df: DataFrame, order: Sequence[Column], n: int | None) -> DataFrame:
    """``ORDER BY ... LIMIT n``; ``order`` must be a total order so that the
    cut is the same on every run and partitioning."""
    ordered = df.orderBy(*order)
    return ordered.limit(n) if n is not None else ordered


# ---------------------------------------------------------------------------
# Aggregates
# ---------------------------------------------------------------------------


def share_of_total(
    df: DataFrame, keys: Sequence[str], count_col: str = "count", pct_col: str = "pct", scale: int = 1
) -> DataFrame:
    """Row count per key and its percentage of all rows (HALF_UP, ``scale``).

    The grand total is the sum of the grouped counts, so the rows are read
    once; only the groups (one row per key) meet in one task."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))
    return (
        counts.withColumn("__total", F.sum(count_col).over(Window.partitionBy(F.lit(0))))
        .withColumn(pct_col, ratio_half_up(F.col(count_col) * F.lit(100), F.col("__total"), scale))
        .drop("__total")
    )


def status_by_day(
    df: DataFrame,
    ts: str,
    state: str,
    counted: dict[str, str],
    day_col: str = "run_date",
    total_col: str = "total_runs",
) -> DataFrame:
    """Per calendar day of ``ts``: all rows plus one count per named state."""
    return df.groupBy(F.to_date(ts).alias(day_col)).agg(
        F.count(F.lit(1)).alias(total_col),
        *[F.count_if(F.col(state) == s).alias(alias) for alias, s in counted.items()],
    )


def latest_per_key(df: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """One row per ``key``: the ``value`` of the row with the greatest
    ``order`` (or the greatest ``value`` when no order column exists).

    Used to deduplicate slowly changing dimensions before joining them."""
    picked = F.max_by(value, F.struct(order, value)) if order else F.max(value)
    return df.groupBy(key).agg(picked.alias(value))


def latest_for(top: DataFrame, dim: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """``top`` (few rows: a cut) with the ``latest_per_key`` value of its keys.

    ``dim`` is read once and reduced to the keys of ``top`` before anything is
    grouped, so it is not shuffled where Spark broadcasts ``top``.  An inner
    join may broadcast either side and evaluates ``top`` once, but drops rows
    without a match; so every row of ``top`` also meets one added row, which
    has no value."""
    row = top.select(F.struct(*top.columns).alias("__top"), F.monotonically_increasing_id().alias("__n"))
    keyed = row.select(
        "__top", "__n",
        F.explode(F.array(F.struct(F.lit(True).alias("dim"), F.col(f"__top.{key}").alias("key")),
                          F.struct(F.lit(False).alias("dim"), F.lit(None).cast(top.schema[key].dataType).alias("key")))).alias("__k"),
    )
    ranked = F.struct(order, value) if order else F.col(value)
    rows = dim.filter(F.col(key).isNotNull()).select(
        F.struct(F.lit(True).alias("dim"), F.col(key).cast(top.schema[key].dataType).alias("key")).alias("__d"),
        F.col(value).alias("__value"), ranked.alias("__rank"),
    )
    added = dim.sparkSession.range(0, 1, 1, 1).select(
        F.struct(F.lit(False).alias("dim"), F.lit(None).cast(top.schema[key].dataType).alias("key")).alias("__d"),
        *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("__value", "__rank")],
    )
    met = rows.unionByName(added).join(
        keyed, (F.col("__d.dim") == F.col("__k.dim")) & F.col("__d.key").eqNullSafe(F.col("__k.key"))
    )
    return met.groupBy("__n", "__top").agg(F.max_by("__value", "__rank").alias(value)).select("__top.*", value)


# ---------------------------------------------------------------------------
# Joins
# ---------------------------------------------------------------------------


def valid_on_join(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    at: str,
    values: dict[str, Column | str],
    start: str,
    end: str,
    fact_key: Sequence[str],
    dedup: str = "latest",
) -> DataFrame:
    """Left join ``facts`` to the ``dim`` rows valid at ``facts[at]``.

    Valid means equal on ``on``, ``start <= at`` and ``end IS NULL OR end > at``.
    ``values`` are the dimension columns to bring over.  With
    ``dedup="latest"`` only the valid row with the greatest ``start`` (of those,
    an open or the latest ``end``, then the greatest values) is kept per fact
    (``fact_key`` must identify a fact row); ``"all"`` keeps every
    valid row (facts repeat when validity intervals overlap).

    Call it on *aggregated* facts (one row per date and key), so the join runs
    on days x keys rows, not on raw events.  ``"latest"`` meets no fact with
    every row of its key's history: see ``_latest_valid``."""
    if dedup not in ("latest", "all"):
        raise ValueError("dedup must be 'latest' or 'all'")
    renamed = dim.select(
        *[F.col(k).alias(f"__dim_{k}") for k in on],
        F.col(start).alias("__dim_start"),
        F.col(end).alias("__dim_end"),
        *[(F.col(v) if isinstance(v, str) else v).alias(name) for name, v in values.items()],
    )
    if dedup == "latest":
        return _latest_valid(facts, renamed, on, at, list(values), fact_key)
    cond = [facts[k] == renamed[f"__dim_{k}"] for k in on]
    cond += [
        renamed["__dim_start"] <= facts[at],
        renamed["__dim_end"].isNull() | (renamed["__dim_end"] > facts[at]),
    ]
    return facts.join(renamed, cond, "left").select(*facts.columns, *values.keys())


def _latest_valid(
    facts: DataFrame, dim: DataFrame, on: Sequence[str], at: str, values: list[str], fact_key: Sequence[str]
) -> DataFrame:
    """As-of sweep: ``facts`` and the starts of ``dim`` rows, sorted by time
    within a key, pass once; each fact carries the row that started last.

    Where that row is still valid it is the one.  Where it has ended, an older
    row can only be valid if it outlives a younger one (a base price around a
    promotion): such facts, told by the greatest end so far, are joined to the
    rows that outlive a younger one, and to no others.  A history without such
    nesting, however long, is never joined."""
    keys = [f"__dim_{k}" for k in on]
    kind = dim.schema["__dim_start"].dataType
    known = dim.dropna(subset=[*keys, "__dim_start"])  # the rest is never valid
    row = F.struct("__dim_start", "__dim_end", *values)
    starts = known.select(
        *[F.col(k).alias(f"__on_{i}") for i, k in enumerate(keys)], F.col("__dim_start").alias("__t"),
        F.lit(0).alias("__fact"), "__dim_end", row.alias("__row"), F.lit(None).cast(facts.schema).alias("__of"),
    )
    moments = facts.select(
        *[F.col(k).cast(dim.schema[d].dataType).alias(f"__on_{i}") for i, (k, d) in enumerate(zip(on, keys))],
        F.col(at).cast(kind).alias("__t"), F.lit(1).alias("__fact"),
        F.lit(None).cast(dim.schema["__dim_end"].dataType).alias("__dim_end"),
        F.lit(None).cast(known.select(row.alias("r")).schema["r"].dataType).alias("__row"),
        F.struct(*facts.columns).alias("__of"),
    )
    by = [f"__on_{i}" for i in range(len(keys))]
    # of rows with one start the last has the open or latest end, then the greatest values
    order = [F.col("__t"), F.col("__fact"), F.col("__dim_end").asc_nulls_last(), *[F.col(f"__row.{v}").asc_nulls_first() for v in values]]
    far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = (
        starts.unionByName(moments)
        .withColumn("__last", F.last("__row", ignorenulls=True).over(far))
        .withColumn("__open", F.max(F.when(F.col("__fact") == 0, F.col("__dim_end").isNull())).over(far))
        .withColumn("__until", F.max("__dim_end").over(far))
        .filter(F.col("__fact") == 1)
    )
    valid = F.col("__last").isNotNull() & (F.col("__last.__dim_end").isNull() | (F.col("__last.__dim_end") > F.col("__t")))
    swept = carried.select(
        "__of", "__t", *by, F.when(valid, F.col("__last")).alias("__last"),
        (F.col("__last").isNotNull() & ~valid & (F.col("__open") | (F.col("__until") > F.col("__t")))).alias("__older"),
    )
    younger = (
        Window.partitionBy(*keys)
        .orderBy(F.col("__dim_start").desc(), F.col("__dim_end").desc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    soonest = F.min("__dim_end").over(younger)
    outliving = (
        known.withColumn("__soonest", soonest)
        .filter(F.col("__soonest").isNotNull() & (F.col("__dim_end").isNull() | (F.col("__dim_end") > F.col("__soonest"))))
        .select(*keys, "__dim_start", F.col("__dim_end").alias("__end"), row.alias("__found"))
    )
    cond = [F.col(b) == F.col(k) for b, k in zip(by, keys)]
    cond += [F.col("__older"), F.col("__dim_start") <= F.col("__t"), F.col("__end").isNull() | (F.col("__end") > F.col("__t"))]
    best = F.struct(
        F.col("__found.__dim_start"), F.col("__end").isNull(), F.col("__end"),
        *[F.struct(F.col(f"__found.{v}").isNotNull(), F.col(f"__found.{v}")) for v in values],
    )
    joined = swept.join(outliving, cond, "left").groupBy(*by, "__of").agg(
        F.any_value("__last").alias("__last"), F.max_by("__found", F.when(F.col("__found").isNotNull(), best)).alias("__found"),
    )
    picked = F.coalesce("__last", "__found")
    return joined.select("__of.*", *[picked.getField(v).alias(v) for v in values])


def without_match(
    df: DataFrame, other: DataFrame, keys: Sequence[str], where: Column | None = None
) -> DataFrame:
    """Rows of ``df`` with no row in ``other`` (optionally filtered) equal on
    all ``keys``: ``NOT EXISTS`` as a left-anti equi-join.

    The other side is reduced to its distinct keys first (partial aggregation
    map-side), so a key repeated millions of times (one table with many
    grants) becomes one row before the shuffle; the join then reuses that
    hash partitioning."""
    right = other.filter(where) if where is not None else other
    return df.join(right.select(*keys).distinct(), list(keys), "left_anti")


# ---------------------------------------------------------------------------
# Activity
# ---------------------------------------------------------------------------


def last_seen_between(
    df: DataFrame,
    key: str,
    ts: str,
    inner: int,
    outer: int,
    as_of: AsOf,
    null_aware: bool = False,
) -> DataFrame:
    """Keys seen in the last ``outer`` days but not in the last ``inner``.

    One pass: ``max(ts)`` per key over the outer window, kept when it falls
    before the inner bound (the anti-join of two windows collapses to that).
    ``null_aware=True`` reproduces ``key NOT IN (active keys)`` literally: one
    NULL key active in the inner window empties the result, and a NULL key is
    reported when nobody was active."""
    if outer <= inner:
        raise InvalidParams("the outer look-back must be longer than the inner one")
    dtype = df.schema[ts].dataType
    window = lookback(df.select(key, ts), ts, as_of, days=outer)
    if not null_aware:
        window = window.filter(F.col(key).isNotNull())
    last = window.groupBy(key).agg(F.max(ts).alias("last_seen"))
    inactive = last.filter(F.col("last_seen") < since(as_of, dtype, days=inner))
    if null_aware:
        active = lookback(df.select(key, ts), ts, as_of, days=inner)
        # 1 if a NULL key is active, else 0 if any key is, else -1: one aggregate
        state = active.agg(
            F.coalesce(F.max(F.when(F.col(key).isNull(), 1).otherwise(0)), F.lit(-1)).alias("state")
        ).scalar()
        inactive = inactive.filter((F.col(key).isNotNull() & (state != 1)) | (F.col(key).isNull() & (state == -1)))
    return inactive.withColumn("days_inactive", F.datediff(now(as_of, dtype), F.col("last_seen")).cast("long"))


# ---------------------------------------------------------------------------
# Trends
# ---------------------------------------------------------------------------


def trend_glyphs(
    df: DataFrame,
    keys: Sequence[str],
    order_col: str,
    value_col: str,
    out: str = "trend",
) -> DataFrame:
    """One glyph string per series: values min-max scaled to 8 blocks.

    A series is one ``keys`` group ordered by ``order_col``; it has one value
    per point, so rows sharing a point are summed first (a partial/final
    aggregate: a hot key collapses map-side, and a series is as long as its
    number of points, e.g. days of a look-back, never its number of rows).
    Empty or all-zero series give ten low blocks; NULL values count as 0.
    The glyphs come from ``transform`` over the sorted points."""
    v = F.coalesce(F.col(value_col).cast("double"), F.lit(0.0))
    points = df.groupBy(*keys, F.col(order_col).alias("__o")).agg(F.sum(v).alias("__v"))
    grouped = points.groupBy(*keys)
    series = grouped.agg(
        F.min("__v").alias("__lo"),
        F.max("__v").alias("__hi"),
        F.array_sort(F.collect_list(F.struct("__o", "__v"))).alias("__pts"),
        F.count(F.lit(1)).alias("points"),
    )
    chars = F.transform("__pts", lambda p: glyph(p["__v"], F.col("__lo"), F.col("__hi")))
    all_zero = F.forall("__pts", lambda p: p["__v"] == 0)
    return series.select(
        *keys,
        F.col("points"),
        F.when(all_zero, F.lit(EMPTY_TREND)).otherwise(F.array_join(chars, "")).alias(out),
    )


def fill_daily_gaps(
    df: DataFrame, date_col: str, start: Column, end: Column, fill: dict[str, object]
) -> DataFrame:
    """Add missing dates between ``start`` and ``end`` (inclusive) with
    ``fill`` values.  A generated calendar (one row per date, at most the
    look-back's length) is full-outer-joined to the data, so dates outside
    the range (future-dated rows) are kept, not dropped."""
    spark = df.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(start, end)).alias(date_col))
    joined = calendar.join(df, date_col, "full")
    return joined.select(
        date_col,
        *[
            F.coalesce(F.col(c), F.lit(fill[c])).alias(c) if c in fill else F.col(c)
            for c in df.columns
            if c != date_col
        ],
    )


__all__ = [
    "asc",
    "desc",
    "fill_daily_gaps",
    "flag_rows",
    "last_seen_between",
    "latest_for",
    "latest_per_key",
    "lookback",
    "name_pattern_scan",
    "of_actions",
    "older_than",
    "scope",
    "share_of_total",
    "status_by_day",
    "top_n",
    "trend_glyphs",
    "valid_on_join",
    "without_match",
]
