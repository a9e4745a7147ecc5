"""Column functions: compact numbers, trend glyphs, previews, alert flags,
exact rounding.  Cases carried over from the original formatter tests."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from opslens.functions import BLOCKS, EMPTY_TREND, alert, compact_number, preview, ratio_half_up
from opslens.operators import flag_rows, trend_glyphs


def _one(spark, col, value, dtype="double"):
    if dtype == "double" and value is not None:
        value = float(value)
    return spark.createDataFrame([(value,)], f"x {dtype}").select(col(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "value,text",
    [
        (2_000_000, "2.0M"),
        (5_000, "5.0K"),
        (1_234, "1.2K"),
        (0, "0"),
        (1234.56, "1.2K"),
        (42, "42"),
        (3.14159, "3.14"),
        (-1500, "-1.5K"),
        (1250, "1.2K"),  # exact tie: half-even, as Python formats 1.25
        (999.5, "999.50"),
        (999.999, "1,000.00"),  # rounds past 1000 below the K threshold: separator shown
        (1_500_000_000, "1500.0M"),
        (None, None),
    ],
)
def test_compact_number(spark, value, text):
    assert _one(spark, compact_number, value) == text


def test_preview(spark):
    long = "x" * 200
    rows = spark.createDataFrame([(long,), ("short",), (None,)], "t string").select(
        preview("t", 80).alias("p")
    ).collect()
    assert rows[0]["p"] == "x" * 80 + "…"
    assert rows[1]["p"] == "short"
    assert rows[2]["p"] == ""


def test_alert_and_flag_rows(spark):
    df = spark.createDataFrame(
        [("FAILED",), ("accessDenied",), ("SUCCEEDED",), ("error: x",), (None,)], "s string"
    )
    assert [r["is_alert"] for r in flag_rows(df, "s").collect()] == [True, True, False, True, False]
    num = spark.createDataFrame([(1,)], "n int")
    assert flag_rows(num, "n").first()["is_alert"] is False
    assert _one(spark, alert, "denied", "string") is True


def _trend(spark, values):
    rows = [("a", i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, d int, v double")
    return trend_glyphs(df, [], "d", "v").first()["trend"]


def test_trend_glyphs(spark):
    assert _trend(spark, []) == EMPTY_TREND
    assert _trend(spark, [0.0, 0.0, 0.0]) == EMPTY_TREND
    assert _trend(spark, [float(i) for i in range(1, 9)]) == BLOCKS
    assert _trend(spark, [5.0, 5.0]) == BLOCKS[0] * 2  # constant non-zero: lowest
    assert _trend(spark, [3.0, None, 1.0]) == "█▁▃"  # 1/3 * 7 -> level 2


def test_trend_glyphs_many_series_ordered(spark):
    rows = [("a", 2, 1.0), ("a", 1, 0.0), ("b", 1, 2.0), ("b", 2, 1.0), ("b", 3, 0.0)]
    df = spark.createDataFrame(rows, "k string, d int, v double")
    got = {r["k"]: (r["points"], r["trend"]) for r in trend_glyphs(df, ["k"], "d", "v").collect()}
    assert got == {"a": (2, "▁█"), "b": (3, "█▄▁")}


@pytest.mark.parametrize(
    "num,den,scale,expected",
    [(1234, 1000, 1, 1.2), (1250, 1000, 1, 1.3), (1249, 1000, 1, 1.2), (-1250, 1000, 1, -1.3), (1, 3, 2, 0.33),
     (2, 3, 2, 0.67), (1005, 1000, 2, 1.01), (0, 7, 1, 0.0)],
)
def test_ratio_half_up(spark, num, den, scale, expected):
    df = spark.createDataFrame([(num,)], "n long")
    assert df.select(ratio_half_up(F.col("n"), den, scale).alias("r")).first()["r"] == expected


def test_trend_glyphs_sums_rows_of_a_point(spark):
    rows = [("a", 1, 1.0), ("a", 1, 1.0), ("a", 2, 1.0)]  # point 1 is 2.0, point 2 is 1.0
    df = spark.createDataFrame(rows, "k string, d int, v double")
    got = trend_glyphs(df, ["k"], "d", "v").first()
    assert (got["points"], got["trend"]) == (2, "█▁")


def test_ratio_half_up_matches_decimal(spark):
    """Property: equals Decimal(num / den) rounded HALF_UP, over random
    values (one Spark job for all cases)."""
    from decimal import ROUND_HALF_UP, Context, Decimal

    from hypothesis import given, settings
    from hypothesis import strategies as st

    cases = []

    @settings(max_examples=300, deadline=None, derandomize=True)
    @given(st.integers(-(10**15), 10**15), st.integers(1, 10**9), st.integers(0, 3))
    def collect(num, den, scale):
        cases.append((num, den, scale))

    collect()
    df = spark.createDataFrame(cases, "n long, d long, s int")
    got = {}
    for scale in range(4):
        part = df.filter(F.col("s") == scale).select("n", "d", ratio_half_up(F.col("n"), F.col("d"), scale).alias("r"))
        got.update({(r["n"], r["d"], scale): r["r"] for r in part.collect()})
    ctx = Context(prec=60)
    for n, d, s in cases:
        exact = ctx.divide(Decimal(n), Decimal(d)).quantize(Decimal(1).scaleb(-s), rounding=ROUND_HALF_UP)
        assert got[(n, d, s)] == float(exact.scaleb(s)) / 10**s, (n, d, s)


def test_compact_number_passes_text_through(spark):
    df = spark.createDataFrame([("N/A",), ("1234",), (None,)], "x string")
    assert [r["y"] for r in df.select(compact_number("x").alias("y")).collect()] == ["N/A", "1.2K", None]


def test_as_of_with_offset(spark):
    """An offset as_of is one instant: zoned columns compare with it, NTZ and
    date columns with the session clock at that instant."""
    from datetime import date, datetime

    from pyspark.sql import types as T

    from opslens.functions import now, since

    row = spark.range(1).select(
        now("2024-01-31T00:00:00+02:00", T.TimestampNTZType()).alias("ntz"),
        since("2024-01-31T00:00:00+02:00", T.DateType(), days=1).alias("d"),
        F.date_format(now("2024-01-31T00:00:00+02:00", T.TimestampType()), "yyyy-MM-dd HH:mm").alias("ltz_utc"),
    ).first()
    assert row["ntz"] == datetime(2024, 1, 30, 22) and row["d"] == date(2024, 1, 29)
    assert row["ltz_utc"] == "2024-01-30 22:00"  # session zone UTC in tests
