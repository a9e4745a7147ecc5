"""Bring-your-own-SQL reports over the bound sources."""
from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..sources import Sources


def custom_report(
    spark: SparkSession,
    src: Sources,
    sql: str,
    args: Mapping[str, Any] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Run ``sql`` with every bound source visible under its logical name
    (``access_audit``, ``billing_usage`` ...).

    The names are temp views only while the text is analysed: the session's
    own views stay as they were.  Parameters go through Spark's named parameter markers (``:name``), never
    through string splicing.  ``limit`` caps the rows, as a panel's row cap."""
    with src.views(spark, only_in=sql):
        df = spark.sql(sql.strip(), args=dict(args) if args else None)
        df.schema  # analysed here, with the sources in place
    return df.limit(limit) if limit is not None else df
