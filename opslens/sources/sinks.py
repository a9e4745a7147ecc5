"""Report sinks: write a report DataFrame as Parquet, CSV or JSON.

The write is distributed (one file per task); nothing is collected.  CSV
gets a header, RFC-4180 quoting and an explicit NULL text, and columns of a
nested type (maps, structs, arrays) are written as JSON text, since CSV has
no nested types.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "csv", "json")


def _flat(df: DataFrame) -> DataFrame:
    nested = (T.MapType, T.StructType, T.ArrayType)
    return df.select(
        *[
            F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_report(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
    null_value: str = "",
    max_records_per_file: int | None = None,
) -> str:
    """Write ``df`` to ``path`` and return the path.

    ``partition_by`` lays the output out in folders (e.g. by date), so later
    reads prune whole folders."""
    if fmt not in FORMATS:
        raise ValueError(f"fmt must be one of {FORMATS}")
    out = _flat(df) if fmt == "csv" else df
    writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    if fmt == "csv":
        writer = (
            writer.option("header", True)
            .option("nullValue", null_value)
            .option("emptyValue", '""')
            .option("quoteAll", False)
            .option("escape", '"')
        )
    writer.format(fmt).save(path)
    return path


def read_report(spark, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """Read back a written report (CSV with header)."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')
    return reader.load(path)
