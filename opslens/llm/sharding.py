"""Contiguous shards of near equal bytes, from global prefix sums of sizes.

1. Rows (sizes and digests, no texts) are dealt by range and sorted by text
   digest, then doc_id, so that equal texts lie side by side and a large group
   of copies still spreads over many tasks.
2. Every task adds up the sizes of its own rows; the sums of the tasks (one row
   a task) give each task the bytes that lie before it, so every row knows its
   place among all bytes without one task having seen them.
3. Shards end at equal targets.  A row belongs to the shard in which its middle
   lies.  Where a target falls inside a group of equal texts of at most
   2 * SLACK shards, the cut moves to the nearer end of that group, so that it
   stays in one shard; a larger group is cut where the target falls.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import longs, map_arrow, written

SHARDS = 40
ROW_BYTES = 16  # counted for every row besides its text
SLACK = 0.01  # share of a shard by which a cut may move to keep equal texts together

_PLACED = "part int, row long, start long, mark binary, doc_id long, size long, text_crc32 long"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row number and bytes before every row, both within the task."""
    row = start = 0
    for batch in batches:
        sizes = longs(batch.column("size"))
        ends = start + np.cumsum(sizes)
        yield pa.RecordBatch.from_arrays(
            [batch.column("part"), pa.array(np.arange(row, row + len(sizes))), pa.array(ends - sizes),
             *[batch.column(c) for c in ("mark", "doc_id", "size", "text_crc32")]],
            names=["part", "row", "start", "mark", "doc_id", "size", "text_crc32"],
        )
        if len(sizes):
            row, start = row + len(sizes), int(ends[-1])


def _mark() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


def _cuts(placed: DataFrame, total: int, shards: int, slack: float) -> list[int]:
    """Bytes before the first row of shard 1, 2, ...: at most one row a cut and
    one a group around a cut come to the driver."""
    end = F.col("offset") + F.col("size")
    astride = placed.where(F.expr(f"offset * {shards} div {total}") != F.floor(end * shards / F.lit(total))).select("mark").distinct()
    groups = (
        placed.join(F.broadcast(astride), "mark")
        .groupBy("mark").agg(F.min("offset").alias("lo"), F.max(end).alias("hi")).collect()
    )
    cuts = []
    for k in range(1, shards):
        target = total * k // shards
        for g in groups:
            if g["lo"] < target < g["hi"] and (g["hi"] - g["lo"]) * shards <= 2 * slack * total:
                target = g["lo"] if target - g["lo"] <= g["hi"] - target else g["hi"]
                break
        cuts.append(target)
    return cuts


def _in_shards(docs: DataFrame, shards: int, slack: float) -> DataFrame:
    """mark, doc_id, size, text_crc32, at (row number over all), shard."""
    text = F.coalesce("text", F.lit(""))
    sizes = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ),
        "shard-sizes",
    )
    ordered = sizes.repartitionByRange("mark", "doc_id").sortWithinPartitions("mark", "doc_id")
    placed = written(map_arrow(ordered.withColumn("part", F.spark_partition_id()), _running, _PLACED), "shard-rows")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    bases = written(
        placed.groupBy("part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).select(
            F.col("part").alias("task"), "bytes",
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        ),
        "shard-bases",
    )
    total = bases.agg(F.sum("bytes")).first()[0] or 1
    # bases holds a row a task of the sort
    placed = placed.join(F.broadcast(bases.drop("bytes")), F.col("part") == F.col("task")).select(
        "mark", "doc_id", "size", "text_crc32", (F.col("row") + F.col("rows_before")).alias("at"),
        (F.col("start") + F.col("bytes_before")).alias("offset"),
    )
    middle = F.col("offset") * 2 + F.col("size")
    passed = [(middle >= 2 * cut).cast("int") for cut in _cuts(placed, total, shards, slack)]
    return placed.withColumn("shard", reduce(add, passed, F.lit(0)))


def assign_shards(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK) -> DataFrame:
    """Shard and place in it of every row.

    ``docs`` needs doc_id (long) and text (string); other columns are ignored.
    A row counts its text's UTF-8 bytes (none for a null) and ROW_BYTES more.
    Returns one row per input row: doc_id, size, text_crc32 (unsigned, of the
    UTF-8 bytes), law (``bytes``), shard (0 to shards - 1), slot (0, 1, ... in
    each shard) and grown_shard (null: another number of shards moves all
    cuts).  Rows are ordered by the SHA-256 of their text, then doc_id (null
    first), so a null text lies with the empty ones, and rows that repeat both
    are interchangeable.  A shard differs from its share by one row at each
    end, and by ``slack`` where a cut moved to keep equal texts together.  With
    fewer rows than shards some shards are empty; an empty table gives an
    empty result.
    """
    rows = _in_shards(docs, shards, slack)
    firsts = rows.groupBy(F.col("shard").alias("whose")).agg(F.min("at").alias("first"))  # at most ``shards`` rows
    return rows.join(F.broadcast(firsts), F.col("shard") == F.col("whose")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, slack: float = SLACK) -> None:
    """Write the rows of ``docs``, all columns, as Parquet folders
    ``path/shard=k``; files of a folder follow each other in slot order.

    A shard is a range of (text digest, doc_id), so one key a shard says where
    every row goes.  Rows that repeat doc_id and text stay together.  The names
    of ``docs`` may not include ``shard``.
    """
    rows = _in_shards(docs, shards, slack)
    firsts = rows.groupBy("shard").agg(F.min_by(F.struct("mark", "doc_id"), "at").alias("key")).orderBy("shard").collect()
    doc_id = F.col("doc_id").cast("long")
    at = F.lit(firsts[0]["shard"] if firsts else 0)
    for row in firsts[1:]:
        mark, first = F.lit(bytes(row["key"]["mark"])), row["key"]["doc_id"]
        later = F.lit(True) if first is None else F.coalesce(doc_id >= first, F.lit(False))
        at = F.when((F.col("shard mark") > mark) | ((F.col("shard mark") == mark) & later), row["shard"]).otherwise(at)
    (
        docs.withColumn("shard mark", _mark())
        .withColumn("shard", at)
        .repartitionByRange("shard", "shard mark", "doc_id")
        .sortWithinPartitions("shard", "shard mark", "doc_id")
        .drop("shard mark")
        .write.partitionBy("shard").parquet(path)
    )
