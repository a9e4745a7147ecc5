"""All-or-nothing publication of a batch of reports.

A run writes its reports under ``<root>/runs/<run>`` and, last, one manifest
under ``<root>/manifests/<run>`` with the rows and a checksum of each report.
Readers go by manifests, so a run that fails half-way is never seen and the
former one stays readable.
"""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sinks import write_report

MANIFEST = "name string, run string, rows long, checksum string, schema string"


def _checksum(schema: T.StructType) -> Column:
    """Sum of the rows' 64-bit hashes: the same in any row order, and repeated
    rows count.  Columns are hashed as JSON, so maps may be among them."""
    row = F.to_json(F.struct(*[F.col(f"`{f}`") for f in schema.names]))
    return F.coalesce(F.sum(F.xxhash64(row).cast("decimal(38,0)")), F.lit(0)).cast("string")


class Publication:
    """One run of a batch, as Parquet.  ``run`` sorts after those before it (a
    time, say) and is not used twice."""

    def __init__(self, spark: SparkSession, root: str, run: str):
        self.spark, self.root, self.run = spark, root.rstrip("/"), run
        self.written: list[tuple] = []
        self.failed: list[str] = []

    def write(self, name: str, df: DataFrame) -> str:
        """Write a report; its rows are counted and hashed on the way."""
        seen = Observation()
        counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), _checksum(df.schema).alias("checksum"))
        try:
            path = write_report(counted, f"{self.root}/runs/{self.run}/{name}")
        except Exception:
            self.failed.append(name)
            raise
        self.written.append((name, self.run, seen.get["rows"], seen.get["checksum"], df.schema.json()))
        return path

    def commit(self) -> None:
        """Make the run the one that readers see; refused if a report failed."""
        if self.failed:
            raise RuntimeError(f"not published, these reports failed: {', '.join(self.failed)}")
        manifest = self.spark.createDataFrame(self.written, MANIFEST).coalesce(1)
        manifest.write.mode("errorifexists").json(f"{self.root}/manifests/{self.run}")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """The reports of all published runs."""
    return spark.read.schema(MANIFEST).json(f"{root.rstrip('/')}/manifests/*")


def _entries(spark: SparkSession, root: str, run: str | None) -> list:
    every = manifests(spark, root)
    # a row a report: these few come to the driver
    run = run or every.agg(F.max("run").alias("run")).toArrow().to_pylist()[0]["run"]
    return every.where(F.col("run") == run).toArrow().to_pylist()


def read_published(spark: SparkSession, root: str, name: str, run: str | None = None) -> DataFrame:
    """A report of the newest published run, or of ``run``."""
    for r in _entries(spark, root, run):
        if r["name"] == name:
            schema = T.StructType.fromJson(json.loads(r["schema"]))
            return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/runs/{r['run']}/{name}")
    raise KeyError(name)


def changed_since(spark: SparkSession, root: str, run: str | None = None) -> list[str]:
    """Reports of a published run whose files no longer hold the rows of the manifest."""
    out = []
    for r in _entries(spark, root, run):
        df = read_published(spark, root, r["name"], r["run"])
        seen = Observation()
        now = df.observe(seen, F.count(F.lit(1)).alias("rows"), _checksum(df.schema).alias("checksum"))
        now.write.format("noop").mode("overwrite").save()
        if (seen.get["rows"], seen.get["checksum"]) != (r["rows"], r["checksum"]):
            out.append(r["name"])
    return out
