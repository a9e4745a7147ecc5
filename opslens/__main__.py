"""Run panels as a Spark job and write every report, KPI frame and status.

    python -m opslens --bind access_audit=ops.audit --bind job_runs=parquet:/data/job_runs \\
        --panels users,jobs --days 14 --out /reports/today
    python -m opslens --fixtures /root/testdata/sf0.01 --out /tmp/reports --local

Each report lands whole in ``<out>/<panel>/<report>`` (Parquet by default),
its rows and effective window in ``_status``, counted while it is written;
nothing is collected on the driver.
"""
from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .params import ALL_PANELS, CustomPanel, Params
from .plans.panels import run_all
from .session import DEFAULT_CONF, ensure_checkpoint_dir, local_session
from .sources import Sources
from .sources.sinks import FORMATS, write_report


def _pairs(specs: list[str]) -> dict[str, str]:
    return {k.strip(): v.strip() for k, _, v in (s.partition("=") for s in specs)}


def _read(spark: SparkSession, spec: str, schema: str | None):
    """``fmt:path`` reads files, anything else is a table name."""
    fmt, sep, path = spec.partition(":")
    if sep and fmt in ("parquet", "orc", "json", "csv", "delta"):
        reader = spark.read.format(fmt)
        if fmt == "csv":
            if schema is None:
                raise ValueError(f"give the columns of {path} with --schema: inferring them reads the whole input")
            reader = reader.option("header", True)
        if schema is not None:
            reader = reader.schema(schema)
        return reader.load(path)
    return spark.table(spec)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="opslens", description=__doc__.split("\n")[0])
    ap.add_argument("--bind", action="append", default=[], metavar="SOURCE=TABLE|FMT:PATH")
    ap.add_argument("--schema", action="append", default=[], metavar="SOURCE=DDL", help="columns of a file source")
    ap.add_argument(
        "--date-partition", action="append", default=[], metavar="SOURCE.TIME_COLUMN=DATE_COLUMN",
        help="date column that a table is partitioned on",
    )
    ap.add_argument("--custom", action="append", default=[], metavar="TITLE=SQL", help="a panel of its own")
    ap.add_argument("--fixtures", metavar="SF_DIR", help="bind the driver test tables of SF_DIR")
    ap.add_argument("--panels", default=",".join(ALL_PANELS))
    ap.add_argument("--days", type=int, default=30)
    ap.add_argument("--catalogs", default="")
    ap.add_argument("--row-limit", type=int, default=500)
    ap.add_argument("--as-of", default=None)
    ap.add_argument("--shared-scans", action="store_true")
    ap.add_argument("--out", required=True)
    ap.add_argument("--format", default="parquet", choices=FORMATS)
    ap.add_argument("--mode", default="errorifexists")
    ap.add_argument("--local", action="store_true", help="start a local session")
    a = ap.parse_args(argv)

    if a.local:
        spark = local_session()
    else:
        builder = SparkSession.builder.appName("opslens")
        for k, v in DEFAULT_CONF.items():
            builder = builder.config(k, v)
        spark = builder.getOrCreate()
        ensure_checkpoint_dir(spark)

    if a.fixtures:
        from .sources.fixtures import bind_driver_tables

        src = bind_driver_tables(spark, a.fixtures)
    else:
        src = Sources()
    schemas = _pairs(a.schema)
    partitions: dict[str, dict[str, str]] = {}
    for place, column in _pairs(a.date_partition).items():
        source, _, time_column = place.partition(".")
        partitions.setdefault(source, {})[time_column] = column
    for name, target in _pairs(a.bind).items():
        # read when a report first asks, so that a bad source fails its reports only
        src = src.bind(
            name, lambda n=name, t=target: _read(spark, t, schemas.get(n)), date_partitions=partitions.get(name)
        )

    params = Params(
        days=a.days,
        catalogs=Params.parse_catalogs(a.catalogs),
        panels=tuple(p for p in a.panels.split(",") if p),
        row_limit=a.row_limit,
        as_of=a.as_of,
        custom_panels=tuple(CustomPanel(title, sql) for title, sql in _pairs(a.custom).items()),
    )
    out = a.out.rstrip("/")
    for panel, result in run_all(spark, src, params, a.shared_scans, display_caps=False).items():
        status = result.run(lambda name, df, p=panel: write_report(df, f"{out}/{p}/{name}", fmt=a.format, mode=a.mode))
        if result.kpis is not None:
            write_report(result.kpis, f"{out}/{panel}/_kpis", fmt=a.format, mode=a.mode)
        write_report(status, f"{out}/{panel}/_status", fmt=a.format, mode=a.mode)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
