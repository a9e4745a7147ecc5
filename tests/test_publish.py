"""Publication: a failed run is never seen, changed files are noticed."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from opslens.plans import jobs_success_rate
from opslens.sources.publish import Publication, changed_since, read_published


def test_failed_run_leaves_the_former_one(spark, src_small, tmp_path):
    root = str(tmp_path / "out")
    first = Publication(spark, root, "2024-01-01")
    report = jobs_success_rate(src_small)
    first.write("jobs/rate", report)
    first.write("empty", spark.range(0).withColumn("m", F.create_map(F.lit("a"), F.col("id"))))
    first.commit()
    second = Publication(spark, root, "2024-01-02")
    second.write("jobs/rate", report.limit(1))
    with pytest.raises(Exception):
        second.write("broken", spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("x")))
    with pytest.raises(RuntimeError, match="broken"):
        second.commit()
    got = read_published(spark, root, "jobs/rate")
    assert sorted(map(str, got.collect())) == sorted(map(str, report.collect()))
    assert changed_since(spark, root) == []
    with pytest.raises(KeyError):
        read_published(spark, root, "broken")
    report.limit(1).write.mode("append").parquet(f"{root}/runs/2024-01-01/jobs/rate")
    assert changed_since(spark, root) == ["jobs/rate"]
