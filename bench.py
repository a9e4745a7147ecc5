"""Time every registered report and derivation on the driver tables.

The headline set is the 31 reports and 10 derivations (option and rollup
variants are checked for correctness but not timed; name them to time them).
Protocol: ``local[$BENCH_CPUS]``, AQE on, one warm-up pass over all queries,
then for each query one more warm-up run and the median of ``$BENCH_RUNS`` runs; a run is plan construction plus a
``noop`` write of the full result (every row produced, nothing collected).
Prints one JSON line; ``value`` is the sum of the per-query medians.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]
"""
from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main(argv: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))

    from opslens.plans.registry import HEADLINE, QUERIES
    from opslens.session import local_session

    spark = local_session(cpus=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")))
    names = argv or list(HEADLINE)
    errors: dict[str, str] = {}
    for name in names:  # one pass to warm the JVM (JIT, class loading) for all queries
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:  # reported below, never hidden
            errors[name] = f"{type(e).__name__}: {str(e)[:300]}"
    times: dict[str, float | None] = {}
    for name in names:
        if name in errors:
            times[name] = None
            continue
        query = QUERIES[name]
        samples = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:  # the first run warms up
                samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 4)
        print(f"{name}: {times[name]:.3f}s", file=sys.stderr)

    m = re.search(r"sf([0-9.]+)$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "report_suite_seconds",
                "value": round(sum(t for t in times.values() if t is not None), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else sf_dir,
                "cpus": cpus,
                "runs": runs,
                "failed": sorted(errors),
                "errors": errors,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
