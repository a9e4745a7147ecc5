"""Summarise the physical plan of every headline query (for PLANS.md).

    python tools/plan_summary.py [/root/testdata/sf0.1] [--no-broadcast] [--stored] > /tmp/plans.md

Counts come from the initial adaptive plan (before runtime re-planning):
hash / range / single-partition exchanges, broadcast and sort-merge joins,
top-k nodes, and whether every Parquet scan carries pushed filters.
"""
from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(plan: str) -> dict:
    scans = re.findall(r"FileScan parquet [^\n]*", plan)
    return {
        "hash_exchanges": len(re.findall(r"Exchange hashpartitioning", plan)),
        "range_exchanges": len(re.findall(r"Exchange rangepartitioning", plan)),
        "single_partition": len(re.findall(r"Exchange SinglePartition", plan)),
        "round_robin": len(re.findall(r"Exchange RoundRobinPartitioning", plan)),
        "broadcast_joins": len(re.findall(r"BroadcastHashJoin", plan)),
        "sort_merge_joins": len(re.findall(r"SortMergeJoin", plan)),
        "top_k": len(re.findall(r"TakeOrderedAndProject", plan)),
        "scans": len(scans),
        "scans_with_pushed_filters": sum("PushedFilters: [" in s and "PushedFilters: []" not in s for s in scans),
        "nested_loop_or_cartesian": len(re.findall(r"BroadcastNestedLoopJoin|CartesianProduct", plan)),
        "python_udf": len(re.findall(r"BatchEvalPython|ArrowEvalPython", plan)),
    }


def main(argv: list[str]) -> None:
    from opslens.plans.registry import HEADLINE, QUERIES
    from opslens.session import local_session

    no_broadcast = "--no-broadcast" in argv
    stored = "--stored" in argv
    argv = [a for a in argv if not a.startswith("--")]
    sf_dir = argv[0] if argv else "/root/testdata/sf0.1"
    spark = local_session()
    if stored:  # reports over stored source tables, as in production: no fixture joins in the plans
        import tempfile

        from opslens.plans import registry
        from opslens.sources import Sources
        from opslens.sources.fixtures import AS_OF, bind_driver_tables

        raw = bind_driver_tables(spark, sf_dir)
        base = tempfile.mkdtemp(prefix="opslens-stored-")
        src = Sources()
        for name in raw.names:
            raw[name].write.parquet(f"{base}/{name}")
            src = src.bind(name, spark.read.parquet(f"{base}/{name}"), as_of=AS_OF[name])
        registry._BOUND.setdefault(spark, {})[sf_dir.rstrip("/")] = src
    if no_broadcast:  # the shape at scale: dimension sides too big to broadcast
        for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.set(k, "-1")
    cols = ["hash_exchanges", "range_exchanges", "single_partition", "round_robin", "broadcast_joins",
            "sort_merge_joins",
            "top_k", "scans", "scans_with_pushed_filters", "nested_loop_or_cartesian", "python_udf"]
    print("| query | " + " | ".join(c.replace("_", " ") for c in cols) + " |")
    print("|---" * (len(cols) + 1) + "|")
    for name in HEADLINE:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        print(f"| `{name}` | " + " | ".join(str(s[c]) for c in cols) + " |")


if __name__ == "__main__":
    main(sys.argv[1:])
