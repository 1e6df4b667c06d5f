"""Run every registered query and summarise its final (adaptive) physical plan in PLANS.md.

Counts shuffles by kind, broadcasts, join strategies, partial top-k, sort-based
aggregation, skew splits and any Python evaluation, so plan regressions are visible
in review. Usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

MARKERS = [
    ("hash shuffle", r"Exchange hashpartitioning\(.*ENSURE_REQUIREMENTS"),
    ("repartition", r"Exchange hashpartitioning\(.*REPARTITION_BY_COL"),
    ("range shuffle", r"Exchange rangepartitioning"),
    ("single-partition", r"Exchange SinglePartition"),
    ("broadcast", r"BroadcastExchange"),
    ("SMJ", r"SortMergeJoin"),
    ("BHJ", r"BroadcastHashJoin"),
    ("partial top-k", r"WindowGroupLimit .*Partial"),
    ("SortAggregate", r"SortAggregate"),
    ("skew split", r"skew=true"),
    ("python", r"(BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas)"),
]


def final_plan(df) -> str:
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    if "== Final Plan ==" in p:
        p = p.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
    return p


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from seqforge.session import checkpoint_dir, get_session
    spark = get_session("local[8]", 8)
    checkpoint_dir(spark)
    from seqforge.plans import catalog  # noqa: F401
    from seqforge.plans.registry import REGISTRY
    print(f"# Plan shapes ({sf}, final adaptive plans, local[8], 8 shuffle partitions)\n")
    print("Generated by `tools/plan_report.py`. Queries that checkpoint between rounds (decoding) show "
          "the plan after their last checkpoint.\n")
    print("| query | " + " | ".join(m for m, _ in MARKERS) + " | sec |")
    print("| --- | " + " | ".join("---" for _ in MARKERS) + " | --- |")
    for name in sorted(REGISTRY):
        t = time.time()
        p = final_plan(REGISTRY[name].fn(spark, sf))
        counts = [len(re.findall(rx, p)) for _, rx in MARKERS]
        print(f"| {name} | " + " | ".join(str(c) if c else "" for c in counts) + f" | {time.time() - t:.1f} |",
              flush=True)


if __name__ == "__main__":
    main()
