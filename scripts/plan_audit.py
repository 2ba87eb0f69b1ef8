"""Print the physical operators of every registered query and flag patterns that do not scale.

Usage: python scripts/plan_audit.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from citeweave.plans.catalog import QUERIES  # noqa: E402
from citeweave.session import build_session  # noqa: E402

FLAGS = ["BroadcastNestedLoopJoin", "CartesianProduct", "SinglePartition", "SortAggregate",
         "BatchEvalPython", "ArrowEvalPython", "Python", "CollectLimit"]
SKIP = {"stream_ingest", "stream_ingest_state", "export_by_source", "lda_topics"}     # run jobs while planning


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    for name, fn in QUERIES.items():
        if name in SKIP:
            continue
        df = fn(spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        ops = sorted(set(re.findall(r"(?:^|[+:\- ])([A-Z][A-Za-z]+(?:Exec)?)(?=[ (\[])", plan)))
        flags = [f for f in FLAGS if f in plan]
        reads = re.findall(r"ReadSchema: (struct<[^>]*>)", df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        print(f"{name:22s} flags={flags} exchanges={plan.count('Exchange')}")
        for r in reads:
            print(f"{'':24s}read {r[:150]}")
    spark.stop()


if __name__ == "__main__":
    main()
