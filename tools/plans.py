"""Shape of the physical plans: scans, exchanges, joins, aggregates that sort.

    python tools/plans.py [--sf 0.1] [--broadcast-off] [name-prefix ...]

With broadcasts off the plans show the shuffles of tables too large to broadcast.
"""
from __future__ import annotations

import argparse
import re
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
NODES = ("FileScan", "Exchange", "BroadcastExchange", "SortMergeJoin", "ShuffledHashJoin",
         "BroadcastHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "SortAggregate",
         "ObjectHashAggregate", "HashAggregate", "Window", "Sort", "ArrowEvalPython", "Generate")


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.1")
    ap.add_argument("--broadcast-off", action="store_true")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from barloom.plans.catalog import QUERIES
    from barloom.session import get_spark
    spark = get_spark("plans")
    if a.broadcast_off:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for name, fn in QUERIES.items():
        if a.names and not any(name.startswith(x) for x in a.names):
            continue
        df = fn(spark, f"/root/testdata/sf{a.sf}")
        text = df._jdf.queryExecution().executedPlan().toString()
        n = Counter(m for m in re.findall(r"(?:[+:\-] |^)\*?(?:\(\d+\) )?(\w+)", text, re.M)
                    if m in NODES)
        print(name, " ".join(f"{k}={n[k]}" for k in NODES if n[k]), flush=True)


if __name__ == "__main__":
    main()
