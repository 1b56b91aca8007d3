"""Summarise the physical plan of every registered query (markdown on stdout).

usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(plan: str) -> dict[str, object]:
    lines = plan.split("\n")
    scans = [ln for ln in lines if "FileScan" in ln]
    cached = sum(1 for ln in lines if "InMemoryTableScan" in ln)
    pushed = sum(1 for ln in scans if re.search(r"PushedFilters: \[[^\]]", ln))
    part = sum(1 for ln in scans if re.search(r"PartitionFilters: \[[^\]]", ln))
    exch = [ln for ln in lines if re.search(r"\bExchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", ln)]
    single = sum(1 for ln in exch if "SinglePartition" in ln)
    return {
        "scans": len(scans),
        "with pushed filters": pushed,
        "with partition filters": part,
        "cached small tables read": cached,
        "shuffles": len(exch),
        "reused shuffles": sum(1 for ln in lines if "ReusedExchange" in ln),
        "of which final single-row aggregates": single,
        "broadcast joins": sum(1 for ln in lines if "BroadcastHashJoin" in ln),
        "sort-merge joins": sum(1 for ln in lines if "SortMergeJoin" in ln),
        "windows": sum(1 for ln in lines if re.search(r"\bWindow \[", ln)),
        "window group limits": sum(1 for ln in lines if "WindowGroupLimit" in ln),
        "grouping-set expands": sum(1 for ln in lines if re.search(r"\bExpand \[", ln)),
        "python nodes": sum(1 for ln in lines if re.search(r"EvalPython|InPandas|InArrow|PythonUDF", ln)),
        "cartesian/nested-loop": sum(1 for ln in lines if "CartesianProduct" in ln or "NestedLoopJoin" in ln),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from plantwise.session import get_session
    from plantwise.plans.catalog import queries

    spark = get_session("local[8]", 8)
    qs = queries()
    keys = None
    rows = []
    for name in sorted(qs):
        df = qs[name](spark, sf_dir)
        df.collect()
        s = summarise(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        keys = list(s)
        rows.append((name, s))
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `tools/plan_report.py` at `{sf_dir}`: the final adaptive plan of each query's result, so")
    print("scans and shuffles are those that ran. What a query writes first (ingest, page index, sizes of")
    print("context lines) is not part of that plan.\n")
    print("| query | " + " | ".join(keys) + " |")
    print("|---" * (len(keys) + 1) + "|")
    for name, s in rows:
        print(f"| {name} | " + " | ".join(str(s[k]) for k in keys) + " |")


if __name__ == "__main__":
    main()
