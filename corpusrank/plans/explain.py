"""Print the scale-relevant facts of registered query plans: scans with their
ReadSchema / PushedFilters, exchanges, joins, window limits and Python nodes.

    python -m corpusrank.plans.explain /root/testdata/sf0.01 topk_all_users tfidf
"""

from __future__ import annotations

import re
import sys

KEYS = ("Scan parquet", "ReadSchema", "PushedFilters", "Exchange", "BroadcastHashJoin",
        "SortMergeJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "WindowGroupLimit",
        "TakeOrderedAndProject", "FlatMapCoGroupsInPandas", "MapInPandas", "ArrowEvalPython",
        "BatchEvalPython", "SinglePartition")


def facts(df) -> list:
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for line in plan.split("\n"):
        if any(k in line for k in KEYS):
            line = re.sub(r"#\d+L?", "", line.strip())
            out.append(line[:220])
    return out


if __name__ == "__main__":
    from corpusrank.plans.catalog import QUERIES
    from corpusrank.session import get_spark
    sf = sys.argv[1]
    spark = get_spark()
    for name in sys.argv[2:]:
        print(f"== {name}")
        for f in facts(QUERIES[name](spark, sf)):
            print("   ", f)
