"""Print what the physical plan of every registered query does, as a Markdown table.

Automatic broadcasts are off, so that joins look as they do on large inputs.
"""

from __future__ import annotations

import os
import re

from cliploom.plans.catalog import all_queries
from cliploom.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.01")


def row(name: str, covers: str, plan: str) -> str:
    def count(pattern: str) -> int:
        return len(re.findall(pattern, plan))

    scans = re.findall(r"FileScan (\w+).*?PushedFilters: \[(.*?)\], ReadSchema: struct<(.*?)>\n", plan + "\n")
    columns = "; ".join(re.sub(r":\w+(<\w+>)?", "", read) or "(count only)" for _, _, read in scans)
    filters = "; ".join(sorted({f for _, f, _ in scans if f}))
    checkpoints = count("Scan ExistingRDD")
    cells = (name, covers, count("Exchange "), count("SortMergeJoin"), count("ArrowEvalPython|MapInArrow"), checkpoints)
    return "| " + " | ".join(map(str, (*cells, columns, filters))) + " |"


def main() -> None:
    spark = build_session(
        "cliploom-explain",
        "local[4]",
        {
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.shuffle.partitions": "8",
            "spark.sql.debug.maxToStringFields": "100",
            "spark.sql.maxMetadataStringLength": "1000",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    print("| query | covers | shuffles | sort-merge joins | Arrow steps | checkpoints read | columns read | pushed filters |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, query in all_queries().items():
        plan = query.run(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        print(row(name, query.covers, plan))
    spark.stop()


if __name__ == "__main__":
    main()
