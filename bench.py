"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]

Every query runs to the end into a sink that keeps nothing; the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "pii_findings_ext",
    "pii_risk",
    "redact_text",
    "pii_dataset_profile",
    "rule_residual_pii",
    "customer_ltv",
    "region_revenue",
    "cross_border_flows",
    "dedup_by_key",
    "dq_suite",
    "dq_unique",
    "script_facts",
    "gate",
    "script_rule_checks",
    "compliance_report",
    "line_diff",
    "table_diff",
    "keyed_diff",
    "message_window",
    "status_transitions",
    "artifacts_by_session",
    "cascade_purge",
    "idempotent_overwrite",
    "merge_upsert",
]


def main() -> None:
    from custodia.plans.catalog import QUERIES
    from custodia.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.range(10**6).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in list(QUERIES) if names == ["all"] else names:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    spark.stop()
    line = {
        "metric": "headline queries, sum of the better of two runs",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
