"""Run registered queries and their checking SQL side by side.

    python -m tests.check [folder] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

from custodia.sources.tables import SCHEMAS


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return f"{type(value).__name__}:{value}"


def as_bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark_df, con, sql) -> str:
    """Empty when equal, else what differs."""
    mine = [tuple(r) for r in spark_df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    a, b = as_bag(spark_df.columns, mine), as_bag(names, theirs)
    if a != b:
        return f"rows {len(mine)} vs {len(theirs)}; only here {list((a - b))[:2]}; only there {list((b - a))[:2]}"
    return ""


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from custodia.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    con = connect(folder)
    checks, bad = oracle_sql(), 0
    for name, build in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in checks:
                df = build(spark, folder)
                verdict = compare(df, con, checks[name]) or f"equal ({con.execute('SELECT count(*) FROM (' + checks[name] + ')').fetchone()[0]} rows)"
            else:
                verdict = f"equal (rows only: {len(build(spark, folder).collect())})"
        except Exception as exc:
            verdict = f"error {type(exc).__name__}: {str(exc)[:600]}"
        bad += not verdict.startswith("equal")
        print(f"{time.time() - start:6.2f}s {name}: {verdict}", flush=True)
    print("BAD", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
