"""The governed runs end to end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.plans import flows
from custodia.plans.corpus_queries import gate_sql
from custodia.plans.quality_queries import RAW_EVENTS, RUN_ID, RUN_TS, expected_events
from custodia.plans.registry import query
from custodia.plans.rule_queries import report_sql
from custodia.session import fresh_path
from custodia.sources.tables import Dataset
from custodia.sources.views import with_views


@query(
    with_views(
        f"""
WITH gated AS ({gate_sql()}),
admitted AS (SELECT script_id, sanitized_code AS code FROM gated WHERE passed),
report AS ({report_sql("admitted")})
SELECT script_id, passed, error_code, rule_violated, sha256(code) AS input_hash, overall_status, risk_level
FROM gated JOIN v_submissions USING (script_id) LEFT JOIN report USING (script_id)
""",
        "v_submissions",
    )
)
def governed_submissions(ds: Dataset) -> DataFrame:
    path = fresh_path(ds.spark, "governed-store")
    return flows.govern_submissions(ds.view("v_submissions"), "script_id", RUN_ID, RUN_TS, path)


@query(
    with_views(
        f"""
WITH gated AS ({gate_sql()}),
admitted AS (SELECT script_id, sanitized_code AS code FROM gated WHERE passed),
report AS ({report_sql("admitted")}),
runs AS (SELECT 'run-a' AS run_id, * FROM gated WHERE script_id % 3 <> 0 UNION ALL SELECT 'run-b', * FROM gated),
rows AS (
  SELECT run_id, 'sessions' AS table_name, CASE WHEN passed THEN 'success' ELSE 'failed' END AS kind FROM runs
  UNION ALL SELECT run_id, 'artifacts', 'compliance' FROM runs WHERE passed
  UNION ALL SELECT run_id, 'pii_reports', risk_level FROM runs JOIN report USING (script_id)
  UNION ALL SELECT run_id, 'audit_log', CASE WHEN NOT passed OR overall_status = 'fail' THEN 'WARNING' ELSE 'INFO' END
    FROM runs LEFT JOIN report USING (script_id))
SELECT run_id, table_name, kind, count(*) AS n FROM rows GROUP BY ALL
""",
        "v_submissions",
    )
)
def governed_store(ds: Dataset) -> DataFrame:
    """What two runs, one of them repeated, leave in the store's tables."""
    path, scripts = fresh_path(ds.spark, "governed-store"), ds.view("v_submissions")
    for run_id, rows in (("run-a", scripts), ("run-b", scripts), ("run-a", scripts.where("script_id % 3 <> 0"))):
        flows.govern_submissions(rows, "script_id", run_id, RUN_TS, path)
    kinds = {"sessions": "status", "artifacts": "artifact_type", "pii_reports": "risk_level", "audit_log": "severity"}
    parts = [
        ds.spark.read.parquet(f"{path}/{name}").select("run_id", F.lit(name).alias("table_name"), F.col(kind).alias("kind"))
        for name, kind in kinds.items()
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("run_id", "table_name", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""
WITH raw AS ({RAW_EVENTS.format(events='events')})
SELECT event_id, TRY_CAST(value AS DECIMAL(12,2)) AS value, sha256(user_id) AS user_id, event_type,
  '{RUN_ID}' AS _etl_run_id, TIMESTAMP '{RUN_TS}' AS _etl_timestamp, 'events' AS _etl_source
FROM raw WHERE TRY_CAST(value AS DECIMAL(12,2)) = TRY_CAST(value AS DECIMAL(38,18)) AND TRY_CAST(user_id AS BIGINT) IS NOT NULL AND event_type IS NOT NULL
"""
)
def governed_table(ds: Dataset) -> DataFrame:
    """The raw events, delivered twice: the key decides which copy stays."""
    raw = ds.spark.sql(RAW_EVENTS, events=ds.table("events"))
    return flows.govern_table(
        raw.unionByName(raw),
        expected_events(),
        keys=["event_id"],
        order=["user_id", "event_type", "value"],
        masks={"user_id": "token"},
        partition_cols=["event_type"],
        run_id=RUN_ID,
        ts=RUN_TS,
        source="events",
        path=fresh_path(ds.spark, "governed-events"),
    )
