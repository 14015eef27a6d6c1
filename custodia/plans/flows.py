"""Whole governed runs: submissions from gate to report, tables from ingest to audited write.

Every stage writes its result to the shared folder and the next one reads it back. That
keeps costly stages from running twice and lets a lost executor repeat one stage only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custodia.functions import masking
from custodia.functions import text as TX
from custodia.operators import gate as gates
from custodia.operators import quality, rules
from custodia.session import fresh_path
from custodia.sources import writes


def govern_submissions(
    submissions: DataFrame, subject: str, run_id: str, ts: str, path: str, **options
) -> DataFrame:
    """Gate, check and report scripts; returns one row per submission.

    Below ``path`` the run leaves its rows in four tables, partitioned by ``run_id``: ``sessions`` (status of every
    submission), ``artifacts`` (compliance reports as JSON), ``pii_reports`` and ``audit_log``. Other runs' rows
    stay; a repeated run replaces its own.
    """
    folder = fresh_path(submissions.sparkSession, "governed")
    gated = gates.gate(submissions.select(subject, "code"), **options).withColumn(
        "input_hash", TX.content_hash(F.col("code"))
    )
    gated = _through(gated.drop("code", "nul_stripped"), f"{folder}/gated")

    admitted = gated.where("passed").select(subject, F.col("sanitized_code").alias("code"))
    report = _through(rules.compliance_report(admitted, subject), f"{folder}/checked")
    session = F.col(subject).alias("session_id")
    payload = F.to_json(F.struct(*[F.col(c) for c in report.columns]))
    writes.write_run(
        report.select(session, F.lit("compliance").alias("artifact_type"), payload.alias("content")),
        f"{path}/artifacts",
        run_id,
    )
    writes.write_run(report.select(session, "pii_summary.*"), f"{path}/pii_reports", run_id)

    verdicts = report.select(subject, "overall_status", "pii_summary.risk_level")
    outcome = _through(
        gated.drop("sanitized_code", "error_message").join(verdicts, subject, "left"), f"{folder}/outcome"
    )
    time = F.lit(ts).cast("timestamp_ntz")
    status = F.when(F.col("passed"), "success").otherwise("failed")
    writes.write_run(
        outcome.select(session, "input_hash", status.alias("status"), "rule_violated", "overall_status", time.alias("created_at")),
        f"{path}/sessions",
        run_id,
    )
    entries = outcome.select(
        session,
        F.when(F.col("passed"), "checked").otherwise("rejected").alias("event_type"),
        F.to_json(F.struct("rule_violated", "overall_status", "risk_level")).alias("event_data"),
        time.alias("event_time"),
        F.when(~F.col("passed") | (F.col("overall_status") == "fail"), "WARNING")
        .otherwise("INFO")
        .alias("severity"),
    )
    writes.write_run(writes.checked_audit(entries), f"{path}/audit_log", run_id)
    return outcome


def _through(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def govern_table(
    raw: DataFrame,
    expected: T.StructType,
    keys: Sequence[str],
    order: Sequence[str | Column],
    masks: Mapping[str, str | Callable[[Column], Column]],
    partition_cols: Sequence[str],
    run_id: str,
    ts: str,
    source: str,
    path: str,
) -> DataFrame:
    """Ingest with quarantine, deduplicate, mask, add audit columns, write idempotently.

    Returns the table as written below ``path``, one row per key also when a row has changed partition;
    quarantined rows lie next to it by run, and a repeated run replaces its own.
    """
    taken = writes.ingest(raw, expected)
    writes.write_run(taken.bad, f"{path}/quarantine", run_id)
    unique = quality.dedup_by_key(taken.good, keys, order)
    audited = quality.with_audit(masking.mask_columns(unique, masks), run_id, ts, source)
    writes.write_keyed(audited, f"{path}/table", partition_cols, keys)
    return raw.sparkSession.read.schema(audited.schema).parquet(f"{path}/table").select(*audited.columns)
