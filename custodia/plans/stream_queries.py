"""Streaming twins; each processes all that is there, then hands over what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia import vocab
from custodia.functions import text as T
from custodia.plans.corpus_queries import gate_sql
from custodia.plans.pii_queries import ALL_KINDS, redacted_sql
from custodia.plans.registry import query, quoted
from custodia.plans.store_queries import DAILY_CAP
from custodia.sources import views
from custodia.sources.tables import SCHEMAS, Dataset
from custodia.sources.views import with_views
from custodia.streaming import streams


def _stream(ds: Dataset, table: str) -> DataFrame:
    return streams.read_stream(ds.spark, ds.path(table), SCHEMAS[table])


def _view(ds: Dataset, name: str, stream: DataFrame) -> DataFrame:
    """A derived view over one streaming table."""
    text, inputs = views.VIEWS[name]
    (source,) = inputs
    below = stream if source in SCHEMAS else _view(ds, source, stream)
    return ds.spark.sql(text, **{source: below})


KINDS = " || ".join(
    f"CASE WHEN regexp_matches(text, {quoted(vocab.PATTERN_BY_KIND[k].regex)}) THEN '{k},' ELSE '' END"
    for k in ALL_KINDS
)


@query(f"SELECT doc_id, rtrim({KINDS}, ',') AS entity_types, {redacted_sql('text')} AS redacted FROM documents")
def stream_pii(ds: Dataset) -> DataFrame:
    return streams.run_append(streams.redacted(_stream(ds, "documents"), "doc_id", "text"), "stream-pii")


@query(
    with_views(
        f"SELECT script_id, passed, rule_violated, sanitized_code FROM ({gate_sql()})", "v_submissions"
    )
)
def stream_gate(ds: Dataset) -> DataFrame:
    submissions = _view(ds, "v_submissions", _stream(ds, "part"))
    out = streams.gated(submissions, "stream-gate")
    schema = "script_id bigint, rule_violated string, sanitized_code string, batch bigint, passed boolean"
    return ds.spark.read.schema(schema).parquet(out).drop("batch")


@query(
    with_views(
        "SELECT date_trunc('hour', event_time) AS window_start, severity, count(*) AS n FROM v_audit_log GROUP BY ALL",
        "v_audit_log",
    )
)
def stream_audit_counts(ds: Dataset) -> DataFrame:
    log = _view(ds, "v_audit_log", _stream(ds, "events"))
    return streams.run_updates(streams.audit_counts(log), "stream-audit", ["window_start", "severity"])


@query("SELECT sha256(CAST(event_id AS STRING) || '|' || event_type) AS input_hash, event_id, event_type FROM events")
def stream_dedup(ds: Dataset) -> DataFrame:
    """Every event delivered three times within minutes; a day of state is enough to keep one of each."""
    times = F.explode(F.array(*[F.lit(m) for m in (0, 5, 45)])).alias("minutes")
    delivered = _stream(ds, "events").select("event_id", "event_type", "ts", times).select(
        T.content_hash(F.concat_ws("|", F.col("event_id").cast("string"), "event_type")).alias("input_hash"),
        "event_id",
        "event_type",
        F.timestamp_add("MINUTE", F.col("minutes"), F.col("ts")).alias("ts"),
    )
    first = streams.first_submissions(delivered, "input_hash", "ts", "ts", "1 day")
    return streams.run_append(first.select("input_hash", "event_id", "event_type"), "stream-dedup")


@query(
    with_views(
        f"SELECT CAST(created_at AS DATE) AS day, CAST(sum(tokens_used) AS BIGINT) AS tokens FROM v_sessions GROUP BY 1 HAVING sum(tokens_used) > {DAILY_CAP}",
        "v_sessions",
    )
)
def stream_token_cap(ds: Dataset) -> DataFrame:
    sessions = _view(ds, "v_sessions", _stream(ds, "orders"))
    return streams.run_updates(streams.token_cap(sessions, DAILY_CAP), "stream-cap", ["day"])


@query(
    with_views(
        """
SELECT session_id, line_no, created_at FROM v_artifacts a
WHERE created_at < TIMESTAMP '1998-01-01' AND NOT EXISTS (
  SELECT 1 FROM v_sessions s WHERE s.id = a.session_id AND s.id % 13 <> 0
    AND s.created_at BETWEEN a.created_at - INTERVAL 60 DAY AND a.created_at + INTERVAL 60 DAY)
""",
        "v_sessions",
        "v_artifacts",
    )
)
def stream_orphans(ds: Dataset) -> DataFrame:
    """Artifacts whose run is missing, or further from them than 60 days; those of the last months still wait."""
    sessions = _view(ds, "v_sessions", _stream(ds, "orders")).where("id % 13 <> 0")
    artifacts = _view(ds, "v_artifacts", _stream(ds, "lineitem")).select("session_id", "line_no", "created_at")
    lost = streams.orphans(artifacts, sessions, "session_id", "id", "created_at", "created_at", "60 days", "1 day", "line_no")
    return streams.run_append(lost, "stream-orphans").where("created_at < timestamp_ntz'1998-01-01'")
