"""Queries over the run store: sessions, artifacts, audit events, reports, messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia import vocab
from custodia.operators import erasure, pii, store
from custodia.plans.pii_queries import BASE_KINDS, findings_sql
from custodia.plans.registry import query, quoted, str_list
from custodia.sources.tables import Dataset
from custodia.sources.views import with_views

DAILY_CAP = 5_000
MONTHLY_BUDGET = 100_000


@query(
    with_views(
        """
SELECT s.id AS session_id, target, status, artifact_type, content
FROM v_sessions s JOIN v_artifacts a ON s.id = a.session_id WHERE artifact_type = 'code'
""",
        "v_sessions",
        "v_artifacts",
    )
)
def artifacts_by_session(ds: Dataset) -> DataFrame:
    found = store.artifacts_of(ds.view("v_sessions"), ds.view("v_artifacts"), "code")
    return found.select("session_id", "target", "status", "artifact_type", "content")


REPORTS = f"""
SELECT id // 2 AS session_id, id AS report_id, string_agg(type, ',' ORDER BY list_position({str_list(BASE_KINDS)}, type)) AS entity_types,
  CASE max(CASE WHEN type IN ('SSN', 'CREDIT_CARD', 'PASSPORT') THEN 3 WHEN type = 'EMAIL' THEN 2 ELSE 1 END)
    WHEN 3 THEN 'critical' WHEN 2 THEN 'high' ELSE 'medium' END AS risk_level
FROM ({findings_sql("v_planted", "id", "text", BASE_KINDS)}) GROUP BY id
"""


@query(
    with_views(
        f"""
WITH reports AS ({REPORTS})
SELECT s.id, s.status, entity_types, risk_level
FROM v_sessions s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY report_id) AS r FROM reports) p
  ON s.id = p.session_id AND r = 1
""",
        "v_sessions",
        "v_planted",
    )
)
def report_by_session(ds: Dataset) -> DataFrame:
    """Reports exist for texts with findings only, two texts to a run."""
    reports = pii.report(ds.view("v_planted"), ["id"], "text").where("has_pii").select(
        F.floor(F.col("id") / 2).alias("session_id"), F.col("id").alias("report_id"), "entity_types", "risk_level"
    )
    sessions = ds.view("v_sessions").select("id", "status")
    return store.report_of(sessions, reports, "report_id")


@query(
    with_views(
        """
SELECT session_id, id, role, content, CAST(row_number() OVER (PARTITION BY session_id ORDER BY id) AS INTEGER) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS r FROM v_messages) WHERE r <= 6
""",
        "v_messages",
    )
)
def message_window(ds: Dataset) -> DataFrame:
    return store.message_window(ds.view("v_messages"))


@query(
    with_views(
        "SELECT session_id, arg_max(status, id) AS status, max(id) AS id FROM v_run_states GROUP BY session_id",
        "v_run_states",
    )
)
def latest_status(ds: Dataset) -> DataFrame:
    return store.latest(ds.view("v_run_states"), "session_id", "id", "status")


@query(
    with_views(
        f"""
WITH days AS (SELECT CAST(created_at AS DATE) AS day, CAST(sum(tokens_used) AS BIGINT) AS tokens FROM v_sessions GROUP BY 1),
running AS (SELECT strftime(day, '%Y-%m') AS month, day, tokens,
    CAST(sum(tokens) OVER (PARTITION BY strftime(day, '%Y-%m') ORDER BY day) AS BIGINT) AS used FROM days)
SELECT month, day, tokens, used, CAST(greatest({MONTHLY_BUDGET} - used, 0) AS BIGINT) AS remaining,
  least(used / {MONTHLY_BUDGET}, CAST(1.0 AS DOUBLE)) AS share, least(used / {MONTHLY_BUDGET}, CAST(1.0 AS DOUBLE)) >= 0.9 AS alert
FROM running
""",
        "v_sessions",
    )
)
def token_budget_running(ds: Dataset) -> DataFrame:
    return store.budget_running(ds.view("v_sessions"), MONTHLY_BUDGET)


@query(
    with_views(
        """
WITH pairs AS (SELECT status, lag(status) OVER (PARTITION BY session_id ORDER BY event_time, id) AS previous FROM v_run_states)
SELECT previous, status, count(*) AS n,
  (previous = 'pending' AND status = 'running') OR (previous = 'running' AND status IN ('success', 'failed')) AS legal
FROM pairs WHERE previous IS NOT NULL GROUP BY previous, status
""",
        "v_run_states",
    )
)
def status_transitions(ds: Dataset) -> DataFrame:
    pairs = store.transitions(ds.view("v_run_states"), "session_id", "event_time", "status", ties=["id"])
    return store.transition_counts(pairs, "status")


@query(
    with_views(
        """
WITH pairs AS (SELECT session_id, id, status, lag(status) OVER (PARTITION BY session_id ORDER BY event_time, id) AS previous FROM v_run_states)
SELECT * FROM pairs WHERE previous IS NOT NULL
  AND NOT ((previous = 'pending' AND status = 'running') OR (previous = 'running' AND status IN ('success', 'failed')))
""",
        "v_run_states",
    )
)
def illegal_transitions(ds: Dataset) -> DataFrame:
    pairs = store.transitions(ds.view("v_run_states"), "session_id", "event_time", "status", ties=["id"])
    illegal = pairs.where(F.col("previous").isNotNull() & ~store.is_legal("status"))
    return illegal.select("session_id", "id", "status", "previous")


@query(with_views("SELECT id, created_at, status FROM v_sessions ORDER BY created_at DESC, id DESC LIMIT 20", "v_sessions"))
def recent_sessions(ds: Dataset) -> DataFrame:
    return store.recent(ds.view("v_sessions").select("id", "created_at", "status"))


@query(
    with_views("SELECT session_id, id, event_type, severity FROM v_audit_log ORDER BY session_id, id", "v_audit_log")
)
def audit_trail(ds: Dataset) -> DataFrame:
    return store.trail(ds.view("v_audit_log").select("session_id", "id", "event_type", "severity"))


@query(
    with_views(
        """
SELECT session_id, event_type, last_seen, CAST(r AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY last_seen DESC, event_type) AS r
      FROM (SELECT session_id, event_type, max(id) AS last_seen FROM v_audit_log GROUP BY session_id, event_type))
WHERE r <= 20
""",
        "v_audit_log",
    )
)
def history_topk(ds: Dataset) -> DataFrame:
    return store.history(ds.view("v_audit_log"), "session_id", "event_type", "id")


DETECTIONS = " + ".join(
    f"CAST(regexp_matches(input_text, {quoted(vocab.PATTERN_BY_KIND[k].regex)}) AS INTEGER)" for k in BASE_KINDS
)


@query(
    with_views(
        f"""
SELECT target, count(*) AS runs, count(*) FILTER (WHERE status = 'success') AS successes,
  count(*) FILTER (WHERE status = 'failed') AS failures, CAST(sum(tokens_used) AS BIGINT) AS tokens,
  count(*) FILTER (WHERE tokens_used > token_budget) AS over_budget, CAST(sum({DETECTIONS}) AS BIGINT) AS pii_detections
FROM v_sessions GROUP BY target
""",
        "v_sessions",
    )
)
def run_metrics(ds: Dataset) -> DataFrame:
    return store.metrics(ds.view("v_sessions"), "target")


BOUNDS = (3600, 86400, 604800, 2592000)


@query(
    with_views(
        f"""
WITH spans AS (SELECT datediff('microsecond', min(event_time), max(event_time)) // 1000000 AS s FROM v_run_states GROUP BY session_id)
{" UNION ALL ".join(f"SELECT '{b}' AS le, count(*) FILTER (WHERE s <= {b}) AS runs FROM spans" for b in BOUNDS)}
UNION ALL SELECT '+Inf', count(*) FROM spans
""",
        "v_run_states",
    )
)
def run_durations(ds: Dataset) -> DataFrame:
    return store.duration_histogram(ds.view("v_run_states"), "session_id", "event_time", BOUNDS)


@query(
    with_views(
        f"""
SELECT CAST(created_at AS DATE) AS day, CAST(sum(tokens_used) AS BIGINT) AS tokens, count(*) AS runs, sum(tokens_used) > {DAILY_CAP} AS over_cap
FROM v_sessions GROUP BY 1
""",
        "v_sessions",
    )
)
def daily_token_cap(ds: Dataset) -> DataFrame:
    return store.token_cap(ds.view("v_sessions"), DAILY_CAP)


@query(with_views("SELECT event_type, severity, count(*) AS n FROM v_audit_log GROUP BY ALL", "v_audit_log"))
def audit_counts(ds: Dataset) -> DataFrame:
    return store.event_counts(ds.view("v_audit_log"))


@query(
    with_views(
        """
SELECT id, CAST(event_data->>'$.k' AS BIGINT) AS k, '{"k":' || (event_data->>'$.k') || ',"severity":"' || severity || '"}' AS encoded
FROM v_audit_log
""",
        "v_audit_log",
    )
)
def audit_event_json(ds: Dataset) -> DataFrame:
    decoded = F.from_json("event_data", "k bigint")
    return ds.view("v_audit_log").select(
        "id",
        decoded["k"].alias("k"),
        F.to_json(F.struct(decoded["k"].alias("k"), F.col("severity"))).alias("encoded"),
    )


PURGED = "status = 'failed' AND tokens_used % 3 = 0"


@query(
    with_views(
        f"""
WITH RECURSIVE reports AS ({REPORTS}),
finding AS (SELECT id AS report_id, type FROM ({findings_sql("v_planted", "id", "text", BASE_KINDS)})),
found AS (
  SELECT 'sessions' AS table_name, id AS n, CAST(id AS VARCHAR) AS row_key, 'delete' AS action, 0 AS depth FROM v_reruns WHERE {PURGED}
  UNION
  SELECT 'sessions', r.id, CAST(r.id AS VARCHAR), 'delete', depth + 1 FROM found JOIN v_reruns r ON table_name = 'sessions' AND r.rerun_of = n WHERE depth < 9
), runs AS (SELECT table_name, n, row_key, action, min(depth) AS depth FROM found GROUP BY ALL),
gone AS (
  SELECT table_name, row_key, action, depth FROM runs
  UNION ALL SELECT DISTINCT 'artifacts', length(CAST(session_id AS VARCHAR)) || ':' || session_id || '1:' || line_no, 'delete', depth + 1
    FROM runs JOIN v_artifacts a ON a.session_id = n
  UNION ALL SELECT 'messages', length(CAST(m.session_id AS VARCHAR)) || ':' || m.session_id || length(CAST(m.id AS VARCHAR)) || ':' || m.id, 'delete', depth + 1
    FROM runs JOIN v_messages m ON m.session_id = n
  UNION ALL SELECT 'reports', CAST(report_id AS VARCHAR), 'delete', depth + 1 FROM runs JOIN reports ON session_id = n
  UNION ALL SELECT 'findings', length(CAST(f.report_id AS VARCHAR)) || ':' || f.report_id || length(type) || ':' || type, 'delete', depth + 2
    FROM runs JOIN reports r ON r.session_id = n JOIN finding f ON f.report_id = r.report_id
  UNION ALL SELECT 'audit_log', CAST(l.id AS VARCHAR), 'retain', depth + 1 FROM runs JOIN v_audit_log l ON l.session_id = n
)
SELECT table_name, row_key, action, min(depth) AS depth FROM gone GROUP BY ALL
""".replace("WITH RECURSIVE ", "WITH "),
        "v_reruns",
        "v_artifacts",
        "v_messages",
        "v_audit_log",
        "v_planted",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def erasure_set(ds: Dataset) -> DataFrame:
    """Failed runs go, with the runs that repeat them, and with all that belongs to these; the audit log stays."""
    runs, planted = ds.view("v_reruns"), ds.view("v_planted")
    reports = pii.report(planted, ["id"], "text").where("has_pii").select(
        F.floor(F.col("id") / 2).alias("session_id"), F.col("id").alias("report_id")
    )
    kinds = [p for p in vocab.BASE_PATTERNS if p.kind in BASE_KINDS]
    findings = pii.scan_text(planted, ["id"], "text", kinds).select(F.col("id").alias("report_id"), "type")
    tables = {
        "sessions": erasure.Table(runs, ("id",)),
        "artifacts": erasure.Table(ds.view("v_artifacts"), ("session_id", "line_no")),
        "messages": erasure.Table(ds.view("v_messages"), ("session_id", "id")),
        "reports": erasure.Table(reports, ("report_id",)),
        "findings": erasure.Table(findings, ("report_id", "type")),
        "audit_log": erasure.Table(ds.view("v_audit_log"), ("id",)),
    }
    keys = [
        erasure.ForeignKey("sessions", "rerun_of", "sessions", "id"),
        *[erasure.ForeignKey(child, "session_id", "sessions", "id") for child in ("artifacts", "messages", "reports")],
        erasure.ForeignKey("findings", "report_id", "reports", "report_id"),
        erasure.ForeignKey("audit_log", "session_id", "sessions", "id", erasure.RETAIN),
    ]
    return erasure.erasure_set(tables, keys, {"sessions": runs.where(PURGED)})
