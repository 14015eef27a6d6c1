"""Queries over the compliance rules: script forms, reports, data forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia import vocab
from custodia.functions import script as S
from custodia.functions import text as T
from custodia.operators import corpus, quality, rules
from custodia.plans.pii_queries import BASE_CRITICAL, BASE_KINDS, pii_columns_sql
from custodia.plans.registry import actual_type_sql, any_of, in_list, query, quoted
from custodia.session import fresh_path
from custodia.sources import writes
from custodia.sources.tables import SCHEMAS, Dataset, small_table
from custodia.sources.views import with_views


def any_sql(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(w)})" for w in words) + ")"


def _missing_sql(code: str) -> str:
    return f"list_filter(['_etl_run_id', '_etl_source', '_etl_timestamp'], lambda x: NOT contains({code}, x))"


def checks_sql(source: str = "v_scripts") -> str:
    """(script_id, rule_id, name, profile, status, detail, remediation, auto_fix, severity)."""
    phi = f"list_sort(list_filter(p, lambda x: x IN {in_list(vocab.PHI_NAMES)}))"
    violated = {
        "GDPR-001": ("len(p) > 0 AND NOT contains(code, 'mask_pii')", "fail", "array_to_string(p, ', ')"),
        "GDPR-002": ("NOT contains(lower(code), 'retention')", "warn", "''"),
        "GDPR-003": (any_sql("lower(code)", vocab.CROSS_BORDER_WORDS), "warn", "''"),
        "HIPAA-001": (f"len({phi}) > 0 AND NOT contains(code, 'mask_pii')", "fail", f"array_to_string({phi}, ', ')"),
        "HIPAA-002": ("NOT contains(lower(code), 'encrypt')", "warn", "''"),
        "SOX-001": (f"len({_missing_sql('code')}) > 0", "fail", f"array_to_string({_missing_sql('code')}, ', ')"),
        "SOX-002": (
            "NOT (contains(upper(code), 'MERGE') OR contains(code, 'mergeInto') OR contains(lower(code), 'idempotent') OR contains(lower(code), 'overwrite'))",
            "warn",
            "''",
        ),
        "ETL-001": (
            "NOT (contains(code, 'StructType') OR contains(lower(code), 'schema') OR contains(code, 'assert') OR contains(code, 'expect') OR contains(lower(code), 'validate'))",
            "warn",
            "''",
        ),
        "ETL-002": (f"regexp_matches(code, {any_of(vocab.NOW_CALL)}) AND NOT contains(code, 'run_id')", "warn", "''"),
        "ETL-003": (f"regexp_matches(code, {quoted(vocab.SELECT_STAR)})", "warn", "''"),
    }
    parts = []
    for r in vocab.RULES:
        condition, status, named = violated[r.rule_id]
        passed_text, violated_text, remediation = (quoted(t) for t in vocab.RULE_TEXTS[r.rule_id])
        parts.append(
            f"SELECT script_id, '{r.rule_id}' AS rule_id, '{r.name}' AS name, '{r.profile}' AS profile, "
            f"CASE WHEN {condition} THEN '{status}' ELSE 'pass' END AS status, "
            f"CASE WHEN {condition} THEN {violated_text} || {named} ELSE {passed_text} END AS detail, "
            f"CASE WHEN {condition} THEN {remediation} ELSE '' END AS remediation, "
            f"{str(r.auto_fix).lower()} AS auto_fix, '{r.severity}' AS severity FROM scanned"
        )
    return (
        f"WITH scanned AS (SELECT script_id, code, {pii_columns_sql('code')} AS p FROM {source})\n"
        + " UNION ALL ".join(parts)
    )


OVERALL = (
    "CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'pass' END"
)


@query(with_views(checks_sql(), "v_scripts"))
def script_rule_checks(ds: Dataset) -> DataFrame:
    return rules.script_checks(ds.view("v_scripts"), "script_id")


@query(
    with_views(
        f"WITH checks AS ({checks_sql()}) SELECT script_id, {OVERALL} AS overall_status FROM checks GROUP BY script_id",
        "v_scripts",
    )
)
def overall_status(ds: Dataset) -> DataFrame:
    checked = rules.with_checks(ds.view("v_scripts"))
    return checked.select("script_id", rules.overall(F.col("checks")).alias("overall_status"))


@query(
    with_views(
        f"""
WITH checks AS ({checks_sql()})
SELECT rule_id, count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'warn') AS n_warn,
  count(*) FILTER (WHERE status = 'fail') AS n_fail
FROM checks GROUP BY rule_id
""",
        "v_scripts",
    )
)
def compliance_matrix(ds: Dataset) -> DataFrame:
    return rules.matrix(rules.script_checks(ds.view("v_scripts"), "script_id"))


@query(
    with_views(
        f"""
WITH checks AS ({checks_sql()})
SELECT script_id, rule_id, status, remediation FROM checks WHERE status <> 'pass' AND auto_fix
""",
        "v_scripts",
    )
)
def autofix_worklist(ds: Dataset) -> DataFrame:
    todo = rules.worklist(rules.script_checks(ds.view("v_scripts"), "script_id"))
    return todo.select("script_id", "rule_id", "status", "remediation")


@query(
    with_views(
        f"SELECT script_id, array_to_string({_missing_sql('code')}, ',') AS missing FROM v_scripts "
        f"WHERE len({_missing_sql('code')}) > 0",
        "v_scripts",
    )
)
def missing_audit_columns(ds: Dataset) -> DataFrame:
    found = ds.view("v_scripts").select(
        "script_id", S.once(missing=corpus.missing_audit_columns(F.col("code")))
    )
    return found.where(F.size("missing") > 0).withColumn("missing", S.joined(F.col("missing")))


GENERATED = "2024-05-01 12:00:00"
TARGET_SQL = "CASE WHEN f.script_id % 2 = 0 THEN 'delta_lake' ELSE 'snowflake' END"


def full_report(scripts: DataFrame) -> DataFrame:
    """Reports with the run's target, its profiles and time, over all rules."""
    target = F.when(F.col("script_id") % 2 == 0, "delta_lake").otherwise("snowflake")
    return rules.compliance_report(
        scripts, "script_id", target=target, profile_names=["gdpr", "sox"], generated_at=GENERATED
    )


def report_sql(source: str = "v_scripts") -> str:
    kinds = {k: f"regexp_matches(code, {quoted(vocab.PATTERN_BY_KIND[k].regex)})" for k in BASE_KINDS}
    count = " + ".join(f"CAST({m} AS INTEGER)" for m in kinds.values())
    score = "greatest(" + ", ".join(
        f"CASE WHEN {m} THEN {vocab.PATTERN_BY_KIND[k].score} ELSE 0 END" for k, m in kinds.items()
    ) + ", CASE WHEN list_has_any(p, ['mrn', 'passport', 'ssn']) THEN 4 WHEN len(p) > 0 THEN 3 ELSE 0 END)"
    critical = " OR ".join(kinds[k] for k in BASE_CRITICAL)
    return f"""
WITH checks AS ({checks_sql(source)}),
folded AS (SELECT script_id, {OVERALL} AS overall_status,
    string_agg(rule_id || ':' || status, ',' ORDER BY rule_id) AS checks FROM checks GROUP BY script_id),
found AS (SELECT script_id, code, {pii_columns_sql('code')} AS p FROM {source})
SELECT f.script_id, {TARGET_SQL} AS target, 'gdpr,sox' AS compliance_profiles, TIMESTAMP '{GENERATED}' AS generated_at,
  overall_status, checks, CAST({count} + len(p) AS INTEGER) AS entities_detected,
  CASE WHEN {critical} OR {score} >= 4 THEN 'critical' WHEN {score} = 3 THEN 'high' WHEN {score} = 2 THEN 'medium' ELSE 'low' END AS risk_level,
  contains(code, 'mask_pii') AS masked_in_output,
  array_to_string(list_filter(['_etl_run_id', '_etl_source', '_etl_timestamp'], lambda x: contains(code, x)), ',') AS audit_columns_added,
  regexp_matches(code, {any_of(vocab.IDEMPOTENCY_FLAG)}) AS idempotency_guard,
  regexp_matches(code, {any_of(vocab.SCHEMA_FLAG)}) AS schema_validation,
  contains(code, '_etl_source') AS lineage_metadata,
  CASE overall_status WHEN 'fail' THEN {quoted(vocab.WARNING_TEXTS['fail'])} WHEN 'warn' THEN {quoted(vocab.WARNING_TEXTS['warn'])} END AS warning
FROM found f JOIN folded USING (script_id)
"""


def _flat(report: DataFrame) -> DataFrame:
    """The report with its nested parts as plain columns; checks in rule-id order."""
    checks = F.array_sort(F.transform("checks", lambda x: F.concat(x["rule_id"], F.lit(":"), x["status"])))
    return report.select(
        "script_id",
        "target",
        S.joined(F.col("compliance_profiles")).alias("compliance_profiles"),
        "generated_at",
        "overall_status",
        S.joined(checks).alias("checks"),
        "pii_summary.entities_detected",
        "pii_summary.risk_level",
        "pii_summary.masked_in_output",
        S.joined(F.col("audit_columns_added")).alias("audit_columns_added"),
        "idempotency_guard",
        "schema_validation",
        "lineage_metadata",
        "warning",
    )


@query(with_views(report_sql(), "v_scripts"))
def compliance_report(ds: Dataset) -> DataFrame:
    return _flat(full_report(ds.view("v_scripts")))


@query(with_views(f"SELECT *, overall_status AS verdict FROM ({report_sql()})", "v_scripts"))
def report_json(ds: Dataset) -> DataFrame:
    """Two types in two calls, the compliance reports first; both are read back."""
    report = full_report(ds.view("v_scripts"))
    path = fresh_path(ds.spark, "report-json")
    columns = [F.col(c) for c in report.columns]
    writes.write_reports(report, path, F.struct(*columns), F.lit("compliance"))
    writes.write_reports(report, path, F.struct("script_id", "overall_status"), F.lit("verdict"))
    back = writes.read_reports(ds.spark, path, report.schema.simpleString())
    full = _flat(back.where(F.col("artifact_type") == "compliance").select("report.*"))
    short = back.where(F.col("artifact_type") == "verdict").select("report.script_id", F.col("report.overall_status").alias("verdict"))
    return full.join(short, "script_id")


def _active_sql(condition: str) -> str:
    values = ", ".join(f"('{r.rule_id}', '{r.profile}', '{r.severity}')" for r in vocab.RULES)
    return (
        "SELECT profiles, rule_id, r.profile, severity, count(*) AS n FROM v_sessions, "
        f"(VALUES {values}) AS r(rule_id, profile, severity) WHERE {condition} GROUP BY ALL"
    )


@query(
    with_views(
        _active_sql(
            "r.profile = 'all' OR list_contains(list_transform(string_split(profiles, ','), lambda s: lower(trim(s))), r.profile)"
        ),
        "v_sessions",
    )
)
def rules_by_profile(ds: Dataset) -> DataFrame:
    return rules.rules_by_profile(ds.spark, ds.view("v_sessions"), "profiles").select(
        "profiles", "rule_id", "profile", "severity", "n"
    )


AS_OF = "2000-06-30"


@query(
    with_views(
        f"""
SELECT id, created_at, CAST(datediff('day', CAST(created_at AS DATE), DATE '{AS_OF}') AS INTEGER) AS age_days
FROM v_sessions WHERE created_at < DATE '{AS_OF}' - INTERVAL 90 DAY
""",
        "v_sessions",
    )
)
def retention_purge(ds: Dataset) -> DataFrame:
    return rules.expired(ds.view("v_sessions"), "created_at", AS_OF).select("id", "created_at", "age_days")


POLICIES = [(f"src{i}", i % 4 != 0) for i in range(15)]


@query(
    f"""
SELECT source, n_rows, n_chars, encrypted, CASE WHEN encrypted THEN 'pass' ELSE 'warn' END AS status
FROM (SELECT source, count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY source)
LEFT JOIN (VALUES {", ".join(f"('{s}', {str(e).lower()})" for s, e in POLICIES)}) AS p(source, encrypted) USING (source)
"""
)
def rule_policy_coverage(ds: Dataset) -> DataFrame:
    datasets = ds.table("documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_chars")
    )
    policies = small_table(ds.spark, POLICIES, "source string, encrypted boolean")
    return rules.policy_coverage(datasets, policies, "source")


RUN_TS = "2024-05-01 00:00:00"


def _audited(ds: Dataset) -> DataFrame:
    """Orders with audit columns, every 97th row without a source, two runs, one with two times."""
    orders = quality.with_audit(ds.table("orders"), "run-1", RUN_TS, "orders")
    key = F.col("o_orderkey")
    return orders.withColumns(
        {
            "_etl_source": F.when(key % 97 != 0, F.col("_etl_source")),
            "_etl_run_id": F.when(key % 2 == 0, "run-2").otherwise(F.col("_etl_run_id")),
            "_etl_timestamp": F.when(
                key % 10 == 0, F.lit("2024-05-02 00:00:00").cast("timestamp_ntz")
            ).otherwise(F.col("_etl_timestamp")),
        }
    )


@query(
    """
SELECT column_name, present, n_rows, n_null, CASE WHEN n_null > 0 THEN 'fail' ELSE 'pass' END AS status
FROM (SELECT count(*) AS n_rows, count(*) FILTER (WHERE o_orderkey % 97 = 0) AS planted FROM orders),
LATERAL (SELECT '_etl_run_id' AS column_name, true AS present, CAST(0 AS BIGINT) AS n_null
  UNION ALL SELECT '_etl_source', true, planted UNION ALL SELECT '_etl_timestamp', true, CAST(0 AS BIGINT))
"""
)
def rule_audit_columns(ds: Dataset) -> DataFrame:
    return rules.audit_columns_filled(_audited(ds))


@query(
    f"""
SELECT run_id AS _etl_run_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows,
  CASE WHEN min(ts) = max(ts) THEN 'pass' ELSE 'warn' END AS status
FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'run-2' ELSE 'run-1' END AS run_id,
        CASE WHEN o_orderkey % 10 = 0 THEN TIMESTAMP '2024-05-02 00:00:00' ELSE TIMESTAMP '{RUN_TS}' END AS ts FROM orders)
GROUP BY run_id
"""
)
def rule_deterministic_ts(ds: Dataset) -> DataFrame:
    return rules.one_timestamp_per_run(_audited(ds), "_etl_run_id", "_etl_timestamp")


@query(
    """
SELECT 'lineitem' AS table_name, count(*) AS duplicate_keys, CAST(sum(n) AS BIGINT) AS rows_in_duplicates,
  CASE WHEN count(*) > 0 THEN 'warn' ELSE 'pass' END AS key_status, true AS same_after_rerun
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
"""
)
def rule_idempotency(ds: Dataset) -> DataFrame:
    """Duplicate business keys, and whether the written table has the fingerprint taken while it was written."""
    lines = ds.table("lineitem")
    path = fresh_path(ds.spark, "rerun")
    watched, seen = quality.fingerprinted(lines, "rerun")
    writes.write_idempotent(watched, path, ["l_returnflag"])
    again = ds.spark.read.schema(lines.schema).parquet(path).select(*lines.columns)
    prints = quality.fingerprint(again, "written", digest=quality.quick_digest)
    same = (F.first("n_rows") == seen.get["n_rows"]) & (F.first("fingerprint") == seen.get["fingerprint"])
    keys = quality.duplicate_keys(lines, ["l_orderkey", "l_linenumber"])
    facts = prints.agg(same.alias("same")).unionByName(
        keys.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows")), allowMissingColumns=True
    )
    one = facts.agg(*[F.max(c).alias(c) for c in ("same", "groups", "rows")])
    return one.select(
        F.lit("lineitem").alias("table_name"),
        F.col("groups").alias("duplicate_keys"),
        F.col("rows").alias("rows_in_duplicates"),
        F.when(F.col("groups") > 0, "warn").otherwise("pass").alias("key_status"),
        F.col("same").alias("same_after_rerun"),
    )


CONTRACT = [
    ("o_orderkey", "bigint", False),
    ("o_custkey", "string", False),
    ("o_orderstatus", "string", False),
    ("o_discount", "double", True),
    ("o_orderdate", "timestamp_ntz", False),
]


def _conformity_sql() -> str:
    """Every column of every table against the contract, with the types the files have."""
    parts = []
    for table, schema in CONTRACTS.items():
        columns = [c.strip().split(" ", 1)[0] for c in SCHEMAS[table].split(",")]
        wanted = {c: (t, nullable) for c, t, nullable in schema}
        for c in dict.fromkeys([*wanted, *columns]):
            expected, nullable = wanted.get(c, (None, True))
            actual = actual_type_sql(c) if c in columns else "CAST(NULL AS STRING)"
            nulls = f"count(*) FILTER (WHERE {c} IS NULL)" if c in columns and not nullable else "CAST(0 AS BIGINT)"
            literal = f"'{expected}'" if expected else "CAST(NULL AS STRING)"
            parts.append(
                f"SELECT '{table}' AS table_name, count(*) AS n_rows, '{c}' AS column_name, {literal} AS expected_type, "
                f"{actual} AS actual_type, {nulls} AS n_null FROM {table}"
            )
    return (
        "SELECT *, CASE WHEN actual_type IS NULL THEN 'missing' WHEN expected_type IS NULL THEN 'extra' "
        "WHEN actual_type <> expected_type THEN 'wrong_type' WHEN n_null > 0 THEN 'nulls' ELSE 'ok' END AS verdict FROM ("
        + " UNION ALL ".join(parts)
        + ")"
    )


# Every table must be as declared; the orders' contract asks for what their files do not have.
CONTRACTS = {
    table: [(*part.strip().split(" ", 1), False) for part in schema.split(",")] for table, schema in SCHEMAS.items()
} | {"orders": CONTRACT}


@query(_conformity_sql())
def schema_conformity(ds: Dataset) -> DataFrame:
    """All tables, by the schemas of their files."""
    parts = [quality.conformity(ds.as_written(table), table, contract) for table, contract in CONTRACTS.items()]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT o_orderkey, o_custkey, o_totalprice, 'o_orderstatus,o_orderdate,o_orderpriority' AS dropped FROM orders")
def projection_contract(ds: Dataset) -> DataFrame:
    kept = quality.project(ds.table("orders"), ["o_orderkey", "o_custkey", "o_totalprice"])
    return kept.df.withColumn("dropped", F.lit(",".join(kept.extra)))


@query(
    with_views(
        """
SELECT id, sha256(input_text || '|' || target || '|1|' || strftime(created_at, '%Y-%m-%d')) AS run_id FROM v_sessions
""",
        "v_sessions",
    )
)
def run_id(ds: Dataset) -> DataFrame:
    return ds.view("v_sessions").select(
        "id",
        T.run_id(F.col("input_text"), F.col("target"), F.lit(1), F.to_date("created_at")).alias("run_id"),
    )
