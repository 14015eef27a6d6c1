"""Compliance rules: the script form of all ten, and the data forms that measure tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia import vocab
from custodia.functions import masking
from custodia.functions import script as S
from custodia.functions import text as T
from custodia.operators import corpus, pii
from custodia.sources.tables import small_table


def rule_table(spark: SparkSession) -> DataFrame:
    return small_table(
        spark,
        [tuple(r) for r in vocab.RULES],
        "rule_id string, name string, profile string, severity string, auto_fix boolean, description string",
    )


def profile_table(spark: SparkSession) -> DataFrame:
    rows = [
        (key, p["name"], p["jurisdiction"], list(p["rules"]), list(p["key_requirements"]))
        for key, p in vocab.PROFILES.items()
    ]
    return small_table(
        spark,
        rows,
        "profile string, name string, jurisdiction string, rules array<string>, key_requirements array<string>",
    )


@dataclass(frozen=True)
class Facts:
    """What the rules look at, as columns of the row under check."""

    code: Column
    lower: Column
    pii_columns: Column
    phi_columns: Column
    missing_audit: Column


@dataclass(frozen=True)
class ScriptRule:
    """A rule as a Column factory; ``named`` lists the offenders in the detail."""

    rule: vocab.Rule
    status: str
    violated: Callable[[Facts], Column]
    passed_text: str
    violated_text: str
    remediation: str
    named: Callable[[Facts], Column] | None = None


def _unmasked(f: Facts) -> Column:
    return ~S.contains(f.code, "mask_pii")


def _validated(f: Facts) -> Column:
    return S.contains_any(f.code, ("StructType", "assert", "expect")) | S.contains_any(
        f.lower, ("schema", "validate")
    )


def _idempotent(f: Facts) -> Column:
    return S.contains(F.upper(f.code), "MERGE") | S.contains_any(f.lower, ("idempotent", "overwrite"))


# rule id -> (status when violated, is violated, offenders)
_PREDICATES: dict[str, tuple[str, Callable[[Facts], Column], Callable[[Facts], Column] | None]] = {
    "GDPR-001": ("fail", lambda f: (F.size(f.pii_columns) > 0) & _unmasked(f), lambda f: f.pii_columns),
    "GDPR-002": ("warn", lambda f: ~S.contains(f.lower, "retention"), None),
    "GDPR-003": ("warn", lambda f: S.contains_any(f.lower, vocab.CROSS_BORDER_WORDS), None),
    "HIPAA-001": ("fail", lambda f: (F.size(f.phi_columns) > 0) & _unmasked(f), lambda f: f.phi_columns),
    "HIPAA-002": ("warn", lambda f: ~S.contains(f.lower, "encrypt"), None),
    "SOX-001": ("fail", lambda f: F.size(f.missing_audit) > 0, lambda f: f.missing_audit),
    "SOX-002": ("warn", lambda f: ~_idempotent(f), None),
    "ETL-001": ("warn", lambda f: ~_validated(f), None),
    "ETL-002": (
        "warn",
        lambda f: S.contains_any(f.code, vocab.NOW_CALL) & ~S.contains(f.code, "run_id"),
        None,
    ),
    "ETL-003": ("warn", lambda f: S.select_star(f.code), None),
}

SCRIPT_RULES = tuple(
    ScriptRule(r, status, violated, *vocab.RULE_TEXTS[r.rule_id], named)
    for r in vocab.RULES
    for status, violated, named in [_PREDICATES[r.rule_id]]
)


NO_SCRIPT = "There is no script to check"


def with_checks(
    df: DataFrame,
    code: str = "code",
    pii_columns: Column | None = None,
    profiles: Column | None = None,
    rules: Sequence[ScriptRule] = SCRIPT_RULES,
) -> DataFrame:
    """Add ``checks``: one struct per rule, in rule order, all from one pass over the code.

    ``profiles`` is an array column of active profiles; rules for ``all`` always apply.
    Each rule is decided once, into a boolean column the structs then read. A null script fails every rule: there is
    nothing that could keep it.
    """
    c = F.col(code)
    columns = pii.pii_columns(c) if pii_columns is None else pii_columns
    staged = df.withColumns(
        {
            "_lower": F.lower(c),
            "_pii_columns": columns,
            "_missing_audit": corpus.missing_audit_columns(c),
        }
    ).withColumn(
        "_phi_columns",
        F.when(
            F.size("_pii_columns") > 0,
            F.sort_array(
                F.array_intersect(
                    F.transform("_pii_columns", lambda n: F.lower(n)), S.array_of(vocab.PHI_NAMES)
                )
            ),
        ).otherwise(F.col("_pii_columns")),
    )
    facts = Facts(c, *[F.col(n) for n in ("_lower", "_pii_columns", "_phi_columns", "_missing_audit")])
    hits = {r.rule.rule_id: f"_hit_{r.rule.rule_id}" for r in rules}
    decided = staged.withColumns({hits[r.rule.rule_id]: r.violated(facts) for r in rules})

    def check(r: ScriptRule) -> Column:
        hit = F.col(hits[r.rule.rule_id])
        detail = F.lit(r.violated_text)
        if r.named is not None:
            detail = F.concat(detail, F.array_join(r.named(facts), ", "))
        return F.struct(
            F.lit(r.rule.rule_id).alias("rule_id"),
            F.lit(r.rule.name).alias("name"),
            F.lit(r.rule.profile).alias("profile"),
            F.when(c.isNull(), "fail").when(hit, r.status).otherwise("pass").alias("status"),
            F.when(c.isNull(), NO_SCRIPT).when(hit, detail).otherwise(r.passed_text).alias("detail"),
            F.when(hit, r.remediation).otherwise("").alias("remediation"),
            F.lit(r.rule.auto_fix).alias("auto_fix"),
            F.lit(r.rule.severity).alias("severity"),
        )

    checks = F.array(*[check(r) for r in rules])
    if profiles is not None:
        checks = F.filter(
            checks, lambda x: (x["profile"] == "all") | F.array_contains(profiles, x["profile"])
        )
    return decided.withColumn("checks", checks).drop(
        "_lower", "_missing_audit", "_phi_columns", *hits.values()
    )


def script_checks(df: DataFrame, subject: str, code: str = "code") -> DataFrame:
    """One row per subject and rule."""
    return with_checks(df.select(subject, code), code).select(subject, S.one_row_each(F.col("checks")))


def overall(checks: Column) -> Column:
    def any_with(status: str) -> Column:
        return F.exists(checks, lambda x: x["status"] == status)

    return F.when(any_with("fail"), "fail").when(any_with("warn"), "warn").otherwise("pass")


def matrix(checks: DataFrame) -> DataFrame:
    """Counts by rule and status. Ten groups: counted on the map side, then ten rows shuffle."""
    return checks.groupBy("rule_id").agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pass", "warn", "fail")]
    )


def compliance_report(
    df: DataFrame,
    subject: str,
    code: str = "code",
    profiles: Column | None = None,
    target: Column | None = None,
    profile_names: Sequence[str] = (),
    generated_at: str | None = None,
) -> DataFrame:
    """The full report of every subject as one row: checks, fold, flags, warnings, PII summary.

    ``profiles`` must be a column expression over the subject's row (an array of names); with it only the
    rules of these profiles are checked. ``profile_names`` are reported where there is no such column.
    ``target`` and ``generated_at`` are reported as given, null otherwise: no clock is read.
    """
    c = F.col(code)
    patterns = vocab.BASE_PATTERNS
    checked = with_checks(T.with_match_flags(df, code, patterns), code, profiles=profiles)
    flags = [F.col(T.match_column(p.kind, code)) for p in patterns]
    count = sum((f.cast("int") for f in flags), F.size("_pii_columns"))
    _, risk = pii.flagged_risk(code, patterns, "_pii_columns")
    status = overall(F.col("checks"))
    return checked.withColumn("overall_status", status).select(
        subject,
        F.lit("1.0").alias("schema_version"),
        (F.lit(None).cast("string") if target is None else target).alias("target"),
        (F.array(*[F.lit(n) for n in profile_names]).cast("array<string>") if profiles is None else profiles).alias(
            "compliance_profiles"
        ),
        F.lit(generated_at).cast("timestamp_ntz").alias("generated_at"),
        "overall_status",
        "checks",
        F.struct(
            count.alias("entities_detected"),
            risk.alias("risk_level"),
            S.contains(c, "mask_pii").alias("masked_in_output"),
        ).alias("pii_summary"),
        S.present(c, vocab.AUDIT_COLUMNS).alias("audit_columns_added"),
        S.contains_any(c, vocab.IDEMPOTENCY_FLAG).alias("idempotency_guard"),
        S.contains_any(c, vocab.SCHEMA_FLAG).alias("schema_validation"),
        S.contains(c, "_etl_source").alias("lineage_metadata"),
        F.when(F.col("overall_status") == "fail", vocab.WARNING_TEXTS["fail"])
        .when(F.col("overall_status") == "warn", vocab.WARNING_TEXTS["warn"])
        .alias("warning"),
    )


def worklist(checks: DataFrame) -> DataFrame:
    """Violations that can be fixed without a human."""
    return checks.where((F.col("status") != "pass") & F.col("auto_fix"))


def rules_by_profile(spark: SparkSession, df: DataFrame, profiles: str) -> DataFrame:
    """Active rules of every distinct profile string, and how many rows ask for them.

    Rows are counted per string first; only the distinct strings meet the rules.
    """
    asked = df.groupBy(profiles).agg(F.count(F.lit(1)).alias("n"))
    active = asked.select(
        profiles,
        "n",
        F.explode_outer(F.array_union(T.profile_list(F.col(profiles)), S.array_of(["all"]))).alias("profile"),
    )
    return active.join(rule_table(spark).select("rule_id", "profile", "severity"), "profile")


# --- data forms ----------------------------------------------------------------------


def residual_pii(df: DataFrame, label: str, text: str, redacted: str) -> DataFrame:
    """GDPR-001 on data: matches before masking, matches left after it; none may be left."""
    patterns = vocab.PATTERNS
    # What masking left as it was has the same matches after it as before; only the rest is searched again.
    same = F.col(text) == F.col(redacted)
    both = df.select(text, same.alias("_same"), F.when(~same, F.col(redacted)).alias(redacted))
    counted = T.with_match_counts(both, [text, redacted], patterns)

    def total(column: str) -> Column:
        return sum((F.col(T.match_column(p.kind, column)) for p in patterns), F.lit(0))

    out = counted.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(total(text)), F.lit(0)).cast("bigint").alias("matches_before"),
        F.coalesce(F.sum(F.when(F.col("_same"), total(text)).otherwise(total(redacted))), F.lit(0))
        .cast("bigint")
        .alias("matches_after"),
    )
    return out.select(
        F.lit(label).alias("table_name"),
        "*",
        F.when(F.col("matches_after") > 0, "fail").otherwise("pass").alias("status"),
    )


def unmasked_values(
    df: DataFrame, table: str, columns: Sequence[str], rule: str, plan: Mapping[str, str] | None = None
) -> DataFrame:
    """HIPAA-001 on data: how many filled values of the given columns are not masked.

    A mask plan names the strategy of a column; its values must look like that strategy's results.
    """
    plan = plan or {}
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(~masking.looks_masked(F.col(c).cast("string"), plan.get(c))).alias(f"_u_{c}") for c in columns],
    )
    rows = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"_u_{c}").alias("n_unmasked")) for c in columns]
    )
    return counts.select(
        F.lit(rule).alias("rule_id"), F.lit(table).alias("table_name"), F.col("_n").alias("n_rows"), S.one_row_each(rows)
    ).withColumn("status", F.when(F.col("n_unmasked") > 0, "fail").otherwise("pass"))


def expired(df: DataFrame, ts: str, as_of: str, days: int = vocab.RETENTION_DAYS) -> DataFrame:
    """GDPR-002 on data: rows older than the retention period at an explicit date.

    The comparison is on the bare column, so it reaches the scan as a pushed filter.
    """
    limit = F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp_ntz")
    return df.where(F.col(ts) < limit).withColumn("age_days", T.age_days(F.col(ts), as_of))


def policy_coverage(datasets: DataFrame, policies: DataFrame, key: str) -> DataFrame:
    """HIPAA-002 on data: datasets without a confirmed encryption policy get a warning."""
    return datasets.join(policies, key, "left").withColumn(
        "status", F.when(F.coalesce("encrypted", F.lit(False)), "pass").otherwise("warn")
    )


def audit_columns_filled(df: DataFrame) -> DataFrame:
    """SOX-001 on data: every audit column exists and is filled in every row."""
    present = [c for c in vocab.AUDIT_COLUMNS if c in df.columns]
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in present]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(c in present).alias("present"),
                (F.col(f"_null_{c}") if c in present else F.col("_n")).alias("n_null"),
            )
            for c in vocab.AUDIT_COLUMNS
        ]
    )
    return counts.select(F.col("_n").alias("n_rows"), S.one_row_each(rows)).withColumn(
        "status", F.when(~F.col("present") | (F.col("n_null") > 0), "fail").otherwise("pass")
    )


def one_timestamp_per_run(df: DataFrame, run: str, ts: str) -> DataFrame:
    """ETL-002 on data: all rows of a run carry the same timestamp. Min and max decide it."""
    return (
        df.groupBy(run)
        .agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_rows"))
        .withColumn("status", F.when(F.col("first_ts") == F.col("last_ts"), "pass").otherwise("warn"))
    )
