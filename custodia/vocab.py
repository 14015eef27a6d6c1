"""Vocabularies shared by the operators.

Everything here is a fixed value: results only agree between installations when
these lists agree, so they are stated as plain text and in natural order.
"""

from __future__ import annotations

from typing import NamedTuple


class Pattern(NamedTuple):
    """A kind of personal data.

    ``digits`` and ``holds`` are cheap conditions without which the expression cannot
    match (two digits close together; literal texts); leave them out for patterns of
    your own if in doubt.
    """

    kind: str
    score: int
    regex: str
    critical: bool = False
    digits: bool = False
    holds: tuple[str, ...] = ()


class Rule(NamedTuple):
    rule_id: str
    name: str
    profile: str
    severity: str
    auto_fix: bool
    description: str


# --- fixed values: personal-data patterns -----------------------------------------
# Only non-capturing groups; always extract group 0.
PATTERNS = (
    Pattern("SSN", 4, r"\b\d{3}-\d{2}-\d{4}\b", critical=True, digits=True, holds=("-",)),
    Pattern("EMAIL", 3, r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", holds=("@",)),
    Pattern("PHONE", 2, r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", digits=True),
    Pattern(
        "CREDIT_CARD",
        4,
        r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b",
        critical=True,
        digits=True,
    ),
    Pattern("IP_ADDRESS", 2, r"\b(?:\d{1,3}\.){3}\d{1,3}\b", digits=True, holds=(".",)),
    Pattern("PASSPORT", 3, r"\b[A-Z]{1,2}[0-9]{6,9}\b", critical=True, digits=True),
    Pattern("IBAN", 4, r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7,}\b", critical=True, digits=True),
    Pattern("NPI", 3, r"\bNPI[\s:\-]?\d{10}\b", digits=True, holds=("NPI",)),
)
PATTERN_BY_KIND = {p.kind: p for p in PATTERNS}
# the smaller set of the scanner, and the full set
BASE_PATTERNS = tuple(p for p in PATTERNS if p.kind not in ("IBAN", "NPI"))

# E-mail addresses first: one that holds another kind's digits would not be an address any more after their
# replacement. Then longer and more specific kinds: the ten digits of an NPI also read as a phone number.
REDACTION_ORDER = ("EMAIL", "NPI", "IBAN", "CREDIT_CARD", "SSN", "PASSPORT", "PHONE", "IP_ADDRESS")
REDACTION_PATTERNS = tuple(PATTERN_BY_KIND[k] for k in REDACTION_ORDER)

# --- fixed values: column names that announce personal data -----------------------
COLUMN_NAMES = tuple(
    """
    account_number address bank_account birth_date birthdate card_number cell credit_card cvv
    date_of_birth dob drivers_license email email_address ethnicity first_name full_name fullname
    gender income ip ip_address ipv4 ipv6 last_name license mail medical_record mobile mrn name
    national_id national_id_number passport passport_number patient_id phone phone_number
    postal_code race routing_number salary sex social_security social_security_number ssn street
    street_address wage zip zip_code zipcode
    """.split()
)
EXTRA_COLUMN_NAMES = tuple(
    """
    age biometric ccn city compensation condition country diagnosis dl_number ein face_id
    fingerprint given_name iban npi patient_name religion sin state surname tax_id telephone tin
    user_id username
    """.split()
)
COLUMN_NAMES_EXTENDED = COLUMN_NAMES + EXTRA_COLUMN_NAMES
STRONG_COLUMN_NAMES = ("mrn", "passport", "ssn")  # score 4, every other name scores 3

PHI_NAMES = ("address", "date_of_birth", "dob", "email", "mrn", "name", "phone", "ssn")
PHI_NAMES_PROFILE = tuple(
    """
    account_number address biometric certificate_number condition date_of_birth device_id diagnosis
    dob email face_id ip_address license medical_record mrn name patient_id phone photo ssn url
    """.split()
)

# --- fixed values: labels -----------------------------------------------------------
RISK_LEVELS = ("low", "medium", "high", "critical")
ENTITY_LABELS = ("GPE", "LOC", "ORG", "PERSON")
AUDIT_COLUMNS = ("_etl_run_id", "_etl_source", "_etl_timestamp")
ENUMS = {
    "input_type": ("pyspark", "prefect"),
    "target": ("snowflake", "delta_lake"),
    "status": ("pending", "running", "success", "failed"),
    "artifact_type": ("code", "diff", "compliance", "validation", "zip"),
    "severity": ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"),
    "risk_level": RISK_LEVELS,
    "role": ("user", "assistant"),
}

# --- fixed values: script corpus ----------------------------------------------------
TRANSFORMS = tuple(
    """
    agg cache coalesce createOrReplaceTempView distinct drop dropDuplicates dropna fillna filter
    groupBy groupby insertInto join limit load orderBy persist read repartition save saveAsTable
    select sort union unionAll where withColumn withColumnRenamed write
    """.split()
)

# --- fixed values: admission gate ---------------------------------------------------
CHARS_PER_TOKEN = 4
MAX_TOKENS = 10_000
DANGEROUS = tuple(
    """
    __import__ builtins compile delattr eval exec getattr globals locals os.execv os.execvp
    os.popen os.system setattr subprocess.Popen subprocess.call subprocess.check_call
    subprocess.check_output subprocess.run vars
    """.split()
)
WRITE_OPEN = r"""open\s*\([^)]*["'][wa\+]["']"""
NETWORK = (
    "requests.", "urllib.", "http.client.", "socket.", "ftplib.", "smtplib.", "telnetlib.", "xmlrpc.",
)
TRAVERSAL = ("../", "..\\", "/etc/", "/proc/", "/sys/")
GATE_IMPORTS = tuple(
    """
    abc azure base64 boto3 calendar collections copy csv dataclasses datetime decimal delta enum
    functools google great_expectations gzip hashlib io itertools json logging math numpy operator
    os pandas pathlib prefect pyarrow pyspark re string struct sys time typing uuid zipfile
    """.split()
)
VALIDATOR_IMPORTS = tuple(
    """
    collections datetime decimal delta functools great_expectations hashlib itertools json logging
    math numpy os pandas prefect pyspark re typing uuid
    """.split()
)

# rule -> message of the rejection; {} takes what was found
GATE_MESSAGES = {
    "MISSING_CODE": "No code was submitted.",
    "SIZE_CHECK": "Input too large: ~{} tokens (limit: {}). Trim code and retry.",
    "ENCODING_CHECK": "Invalid encoding",
    "DANGEROUS_PATTERN": "Dangerous pattern detected: `{}`. Remove it before submitting.",
    "DANGEROUS_WRITE": "File write operations are not permitted in submitted code.",
    "NETWORK_CALL": "Direct network calls are not permitted in submitted code.",
    "IMPORT_WHITELIST": "Import `{}` is not in the allowed data-engineering import list.",
    "PATH_TRAVERSAL": (
        "Path traversal patterns detected (e.g., `../`, `/etc/`). "
        "Remove absolute or traversal paths."
    ),
}

# --- fixed values: name-based type inference, first rule that matches wins ---------
TYPE_RULES = (
    ("timestamp", ("date", "time", "ts", "at")),
    ("bigint", ("id", "num", "count", "qty")),
    ("double", ("amount", "price", "rate")),
    ("boolean", ("flag", "is_", "has_", "active")),
)
DEFAULT_SCHEMA = (("id", "bigint"), ("value", "string"), ("amount", "double"))
MAX_INFERRED_COLUMNS = 20

# --- fixed values: rules and profiles ----------------------------------------------
RULES = (
    Rule("GDPR-001", "PII Masking", "gdpr", "critical", True,
         "PII columns must be masked before output"),
    Rule("GDPR-002", "Data Retention Policy", "gdpr", "warning", False,
         "A data retention policy comment must be present"),
    Rule("GDPR-003", "Cross-Border Transfer", "gdpr", "warning", False,
         "Cross-border data transfers must be flagged"),
    Rule("HIPAA-001", "PHI Masking", "hipaa", "critical", True,
         "Protected Health Information fields must be masked"),
    Rule("HIPAA-002", "Encryption at Rest", "hipaa", "warning", False,
         "Encryption-at-rest must be referenced or confirmed"),
    Rule("SOX-001", "Audit Trail Columns", "sox", "critical", True,
         "Audit columns _etl_run_id, _etl_timestamp, _etl_source must be present"),
    Rule("SOX-002", "Idempotency Guard", "sox", "warning", True,
         "Write operations must be idempotent (MERGE/OVERWRITE)"),
    Rule("ETL-001", "Schema Validation", "all", "warning", True,
         "Schema validation must be present at ingestion"),
    Rule("ETL-002", "Deterministic Timestamps", "all", "warning", True,
         "Non-deterministic timestamps must use run_id seed"),
    Rule("ETL-003", "Explicit Column Selection", "all", "info", False,
         "SELECT * should be replaced with explicit columns"),
)
# rule id -> (text when passed, text when not, remediation)
RULE_TEXTS = {
    "GDPR-001": ("No unmasked PII columns detected", "PII columns without masking: ",
                 "Add mask_pii() calls for detected PII columns"),
    "GDPR-002": ("Retention policy comment present", "No data retention policy comment found",
                 "Add a comment describing data retention policy"),
    "GDPR-003": ("No cross-border transfer indicators found",
                 "Possible cross-border data transfer — ensure GDPR Art.46 compliance",
                 "Document legal basis for cross-border transfer"),
    "HIPAA-001": ("PHI masking present or no PHI detected", "PHI fields without masking: ",
                  "Apply HIPAA Safe Harbor or Expert Determination"),
    "HIPAA-002": ("Encryption reference present", "No encryption-at-rest comment or call found",
                  "Add comment confirming encryption at rest is configured"),
    "SOX-001": ("All SOX audit columns present", "Missing audit columns: ",
                "Add _etl_run_id, _etl_timestamp, _etl_source columns"),
    "SOX-002": ("Idempotency pattern detected",
                "No idempotency guard detected (no MERGE/OVERWRITE pattern)",
                "Use MERGE or INSERT OVERWRITE for idempotent writes"),
    "ETL-001": ("Schema validation present", "No schema validation at ingestion boundary",
                "Add StructType schema or Great Expectations suite"),
    "ETL-002": ("No non-deterministic timestamp issue",
                "Non-deterministic timestamp used without run_id seed",
                "Pin run_id to make runs reproducible"),
    "ETL-003": ("No unbounded SELECT * detected",
                "SELECT * detected — prefer explicit column list",
                "Replace SELECT * with explicit column names"),
}
WARNING_TEXTS = {
    "fail": "Compliance check FAILED — review report before deployment",
    "warn": "Compliance warnings detected — review before deployment",
}
CROSS_BORDER_WORDS = ("cross.border", "transfer", "eu", "gdpr", "international", "overseas")
NOW_CALL = ("current_timestamp()", "now()", "datetime.now(")
SELECT_STAR = r"""select\s*\(\s*["']\*["']|\.select\(\s*\*"""
IDEMPOTENCY_FLAG = ("MERGE", "mergeInto", "overwrite", "OVERWRITE")
SCHEMA_FLAG = ("StructType", "schema=", "validate", "expect")
PROFILES = {
    "gdpr": {
        "name": "General Data Protection Regulation",
        "jurisdiction": "EU",
        "rules": ("GDPR-001", "GDPR-002", "GDPR-003"),
        "key_requirements": (
            "PII masking for all personal data",
            "Data retention policy documentation",
            "Cross-border transfer disclosure",
            "Right to erasure support",
            "Audit trail for data access",
        ),
    },
    "hipaa": {
        "name": "Health Insurance Portability and Accountability Act",
        "jurisdiction": "US",
        "rules": ("HIPAA-001", "HIPAA-002"),
        "key_requirements": (
            "De-identification of Protected Health Information (PHI)",
            "Encryption at rest and in transit",
            "Access controls and audit logging",
            "Minimum necessary data principle",
            "Business Associate Agreement documentation",
        ),
    },
    "sox": {
        "name": "Sarbanes-Oxley Act",
        "jurisdiction": "US",
        "rules": ("SOX-001", "SOX-002"),
        "key_requirements": (
            "Audit trail columns on all output tables",
            "Idempotent write operations",
            "Change tracking and version control",
            "Access control documentation",
            "Data lineage and provenance",
        ),
    },
}

# --- fixed values: store defaults ----------------------------------------------------
RETENTION_DAYS = 90
MESSAGE_WINDOW = 6
RECENT_LIMIT = 20
BUDGET_ALERT_SHARE = 0.9
