"""Queries over texts, column names and masks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia import vocab
from custodia.functions import masking
from custodia.functions import script as S
from custodia.functions import text as T
from custodia.operators import corpus, pii, rules
from custodia.plans.registry import in_list, query, quoted, str_list
from custodia.sources.tables import SCHEMAS, Dataset
from custodia.sources.views import with_views

BASE_KINDS = tuple(p.kind for p in vocab.BASE_PATTERNS)
ALL_KINDS = tuple(p.kind for p in vocab.PATTERNS)
BASE_CRITICAL = ("SSN", "CREDIT_CARD", "PASSPORT")
CRITICAL_KINDS = (*BASE_CRITICAL, "IBAN")
COLUMN_WORD = quoted(r"""['"](\w+)['"]""")


def found_sql(source: str, ids: str, text: str, kinds) -> str:
    """Rows (ids, type, score, a) with the list of matches, one branch per kind."""
    return " UNION ALL ".join(
        f"SELECT {ids}, '{k}' AS type, {vocab.PATTERN_BY_KIND[k].score} AS score, "
        f"regexp_extract_all({text}, {quoted(vocab.PATTERN_BY_KIND[k].regex)}) AS a FROM {source}"
        for k in kinds
    )


def findings_sql(source: str, ids: str, text: str, kinds) -> str:
    return (
        f"SELECT {ids}, type, CAST(len(a) AS BIGINT) AS n, score, left(a[1], 8) || '…' AS sample, "
        f"'regex' AS source FROM ({found_sql(source, ids, text, kinds)}) WHERE len(a) > 0"
    )


def redacted_sql(text: str) -> str:
    out = text
    for k in vocab.REDACTION_ORDER:
        out = f"regexp_replace({out}, {quoted(vocab.PATTERN_BY_KIND[k].regex)}, '[{k}]', 'g')"
    return out


def risk_sql(score: str, critical: str) -> str:
    return (
        f"CASE WHEN {critical} OR {score} >= 4 THEN 'critical' WHEN {score} = 3 THEN 'high' "
        f"WHEN {score} = 2 THEN 'medium' ELSE 'low' END"
    )


def columns_sql(code: str) -> str:
    return (
        f"list_sort(list_distinct(list_filter(regexp_extract_all({code}, {COLUMN_WORD}, 1), "
        "lambda x: length(x) > 1 AND x[1] <> '_')))"
    )


def pii_columns_sql(code: str, names=vocab.COLUMN_NAMES) -> str:
    return f"list_filter({columns_sql(code)}, lambda x: lower(x) IN {in_list(names)})"


DOCUMENTS_AND_PAGES = (
    "(SELECT 'documents' AS table_name, doc_id AS id, text FROM documents "
    "UNION ALL SELECT 'pages' AS table_name, page_id AS id, html AS text FROM pages)"
)
ALL_TEXTS = DOCUMENTS_AND_PAGES[:-1] + (
    " UNION ALL SELECT 'v_planted' AS table_name, id, text FROM v_planted)"
)


def labelled(df: DataFrame, name: str, key: str, text: str) -> DataFrame:
    return df.select(F.lit(name).alias("table_name"), F.col(key).alias("id"), F.col(text).alias("text"))


def texts(ds: Dataset, planted: bool = False) -> DataFrame:
    parts = [
        labelled(ds.texts("documents"), "documents", "doc_id", "text"),
        labelled(ds.texts("pages"), "pages", "page_id", "html"),
    ]
    if planted:
        parts.append(labelled(ds.view("v_planted"), "v_planted", "id", "text"))
    return reduce(DataFrame.unionByName, parts)


@query(findings_sql("documents", "doc_id", "text", BASE_KINDS))
def pii_findings(ds: Dataset) -> DataFrame:
    return pii.scan_text(ds.texts("documents"), ["doc_id"], "text")


@query(with_views(findings_sql("v_planted", "id", "text", ALL_KINDS), "v_planted"))
def pii_findings_planted(ds: Dataset) -> DataFrame:
    return pii.scan_text(ds.view("v_planted"), ["id"], "text", vocab.PATTERNS)


@query(findings_sql(DOCUMENTS_AND_PAGES, "table_name, id", "text", ALL_KINDS))
def pii_findings_ext(ds: Dataset) -> DataFrame:
    return pii.scan_text(texts(ds), ["table_name", "id"], "text", vocab.PATTERNS)


@query(
    f"""
SELECT doc_id, CAST(max(CASE WHEN len(a) > 0 THEN score ELSE 0 END) AS INTEGER) AS max_score,
  {risk_sql("max(CASE WHEN len(a) > 0 THEN score ELSE 0 END)", f"bool_or(len(a) > 0 AND type IN {in_list(BASE_CRITICAL)})")} AS risk_level
FROM ({found_sql("documents", "doc_id", "text", BASE_KINDS)}) GROUP BY doc_id
"""
)
def pii_risk(ds: Dataset) -> DataFrame:
    return pii.text_risk(ds.texts("documents"), ["doc_id"], "text")


def _report_sql(source: str, key: str, text: str) -> str:
    hits = " || ".join(
        f"CASE WHEN regexp_matches({text}, {quoted(vocab.PATTERN_BY_KIND[k].regex)}) THEN '{k},' ELSE '' END"
        for k in BASE_KINDS
    )
    score = "greatest(" + ", ".join(
        [f"CASE WHEN contains(k, '{k},') THEN {vocab.PATTERN_BY_KIND[k].score} ELSE 0 END" for k in BASE_KINDS]
        + [f"CASE WHEN list_has_any(c, {str_list(vocab.STRONG_COLUMN_NAMES)}) THEN 4 WHEN len(c) > 0 THEN 3 ELSE 0 END"]
    ) + ")"
    critical = " OR ".join(f"contains(k, '{k},')" for k in BASE_CRITICAL)
    kinds = "len(k) - len(replace(k, ',', ''))"
    return f"""
SELECT {key}, {_entities_sql(text)} AS entities, CAST({kinds} + len(c) AS BIGINT) AS entity_count, ({kinds} + len(c)) > 0 AS has_pii,
  {risk_sql(score, f"({critical})")} AS risk_level, rtrim(k, ',') AS entity_types,
  array_to_string(c, ',') AS pii_column_names
FROM (SELECT {key}, {text}, {hits} AS k, {pii_columns_sql(text)} AS c FROM {source})
"""


def _entities_sql(text: str) -> str:
    """type:count:score:sample:source of every kind found and every column name, joined."""
    kinds = ", ".join(
        f"CASE WHEN len(regexp_extract_all({text}, {quoted(vocab.PATTERN_BY_KIND[k].regex)})) > 0 THEN '{k}:' || "
        f"CAST(len(regexp_extract_all({text}, {quoted(vocab.PATTERN_BY_KIND[k].regex)})) AS STRING) || ':{vocab.PATTERN_BY_KIND[k].score}:' || "
        f"left(regexp_extract({text}, {quoted(vocab.PATTERN_BY_KIND[k].regex)}), 8) || '…:regex' END"
        for k in BASE_KINDS
    )
    return (
        f"array_to_string(list_filter([{kinds}], lambda x: x IS NOT NULL) || list_transform(c, lambda n: 'COLUMN_NAME:1:' || "
        f"CASE WHEN n IN {in_list(vocab.STRONG_COLUMN_NAMES)} THEN '4' ELSE '3' END || ':' || n || ':heuristic'), ';')"
    )


def _report(df: DataFrame, key: str, text: str) -> DataFrame:
    parts = ("type", "n", "score", "sample", "source")
    lines = F.transform("entities", lambda e: F.concat_ws(":", *[e[c].cast("string") for c in parts]))
    return pii.report(df, [key], text).withColumns(
        {"pii_column_names": S.joined(F.col("pii_column_names")), "entities": F.array_join(lines, ";")}
    )


@query(_report_sql("documents", "doc_id", "text"))
def pii_report(ds: Dataset) -> DataFrame:
    return _report(ds.texts("documents"), "doc_id", "text")


@query(with_views(_report_sql("v_scripts", "script_id", "code"), "v_scripts"))
def pii_report_scripts(ds: Dataset) -> DataFrame:
    return _report(ds.view("v_scripts"), "script_id", "code")


PROFILED = {
    "documents": ("text", "lang", "source"),
    "pages": ("url", "html"),
    "conversations": ("role", "text"),
    "events": ("event_type", "props"),
    "benchmark": ("text",),
    "region": ("r_name",),
    "nation": ("n_name",),
    "customer": ("c_name", "c_mktsegment"),
    "supplier": ("s_name",),
    "part": ("p_name", "p_brand", "p_type"),
    "orders": ("o_orderstatus", "o_orderpriority"),
    "lineitem": ("l_returnflag", "l_linestatus"),
}


def _profile_sql() -> str:
    cells = []
    for table, columns in PROFILED.items():
        for c in columns:
            for k in ALL_KINDS:
                score = vocab.PATTERN_BY_KIND[k].score
                critical = "true" if k in CRITICAL_KINDS else "false"
                cells.append(
                    f"SELECT '{table}' AS table_name, '{c}' AS column_name, '{k}' AS type, {score} AS score, "
                    f"{critical} AS critical, count(*) AS n_rows, count(*) FILTER (WHERE m > 0) AS rows_hit, "
                    f"CAST(sum(m) AS BIGINT) AS n_matches FROM (SELECT "
                    f"len(regexp_extract_all({c}, {quoted(vocab.PATTERN_BY_KIND[k].regex)})) AS m FROM {table})"
                )
    risk = risk_sql("CASE WHEN rows_hit > 0 THEN score ELSE 0 END", "(rows_hit > 0 AND critical)")
    return (
        "SELECT table_name, column_name, type, n_rows, rows_hit, n_matches, "
        f"rows_hit / n_rows AS share, {risk} AS risk_level FROM (" + " UNION ALL ".join(cells) + ")"
    )


@query(_profile_sql())
def pii_dataset_profile(ds: Dataset) -> DataFrame:
    parts = [pii.profile(ds.get(t), t, columns) for t, columns in PROFILED.items()]
    return reduce(DataFrame.unionByName, parts)


@query(
    f"""
SELECT lang, type, count(DISTINCT doc_id) AS subjects_hit, count(*) AS matches, count(DISTINCT v) AS distinct_values
FROM (SELECT doc_id, lang, type, unnest(a) AS v FROM ({found_sql("documents", "doc_id, lang", "text", ALL_KINDS)}))
GROUP BY lang, type
"""
)
def pii_summary(ds: Dataset) -> DataFrame:
    return pii.summary(ds.texts("documents"), "lang", "text")


@query(
    with_views(
        f"""
SELECT script_id, column_name, lower(trim(column_name)) IN {in_list(vocab.COLUMN_NAMES)} AS is_pii,
  CASE WHEN lower(trim(column_name)) IN {in_list(vocab.STRONG_COLUMN_NAMES)} THEN 4
       WHEN lower(trim(column_name)) IN {in_list(vocab.COLUMN_NAMES)} THEN 3 END AS score
FROM (SELECT script_id, unnest({columns_sql("code")}) AS column_name FROM v_scripts)
""",
        "v_scripts",
    )
)
def pii_column_scan(ds: Dataset) -> DataFrame:
    named = corpus.column_index(ds.view("v_scripts"))
    found = pii.scan_columns(named, pii.dictionary(ds.spark))
    return found.select("script_id", "column_name", "is_pii", "score")


def _catalog() -> list[tuple[str, str, str]]:
    """(table, column, type) as declared."""
    return [
        (table, *part.strip().split(" ", 1)) for table, ddl in SCHEMAS.items() for part in ddl.split(",")
    ]


def _flagged(column: str) -> bool:
    """Whether the extended dictionary knows the name, without its table prefix."""
    return re.sub(r"^[a-z]{1,2}_", "", column) in vocab.COLUMN_NAMES_EXTENDED


def _catalog_scan_sql() -> str:
    parts = [
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, (SELECT count(*) FROM {t}) AS n_rows, "
        + (f"(SELECT count({c}) FROM {t}) AS n_values" if _flagged(c) else "CAST(NULL AS BIGINT) AS n_values")
        for t, c, _ in _catalog()
    ]
    key = "regexp_replace(lower(trim(column_name)), '^[a-z]{1,2}_', '')"
    return f"""
SELECT table_name, column_name, {key} AS normalised, {key} IN {in_list(vocab.COLUMN_NAMES_EXTENDED)} AS is_pii,
  CASE WHEN {key} IN {in_list(vocab.STRONG_COLUMN_NAMES)} THEN 4 WHEN {key} IN {in_list(vocab.COLUMN_NAMES_EXTENDED)} THEN 3 END AS score,
  n_rows, n_values
FROM ({" UNION ALL ".join(parts)})
"""


@query(_catalog_scan_sql())
def pii_column_scan_ext(ds: Dataset) -> DataFrame:
    """Every column of every table; filled values are counted for flagged columns only."""
    tables = {t: [c for u, c, _ in _catalog() if u == t] for t in SCHEMAS}
    exposed = reduce(
        DataFrame.unionByName,
        [
            pii.exposure(ds.table(t), t, columns, [c for c in columns if _flagged(c)])
            for t, columns in tables.items()
        ],
    )
    found = pii.scan_columns(exposed, pii.dictionary(ds.spark, extended=True), strip_prefix=True)
    return found.select("table_name", "column_name", "normalised", "is_pii", "score", "n_rows", "n_values")


def _terms_sql() -> str:
    literals = quoted(r"""["']([^"']{10,})["']""")
    return rf"""
SELECT id, literal_no, word_no, 'NER_' || label AS type, term AS text, 2 AS score, 'terms' AS source
FROM (SELECT id, literal_no, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS word_no, unnest(ws) AS w, ws
      FROM (SELECT id, literal_no, regexp_split_to_array(l, '\W+') AS ws
            FROM (SELECT id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS literal_no, unnest(ls) AS l
                  FROM (SELECT id, regexp_extract_all(text, {literals}, 1) AS ls FROM v_notes))))
JOIN (SELECT DISTINCT term, label, list_filter(regexp_split_to_array(term, '\W+'), lambda x: x <> '') AS ts FROM v_terms)
  ON w = ts[1] AND ws[word_no + 1:word_no + len(ts)] = ts
"""


@query(with_views(_terms_sql(), "v_notes", "v_terms"))
def gazetteer_scan(ds: Dataset) -> DataFrame:
    return pii.scan_terms(ds.view("v_notes"), ["id"], "text", ds.view("v_terms"))


@query(with_views(_terms_sql(), "v_notes", "v_terms"))
def phrase_scan(ds: Dataset) -> DataFrame:
    return pii.scan_phrases(ds.view("v_notes"), ["id"], "text", ds.view("v_terms"))


@query(
    with_views(
        f"""
SELECT 'p' || CAST(id AS STRING) AS subject, type, sample AS match_sample, n, score, source, CAST(NULL AS STRING) AS "column"
FROM ({findings_sql("v_planted", "id", "text", BASE_KINDS)})
UNION ALL
SELECT 's' || CAST(script_id AS STRING), 'COLUMN_NAME', NULL, NULL,
  CASE WHEN c IN {in_list(vocab.STRONG_COLUMN_NAMES)} THEN 4 ELSE 3 END, 'heuristic', c
FROM (SELECT script_id, unnest({pii_columns_sql("code")}) AS c FROM v_scripts)
UNION ALL
SELECT 'n' || CAST(id AS STRING), type, text, NULL, score, source, NULL FROM ({_terms_sql()})
""",
        "v_planted",
        "v_scripts",
        "v_notes",
        "v_terms",
    )
)
def all_findings(ds: Dataset) -> DataFrame:
    def subject(prefix: str, key: str):
        return F.concat(F.lit(prefix), F.col(key).cast("string")).alias("subject")

    text = pii.scan_text(ds.view("v_planted"), ["id"], "text").select(subject("p", "id"), "*")
    named = pii.scan_columns(corpus.column_index(ds.view("v_scripts")), pii.dictionary(ds.spark))
    columns = named.where("is_pii").select(subject("s", "script_id"), "column_name", "score")
    terms = pii.scan_terms(ds.view("v_notes"), ["id"], "text", ds.view("v_terms")).select(
        subject("n", "id"), "*"
    )
    return pii.all_findings(text, columns, terms)


@query(
    with_views(
        f"""
SELECT script_id, array_to_string(phi, ',') AS phi_columns, contains(code, 'mask_pii') AS masked
FROM (SELECT script_id, code, list_filter({pii_columns_sql("code")}, lambda x: x IN {in_list(vocab.PHI_NAMES)}) AS phi FROM v_scripts)
WHERE len(phi) > 0
""",
        "v_scripts",
    )
)
def phi_columns(ds: Dataset) -> DataFrame:
    found = corpus.phi_columns(ds.view("v_scripts"), "code", "script_id")
    return found.withColumn("phi_columns", S.joined(F.col("phi_columns")))


@query(
    with_views(
        f"""
SELECT script_id, array_to_string(phi, ',') AS phi_columns, contains(code, 'mask_pii') AS masked
FROM (SELECT script_id, code, list_filter({pii_columns_sql("code", vocab.COLUMN_NAMES_EXTENDED)}, lambda x: x IN {in_list(vocab.PHI_NAMES_PROFILE)}) AS phi FROM v_scripts)
WHERE len(phi) > 0
""",
        "v_scripts",
    )
)
def phi_columns_profile(ds: Dataset) -> DataFrame:
    """The same with the profile's longer list of health-information names."""
    found = corpus.phi_columns(
        ds.view("v_scripts"), "code", "script_id", vocab.PHI_NAMES_PROFILE, vocab.COLUMN_NAMES_EXTENDED
    )
    return found.withColumn("phi_columns", S.joined(F.col("phi_columns")))


# column made, the mask plan's strategy, what SQL makes of the name, what it must look like in RE2
MASK_CASES = [
    ("m_redact", "redact", "'***'", r"^\*\*\*$"),
    ("m_partial", "partial", "CASE WHEN length(c_name) <= 4 THEN repeat('*', length(c_name)) ELSE repeat('*', length(c_name) - 4) || right(c_name, 4) END", r"^(\*{1,4}|\*+.{4})$"),
    ("m_token", "token", "sha256(c_name)", r"^[0-9a-f]{64}$"),
    ("m_null", "null", "CAST(NULL AS STRING)", r"^$"),
    ("m_shape", "shape", "regexp_replace(regexp_replace(regexp_replace(c_name, '[a-z]', 'x', 'g'), '[A-Z]', 'X', 'g'), '[0-9]', 'n', 'g')", r"^([Xxn]|[^\p{L}\p{Nd}])*[Xxn]([Xxn]|[^\p{L}\p{Nd}])*$"),
    ("m_email", "email", "regexp_replace(c_name || '@x.org', '^[^@]*', '***')", r"^\*\*\*(@.*)?$"),
    ("m_phone", "phone", "regexp_replace('555-123-' || CAST(c_custkey AS STRING), '[0-9]', '#', 'g')", r"^[^0-9]*#[^0-9]*$"),
    ("m_name", "name", "left(c_name, 1) || '***'", r"^.?\*\*\*$"),
    ("m_ssn", "ssn", "'***-**-' || right(c_name, 4)", r"^\*\*\*-\*\*-.{0,4}$"),
    ("m_mixed", "partial", "CASE WHEN c_custkey % 3 = 0 THEN '*Bob' ELSE c_name END", r"^(\*{1,4}|\*+.{4})$"),
    ("c_name", None, "c_name", r"^$"),
]


def _unmasked_sql() -> str:
    parts = [
        f"SELECT '{column}' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE NOT regexp_matches({value}, {quoted(form)})) AS n_unmasked FROM customer"
        for column, _, value, form in MASK_CASES
    ]
    return (
        "SELECT 'HIPAA-001' AS rule_id, 'customer' AS table_name, n_rows, column_name, n_unmasked, "
        "CASE WHEN n_unmasked > 0 THEN 'fail' ELSE 'pass' END AS status FROM (" + " UNION ALL ".join(parts) + ")"
    )


@query(_unmasked_sql())
def rule_unmasked_phi(ds: Dataset) -> DataFrame:
    """Every strategy's results against its own form, a column that is only partly masked, and a plain one."""
    masking.register_mask_pii(ds.spark)
    customer, name = ds.table("customer"), F.col("c_name")
    fields = {
        "email": F.concat("c_name", F.lit("@x.org")),
        "phone": F.concat(F.lit("555-123-"), F.col("c_custkey").cast("string")),
        "name": name,
        "ssn": name,
    }
    made = {f"m_{s}": masking.STRATEGIES[s](name) for s in masking.STRATEGIES}
    made |= {f"m_{kind}": F.call_function("mask_pii", value, F.lit(kind)) for kind, value in fields.items()}
    made["m_mixed"] = F.when(F.col("c_custkey") % 3 == 0, "*Bob").otherwise(name)
    plan = {column: strategy for column, strategy, _, _ in MASK_CASES if strategy}
    columns = [column for column, *_ in MASK_CASES]
    return rules.unmasked_values(customer.withColumns(made), "customer", columns, "HIPAA-001", plan)


@query(
    with_views(
        f"SELECT table_name, id, {redacted_sql('text')} AS redacted, {redacted_sql('text')} <> text AS changed FROM {ALL_TEXTS}",
        "v_planted",
    )
)
def redact_text(ds: Dataset) -> DataFrame:
    out = T.with_redaction(texts(ds, planted=True), "text", "redacted")
    return out.select("table_name", "id", "redacted", (F.col("redacted") != F.col("text")).alias("changed"))


@query(
    with_views(
        f"""
SELECT table_name, n_rows, matches_before, matches_after,
  CASE WHEN matches_after > 0 THEN 'fail' ELSE 'pass' END AS status
FROM (SELECT table_name, count(*) AS n_rows,
        CAST(sum({" + ".join(f"len(regexp_extract_all(text, {quoted(p.regex)}))" for p in vocab.PATTERNS)}) AS BIGINT) AS matches_before,
        CAST(sum({" + ".join(f"len(regexp_extract_all(r, {quoted(p.regex)}))" for p in vocab.PATTERNS)}) AS BIGINT) AS matches_after
      FROM (SELECT table_name, text, {redacted_sql('text')} AS r FROM {ALL_TEXTS}) GROUP BY table_name)
""",
        "v_planted",
    )
)
def rule_residual_pii(ds: Dataset) -> DataFrame:
    sources = {
        "documents": ds.texts("documents").select("text"),
        "pages": ds.texts("pages").select(F.col("html").alias("text")),
        "v_planted": ds.view("v_planted").select("text"),
    }
    parts = [
        rules.residual_pii(T.with_redaction(df, "text", "redacted"), name, "text", "redacted")
        for name, df in sources.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    r"""
SELECT c_custkey, sha256(c_name) AS c_name,
  '***' AS c_mktsegment,
  CASE WHEN length(CAST(c_custkey AS STRING)) <= 4 THEN repeat('*', length(CAST(c_custkey AS STRING)))
       ELSE repeat('*', length(CAST(c_custkey AS STRING)) - 4) || right(CAST(c_custkey AS STRING), 4) END AS key_partial,
  regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS name_shape,
  CAST(NULL AS STRING) AS c_acctbal
FROM customer
"""
)
def mask_columns(ds: Dataset) -> DataFrame:
    customer = ds.table("customer").select(
        "c_custkey", "c_name", "c_mktsegment", F.col("c_custkey").alias("key_partial"),
        F.col("c_name").alias("name_shape"), "c_acctbal",
    )
    return masking.mask_columns(
        customer,
        {
            "c_name": "token",
            "c_mktsegment": "redact",
            "key_partial": "partial",
            "name_shape": "shape",
            "c_acctbal": "null",
        },
    )


@query(
    r"""
SELECT c_custkey, left(c_name, 1) || '***' AS name,
  regexp_replace('user' || CAST(c_custkey AS STRING) || '@example.com', '^[^@]*', '***') AS email,
  regexp_replace('555-123-' || CAST(1000 + c_custkey % 9000 AS STRING), '[0-9]', '#', 'g') AS phone,
  '***-**-' || right(CAST(1000 + c_custkey % 9000 AS STRING), 4) AS ssn, '***' AS segment
FROM customer
"""
)
def mask_function(ds: Dataset) -> DataFrame:
    masking.register_mask_pii(ds.spark)
    return ds.spark.sql(
        """
        SELECT c_custkey, mask_pii(c_name, 'name') AS name,
          mask_pii('user' || CAST(c_custkey AS STRING) || '@example.com', 'email') AS email,
          mask_pii('555-123-' || CAST(1000 + c_custkey % 9000 AS STRING), 'phone') AS phone,
          mask_pii('123-45-' || CAST(1000 + c_custkey % 9000 AS STRING), 'ssn') AS ssn,
          mask_pii(c_mktsegment, 'segment') AS segment
        FROM {customer}
        """,
        customer=ds.table("customer"),
    )


@query(
    """
SELECT 'documents' AS table_name, doc_id AS id, CAST(0 AS BIGINT) AS part, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents
UNION ALL
SELECT 'conversations', conv_id, turn, CAST(length(text) // 4 AS BIGINT) FROM conversations
"""
)
def token_estimate(ds: Dataset) -> DataFrame:
    tokens = T.token_estimate(F.col("text")).alias("tokens")
    documents = ds.texts("documents").select(
        F.lit("documents").alias("table_name"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("part"), tokens
    )
    turns = ds.texts("conversations").select(
        F.lit("conversations").alias("table_name"), F.col("conv_id").alias("id"), F.col("turn").alias("part"), tokens
    )
    return documents.unionByName(turns)


@query(
    """
SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc_id
FROM documents GROUP BY sha256(text) HAVING count(*) > 1
"""
)
def duplicate_content(ds: Dataset) -> DataFrame:
    return corpus.duplicates(ds.texts("documents"), "text", "doc_id")


@query(
    """
SELECT doc_id, length(text) // 4 <= 1000 AS passed,
  CASE WHEN length(text) // 4 > 1000 THEN 'E002' END AS error_code
FROM documents
"""
)
def gate_size(ds: Dataset) -> DataFrame:
    over = T.token_estimate(F.col("text")) > 1000
    return ds.texts("documents").select("doc_id", (~over).alias("passed"), F.when(over, "E002").alias("error_code"))


OWN_PATTERNS = (
    vocab.Pattern("ACCESS_KEY", 4, r"\bAKIA[A-Z0-9]{16}\b", critical=True, holds=("AKIA",)),
    vocab.Pattern("LICENCE", 2, r"\b(?:MIT|GPL|Apache|BY-NC)\b"),
)


def _own_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id, '{p.kind}' AS type, CAST(len(a) AS BIGINT) AS n, {p.score} AS score, left(a[1], 8) || '…' AS sample, 'regex' AS source "
        f"FROM (SELECT doc_id, regexp_extract_all(text, {quoted(p.regex)}) AS a FROM documents) WHERE len(a) > 0"
        for p in OWN_PATTERNS
    )


@query(_own_sql())
def own_patterns(ds: Dataset) -> DataFrame:
    """A scan with the caller's own patterns."""
    return pii.scan_text(ds.texts("documents"), ["doc_id"], "text", OWN_PATTERNS)


# In practice the secrets come from a vault; these are for the checks.
KEYS = masking.Keyring({1: b"first secret", 2: b"second secret"})


def hmac_sql(value: str, domain: str, version: int) -> str:
    block = KEYS.key(domain, version).ljust(64, b"\0")
    inner, outer = ("unhex('" + bytes(b ^ pad for b in block).hex() + "')" for pad in (0x36, 0x5C))
    return f"'{version}.' || left(sha256({outer} || unhex(sha256({inner} || encode(CAST({value} AS VARCHAR))))), 32)"


@query(
    f"""
SELECT {hmac_sql('c_custkey', 'customer', 2)} AS customer, {hmac_sql('c_name', 'name', 2)} AS c_name, c_mktsegment, count(*) AS n_orders
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL
"""
)
def pseudonymise(ds: Dataset) -> DataFrame:
    """Customers and orders masked apart, the orders under an old secret and then carried over, join by pseudonym."""
    customer = ds.table("customer")
    masked = masking.pseudonymise(customer, {"c_custkey": "customer", "c_name": "name"}, KEYS).withColumnRenamed("c_custkey", "customer")
    old = masking.pseudonymise(ds.table("orders").select("o_custkey"), {"o_custkey": "customer"}, KEYS, version=1)
    walk = masking.crosswalk(customer, "c_custkey", "customer", KEYS, old=1, new=2)
    orders = masking.rotated(old, "o_custkey", walk).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    return masked.join(orders, F.col("customer") == F.col("o_custkey")).select("customer", "c_name", "c_mktsegment", "n_orders")
