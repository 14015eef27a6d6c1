"""Queries over the script corpus and the admission gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia import vocab
from custodia.functions import script as S
from custodia.functions import text as T
from custodia.operators import corpus, gate, lineage
from custodia.plans.pii_queries import columns_sql, pii_columns_sql
from custodia.plans.registry import any_of, in_list, query, quoted, str_list
from custodia.session import fresh_path
from custodia.sources.tables import Dataset, read_scripts, write_scripts
from custodia.sources.views import with_views


NAME = S.NAME
STATEMENT = r"[\n\r;:][ \t\f]*(?:import[ \t\f]+[^\n\r;#]+|from(?:[ \t\f]+\.*|\.+)[ \t\f]*" + NAME + r"[ \t\f]+import\b)"
LISTED = r"^[ \t\f(]*(" + NAME + ")"
FROM = r"^[\n\r;:][ \t\f]*from[ \t\f.]*(" + NAME + ")"


def names_sql(code: str) -> str:
    """Imported dotted names of a script in order, continued lines read both ways, as a list."""
    joined = rf"regexp_replace({code}, '\\\r?\n', ' ', 'g')"
    found = (
        f"(CASE WHEN contains({code}, chr(92)) THEN regexp_extract_all(chr(10) || {joined}, {quoted(STATEMENT)}) ELSE [] END "
        f"|| regexp_extract_all(chr(10) || {code}, {quoted(STATEMENT)}))"
    )
    return (
        f"list_filter(flatten(list_transform({found}, lambda s: CASE WHEN regexp_matches(s, '^[\n\r;:][ \t\f]*import[ \t\f]') "
        f"THEN list_transform(string_split(regexp_replace(s, '^[\n\r;:][ \t\f]*import[ \t\f]+', ''), ','), lambda t: regexp_extract(t, {quoted(LISTED)}, 1)) "
        f"ELSE [regexp_extract(s, {quoted(FROM)}, 1)] END)), lambda t: t <> '')"
    )


def imports_sql(code: str) -> str:
    return f"list_sort(list_distinct(list_transform({names_sql(code)}, lambda s: split_part(s, '.', 1))))"


def transforms_sql(code: str) -> str:
    """Every recognised name is searched for on its own."""
    found = ", ".join(
        rf"CASE WHEN regexp_matches({code}, '\.{t}\s*\(') THEN '{t}' END" for t in vocab.TRANSFORMS
    )
    return f"list_sort(list_filter([{found}], lambda s: s IS NOT NULL))"


BLOCK = r"(?m)(?:^@[^\n]*\n(?:^[ \t]*(?:#[^\n]*)?\n)*)*^def[ \t]+\w+[ \t]*\("


def functions_sql(code: str) -> str:
    """Top-level functions as a list of structs: name, decos, line_no, args."""
    args = rf"regexp_extract_all({code}, '(?m)^def[ \t]+\w+[ \t]*\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)', 1)"
    plain = "a"
    for _ in range(3):
        plain = rf"regexp_replace({plain}, '\([^()\[\]{{}}]*\)|\[[^()\[\]{{}}]*\]|\{{[^()\[\]{{}}]*\}}', '', 'g')"
    plain = rf"regexp_replace({plain}, '(?s)(^|,)\s*\*.*', '')"
    names = rf"list_filter(list_transform(string_split({plain}, ','), lambda t: regexp_extract(t, '^\s*(\w+)', 1)), lambda t: t <> '')"
    lines = (
        f"list_filter(list_transform(string_split({code}, chr(10)), lambda l, i: {{'no': i, 'line': l}}), "
        r"lambda x: regexp_matches(x.line, '^def[ \t]+\w+[ \t]*\('))"
    )
    return (
        f"list_transform(list_zip(regexp_extract_all({code}, {quoted(BLOCK)}), {lines}, {args}), lambda z: {{"
        r"'name': regexp_extract(z[1], '(?m)^def[ \t]+(\w+)', 1), "
        r"'decos': list_transform(regexp_extract_all(z[1], '(?m)^@([\w.]+)[ \t]*(?:#.*)?$', 1), lambda d: string_split(d, '.')[-1]), "
        f"'line_no': z[2].no, 'args': list_transform([z[3]], lambda a: {names})[1]}})"
    )


def tagged_sql(code: str, tag: str) -> str:
    return f"list_transform(list_filter({functions_sql(code)}, lambda f: list_contains(f.decos, '{tag}')), lambda f: f.name)"


@query(
    with_views(
        f"SELECT script_id, array_to_string({imports_sql('code')}, ',') AS imports FROM v_submissions",
        "v_submissions",
    )
)
def script_imports(ds: Dataset) -> DataFrame:
    return ds.view("v_submissions").select("script_id", S.joined(S.imports(F.col("code"))).alias("imports"))


@query(
    with_views(
        f"""
SELECT script_id, f.name AS name, array_to_string(f.decos, ',') AS decorators, CAST(f.line_no AS STRING) AS line_no,
  array_to_string(f.args, ',') AS args
FROM (SELECT script_id, unnest({functions_sql('code')}) AS f FROM v_submissions)
""",
        "v_submissions",
    )
)
def script_functions(ds: Dataset) -> DataFrame:
    found = corpus.items(ds.view("v_submissions"), S.functions(F.col("code")), "f", "script_id")
    return found.select(
        "script_id",
        "f.name",
        S.joined(F.col("f.decorators")).alias("decorators"),
        F.col("f.line_no").cast("string").alias("line_no"),
        S.joined(F.col("f.args")).alias("args"),
    )


@query(
    with_views(
        f"SELECT script_id, CASE WHEN code IS NOT NULL THEN array_to_string({transforms_sql('code')}, ',') END AS transforms FROM v_submissions",
        "v_submissions",
    )
)
def script_transforms(ds: Dataset) -> DataFrame:
    return ds.view("v_submissions").select(
        "script_id", S.joined(S.transforms(F.col("code"))).alias("transforms")
    )


@query(
    with_views(
        f"SELECT unnest({columns_sql('code')}) AS column_name, script_id FROM v_submissions", "v_submissions"
    )
)
def column_index(ds: Dataset) -> DataFrame:
    return corpus.column_index(ds.view("v_submissions"))


# Java's expression without its possessive repetitions and lookahead, which this engine lacks.
TOKEN = (
    r'(?s)"""(?:[^\\]|\\.)*?"""|'
    r"'''(?:[^\\]|\\.)*?'''|"
    r'"(?:[^"\\\n]|\\.)*"|'
    r"'(?:[^'\\\n]|\\.)*'|"
    r"#[^\n]*|\\\n|[^\"'#\\]+|."
)
LEXED = rf"""
cut AS (
  SELECT script_id, regexp_extract_all(code, {quoted(TOKEN)}) AS tokens FROM v_quoted
), masked AS (
  SELECT script_id, tokens, array_to_string(list_transform(tokens, lambda t: CASE
    WHEN length(t) > 1 AND (t[1] = '"' OR t[1] = chr(39)) THEN
      CASE WHEN contains(t, chr(10)) THEN '""[' || regexp_replace(t, '[^\n]', '', 'g') || ']' ELSE '""' END
    WHEN t[1] = '#' THEN '' WHEN t = chr(92) || chr(10) THEN '[' || chr(10) || ']' ELSE t END), '') AS code
  FROM cut
), lines AS (
  SELECT script_id, x.no, x.line, length(regexp_replace(x.line, '[^(\[{{]', '', 'g')) - length(regexp_replace(x.line, '[^)\]}}]', '', 'g')) AS net
  FROM (SELECT script_id, unnest(list_transform(string_split(code, chr(10)), lambda l, i: {{'no': i, 'line': l}})) AS x FROM masked)
), deep AS (
  SELECT *, coalesce(sum(net) OVER (PARTITION BY script_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM lines
), numbered AS (
  SELECT *, sum(CASE WHEN depth = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY script_id ORDER BY no) AS head FROM deep
), logical AS (
  SELECT script_id, min(no) AS no, replace(string_agg(line, ' ' ORDER BY no), '[ ]', ' ') AS text FROM numbered GROUP BY script_id, head
), marked AS (
  SELECT *, text[1] = '@' AS decorates, row_number() OVER (PARTITION BY script_id ORDER BY no) AS place FROM logical
  WHERE regexp_matches(text, '^(@|def |class |async )')
), placed AS (
  SELECT *, coalesce(max(CASE WHEN NOT decorates THEN place END)
    OVER (PARTITION BY script_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM marked
), decorators AS (
  SELECT f.script_id, f.no, string_agg(regexp_extract(d.text, '(\w+)\s*$', 1), ',' ORDER BY d.place) AS decorators
  FROM placed f JOIN placed d ON f.script_id = d.script_id AND d.place > f.before AND d.place < f.place AND regexp_matches(d.text, '^@[\w.]+\s*$')
  WHERE NOT f.decorates GROUP BY f.script_id, f.no
)"""


def arguments_sql(text: str) -> str:
    plain = rf"regexp_extract({text}, '^def[ \t]+\w+[ \t]*\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)', 1)"
    for _ in range(3):
        plain = rf"regexp_replace({plain}, '\([^()\[\]{{}}]*\)|\[[^()\[\]{{}}]*\]|\{{[^()\[\]{{}}]*\}}', '', 'g')"
    plain = rf"regexp_replace({plain}, '(^|,)\s*\*.*', '')"
    return rf"list_filter(list_transform(string_split({plain}, ','), lambda t: regexp_extract(t, '^\s*(\w+)', 1)), lambda t: t <> '')"


@query(
    with_views(
        rf"""
WITH {LEXED}
SELECT DISTINCT script_id, 'import' AS kind, unnest({imports_sql('text')}) AS name, CAST(NULL AS INTEGER) AS line_no,
  CAST(NULL AS VARCHAR) AS decorators, CAST(NULL AS VARCHAR) AS args FROM logical
UNION ALL
SELECT script_id, 'function', regexp_extract(text, '^def\s+(\w+)', 1), CAST(no AS INTEGER), coalesce(decorators, ''),
  array_to_string({arguments_sql('text')}, ',')
FROM marked LEFT JOIN decorators USING (script_id, no) WHERE text LIKE 'def%'
UNION ALL
SELECT DISTINCT script_id, 'column', trim(t, '"' || chr(39)), NULL, NULL, NULL FROM (SELECT script_id, unnest(tokens) AS t FROM masked)
WHERE regexp_matches(t, '^("[a-zA-Z0-9]\w+"|''[a-zA-Z0-9]\w+'')$')
""",
        "v_quoted",
    )
)
def script_lexed(ds: Dataset) -> DataFrame:
    return corpus.lexical_facts(ds.view("v_quoted"), "code", "script_id")


@query(
    with_views(
        r"""
WITH plain AS (
  SELECT script_id, list_filter(string_split(code, chr(10)), lambda l: NOT starts_with(l, '#') AND NOT starts_with(l, repeat('"', 3))) AS lines FROM v_jobs
), said AS (SELECT script_id, array_to_string(lines, chr(10)) AS code FROM plain),
ends AS (
  SELECT script_id,
    list_filter(regexp_extract_all(code, '(?:spark\.read\.\w+|\.load|spark\.table|"true"\)\.parquet)\("([^"]+)"', 1), lambda r: r NOT IN ('mergeSchema', 'csv')) AS reads,
    regexp_extract_all(code, '(?:\.save|saveAsTable|"day"\)\.parquet)\("([^"]+)"', 1) AS writes,
    CASE WHEN contains(code, 'select("*")') THEN ['*'] ELSE list_distinct(regexp_extract_all(code, '"([a-zA-Z0-9]\w+)"', 1)) END AS columns FROM said
), reading AS (SELECT script_id, unnest(reads) AS source FROM ends),
writing AS (SELECT script_id, unnest(writes) AS sink FROM ends),
naming AS (SELECT script_id, unnest(list_filter(columns, lambda c: NOT list_contains(reads, c) AND NOT list_contains(writes, c))) AS column_name FROM ends),
direct AS (SELECT DISTINCT column_name, source, sink FROM reading JOIN writing USING (script_id) JOIN naming USING (script_id)),
step AS (
  SELECT * FROM direct WHERE column_name <> '*'
  UNION SELECT c.column_name, source, sink FROM direct, (SELECT DISTINCT column_name FROM direct WHERE column_name <> '*') c WHERE direct.column_name = '*'
), way AS (
  SELECT column_name, source, sink, 1 AS distance FROM step
  UNION SELECT w.column_name, w.source, s.sink, distance + 1 FROM way w JOIN step s ON w.column_name = s.column_name AND w.sink = s.source WHERE distance < 16
)
SELECT column_name, source, sink, min(distance) AS distance FROM way GROUP BY ALL
""",
        "v_jobs",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def column_lineage(ds: Dataset) -> DataFrame:
    return lineage.column_lineage(ds.view("v_jobs"), "script_id")


@query(
    with_views(
        f"""
SELECT script_id,
  CASE WHEN len({tagged_sql('code', 'task')}) + len({tagged_sql('code', 'flow')}) > 0 THEN 'prefect' ELSE 'pyspark' END AS job_type,
  CAST(length(code) - length(replace(code, chr(10), '')) AS INTEGER) AS line_count,
  contains(code, 'SparkSession') AS has_spark_session,
  contains(code, 'StructType') OR contains(code, 'schema=') AS has_schema_def,
  CASE WHEN code IS NOT NULL THEN list_has_any({transforms_sql('code')}, ['write', 'save', 'saveAsTable']) END AS has_write,
  array_to_string({tagged_sql('code', 'task')}, ',') AS tasks,
  array_to_string({tagged_sql('code', 'flow')}, ',') AS flows
FROM v_submissions
""",
        "v_submissions",
    )
)
def script_facts(ds: Dataset) -> DataFrame:
    return corpus.facts(ds.view("v_submissions")).select(
        "script_id",
        "job_type",
        "line_count",
        "has_spark_session",
        "has_schema_def",
        "has_write",
        S.joined(F.col("tasks")).alias("tasks"),
        S.joined(F.col("flows")).alias("flows"),
    )


@query(
    with_views(
        "SELECT sha256(code) AS content_hash, count(*) AS copies, min(script_id) AS first_script_id "
        "FROM v_scripts GROUP BY 1 HAVING count(*) > 1",
        "v_scripts",
    )
)
def duplicate_scripts(ds: Dataset) -> DataFrame:
    return corpus.duplicates(ds.view("v_scripts"), "code", "script_id")


@query(
    with_views(
        f"""
SELECT script_id, array_to_string(c, ',') AS pii_columns, CAST(len(c) AS BIGINT) AS n
FROM (SELECT script_id, {pii_columns_sql('code')} AS c FROM v_submissions) WHERE len(c) > 0
""",
        "v_submissions",
    )
)
def pii_columns_by_script(ds: Dataset) -> DataFrame:
    found = corpus.pii_columns_by_subject(ds.view("v_submissions"), "code", "script_id")
    return found.select(
        "script_id", S.joined(F.col("pii_columns")).alias("pii_columns"), F.size("pii_columns").cast("bigint").alias("n")
    )


def _top_sql(name: str, values: str, k: int) -> str:
    return with_views(
        f"SELECT {name}, count(*) AS uses FROM (SELECT unnest({values}) AS {name} FROM v_submissions) "
        f"GROUP BY 1 ORDER BY uses DESC, {name} LIMIT {k}",
        "v_submissions",
    )


@query(_top_sql("transform", transforms_sql("code"), 10))
def top_transforms(ds: Dataset) -> DataFrame:
    return corpus.top(ds.view("v_submissions"), S.transforms(F.col("code")), "transform", 10)


@query(_top_sql("column_name", columns_sql("code"), 10))
def top_columns(ds: Dataset) -> DataFrame:
    return corpus.top(ds.view("v_submissions"), S.columns(F.col("code")), "column_name", 10)


@query(_top_sql("module", imports_sql("code"), 10))
def top_imports(ds: Dataset) -> DataFrame:
    return corpus.top(ds.view("v_submissions"), S.imports(F.col("code")), "module", 10)


def gate_sql() -> str:
    danger = "coalesce(" + ", ".join(
        f"CASE WHEN contains(code, '{w}') THEN '{w}' END" for w in vocab.DANGEROUS
    ) + ")"
    outside = f"list_filter({names_sql('code')}, lambda s: split_part(s, '.', 1) NOT IN {in_list(vocab.GATE_IMPORTS)})"
    return f"""
SELECT script_id, rule IS NULL AS passed,
  CASE WHEN rule = 'SIZE_CHECK' THEN 'E002' WHEN rule IS NOT NULL THEN 'E001' END AS error_code,
  rule AS rule_violated,
  CASE rule
    WHEN 'MISSING_CODE' THEN 'No code was submitted.'
    WHEN 'SIZE_CHECK' THEN 'Input too large: ~' || CAST(length(code) // 4 AS STRING) || ' tokens (limit: 10000). Trim code and retry.'
    WHEN 'DANGEROUS_PATTERN' THEN 'Dangerous pattern detected: `' || danger || '`. Remove it before submitting.'
    WHEN 'DANGEROUS_WRITE' THEN 'File write operations are not permitted in submitted code.'
    WHEN 'NETWORK_CALL' THEN 'Direct network calls are not permitted in submitted code.'
    WHEN 'IMPORT_WHITELIST' THEN 'Import `' || outside[1] || '` is not in the allowed data-engineering import list.'
    WHEN 'PATH_TRAVERSAL' THEN 'Path traversal patterns detected (e.g., `../`, `/etc/`). Remove absolute or traversal paths.'
  END AS error_message,
  CASE WHEN rule IS NULL THEN code END AS sanitized_code
FROM (SELECT *, CASE WHEN code IS NULL THEN 'MISSING_CODE' WHEN length(code) // 4 > 10000 THEN 'SIZE_CHECK'
        WHEN danger IS NOT NULL THEN 'DANGEROUS_PATTERN'
        WHEN regexp_matches(code, {quoted(vocab.WRITE_OPEN)}) THEN 'DANGEROUS_WRITE'
        WHEN regexp_matches(code, {any_of(vocab.NETWORK)}) THEN 'NETWORK_CALL'
        WHEN len(outside) > 0 THEN 'IMPORT_WHITELIST'
        WHEN regexp_matches(code, {any_of(vocab.TRAVERSAL)}) THEN 'PATH_TRAVERSAL' END AS rule
      FROM (SELECT script_id, code, {danger} AS danger, {outside} AS outside FROM v_submissions))
"""


@query(with_views(gate_sql(), "v_submissions"), name="gate")
def gate_scripts(ds: Dataset) -> DataFrame:
    return gate.gate(ds.view("v_submissions")).select(
        "script_id", "passed", "error_code", "rule_violated", "error_message", "sanitized_code"
    )


@query(
    with_views(
        f"SELECT coalesce(rule_violated, 'PASSED') AS rule_violated, count(*) AS n FROM ({gate_sql()}) GROUP BY 1",
        "v_submissions",
    )
)
def gate_stats(ds: Dataset) -> DataFrame:
    return gate.stats(gate.gate(ds.view("v_submissions")))


@query(
    with_views(
        rf"""
SELECT coalesce(rule_violated, 'PASSED') AS rule_violated, count(*) AS n
FROM (SELECT CASE WHEN code IS NULL THEN 'MISSING_CODE' WHEN length(code) // 4 > 10000 THEN 'SIZE_CHECK'
        WHEN regexp_matches(code, {quoted(S.whole_words(vocab.DANGEROUS))}) THEN 'DANGEROUS_PATTERN'
        WHEN regexp_matches(code, {quoted(vocab.WRITE_OPEN)}) THEN 'DANGEROUS_WRITE'
        WHEN regexp_matches(code, {any_of(vocab.NETWORK)}) THEN 'NETWORK_CALL'
        WHEN len(list_filter({names_sql('code')}, lambda s: split_part(s, '.', 1) NOT IN {in_list(vocab.GATE_IMPORTS)})) > 0 THEN 'IMPORT_WHITELIST'
        WHEN regexp_matches(code, {any_of(vocab.TRAVERSAL)}) THEN 'PATH_TRAVERSAL' END AS rule_violated
      FROM v_submissions) GROUP BY 1
""",
        "v_submissions",
    )
)
def gate_stats_strict(ds: Dataset) -> DataFrame:
    return gate.stats(gate.gate(ds.view("v_submissions"), mode="strict"))


@query(
    with_views(
        f"""
SELECT script_id, unnest(list_filter(list_concat(
    list_transform(list_filter({str_list(vocab.DANGEROUS)}, lambda w: contains(code, w)), lambda w: w),
    [CASE WHEN regexp_matches(code, {quoted(vocab.WRITE_OPEN)}) THEN 'write-mode open' END,
     CASE WHEN regexp_matches(code, {any_of(vocab.NETWORK)}) THEN 'network call' END]), lambda w: w IS NOT NULL)) AS pattern
FROM v_submissions
""",
        "v_submissions",
    )
)
def dangerous_patterns(ds: Dataset) -> DataFrame:
    return corpus.dangerous_patterns(ds.view("v_submissions"), "code", "script_id")


def _outside_sql(label: str, allowed) -> str:
    return (
        f"SELECT '{label}' AS allow_list, script_id, m AS module FROM "
        f"(SELECT script_id, unnest({imports_sql('code')}) AS m FROM v_submissions) WHERE m NOT IN {in_list(allowed)}"
    )


@query(
    with_views(
        _outside_sql("gate", vocab.GATE_IMPORTS) + " UNION ALL " + _outside_sql("validator", vocab.VALIDATOR_IMPORTS),
        "v_submissions",
    )
)
def import_violations(ds: Dataset) -> DataFrame:
    lists = {"gate": vocab.GATE_IMPORTS, "validator": vocab.VALIDATOR_IMPORTS}
    return corpus.import_violations(ds.view("v_submissions"), "code", "script_id", lists)


@query(
    with_views(
        r"""
SELECT session_id, id, CASE WHEN regexp_matches(answer, '(?s)```(?:python)?\s*\n(.*?)```')
    THEN regexp_replace(regexp_extract(answer, '(?s)```(?:python)?\s*\n(.*?)```', 1), '^\s+|\s+$', '', 'g')
    ELSE regexp_replace(answer, '^\s+|\s+$', '', 'g') END AS code
FROM v_answers
""",
        "v_answers",
    )
)
def fenced_code(ds: Dataset) -> DataFrame:
    return ds.view("v_answers").select("session_id", "id", T.fenced_code(F.col("answer")).alias("code"))


@query(
    with_views(
        "SELECT script_id, sha256(code) AS content_hash, length(code) AS n_chars FROM v_submissions WHERE code IS NOT NULL",
        "v_submissions",
    )
)
def script_files(ds: Dataset) -> DataFrame:
    """The corpus written as one file per script, and scanned again."""
    path = fresh_path(ds.spark, "scripts")
    write_scripts(ds.view("v_submissions").where("code IS NOT NULL"), path)
    files = read_scripts(ds.spark, path)
    code = F.expr("substr(code, 1, length(code) - 1)")  # the writer closes the last line
    return files.select(
        F.regexp_extract("path", "script_id=([0-9]+)/", 1).cast("bigint").alias("script_id"),
        T.content_hash(code).alias("content_hash"),
        F.length(code).cast("bigint").alias("n_chars"),
    )
