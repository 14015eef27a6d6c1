"""Derived inputs: a script corpus, a run store, texts with planted personal data.

The driver tables hold no scripts and no run store, so these views derive both
from them, row by row. ``{name}`` stands for the table or view read; the same
text, with plain names, runs on the checking side.
"""

from __future__ import annotations

V_SCRIPTS = """
SELECT p_partkey AS script_id,
  CASE WHEN p_partkey % 11 = 0 THEN 'import requests' || chr(10)
       WHEN p_partkey % 13 = 0 THEN 'import os' || chr(10) || 'os.system("x")' || chr(10)
       ELSE '' END
  || CASE WHEN p_partkey % 5 = 0 THEN 'from prefect import flow, task' || chr(10)
          || '@flow' || chr(10) || 'def job_' || CAST(p_partkey % 50 AS STRING) || '():' || chr(10) || '    pass' || chr(10)
          ELSE '' END
  || 'from pyspark.sql import SparkSession' || chr(10)
  || 'df = spark.read.parquet("/data/in")' || chr(10)
  || CASE p_partkey % 4
       WHEN 0 THEN 'df = df.select("email", "name")'
       WHEN 1 THEN 'df = df.select("*")'
       WHEN 2 THEN 'df = df.filter(F.col("status") == "active")'
       ELSE 'df = df.groupBy("region").agg(F.sum("amount"))' END || chr(10)
  || CASE WHEN p_partkey % 8 = 0 THEN 'df = df.withColumn("email", mask_pii("email"))' || chr(10) ELSE '' END
  || CASE WHEN p_partkey % 3 = 0 THEN 'df = df.withColumn("_etl_run_id", r)' || chr(10)
          || 'df = df.withColumn("_etl_timestamp", t)' || chr(10)
          || 'df = df.withColumn("_etl_source", s)' || chr(10) ELSE '' END
  || CASE WHEN p_partkey % 7 = 0 THEN 'df = df.withColumn("t", F.current_timestamp())' || chr(10) ELSE '' END
  || CASE WHEN p_partkey % 6 = 0 THEN '# DATA RETENTION: 90 days' || chr(10) ELSE '' END
  || CASE WHEN p_partkey % 9 = 0 THEN '# encrypted at rest' || chr(10) ELSE '' END
  || CASE WHEN p_partkey % 10 = 0 THEN '# transfer to overseas region' || chr(10) ELSE '' END
  || CASE WHEN p_partkey % 12 = 0 THEN 'schema = StructType([])' || chr(10) ELSE '' END
  || CASE p_partkey % 3
       WHEN 0 THEN 'df.write.mode("overwrite").save("/data/out")'
       WHEN 1 THEN 'df.write.mode("append").save("/data/out")'
       ELSE 'df.write.mode("append").save("../out")' END || chr(10) AS code
FROM {part}
"""

V_SCRIPTS_V2 = """
SELECT script_id,
  CASE WHEN script_id % 2 = 0
       THEN replace(code, 'mode("append")', 'mode("overwrite")') || '# revised' || chr(10)
       ELSE code END AS code
FROM {v_scripts}
"""

# the corpus plus what it lacks: file writes, network calls, lists of imports, oversize texts, statements over
# several lines, names beyond ASCII, functions with nested defaults and spaced-out decorators, no script at all
V_SUBMISSIONS = """
SELECT script_id,
  CASE WHEN script_id % 17 = 0 THEN 'f = open("/tmp/file", "w")' || chr(10)
       WHEN script_id % 19 = 0 THEN 'r = urllib.request.urlopen(u)' || chr(10)
       WHEN script_id % 23 = 0 THEN 'import json, flask.views as fv, os.path' || chr(10)
       WHEN script_id % 29 = 0 THEN 'retrieval = eval("1")' || chr(10)
       WHEN script_id % 31 = 0 THEN 'p = "/etc/passwd"' || chr(10)
       WHEN script_id % 37 = 0 THEN repeat('# filler line' || chr(10), 3000)
       WHEN script_id % 41 = 0 THEN 'from ..shared.utils import helper; import numpy as np' || chr(10)
       WHEN script_id % 43 = 0 THEN 'import json, ' || chr(92) || chr(10) || '  requests' || chr(10)
       WHEN script_id % 47 = 0 THEN '# a comment ' || chr(92) || chr(10) || 'from ' || chr(92) || chr(10) || '  httpx import get' || chr(10)
       WHEN script_id % 53 = 0 THEN 'import ｒequests, é.f' || chr(10)
       WHEN script_id % 59 = 0 THEN 'from flask import a' || chr(10) || 'import requests' || chr(10)
       WHEN script_id % 61 = 0 THEN '@task' || chr(10) || '# a note' || chr(10) || chr(10) || '@utils.logged  # twice' || chr(10)
            || 'def load(a=(1, 2), b=3, *, c=4):' || chr(10) || '    pass' || chr(10) || chr(10) || '@flow' || chr(10) || chr(10)
            || 'def run(x=lit(0), y: Dict[str, int] = {{}}, z=max((1, 2), 3)):' || chr(10) || '    return load()' || chr(10)
       WHEN script_id % 67 = 0 THEN NULL
       ELSE '' END || code AS code
FROM {v_scripts}
"""

# scripts whose strings, docstrings and comments hold what looks like statements
V_QUOTED = """
SELECT script_id,
  CASE WHEN script_id % 2 = 0 THEN repeat('"', 3) || 'Use:' || chr(10) || 'import requests' || chr(10) || '@flow' || chr(10) || 'def fake(a):' || chr(10)
            || 'it''s "quoted" here' || chr(10) || repeat('"', 3) || chr(10) ELSE '' END
  || CASE WHEN script_id % 3 = 0 THEN 's = ''import os; x''; t = "from a import b"  # don''t import re' || chr(10) || '# it''s "email"' || chr(10) ELSE '' END
  || CASE WHEN script_id % 5 = 0 THEN 'rows = frame(' || chr(10) || 'a' || chr(10) || '@b)' || chr(10) || 'def real(x=")", y=(1, [2, 3]), *, z=''('') -> str:'
            || chr(10) || '    return ' || repeat('''', 3) || chr(10) || 'from httpx import get' || chr(10) || '@task' || chr(10) || repeat('''', 3) || chr(10) ELSE '' END
  || CASE WHEN script_id % 7 = 0 THEN '@task' || chr(10) || 'def wide(' || chr(10) || '    first: int,  # the (first' || chr(10) || '    second="a,b",' || chr(10)
            || '):' || chr(10) || '    import json' || chr(10) || 'x = "a' || chr(92) || '"b"; import csv' || chr(10) ELSE '' END
  || code AS code
FROM {v_submissions}
"""

# scripts that pass columns from dataset to dataset, some in a ring, with datasets named in comments and docstrings
V_JOBS = """
SELECT p_partkey AS script_id,
  repeat('"', 3) || 'Reads spark.read.parquet("/doc/none")' || repeat('"', 3) || chr(10)
  || '# df.write.save("/comment/none")' || chr(10)
  || CASE p_partkey % 3 WHEN 0 THEN 'df = spark.read.option("mergeSchema", "true").parquet("/lake/t' || CAST(p_partkey % 37 AS STRING) || '")'
       WHEN 1 THEN 'df = spark.table("t' || CAST(p_partkey % 29 AS STRING) || '")'
       ELSE 'df = spark.read.format("csv").load("/lake/t' || CAST(p_partkey % 41 AS STRING) || '")' END || chr(10)
  || CASE WHEN p_partkey % 8 = 0 THEN 'other = spark.read.json("/lake/t' || CAST(p_partkey % 23 AS STRING) || '")' || chr(10) ELSE '' END
  || CASE p_partkey % 5 WHEN 0 THEN 'df = df.select("email", "name")' WHEN 1 THEN 'df = df.filter(F.col("status") == "active")'
       WHEN 2 THEN 'df = df.groupBy("region").agg(F.sum("amount"))' WHEN 3 THEN 'df = df.select("region", "email")'
       ELSE CASE WHEN p_partkey % 35 = 4 THEN 'df = df.select("*")' ELSE 'df = df.select("ssn")' END END || chr(10)
  || CASE p_partkey % 4 WHEN 0 THEN 'df.write.mode("append").save("/lake/t' || CAST((p_partkey * 7 + 3) % 43 AS STRING) || '")'
       WHEN 1 THEN 'df.write.saveAsTable("t' || CAST((p_partkey + 11) % 31 AS STRING) || '")'
       WHEN 2 THEN 'df.write.partitionBy("day").parquet("/lake/t' || CAST((p_partkey + 1) % 47 AS STRING) || '")'
       ELSE 'df.show()' END || chr(10) AS code
FROM {part} WHERE p_partkey % 6 <> 5
"""

V_SESSIONS = """
SELECT o_orderkey AS id, o_orderdate AS created_at,
  CAST(o_custkey AS STRING) || '|' || o_orderpriority AS input_text,
  CASE WHEN o_orderkey % 2 = 0 THEN 'pyspark' ELSE 'prefect' END AS input_type,
  CASE WHEN o_orderkey % 17 = 0 THEN 'bigquery' WHEN o_orderkey % 3 = 0 THEN 'snowflake' ELSE 'delta_lake' END AS target,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  CAST(o_custkey % 16000 AS BIGINT) AS tokens_used,
  8000 AS token_budget,
  CASE o_orderkey % 5 WHEN 0 THEN 'gdpr' WHEN 1 THEN ' SOX , hipaa' WHEN 2 THEN 'gdpr,hipaa,sox'
       WHEN 3 THEN '' ELSE 'hipaa,,GDPR ' END AS profiles
FROM {orders}
"""

# runs that repeat others, some in a ring
V_RERUNS = """
SELECT id, status, tokens_used,
  CASE id % 10 WHEN 1 THEN id + 2 WHEN 3 THEN id + 4 WHEN 7 THEN id - 6 WHEN 4 THEN id - 1 WHEN 5 THEN id - 1 WHEN 6 THEN id - 1 END AS rerun_of
FROM {v_sessions}
"""

V_ARTIFACTS = """
SELECT l_orderkey AS session_id, l_linenumber AS line_no, l_partkey AS part_no, l_suppkey AS supp_no,
  CASE l_linenumber WHEN 1 THEN 'code' WHEN 2 THEN 'diff' WHEN 3 THEN 'compliance' WHEN 4 THEN 'validation' ELSE 'zip' END AS artifact_type,
  'part ' || CAST(l_partkey AS STRING) AS content, l_shipdate AS created_at
FROM {lineitem}
"""

V_AUDIT_LOG = """
SELECT event_id AS id, user_id AS session_id, event_type, props AS event_data, ts AS event_time,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS severity
FROM {events}
"""

# the same log with run states in place of event types, for the lifecycle checks
V_RUN_STATES = """
SELECT id, session_id, event_time,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'view' THEN 'running'
       WHEN 'purchase' THEN 'success' ELSE 'failed' END AS status
FROM {v_audit_log}
"""

V_MESSAGES = """
SELECT conv_id AS session_id, turn AS id, role, text AS content FROM {conversations}
"""

# answers of an assistant, some with a fenced block
V_ANSWERS = """
SELECT conv_id AS session_id, turn AS id,
  CASE turn % 3 WHEN 0 THEN 'Here it is:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'done ```x```'
                WHEN 1 THEN '```' || chr(10) || text || chr(10) || '```'
                ELSE '  ' || text || chr(10) END AS answer
FROM {conversations}
"""

V_PLANTED = """
SELECT c_custkey AS id,
  CASE c_custkey % 9
    WHEN 0 THEN 'ssn 123-45-' || CAST(1000 + c_custkey % 9000 AS STRING)
    WHEN 1 THEN 'mail user' || CAST(c_custkey AS STRING) || '@example.com'
    WHEN 2 THEN 'call 555-123-' || CAST(1000 + c_custkey % 9000 AS STRING)
    WHEN 3 THEN 'card 4111111111111111'
    WHEN 4 THEN 'host 192.168.1.' || CAST(c_custkey % 256 AS STRING)
    WHEN 5 THEN 'doc AB' || CAST(1000000 + c_custkey AS STRING)
    WHEN 6 THEN 'iban GB82WEST12345698765432'
    WHEN 7 THEN 'NPI 1234567890'
    WHEN 8 THEN CASE WHEN c_custkey % 2 = 0 THEN 'from john.smith-123-45-6789@corp.com' ELSE 'nothing here' END
    ELSE 'nothing here' END AS text
FROM {customer}
"""

# quoted literals that name places, for the term scan
V_NOTES = """
SELECT c_custkey AS id,
  'memo "' || c_name || ' moved to ' || n_name || ' in spring" see "' || n_name || '" or "'
  || c_mktsegment || ' desk, ' || r_name || '"' AS text
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

V_TERMS = """
SELECT n_name AS term, 'GPE' AS label FROM {nation}
UNION ALL SELECT r_name AS term, 'LOC' AS label FROM {region}
UNION ALL SELECT DISTINCT c_mktsegment AS term, 'ORG' AS label FROM {customer}
UNION ALL SELECT DISTINCT c_mktsegment || ' desk' AS term, 'ORG' AS label FROM {customer}
UNION ALL SELECT n_name || ' in spring' AS term, 'EVENT' AS label FROM {nation}
"""

# name -> (SQL text, inputs)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "v_scripts": (V_SCRIPTS, ("part",)),
    "v_scripts_v2": (V_SCRIPTS_V2, ("v_scripts",)),
    "v_submissions": (V_SUBMISSIONS, ("v_scripts",)),
    "v_quoted": (V_QUOTED, ("v_submissions",)),
    "v_jobs": (V_JOBS, ("part",)),
    "v_sessions": (V_SESSIONS, ("orders",)),
    "v_reruns": (V_RERUNS, ("v_sessions",)),
    "v_artifacts": (V_ARTIFACTS, ("lineitem",)),
    "v_audit_log": (V_AUDIT_LOG, ("events",)),
    "v_run_states": (V_RUN_STATES, ("v_audit_log",)),
    "v_messages": (V_MESSAGES, ("conversations",)),
    "v_answers": (V_ANSWERS, ("conversations",)),
    "v_planted": (V_PLANTED, ("customer",)),
    "v_notes": (V_NOTES, ("customer", "nation", "region")),
    "v_terms": (V_TERMS, ("nation", "region", "customer")),
}


def with_views(body: str, *names: str) -> str:
    """Checking SQL: put the named views, and the views they read, before the body."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for i in VIEWS[name][1]:
                visit(i)
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({VIEWS[n][0].format(**{i: i for i in VIEWS[n][1]}).strip()})" for n in ordered]
    text = body.strip()
    if text[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + text[5:]
    return "WITH " + ",\n".join(parts) + "\n" + text
