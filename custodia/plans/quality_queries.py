"""Queries over data quality, governed writes, and integrity."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custodia import vocab
from custodia.functions import text as TX
from custodia.operators import history, rules, sketches
from custodia.operators import quality as Q
from custodia.plans.registry import in_list, query
from custodia.session import fresh_path
from custodia.sources import writes
from custodia.sources.tables import Dataset
from custodia.sources.views import with_views

RUN_ID, RUN_TS = "run-0001", "2024-05-01 00:00:00"

SUITES = {
    "orders": [
        ("not_null(o_orderkey)", "o_orderkey IS NULL", Q.not_null("o_orderkey")),
        ("accepted(o_orderstatus)", "o_orderstatus NOT IN ('F', 'O')", Q.accepted("o_orderstatus", ["F", "O"])),
        ("between(o_totalprice)", "o_totalprice NOT BETWEEN 1000 AND 200000", Q.between("o_totalprice", 1000, 200000)),
        ("matches(o_orderpriority)", "NOT regexp_matches(o_orderpriority, '^[1-4]')", Q.matches("o_orderpriority", "^[1-4]")),
    ],
    "lineitem": [
        ("not_null(l_shipdate)", "l_shipdate IS NULL", Q.not_null("l_shipdate")),
        ("between(l_discount)", "l_discount NOT BETWEEN 0 AND 0.05", Q.between("l_discount", 0, 0.05)),
        ("accepted(l_returnflag)", "l_returnflag NOT IN ('A', 'N')", Q.accepted("l_returnflag", ["A", "N"])),
    ],
}


def _suite_sql() -> str:
    parts = []
    for table, suite in SUITES.items():
        for name, failed, _ in suite:
            parts.append(
                f"SELECT '{table}' AS table_name, '{name}' AS expectation, count(*) AS evaluated, "
                f"count(*) FILTER (WHERE {failed}) AS failed FROM {table}"
            )
        parts.append(
            f"SELECT '{table}', 'row_count', CAST(1 AS BIGINT), "
            f"CAST(count(*) NOT BETWEEN 1 AND 1000000000000 AS BIGINT) FROM {table}"
        )
    return (
        "SELECT *, failed / evaluated AS share, CASE WHEN failed > 0 THEN 'fail' ELSE 'pass' END AS status FROM ("
        + " UNION ALL ".join(parts)
        + ")"
    )


@query(_suite_sql())
def dq_suite(ds: Dataset) -> DataFrame:
    parts = [
        Q.expect(ds.table(t), [e for _, _, e in suite] + [Q.row_count_between(1, 10**12)]).select(
            F.lit(t).alias("table_name"), "*"
        )
        for t, suite in SUITES.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    """
SELECT 'lineitem' AS table_name, l_orderkey AS k1, CAST(l_linenumber AS BIGINT) AS k2, count(*) AS n
FROM lineitem GROUP BY ALL HAVING count(*) > 1
UNION ALL
SELECT 'orders', o_orderkey, NULL, count(*) FROM orders GROUP BY ALL HAVING count(*) > 1
"""
)
def dq_unique(ds: Dataset) -> DataFrame:
    lines = Q.duplicate_keys(ds.table("lineitem"), ["l_orderkey", "l_linenumber"]).select(
        F.lit("lineitem").alias("table_name"),
        F.col("l_orderkey").alias("k1"),
        F.col("l_linenumber").cast("bigint").alias("k2"),
        "n",
    )
    orders = Q.duplicate_keys(ds.table("orders"), ["o_orderkey"]).select(
        F.lit("orders").alias("table_name"), F.col("o_orderkey").alias("k1"), F.lit(None).cast("bigint").alias("k2"), "n"
    )
    return lines.unionByName(orders)


@query(
    with_views(
        f"""
SELECT 'sessions' AS table_name, id, CAST(0 AS BIGINT) AS part, 'target' AS violations FROM v_sessions
WHERE target NOT IN {in_list(vocab.ENUMS['target'])}
UNION ALL
SELECT 'messages', session_id, id, 'role' FROM v_messages WHERE role NOT IN {in_list(vocab.ENUMS['role'])}
""",
        "v_sessions",
        "v_messages",
    )
)
def enum_violations(ds: Dataset) -> DataFrame:
    sessions = Q.check_enums(ds.view("v_sessions"), Q.STORE_ENUMS["sessions"]).select(
        F.lit("sessions").alias("table_name"), "id", F.lit(0).cast("bigint").alias("part"), "violations"
    )
    messages = Q.check_enums(ds.view("v_messages"), Q.STORE_ENUMS["messages"]).select(
        F.lit("messages").alias("table_name"),
        F.col("session_id").alias("id"),
        F.col("id").alias("part"),
        "violations",
    )
    return sessions.unionByName(messages)


@query(
    with_views(
        """
SELECT column_name, n_rows, n_null, default_value,
  CASE WHEN n_null > 0 AND default_value IS NULL THEN 'fail' WHEN n_null > 0 THEN 'defaulted' ELSE 'pass' END AS status
FROM (SELECT 'id' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE id IS NULL) AS n_null, CAST(NULL AS STRING) AS default_value FROM v_sessions
  UNION ALL SELECT 'target', count(*), count(*) FILTER (WHERE target = 'bigquery'), NULL FROM v_sessions
  UNION ALL SELECT 'status', count(*), count(*) FILTER (WHERE status = 'failed'), 'pending' FROM v_sessions)
""",
        "v_sessions",
    )
)
def null_violations(ds: Dataset) -> DataFrame:
    sessions = ds.view("v_sessions").withColumns(
        {
            "target": F.nullif("target", F.lit("bigquery")),
            "status": F.nullif("status", F.lit("failed")),
        }
    )
    return Q.check_required(sessions, ["id", "target"], {"status": "pending"})


RAW_EVENTS = """
SELECT event_id,
  CASE WHEN event_id % 97 = 0 THEN 'n/a' WHEN event_id % 79 = 0 THEN CAST(CAST(value AS DECIMAL(12,2)) AS STRING) || '9' ELSE CAST(CAST(value AS DECIMAL(12,2)) AS STRING) END AS value,
  CASE WHEN event_id % 89 = 0 THEN 'u' || CAST(user_id AS STRING) ELSE CAST(user_id AS STRING) END AS user_id,
  CASE WHEN event_id % 83 = 0 THEN CAST(NULL AS STRING) ELSE event_type END AS event_type,
  props
FROM {events}
"""


def expected_events() -> T.StructType:
    return T.StructType(
        [
            T.StructField("event_id", T.LongType(), False),
            T.StructField("value", T.DecimalType(12, 2), True),
            T.StructField("user_id", T.LongType(), False),
            T.StructField("event_type", T.StringType(), False),
        ]
    )


@query(
    f"""
WITH raw AS ({RAW_EVENTS.format(events='events')})
SELECT event_id, TRY_CAST(value AS DECIMAL(12,2)) AS value, TRY_CAST(user_id AS BIGINT) AS user_id, event_type,
  concat_ws(',', CASE WHEN TRY_CAST(value AS DECIMAL(12,2)) IS NULL THEN 'value:type'
      WHEN TRY_CAST(value AS DECIMAL(38,18)) <> TRY_CAST(value AS DECIMAL(12,2)) THEN 'value:lossy' END,
    CASE WHEN TRY_CAST(user_id AS BIGINT) IS NULL THEN 'user_id:type' END,
    CASE WHEN event_type IS NULL THEN 'event_type:null' END) AS reasons,
  'value=string -> decimal(12,2);user_id=string -> bigint;props=extra' AS drift
FROM raw
"""
)
def ingest_quarantine(ds: Dataset) -> DataFrame:
    raw = ds.spark.sql(RAW_EVENTS, events=ds.table("events"))
    expected = expected_events()
    result = writes.ingest(raw, expected)
    drift = ";".join(f"{c}={what}" for c, what in result.drift)
    return result.all.withColumnRenamed("_reasons", "reasons").withColumn("drift", F.lit(drift))


@query(
    """
SELECT event_id, json_valid(CASE WHEN event_id % 50 = 0 THEN '{' || props ELSE props END) AS ok FROM events
"""
)
def payload_valid(ds: Dataset) -> DataFrame:
    payload = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    return ds.table("events").select("event_id", TX.payload_ok(payload).alias("ok"))


@query(
    """
SELECT * FROM (SELECT CASE WHEN l_partkey % 10 = 0 THEN l_orderkey + 1000000000000 ELSE l_orderkey END AS l_orderkey,
    l_linenumber, l_partkey, l_suppkey FROM lineitem)
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
"""
)
def fk_orphans(ds: Dataset) -> DataFrame:
    """Lines of orders that do not exist; the lines of some parts point to such orders."""
    lost = F.when(F.col("l_partkey") % 10 == 0, F.col("l_orderkey") + 1_000_000_000_000)
    children = ds.table("lineitem").select(
        lost.otherwise(F.col("l_orderkey")).alias("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey"
    )
    return Q.orphans(children, ds.table("orders").select("o_orderkey"), "l_orderkey", "o_orderkey")


@query(
    with_views(
        """
SELECT session_id, line_no, part_no, artifact_type, true AS purged FROM v_artifacts
WHERE session_id IN (SELECT id FROM v_sessions WHERE created_at < DATE '1997-01-01' - INTERVAL 90 DAY)
UNION ALL
SELECT session_id, line_no, part_no, artifact_type, false FROM v_artifacts
WHERE session_id NOT IN (SELECT id FROM v_sessions WHERE created_at < DATE '1997-01-01' - INTERVAL 90 DAY)
""",
        "v_artifacts",
        "v_sessions",
    )
)
def cascade_purge(ds: Dataset) -> DataFrame:
    children = ds.view("v_artifacts").select("session_id", "line_no", "part_no", "artifact_type")
    purged = rules.expired(ds.view("v_sessions"), "created_at", "1997-01-01").select("id")
    return Q.mark_cascade(children, purged, "session_id", "id")


LINE_ORDER = [
    "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
]


@query(
    f"""
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(LINE_ORDER)}) AS r FROM lineitem)
WHERE r = 1
"""
)
def dedup_by_key(ds: Dataset) -> DataFrame:
    return Q.dedup_by_key(ds.table("lineitem"), ["l_orderkey", "l_linenumber"], LINE_ORDER)


def _fingerprint_sql(table: str, columns) -> str:
    parts = " || ".join(f"coalesce(length(CAST({c} AS STRING)) || ':' || CAST({c} AS STRING), '-')" for c in columns)
    return (
        f"SELECT '{table}' AS table_name, count(*) AS n_rows, "
        f"CAST(CAST(sum(CAST(('0x' || substr(sha256({parts}), 1, 15)) AS BIGINT)) AS DECIMAL(38,0)) AS STRING) AS fingerprint FROM {table}"
    )


FINGERPRINTED = {
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
}


@query(" UNION ALL ".join(_fingerprint_sql(t, c) for t, c in FINGERPRINTED.items()))
def dataset_fingerprint(ds: Dataset) -> DataFrame:
    parts = [Q.fingerprint(ds.table(t), t, columns) for t, columns in FINGERPRINTED.items()]
    return reduce(DataFrame.unionByName, parts)


@query(
    """
SELECT 0 AS step_no, 'read' AS step, count(*) AS n_rows FROM orders
UNION ALL SELECT 1, 'active', count(*) FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 2, 'lines', count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'
"""
)
def step_row_counts(ds: Dataset) -> DataFrame:
    lines = ds.table("lineitem").select("l_orderkey")
    return Q.step_counts(
        ds.table("orders").select("o_orderkey", "o_orderstatus"),
        [
            ("active", lambda df: df.where(F.col("o_orderstatus") == "O")),
            ("lines", lambda df: df.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))),
        ],
    )


@query(
    f"""
SELECT *, '{RUN_ID}' AS _etl_run_id, TIMESTAMP '{RUN_TS}' AS _etl_timestamp, 'orders' AS _etl_source FROM orders
"""
)
def audit_columns(ds: Dataset) -> DataFrame:
    return Q.with_audit(ds.table("orders"), RUN_ID, RUN_TS, "orders")


@query("SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN 'moved' ELSE event_type END AS event_type) FROM events")
def idempotent_overwrite(ds: Dataset) -> DataFrame:
    """The whole table; one event type again, which replaces its own partition only; then some rows under another type.

    The last write goes by key, so no event is left in the partition that it came from.
    """
    events = ds.table("events")
    path = fresh_path(ds.spark, "events")
    writes.write_idempotent(events, path, ["event_type"])
    writes.write_idempotent(events.where(F.col("event_type") == "click"), path, ["event_type"])
    moved = events.where(F.col("event_id") % 7 == 0).withColumn("event_type", F.lit("moved"))
    writes.write_keyed(moved, path, ["event_type"], ["event_id"])
    back = ds.spark.read.schema(events.schema).parquet(path)
    return back.select(*events.columns)


UPDATES = """
SELECT CASE WHEN c_custkey % 5 = 0 THEN c_custkey ELSE c_custkey + 100000000000 END AS c_custkey,
  c_name || ' v' || CAST(v AS STRING) AS c_name, c_nationkey, c_acctbal, c_mktsegment, v
FROM {customer}, (VALUES (1), (2)) AS versions(v)
"""


def customer_updates(ds: Dataset) -> DataFrame:
    """Two versions of every customer, every fifth under its own key, the others under new keys."""
    key, version = F.col("c_custkey"), F.col("v")
    return (
        ds.table("customer")
        .withColumn("v", F.explode(F.array(F.lit(1), F.lit(2))))
        .withColumn("c_name", F.concat("c_name", F.lit(" v"), version.cast("string")))
        .withColumn("c_custkey", F.when(key % 5 == 0, key).otherwise(key + 100_000_000_000))
    )


MERGED = """
SELECT * EXCLUDE (v) FROM updates WHERE v = 2
UNION ALL SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM updates)
"""


@query(f"WITH updates AS ({UPDATES.format(customer='customer')}) {MERGED}")
def merge_upsert(ds: Dataset) -> DataFrame:
    return writes.merge_upsert(ds.table("customer"), customer_updates(ds), ["c_custkey"], [F.desc("v")])


@query(with_views("SELECT id, session_id, event_type, event_data, severity FROM v_audit_log", "v_audit_log"))
def audit_append(ds: Dataset) -> DataFrame:
    """The log in two appends, read back."""
    log = ds.view("v_audit_log").select("id", "session_id", "event_type", "event_data", "severity")
    path = fresh_path(ds.spark, "audit")
    writes.append_audit(log.where(F.col("severity") == "INFO"), path)
    writes.append_audit(log.where(F.col("severity") != "INFO"), path)
    return ds.spark.read.schema(log.schema).parquet(path)


@query(
    """
WITH h AS (SELECT user_id, ts FROM events WHERE event_id % 10 < 7),
b AS (SELECT user_id, ts FROM events WHERE event_id % 10 >= 7 UNION ALL SELECT user_id, ts FROM events WHERE event_id % 50 = 3
  UNION ALL SELECT user_id, ts FROM events WHERE event_id % 100 = 8)
SELECT user_id, ts, count(*) AS n_batch, (user_id, ts) IN (SELECT (user_id, ts) FROM h WHERE user_id IS NOT NULL AND ts IS NOT NULL) AS seen_before
FROM b WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id, ts HAVING count(*) > 1 OR seen_before
"""
)
def incremental_unique(ds: Dataset) -> DataFrame:
    """A batch of events, some delivered before and some twice, against a history of two batches."""
    events, key = ds.table("events"), F.col("event_id")
    past = history.KeyHistory(ds.spark, fresh_path(ds.spark, "key-history"), ("user_id", "ts"))
    for name, rows in (("a", key % 10 < 4), ("b", (key % 10 >= 4) & (key % 10 < 7))):
        past.add(events.where(rows), name)
    batch = events.where(key % 10 >= 7).unionByName(events.where(key % 50 == 3)).unionByName(events.where(key % 100 == 8))
    return history.incremental_unique(past, batch)


QUANTILES = (0.5, 0.9, 0.99)
LOG_GROWTH = repr(math.log(sketches.GROWTH))


def _middle_sql(item: str) -> str:
    size = f"pow({sketches.GROWTH!r}, abs({item}) - {sketches._OFFSET}) * {2 / (sketches.GROWTH + 1)!r}"
    digits = f"pow(10.0, 8 - floor(log10({size})))"
    return f"CASE WHEN {item} = 0 THEN 0.0 ELSE sign({item}) * round(({size}) * {digits}) / {digits} END"


@query(
    f"""
WITH e AS (SELECT event_type, value, event_id FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'),
b AS (SELECT event_type, CAST(CASE WHEN value = 0 THEN 0 ELSE sign(value) * (ceil(ln(abs(value)) / {LOG_GROWTH}) + {sketches._OFFSET}) END AS BIGINT) AS item, count(*) AS n
  FROM e WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY item) AS upto, sum(n) OVER (PARTITION BY event_type) AS total FROM b),
q AS (SELECT event_type, CAST(max(total) AS BIGINT) AS n_values, {", ".join(f"min(CASE WHEN upto >= ceil(total * {q}) THEN item END) AS i{round(100 * q)}" for q in QUANTILES)}
  FROM r GROUP BY event_type),
h AS (SELECT DISTINCT event_type, CAST('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 13) AS BIGINT) AS item FROM e),
k AS (SELECT event_type, count(*) AS n, max(item) AS last FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY item) AS nth FROM h) WHERE nth <= 1024 GROUP BY event_type)
SELECT event_type, n_values, {", ".join(f"{_middle_sql(f'i{round(100 * q)}')} AS q{round(100 * q)}" for q in QUANTILES)},
  CAST(CASE WHEN n < 1024 THEN n ELSE round(1023 / ((last + 1) / pow(2, 52))) END AS BIGINT) AS n_distinct
FROM q JOIN k USING (event_type)
"""
)
def profile_merged(ds: Dataset) -> DataFrame:
    """Values and events of some days, from what was stored a day; some days were delivered twice."""
    events = ds.table("events").withColumn("day", F.to_date("ts"))
    path, day = fresh_path(ds.spark, "daily-sketches"), F.col("day")
    for rows in (day < "2024-01-12", day.between("2024-01-10", "2024-01-31")):
        sketches.store_days(events.where(rows), path, "day", ["event_type"], "value", "event_id")
    stored = sketches.read_days(ds.spark, path, "day", "2024-01-05", "2024-01-20")
    return sketches.profile(sketches.merged(stored, ["event_type"]), ["event_type"], QUANTILES)
