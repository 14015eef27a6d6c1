from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custodia.operators import quality as Q
from custodia.operators import rules, store
from custodia.session import cluster_settings, fresh_path
from custodia.sources import writes
from custodia.sources.tables import Dataset, read_table, spread
from tests.conftest import SMALL, rows


def test_suite(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "zz")], "id int, s string")
    suite = [
        Q.not_null("id"), Q.accepted("s", ["a", "b"]), Q.between("id", 1, 1), Q.matches("s", "^[a-z]$"),
        Q.row_count_between(1, 2),
    ]
    got = {r["expectation"]: (r["evaluated"], r["failed"], r["status"]) for r in Q.expect(df, suite).collect()}
    assert got == {
        "not_null(id)": (3, 1, "fail"),
        "accepted(s)": (3, 1, "fail"),
        "between(id)": (3, 1, "fail"),
        "matches(s)": (3, 1, "fail"),
        "row_count": (1, 1, "fail"),
    }


def test_conformity_counts_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, s string")
    got = {r["column_name"]: r["verdict"] for r in Q.conformity(df, "t", [("id", "int", False), ("s", "string", False)]).collect()}
    assert got == {"id": "ok", "s": "nulls"}


def test_projection(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    kept = Q.project(df, ["c", "a"])
    assert kept.df.columns == ["c", "a"] and kept.extra == ("b",)
    with pytest.raises(ValueError, match="zz"):
        Q.project(df, ["a", "zz"])


def test_required_with_default(spark):
    df = spark.createDataFrame([(None, None), ("x", "running")], "id string, status string")
    got = {r["column_name"]: r["status"] for r in Q.check_required(df, ["id"], {"status": "pending"}).collect()}
    assert got == {"id": "fail", "status": "defaulted"}
    assert Q.with_defaults(df, {"status": "pending"}).first()["status"] == "pending"


def test_fingerprint_ignores_order_and_sees_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    b = spark.createDataFrame([(2, None), (1, "x")], "i int, s string")
    c = spark.createDataFrame([(1, "x"), (2, "")], "i int, s string")
    for digest in (Q.row_digest, Q.quick_digest):
        prints = [Q.fingerprint(df, "t", digest=digest).first()["fingerprint"] for df in (a, b, c)]
        assert prints[0] == prints[1] != prints[2]


def test_fingerprints_tell_separators_inside_values(spark):
    pairs = [("a\x1f", "b"), ("a", "\x1fb"), ("\x00", ""), (None, ""), ("", None), ("-", ""), ("1:", "a"), ("1", ":a"), (None, "-"), ("-", None)]
    for digest in (Q.row_digest, Q.quick_digest):
        frames = [spark.createDataFrame([p], "a string, b string") for p in pairs]
        assert len({Q.fingerprint(f, "t", digest=digest).first()["fingerprint"] for f in frames}) == len(pairs)


def test_observed(spark):
    df, watch = Q.observed(spark.range(7).where("id > 2"), "kept")
    df.write.format("noop").mode("overwrite").save()
    assert watch.get["n_rows"] == 4


def test_audit_rules(spark):
    df = Q.with_audit(spark.range(3), "r", "2024-01-01 00:00:00", "src")
    assert {r["status"] for r in rules.audit_columns_filled(df).collect()} == {"pass"}
    assert {r["column_name"]: r["status"] for r in rules.audit_columns_filled(df.drop("_etl_source")).collect()}[
        "_etl_source"
    ] == "fail"
    assert rules.one_timestamp_per_run(df, "_etl_run_id", "_etl_timestamp").first()["status"] == "pass"


def test_ingest(spark):
    raw = spark.createDataFrame([("1", "2.5", "k"), ("x", "1", "k"), (None, "1", "k")], "id string, v string, extra string")
    expected = T.StructType(
        [T.StructField("id", T.IntegerType(), False), T.StructField("v", T.DoubleType()), T.StructField("w", T.StringType())]
    )
    got = writes.ingest(raw, expected)
    assert rows(got.good) == [(1, 2.5, None)]
    assert sorted(r["_reasons"] for r in got.bad.collect()) == ["id:null", "id:type"]
    assert dict(got.drift) == {"w": "missing", "id": "string -> int", "v": "string -> double", "extra": "extra"}


def test_idempotent_write_with_a_hot_partition(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 5)).alias("part"))
    path = fresh_path(spark, "test-idem")
    for _ in range(2):
        writes.write_idempotent(df, path, ["part"])
    writes.write_idempotent(df.where("part = 'p1'"), path, ["part"])
    back = spark.read.parquet(path)
    prints = [Q.fingerprint(d, "t", digest=Q.quick_digest).first() for d in (df, back.select("id", "part"))]
    assert prints[0] == prints[1] and back.count() == 3000


def test_keyed_write_when_rows_change_partition(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 1), (4, "c d", 1), (5, None, 1)], "id long, part string, v int")
    path = fresh_path(spark, "test-keyed")
    moved = spark.createDataFrame([(1, "b", 2), (4, "a", 2), (6, "e", 2), (5, "b", 2)], "id long, part string, v int")
    for batch in (df, moved, moved):
        writes.write_keyed(batch, path, ["part"], ["id"])
    got = spark.read.schema(df.schema).parquet(path).select("id", "part", "v")
    assert rows(got, "id") == [(1, "b", 2), (2, "a", 1), (3, "b", 1), (4, "a", 2), (5, "b", 2), (6, "e", 2)]


def test_lossy_casts_are_quarantined(spark):
    raw = spark.createDataFrame([(1.9, "1.239"), (2.0, "1.50"), (3.0, "1e1"), (None, None)], "a double, b string")
    got = writes.ingest(raw, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DecimalType(6, 2))]))
    assert [r["_reasons"] for r in got.bad.collect()] == ["a:lossy,b:lossy"] and got.good.count() == 3


def test_two_report_types_in_two_calls(spark):
    path = fresh_path(spark, "test-reports")
    df = spark.createDataFrame([(1, "x")], "id long, v string")
    writes.write_reports(df, path, F.struct("id"), F.lit("compliance"))
    writes.write_reports(df, path, F.struct("v"), F.lit("diff"))
    got = writes.read_reports(spark, path, "id long, v string").orderBy("artifact_type").collect()
    assert [(r["artifact_type"], r["report"]["id"], r["report"]["v"]) for r in got] == [("compliance", 1, None), ("diff", None, "x")]


def test_quick_digest_sees_which_column_is_null(spark):
    a = spark.createDataFrame([(None, "x")], "p string, q string")
    b = spark.createDataFrame([("x", None)], "p string, q string")
    assert len({Q.fingerprint(d, "t", digest=Q.quick_digest).first()["fingerprint"] for d in (a, b)}) == 2


def test_transitions_with_ties_nulls_and_times(spark):
    data = [("k", 5, 2, "b"), ("k", 5, 1, "a"), ("k", 6, 3, "c"), ("k", None, 4, "x"), ("k", None, 5, "y"), ("j", None, 1, "z")]
    df = spark.createDataFrame(data, "k string, o int, id int, s string").withColumn("t", F.timestamp_seconds(F.col("o") * 10**6))
    want = [("j", "z", None), ("k", "a", "y"), ("k", "b", "a"), ("k", "c", "b"), ("k", "x", None), ("k", "y", "x")]
    for order in ("o", "t"):
        got = store.transitions(df, "k", order, "s", ties=["id"], chunk=1).select("k", "s", "previous")
        assert rows(got, "k", "s") == want


def test_audit_append_rejects_unknown_severity(spark):
    good = spark.createDataFrame([(1, "INFO")], "id long, severity string")
    bad = spark.createDataFrame([(2, "LOUD")], "id long, severity string")
    path = fresh_path(spark, "test-audit")
    writes.append_audit(good, path)
    with pytest.raises(Exception, match="unknown severity"):
        writes.append_audit(bad, path)
    assert spark.read.parquet(path).count() == 1


def test_upsert_takes_latest(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    updates = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (3, "c", 1)], "k int, v string, at int")
    got = writes.merge_upsert(target, updates, ["k"], [F.desc("at")])
    assert rows(got, "k") == [(1, "a"), (2, "new"), (3, "c")]


def test_declared_schema_is_enforced(spark):
    with pytest.raises(Exception):
        read_table(spark, f"{SMALL}/customer.parquet", "c_custkey boolean").collect()
    assert Dataset(spark, SMALL).table("region").count() == 5


def brute_transitions(data):
    out, last = [], {}
    for key, order, state in sorted(data, key=lambda r: (r[0], r[1])):
        out.append((key, order, state, last.get(key)))
        last[key] = state
    return sorted(out)


@pytest.mark.parametrize("chunk", [1, 7, 100, 10_000])
def test_transitions_equal_brute_force(spark, chunk):
    rng = random.Random(chunk)
    data = [(0 if rng.random() < 0.5 else rng.randrange(1, 20), i, rng.choice("abc")) for i in range(800)]
    df = spark.createDataFrame(data, "k int, i long, s string")
    got = sorted(tuple(r) for r in store.transitions(df, "k", "i", "s", chunk=chunk).collect())
    assert got == brute_transitions(data)


def test_legal_transitions(spark):
    df = spark.createDataFrame(
        [(1, 1, "pending"), (1, 2, "running"), (1, 3, "success"), (2, 1, "pending"), (2, 2, "success")],
        "k int, i long, s string",
    )
    got = {(r["previous"], r["s"]): r["legal"] for r in store.transition_counts(store.transitions(df, "k", "i", "s"), "s").collect()}
    assert got == {("pending", "running"): True, ("running", "success"): True, ("pending", "success"): False}


def test_message_window(spark):
    data = [("s", i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(10)]
    df = spark.createDataFrame(data, "session_id string, id long, role string, content string")
    got = store.message_window(df, n=4).orderBy("position").collect()
    assert [r["content"] for r in got] == ["m6", "m7", "m8", "m9"]
    assert [r["role"] for r in got][:2] == ["user", "assistant"]
    assert store.message_window(df.where("session_id = 'unknown'")).count() == 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_are_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 1, "a")], "session_id long, id long, v string")
    for plan in (plan_of(store.message_window(df)), plan_of(Q.dedup_by_key(df, ["session_id"], ["id"]))):
        assert "Partial" in plan and "WindowGroupLimit" in plan


def test_recent(spark):
    df = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3}") for i in range(5)], "id int, created_at string")
    assert [r["id"] for r in store.recent(df, 3).collect()] == [2, 4, 1]
    assert store.recent(df, 10).count() == 5


def test_trail_order_and_null_data(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "{}"), ("b", 3, None)], "session_id string, id long, event_data string")
    assert [r["id"] for r in store.trail(df).collect()] == [1, 2, 3]
    only = spark.createDataFrame([("a",)], "id string")
    assert [r["id"] for r in store.trail(df, only).collect()] == [1, 2]


def test_artifacts_and_reports(spark):
    sessions = spark.createDataFrame([("s1", "delta_lake", "success"), ("s2", "snowflake", "failed")], "id string, target string, status string")
    artifacts = spark.createDataFrame([("s1", "code", "x"), ("s1", "diff", "y"), ("s3", "code", "z")], "session_id string, artifact_type string, content string")
    assert store.artifacts_of(sessions, artifacts).count() == 2
    assert store.artifacts_of(sessions, artifacts, "code").count() == 1
    reports = spark.createDataFrame([("s1", 2, "high"), ("s1", 1, "low")], "session_id string, no int, risk_level string")
    got = {r["id"]: r["risk_level"] for r in store.report_of(sessions, reports, "no").collect()}
    assert got == {"s1": "low", "s2": None}


def test_budget(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00", 50), ("2024-01-02 10:00:00", 45), ("2024-01-03 10:00:00", 30), ("2024-02-01 10:00:00", 10)], "t string, tokens_used long")
    got = store.budget_running(df.select(F.col("t").cast("timestamp").alias("created_at"), "tokens_used"), 100).orderBy("day").collect()
    assert [(r["used"], r["remaining"], r["alert"]) for r in got] == [(50, 50, False), (95, 5, True), (125, 0, True), (10, 90, False)]


def test_spread_only_touches_small_inputs(spark):
    few = spark.range(0, 100, 1, 1)
    many = spark.range(0, 100, 1, 2)
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(many) is many
    assert cluster_settings(100 * 10**12)["spark.sql.shuffle.partitions"] == "476838"


def test_orphans_ignore_missing_references(spark):
    child = spark.createDataFrame([(1, 10), (2, None), (3, 30)], "id int, parent int")
    parent = spark.createDataFrame([(10,)], "pk int")
    assert rows(Q.orphans(child, parent, "parent", "pk")) == [(3, 30)]


def test_a_repeated_run_without_rows_leaves_none(spark):
    path = fresh_path(spark, "runs")
    rows_of = spark.range(3)
    for run in ("a", "b"):
        writes.write_run(rows_of, path, run)
    writes.write_run(rows_of.limit(0), path, "a")
    assert {r["run_id"] for r in spark.read.parquet(path).collect()} == {"b"}
    writes.write_run(rows_of.where("id = 1"), path, "a")
    assert sorted((r["run_id"], r["id"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 0), ("b", 1), ("b", 2)]


def test_repeating_a_stopped_keyed_write_ends_it(spark):
    path = fresh_path(spark, "keyed")
    old = spark.createDataFrame([(1, "x", "p"), (2, "x", "p"), (3, "y", "p"), (4, "z", "p")], "k int, part string, v string")
    writes.write_keyed(old, path, ["part"], ["k"])
    batch = spark.createDataFrame([(1, "w", "q"), (3, "x", "q"), (4, "z", "q")], "k int, part string, v string")
    # as if the run had stopped between writing the partitions and deleting the emptied one
    writes.write_idempotent(spark.createDataFrame([(1, "w", "q"), (2, "x", "p"), (3, "x", "q"), (4, "z", "q")], old.schema), path, ["part"])
    assert spark.read.parquet(path).where("k = 3").count() == 2
    for _ in range(2):
        writes.write_keyed(batch, path, ["part"], ["k"])
        got = sorted((r["k"], r["part"], r["v"]) for r in spark.read.parquet(path).collect())
        assert got == [(1, "w", "q"), (2, "x", "p"), (3, "x", "q"), (4, "z", "q")]
