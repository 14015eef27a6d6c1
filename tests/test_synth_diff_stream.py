from __future__ import annotations

import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from custodia.functions import script as S
from custodia.operators import diff, synth
from custodia.session import fresh_path, shared_folder
from custodia.streaming import streams
from tests.conftest import rows, scripts


@pytest.mark.parametrize(
    ("name", "token", "reference"),
    [
        ("created_at", "timestamp", "timestamp"),
        ("user_id", "bigint", "bigint"),
        ("order_id", "bigint", "bigint"),
        ("price", "double", "double"),
        ("is_active", "boolean", "boolean"),
        ("status", "string", "timestamp"),
        ("category", "string", "timestamp"),
        ("tax_rate", "double", "timestamp"),
        ("name", "string", "string"),
    ],
)
def test_types_by_name(spark, name, token, reference):
    for mode, expected in (("token", token), ("reference", reference)):
        assert synth.type_by_name(name, mode) == expected
        assert spark.range(1).select(synth.inferred_type(F.lit(name), mode)).first()[0] == expected


def test_inferred_schema_has_all_columns_and_a_default(spark):
    many = " ".join(f"'col_{i:02d}'" for i in range(50))
    df = scripts(spark, many, "nothing quoted")
    got = synth.infer_types(df, S.columns(F.col("code")), "script_id")
    assert got.where("script_id = 0").count() == 50
    assert synth.infer_types(df, S.columns(F.col("code")), "script_id", limit=20).where("script_id = 0").count() == 20
    assert rows(got.where("script_id = 1").select("column_name", "inferred_type")) == [
        ("id", "bigint"), ("value", "string"), ("amount", "double"),
    ]


def test_type_fit_counts_castable(spark):
    df = spark.createDataFrame([("1", 1.5), ("x", 2.0), (None, 3.0)], "id string, price double")
    got = {r["column_name"]: (r["n_values"], r["n_castable"]) for r in synth.type_fit(df, "t", [("id", "bigint"), ("price", "double")], True).collect()}
    assert got == {"id": (2, 1), "price": (3, 3)}


def test_synthetic_rows(spark):
    schema = [("id", "bigint"), ("price", "double"), ("is_x", "boolean"), ("d", "date"), ("t", "timestamp"), ("s", "string")]
    df = synth.synthetic_rows(spark, schema, 10)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema.fields] == schema
    got = df.orderBy("id").collect()
    assert len(got) == 10
    assert tuple(got[2]) == (3, 3.0, True, datetime.date(2020, 1, 3), datetime.datetime(2020, 1, 1, 2), "synthetic_s_2")


def test_contract_check(spark):
    schema = [("id", "bigint"), ("price", "double")]
    ok = synth.contract_check(spark, "ok", lambda d: d.where("id > 5"), schema, 10, schema).first()
    assert (ok["passed"], ok["rows_in"], ok["rows_out"], ok["runtime_error"]) == (True, 10, 5, "")
    bad = synth.contract_check(spark, "bad", lambda d: d.select("nope"), schema, 10, schema).first()
    assert not bad["passed"] and bad["runtime_error"] == "AnalysisException"
    off = synth.contract_check(spark, "off", lambda d: d.select("id"), schema, 10, [("id", "string"), ("price", "double")]).first()
    assert (off["missing"], off["wrong_type"], off["passed"]) == ("price", "id", False)


OLD, NEW = "x = 1\ny = 2\n", "x = 1\ny = 3\nz = 4\n"


def test_line_diff(spark):
    old = scripts(spark, OLD, OLD, OLD, "a\na\nb")
    new = scripts(spark, NEW, OLD, "", "a\nb\r\n")
    got = rows(diff.line_diff(old, new, "script_id", "code"), "script_id", "change", "line")
    assert got == [
        (0, "added", "y = 3", 1), (0, "added", "z = 4", 1), (0, "removed", "y = 2", 1), (3, "removed", "a", 1),
    ]
    counts = rows(diff.diff_counts(old, new, "script_id", "code"), "script_id")
    assert counts == [(0, 2, 1, True), (1, 0, 0, False), (2, 0, 0, False), (3, 0, 1, True)]


def test_keyed_diff(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", None), (3, "z", 3)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "x", 1), (2, "q", 5), (4, "w", 4)], "k int, s string, n int")
    assert rows(diff.keyed_diff(a, b, ["k"]), "k") == [(2, "changed", "s,n"), (3, "removed", None), (4, "added", None)]


def test_table_diff_is_a_multiset_difference(spark):
    a = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    b = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert rows(diff.table_diff(a, b), "k") == [(1, "left", 1), (2, "right", 1)]
    assert a.exceptAll(b).count() == 1 and b.exceptAll(a).count() == 1


def session_like(master: str, **conf: str):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: conf.get(key.replace(".", "_"), default)),
        sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: conf.get("folder")),
    )


def test_shared_folder_is_the_one_the_cluster_names(spark):
    named = session_like("spark://host", spark_checkpoint_dir="hdfs:///shared/")
    assert shared_folder(named) == "hdfs:///shared"
    assert shared_folder(session_like("spark://host", folder="hdfs:///set")) == "hdfs:///set"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session_like("spark://host"))
    assert shared_folder(spark) == shared_folder(spark)
    assert fresh_path(spark, "a") != fresh_path(spark, "a")


def test_late_events_are_dropped_in_append_mode(spark):
    """Batch by batch: an event older than the watermark changes nothing."""
    path = fresh_path(spark, "test-late")
    schema = "id long, event_time timestamp_ntz, severity string"
    batches = [
        [(1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:20:00")],
        [(3, "2024-01-01 09:00:00")],
        [(6, "2024-01-01 10:00:00")],
        [(4, "2024-01-01 00:30:00"), (5, "2024-01-01 20:00:00")],
    ]
    for batch in batches:
        df = spark.createDataFrame(batch, "id long, t string")
        df.select("id", F.col("t").cast("timestamp_ntz").alias("event_time"), F.lit("INFO").alias("severity")).coalesce(
            1
        ).write.mode("append").parquet(path)
    stream = streams.read_stream(spark, path, schema, files_per_batch=1)
    got = rows(streams.run_append(streams.audit_counts(stream), "test-late-out"), "window_start")
    assert (datetime.datetime(2024, 1, 1), "INFO", 2) in got


def test_stream_dedup_with_a_hot_key(spark):
    path = fresh_path(spark, "test-dedup")
    df = spark.range(2000).select(
        "id",
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("input_hash"),
    )
    df.write.parquet(path)
    schema = "id long, ts timestamp_ntz, input_hash string"
    stream = streams.read_stream(spark, path, schema, files_per_batch=1)
    first = streams.first_submissions(stream, "input_hash", "ts", "id", "1 day")
    got = streams.run_append(first.select("input_hash"), "test-dedup-out")
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in df.select("input_hash").distinct().collect())


def test_streams_leave_neighbours_alone(spark):
    base = fresh_path(spark, "test-neighbours")
    spark.range(3).coalesce(1).write.parquet(f"{base}/in")
    spark.range(5).write.parquet(f"{base}/in_old")
    assert streams.run_append(streams.read_stream(spark, f"{base}/in", "id long"), "test-folder").count() == 3
    import glob

    (one,) = glob.glob(f"{base}/in/part-*.parquet")
    assert streams.run_append(streams.read_stream(spark, one, "id long"), "test-file").count() == 3


def test_updates_keep_the_last_row_of_a_key(spark):
    base = fresh_path(spark, "test-updates")
    for no in range(3):
        rows_in = [(f"2024-01-01 0{h}:00:00", "INFO") for h in range(no + 1)]
        spark.createDataFrame(rows_in, "event_time string, severity string").coalesce(1).write.mode("append").parquet(base)
    stream = streams.read_stream(spark, base, "event_time string, severity string", files_per_batch=1)
    got = streams.run_updates(streams.audit_counts(stream, late="10 hours"), "test-updates-out", ["window_start", "severity"])
    assert sorted(r["n"] for r in got.collect()) == [1, 2, 3]


def test_stream_orphans_wait_for_late_parents(spark):
    """As the batch query for what the watermark has passed, whichever side comes first."""
    day = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id as int))")
    children = spark.range(300).select("id", F.when(F.col("id") % 11 != 4, F.col("id") % 40).alias("parent"), day.alias("at"))
    parents = spark.range(40).where("id % 3 <> 0").select("id", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id * 7 as int))").alias("at"))
    paths = [fresh_path(spark, "orphans-in") for _ in range(2)]
    for path, df, order in zip(paths, (children, parents), ("at", "id desc"), strict=True):
        for n in range(4):  # several files, the parents' newest first
            df.where(f"id % 4 = {n}").orderBy(F.expr(order.split()[0])).coalesce(1).write.mode("append").parquet(path)
    ends = "2024-09-01"
    a, b = children.alias("a"), parents.alias("b")
    near = F.expr("a.parent = b.id and b.at between a.at - interval 5 days and a.at + interval 5 days")
    want = a.where("parent is not null").join(b, near, "left_anti").where(F.col("at") < ends)
    child, parent = (streams.read_stream(spark, p, s, files_per_batch=2) for p, s in zip(paths, ("id long, parent long, at timestamp_ntz", "id long, at timestamp_ntz"), strict=True))
    lost = streams.orphans(child, parent, "parent", "id", "at", "at", "5 days", "400 days", "id")
    found = streams.run_append(lost, "orphans-test")
    assert found.count() == 0  # all still wait
    child, parent = (streams.read_stream(spark, p, s) for p, s in zip(paths, ("id long, parent long, at timestamp_ntz", "id long, at timestamp_ntz"), strict=True))
    lost = streams.orphans(child, parent, "parent", "id", "at", "at", "5 days", "1 day", "id")
    found = streams.run_append(lost, "orphans-test").where(F.col("at") < ends)
    assert rows(found, "id") == rows(want, "id") and found.count() > 60


def test_gated_batches_are_not_sorted_by_folder(spark, monkeypatch, tmp_path):
    """Writers of both folders are open at once."""
    batch = spark.newSession().createDataFrame([(1, "x = 1\n"), (2, "import requests\n")], "script_id long, code string")
    monkeypatch.setattr(streams, "run_batches", lambda df, label, write: write(df, 0, str(tmp_path)) or str(tmp_path))
    out = streams.gated(batch, "test-gate")
    assert int(batch.sparkSession.conf.get("spark.sql.maxConcurrentOutputFileWriters")) >= 2
    assert {r["passed"] for r in spark.read.parquet(f"{out}/batch=0").select("passed").collect()} == {"true", "false"}


def test_orphans_state_is_packed(spark):
    """State has a row for a group, not for each of 3,000 children and every copy of 2,000 parents."""
    base = fresh_path(spark, "orphans-state")
    day = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 9 as int))")
    spark.range(3000).select("id", (F.col("id") % 2500).alias("parent"), day.alias("at")).write.parquet(f"{base}/children")
    spark.range(2000).select("id", day.alias("at")).write.parquet(f"{base}/parents")
    child = streams.read_stream(spark, f"{base}/children", "id long, parent long, at timestamp_ntz")
    parent = streams.read_stream(spark, f"{base}/parents", "id long, at timestamp_ntz")
    lost = streams.orphans(child, parent, "parent", "id", "at", "at", "5 days", "1 day", "id")
    run = lost.writeStream.format("noop").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    assert 0 < max(o["numRowsTotal"] for p in run.recentProgress for o in p["stateOperators"]) < 1000


def test_orphans_come_back_as_they_were(spark):
    """Every type and null, a parent at either end of the span, times that pandas doesn't have."""
    base = fresh_path(spark, "orphans-types")
    schema = (
        "k long, at timestamp, n int, big long, d double, m decimal(20,3), s string, b binary, y boolean, day date,"
        " t timestamp_ntz, l array<int>, o struct<t: timestamp_ntz, x: string>"
    )
    rare = "double('NaN'), 1.125BD, '', X'ff00', true, date'0001-01-01', timestamp_ntz'9999-12-31 23:59:59.123456', array(1, null), named_struct('t', timestamp_ntz'2024-01-01 00:00:00.000001', 'x', cast(null as string))"
    none = ", ".join(["null"] * 11)
    last = "timestamp'2024-03-01 00:00:00.000001'"
    spark.sql(
        f"""SELECT * FROM VALUES (1L, timestamp'2024-01-01 00:00:00.000001', 1, 9223372036854775807L, {rare}),
        (2L, timestamp'2024-01-02', {none}), (3L, timestamp'2024-01-06', {none}), (4L, timestamp'2024-01-06', {none}),
        (5L, timestamp'2024-01-06', {none}), (null, timestamp'2024-01-06', {none}), (6L, null, {none}), (7L, {last}, {none}),
        (8L, timestamp'9999-01-01', {none})"""
    ).toDF(*[f.split()[0] for f in schema.replace("struct<t: timestamp_ntz, x: string>", "struct").split(", ")]).write.parquet(f"{base}/children")
    spark.sql(
        """SELECT * FROM VALUES (3L, timestamp'2024-01-11'), (4L, timestamp'2024-01-01'), (5L, timestamp'2024-01-11 00:00:00.000001'),
        (5L, timestamp'2023-12-31 23:59:59.999999'), (1L, null), (2L, timestamp'2024-03-01'), (9L, timestamp'9999-01-01')"""
    ).toDF("k", "at").write.parquet(f"{base}/parents")
    child = streams.read_stream(spark, f"{base}/children", schema)
    parent = streams.read_stream(spark, f"{base}/parents", "k long, at timestamp")
    lost = streams.orphans(child, parent, "k", "k", "at", "at", "5 days", "1 day", "k")
    assert [(f.name, f.dataType) for f in lost.schema] == [(f.name, f.dataType) for f in child.schema]
    want = spark.read.schema(schema).parquet(f"{base}/children").where("k in (1, 2, 5, 7)")
    found = streams.run_append(lost, "orphans-types-out")
    assert found.count() == 4 and found.exceptAll(want).count() == 0 and want.exceptAll(found).count() == 0
