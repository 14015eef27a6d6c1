"""A key that holds a third of the rows: joins split it, and results stay whole."""

from __future__ import annotations

import contextlib

import pytest
from pyspark.sql import functions as F

from custodia.operators import diff, quality, store
from custodia.plans import jobs

LARGE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}


@contextlib.contextmanager
def as_if_large(spark):
    """Thresholds lowered so that small tables are treated like large ones."""
    before = {k: spark.conf.get(k, None) for k in LARGE}
    for k, v in LARGE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lines(spark):
    """200,000 lines of 5,000 orders; a third belongs to order 0, a third to supplier 0."""
    i = F.col("id")
    return spark.range(0, 200_000, 1, 8).select(
        F.when(i % 3 == 0, 0).otherwise(i % 5000).alias("l_orderkey"),
        F.when(i % 3 == 1, 0).otherwise(i % 100).alias("l_suppkey"),
        (i % 7 + 1).cast("int").alias("l_linenumber"),
        (F.col("id") % 1000).cast("double").alias("l_extendedprice"),
        F.lit(0.0).alias("l_discount"),
    )


def test_artifacts_of_a_hot_run(spark, lines):
    sessions = spark.range(5000).select("id", F.lit("delta_lake").alias("target"), F.lit("success").alias("status"))
    artifacts = lines.select(
        F.col("l_orderkey").alias("session_id"), F.lit("code").alias("artifact_type"), F.sha2(F.col("l_suppkey").cast("string"), 256).alias("content")
    )
    with as_if_large(spark):
        joined = store.artifacts_of(sessions, artifacts, "code")
        assert len(joined.collect()) == 200_000
        assert "skew=true" in final_plan(joined)


def test_orphans_of_a_hot_parent(spark, lines):
    parents = spark.range(1, 5000).select(F.col("id").alias("o_orderkey"))
    with as_if_large(spark):
        lost = quality.orphans(lines, parents, "l_orderkey", "o_orderkey")
        assert len(lost.collect()) == lines.where("l_orderkey = 0").count()
        assert "skew=true" in final_plan(lost)


def test_flows_with_a_hot_order_and_a_hot_supplier(spark, lines):
    orders = spark.range(5000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 50).alias("o_custkey"))
    customer = spark.range(50).select(F.col("id").alias("c_custkey"), (F.col("id") % 4).cast("int").alias("c_nationkey"))
    supplier = spark.range(100).select(F.col("id").alias("s_suppkey"), (F.col("id") % 4).cast("int").alias("s_nationkey"))
    nation = spark.range(4).select(
        F.col("id").cast("int").alias("n_nationkey"), (F.col("id") % 2).cast("int").alias("n_regionkey")
    )
    region = spark.createDataFrame([(0, "EAST"), (1, "WEST")], "r_regionkey int, r_name string")

    def nation_of(key: str, mod: int):
        return F.col(key) % mod % 4 % 2

    expected = {
        (r["c"], r["s"]): r["n"]
        for r in lines.select(
            nation_of("l_orderkey", 50).alias("c"), nation_of("l_suppkey", 100).alias("s")
        ).where("c <> s").groupBy("c", "s").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    with as_if_large(spark):
        flows = jobs.cross_border_flows(orders, lines, customer, supplier, nation, region)
        got = {
            (int(r["customer_region"] == "WEST"), int(r["supplier_region"] == "WEST")): r["n_lines"]
            for r in flows.collect()
        }
        assert got == expected
        assert "skew=true" in final_plan(flows)


def test_hot_key_reaches_the_shuffle_as_few_rows(spark, lines):
    """Deduplication and latest values hand over one row per key and task, not the key's rows."""
    deduped = quality.dedup_by_key(lines, ["l_orderkey"], ["l_suppkey", "l_linenumber", "l_extendedprice"])
    assert len(deduped.collect()) == lines.select("l_orderkey").distinct().count()
    newest = store.latest(lines.withColumn("at", F.col("l_extendedprice").cast("long")), "l_orderkey", "at", "l_linenumber")
    assert len(newest.collect()) == lines.select("l_orderkey").distinct().count()


def test_copies_of_a_key_do_not_multiply_in_diffs(spark):
    copies = spark.range(3000).select(F.lit(1).alias("id"), F.lit("a\nb").alias("code"))
    one = spark.createDataFrame([(1, "a\nc"), (2, "new")], "id int, code string")
    got = sorted(tuple(r) for r in diff.line_diff(copies, one, "id", "code").collect())
    # Every copy counts, once: 3000 texts became one.
    assert got == [(1, "added", "c", 1), (1, "removed", "a", 2999), (1, "removed", "b", 3000), (2, "added", "new", 1)]
    keyed = sorted(tuple(r) for r in diff.keyed_diff(copies, one, ["id"]).collect())
    assert keyed == [(1, "changed", "code"), (2, "added", None)]


def test_a_diff_shuffles_once(spark):
    old = spark.createDataFrame([(1, "a")], "id int, code string")
    with as_if_large(spark):
        plan = diff.line_diff(old, old, "id", "code")
        plan.collect()
        assert final_plan(plan).split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
