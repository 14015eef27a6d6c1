"""Erasure closures against a plain search, reconciliation against the keyed difference."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from custodia.operators import erasure, reconcile
from custodia.operators.diff import keyed_diff
from custodia.operators.erasure import ForeignKey, Table
from custodia.session import fresh_path
from tests.conftest import rows


def plain_closure(data, keys, seeds):
    """data: table -> {row_key: row}; the least depth of every row that is found, and whether it goes."""
    found = {(t, k): ["delete", 0] for t, ks in seeds.items() for k in ks}
    frontier, depth = set(found), 0
    while frontier:
        depth += 1
        new = set()
        for t, k in frontier:
            for fk in keys:
                if fk.parent != t:
                    continue
                value = data[t][k][fk.parent_column]
                for child, row in data[fk.child].items():
                    if value is None or row[fk.column] != value:
                        continue
                    old = found.get((fk.child, child))
                    if old is None:
                        found[(fk.child, child)] = [fk.action, depth]
                    elif old[0] == "retain" and fk.action == "delete":
                        old[0] = "delete"
                    else:
                        continue
                    if fk.action == "delete":
                        new.add((fk.child, child))
        frontier = new
    return sorted((t, k, a, d) for (t, k), (a, d) in found.items())


KEYS = [
    ForeignKey("a", "up", "a", "id"),
    ForeignKey("b", "a_id", "a", "id"),
    ForeignKey("a", "b_code", "b", "code"),
    ForeignKey("c", "b_code", "b", "code"),
    ForeignKey("log", "a_id", "a", "id", erasure.RETAIN),
    ForeignKey("log", "c_id", "c", "id"),
]


def test_closure_over_rings_and_own_references(spark):
    for seed in range(3):
        rng = random.Random(seed)

        def some(n, rng=rng):
            return rng.choice([None, *range(n)])

        a = [(i, rng.choice([None, i, *range(30)]), rng.choice([None, "x1", "x2", "x7"])) for i in range(30)]
        b = [(i, some(30), f"x{i}") for i in range(20)]
        c = [(i, rng.choice([None, *[f"x{n}" for n in range(20)]])) for i in range(25)]
        log = [(i, some(30), some(25)) for i in range(40)]
        frames = {
            "a": spark.createDataFrame(a, "id int, up int, b_code string"),
            "b": spark.createDataFrame(b, "id int, a_id int, code string"),
            "c": spark.createDataFrame(c, "id int, b_code string"),
            "log": spark.createDataFrame(log, "id int, a_id int, c_id int"),
        }
        data = {n: {str(r["id"]): r.asDict() for r in f.collect()} for n, f in frames.items()}
        tables = {n: Table(f, ("id",)) for n, f in frames.items()}
        got = erasure.erasure_set(tables, KEYS, {"a": frames["a"].where("id in (3, 8)"), "c": frames["c"].where("id = 1")})
        assert rows(got, "table_name", "row_key") == sorted(plain_closure(data, KEYS, {"a": ["3", "8"], "c": ["1"]}), key=lambda r: r[:2])
        kept = erasure.remaining(tables["log"], "log", got)
        gone = {r["row_key"] for r in got.where("table_name = 'log' and action = 'delete'").collect()}
        assert {str(r["id"]) for r in kept.collect()} == set(data["log"]) - gone


def test_long_chain_and_repeated_rows(spark):
    chain = spark.range(25).select("id", (F.col("id") - 1).alias("up"))
    tables = {"t": Table(chain.unionByName(chain), ("id",))}
    got = erasure.erasure_set(tables, [ForeignKey("t", "up", "t", "id")], {"t": chain.where("id = 5")})
    assert sorted((int(k), d) for _, k, _, d in rows(got)) == [(5 + n, n) for n in range(20)]


def test_tables_outside_rings_are_joined_once(spark, monkeypatch):
    """Only the chain's table goes round by round; the children's depths are those of their nearest parents."""
    chain = spark.range(4).select("id", (F.col("id") - 1).alias("up"))
    children = spark.createDataFrame([(1, 0), (2, 3), (3, 2), (3, 1), (4, None)], "id int, t_id int")
    written, write = [], erasure._written
    monkeypatch.setattr(erasure, "_written", lambda df: written.append(df) or write(df))
    keys = [ForeignKey("t", "up", "t", "id"), ForeignKey("b", "t_id", "t", "id")]
    got = erasure.erasure_set({"t": Table(chain, ("id",)), "b": Table(children, ("id",))}, keys, {"t": chain.where("id = 0")})
    assert sorted((k, d) for t, k, _, d in rows(got) if t == "b") == [("1", 1), ("2", 4), ("3", 2)]
    assert len(written) <= 6


def test_no_seeds(spark):
    t = Table(spark.range(3), ("id",))
    assert erasure.erasure_set({"t": t}, [], {"t": t.rows.limit(0)}).collect() == []


def test_composite_keys_do_not_collide(spark):
    df = spark.createDataFrame([("1", "11"), ("11", "1"), (None, "a"), ("-", "a"), ("a", None)], "x string, y string")
    keys = [r[0] for r in df.select(Table(df, ("x", "y")).row_key()).collect()]
    assert len(set(keys)) == 5


# --- reconciliation


def versions(spark, n=4000):
    old = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("s"), F.lit(None).cast("int").alias("m"))
    changed = F.when(F.col("k") % 500 == 3, "new").otherwise(F.col("s"))
    new = old.withColumn("s", changed).withColumn("m", F.when(F.col("k") == 77, 1)).where("k <> 10")
    return old, new.unionByName(spark.createDataFrame([(-1, "x", 1), (20, "again", 2)], "k long, s string, m int"))


@pytest.mark.parametrize("bits", [2, 16])
def test_reconcile_is_the_keyed_difference(spark, bits):
    old, new = versions(spark)
    want = rows(keyed_diff(old, new, ["k"]), "k")
    assert len(want) == 12 and rows(reconcile.reconcile(old, new.select("m", "k", "s"), ["k"], bits), "k") == want
    assert reconcile.reconcile(old, old.repartition(3), ["k"], bits).collect() == []


def test_null_keys_repeated_rows_and_empty_sides(spark):
    old = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (2, "c")], "k int, s string")
    new = spark.createDataFrame([(None, "z"), (1, "b"), (2, "c"), (2, "d")], "k int, s string")
    assert rows(reconcile.reconcile(old, new, ["k"]), "k") == rows(keyed_diff(old, new, ["k"]), "k") == [(None, "changed", "s"), (2, "repeated", None)]
    assert len(reconcile.reconcile(old, new.limit(0), ["k"]).collect()) == 3
    assert reconcile.reconcile(old.limit(0), new.limit(0), ["k"]).collect() == []


def test_levels_add_up(spark):
    old, _ = versions(spark)
    fine = reconcile.digests(old, ["k"], 8)
    direct = reconcile.digests(old, ["k"], 8).groupBy(F.shiftright("bucket", 5).alias("bucket")).agg(*[F.sum(c).alias(c) for c in reconcile.DIGEST])
    above = reconcile.level(fine, 8, 3)
    assert rows(above, "bucket") == rows(direct, "bucket") and above.agg(F.sum("n_rows")).first()[0] == 4000


def test_written_versions_read_only_unequal_folders(spark):
    old, new = versions(spark)
    new = new.where("k <> 20 or s = '6'").where("k not in (3, 503, 1003)").unionByName(old.where("k in (3, 503, 1003)"))
    paths = [fresh_path(spark, "version") for _ in range(2)]
    for path, df in zip(paths, (old, new), strict=True):
        reconcile.write_digested(df, path, ["k"])
    found = reconcile.reconcile_written(spark, *paths, ["k"])
    assert rows(found, "k") == rows(keyed_diff(old, new, ["k"]), "k")
    folders = {r[0] for r in keyed_diff(old, new, ["k"]).select(reconcile.coarse(reconcile.fine_bucket(["k"]))).collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    pruned = re.findall(r"PartitionFilters: \[[^\]]*coarse_bucket#\d+ IN \(([\d,]+)\)|PartitionFilters: \[[^\]]*\(coarse_bucket#\d+ = (\d+)\)", plan)
    assert len(pruned) == 2 and all({int(n) for n in (some or one).split(",")} == folders for some, one in pruned)
    assert 0 < len(folders) < 12


def test_unequal_rows_alone_are_shuffled(spark):
    """The rows that reach the second shuffle are those of unequal buckets."""
    old, new = versions(spark, 20_000)
    buckets = reconcile.unequal(reconcile.digests(old, ["k"]), reconcile.digests(new, ["k"]))
    kept = reconcile._within(old, buckets, ["k"], reconcile.FINE_BITS).count()
    assert buckets.count() <= 45 and kept < 100


def test_a_stopped_write_is_no_version(spark):
    old, _ = versions(spark, 50)
    path = fresh_path(spark, "version")
    old.withColumn("coarse_bucket", F.lit(0)).write.partitionBy("coarse_bucket").parquet(f"{path}/rows")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        reconcile.reconcile_written(spark, path, path, ["k"])
    reconcile.write_digested(old, path, ["k"])
    assert reconcile.reconcile_written(spark, path, path, ["k"]).collect() == []
