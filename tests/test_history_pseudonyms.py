from __future__ import annotations

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from custodia.functions import masking
from custodia.operators.history import KeyHistory, incremental_unique
from custodia.session import fresh_path
from tests.conftest import rows

RING = masking.Keyring({1: b"one", 2: b"two" * 30})


def plain(value: str, domain: str, version: int) -> str:
    key = hmac.digest(RING.secrets[version], domain.encode(), hashlib.sha256)
    return f"{version}.{hmac.new(key, value.encode(), hashlib.sha256).hexdigest()[:32]}"


def test_pseudonyms_are_hmacs_of_their_domain(spark):
    df = spark.createDataFrame([("é\x1f", 5), ("", None), (None, 7)], "name string, id int")
    got = rows(masking.pseudonymise(df, {"name": "n", "id": "i"}, RING))
    assert got == [(plain("é\x1f", "n", 2), plain("5", "i", 2)), (plain("", "n", 2), None), (None, plain("7", "i", 2))]
    old = masking.pseudonymise(df, {"name": "n"}, RING, version=1).first()["name"]
    assert old == plain("é\x1f", "n", 1) != plain("é\x1f", "i", 1)
    with pytest.raises(ValueError, match="zz"):
        masking.pseudonymise(df, {"zz": "n"}, RING)


def test_masked_tables_join_as_the_plain_ones(spark):
    left = spark.range(50).select("id", (F.col("id") % 7).alias("v"))
    right = spark.range(20, 80).select((F.col("id") % 60).cast("string").alias("ref"))
    want = left.join(right, left["id"] == right["ref"].cast("long")).groupBy("v").count()
    a = masking.pseudonymise(left, {"id": "k"}, RING)
    b = masking.pseudonymise(right, {"ref": "k"}, RING)
    assert rows(a.join(b, a["id"] == b["ref"]).groupBy("v").count(), "v") == rows(want, "v")


def test_rotation_carries_stored_tables_over(spark):
    values = spark.range(5).select(F.col("id"))
    old = masking.pseudonymise(values.unionByName(values), {"id": "k"}, RING, version=1).unionByName(spark.createDataFrame([("1.unknown",), (None,)], "id string"))
    walk = masking.crosswalk(values, "id", "k", RING, old=1, new=2)
    new = [r["id"] for r in masking.rotated(old, "id", walk).collect()]
    assert sorted(x or "" for x in new) == sorted([plain(str(i), "k", 2) for i in range(5)] * 2 + ["1.unknown", ""])


# --- uniqueness against history


def test_incremental_uniqueness_is_exact(spark):
    past = KeyHistory(spark, fresh_path(spark, "history"), ("a", "b"), words=64)
    batch = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, None), (3, None), (9, "z")], "a long, b string")
    assert rows(incremental_unique(past, batch), "a") == [(1, "x", 2, False)]
    stored = spark.range(2000).select((F.col("id") + 5).alias("a"), F.lit("z").alias("b"))
    past.add(stored.where("a < 1000"), "one")
    past.add(stored.where("a >= 1000"), "two")
    past.add(stored.where("a < 1000").unionByName(spark.createDataFrame([(2, "y"), (2, None)], "a long, b string")), "one")
    for _ in range(2):
        assert rows(incremental_unique(past, batch), "a") == [(1, "x", 2, False), (2, "y", 1, True), (9, "z", 1, True)]
    assert incremental_unique(past, batch.limit(0)).collect() == []


def test_only_suspects_go_on(spark):
    past = KeyHistory(spark, fresh_path(spark, "history"), ("id",))
    past.add(spark.range(100_000), "old")
    batch = spark.range(95_000, 200_000)
    found = past.suspects(batch)
    assert 5_000 <= found.count() < 5_400  # what was there, and few of 100,000 others
    assert past.seen(batch).count() == 5_000


def test_a_stopped_add_hides_no_key(spark):
    path = fresh_path(spark, "history")
    past = KeyHistory(spark, path, ("id",))
    past.add(spark.range(10), "a")
    past._placed(spark.range(10, 20)).groupBy("_word").agg(F.bit_or("_bits").alias("_bits")).withColumn("batch_id", F.lit("b")).write.mode(
        "append"
    ).partitionBy("batch_id").parquet(f"{path}/filter")
    assert past.seen(spark.range(5, 15)).count() == 5
    past.add(spark.range(10, 20), "b")
    assert past.seen(spark.range(5, 15)).count() == 10
