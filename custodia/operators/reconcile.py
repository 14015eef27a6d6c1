"""Reconciliation of two versions of a keyed table by a tree of digests.

Keys are dealt into buckets by hash, and buckets into fewer, coarser ones. A bucket's digest is a sum over its rows, so
it doesn't depend on their order, combines before the shuffle, and adds up to the digest of the coarser bucket above.
Equal digests mean equal rows; only buckets whose digests differ are read again and compared key by key.

`reconcile` does so with any two frames. `write_digested` stores a version by coarse buckets with its digests
beside it, and `reconcile_written` then compares the stored digests level by level: what is equal is never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia.operators.diff import keyed_diff

COARSE_BITS = 6  # folders of a stored version: 64
FINE_BITS = 16  # digests of a version: 65,536 at most, whatever its size
DIGEST = ["n_rows", "first_sum", "second_sum"]


def fine_bucket(keys: Sequence[str], bits: int = FINE_BITS) -> Column:
    """The bucket of a key; the coarse bucket above it has the upper bits."""
    parts = [part for k in keys for part in (F.col(k), F.col(k).isNull())]
    return F.pmod(F.xxhash64(*parts), F.lit(1 << bits)).cast("int")


def coarse(bucket: Column, bits: int = FINE_BITS, coarse_bits: int = COARSE_BITS) -> Column:
    return F.shiftright(bucket, bits - coarse_bits)


def digests(df: DataFrame, keys: Sequence[str], bits: int = FINE_BITS) -> DataFrame:
    """A row per bucket that has rows: bucket, n_rows, first_sum, second_sum. Two sums of 64-bit hashes, seeded apart."""
    parts = [part for c in sorted(df.columns) for part in (F.col(c), F.col(c).isNull())]
    hashes = [F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)") for seed in (0, 1)]
    rows = df.select(fine_bucket(keys, bits).alias("bucket"), hashes[0].alias("a"), hashes[1].alias("b"))
    sums = [F.sum(c).cast("decimal(38,0)").alias(n) for c, n in (("a", "first_sum"), ("b", "second_sum"))]
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"), *sums)


def level(fine: DataFrame, bits: int = FINE_BITS, coarse_bits: int = COARSE_BITS) -> DataFrame:
    """The digests of the level above, from those below."""
    sums = [F.sum(c).cast(fine.schema[c].dataType).alias(c) for c in DIGEST]
    return fine.groupBy(coarse(F.col("bucket"), bits, coarse_bits).alias("bucket")).agg(*sums)


def unequal(old: DataFrame, new: DataFrame) -> DataFrame:
    """Buckets whose digests differ, those that only one side has included."""
    sides = old.withColumn("_sign", F.lit(-1)).unionByName(new.withColumn("_sign", F.lit(1)))
    nets = [F.sum(F.col(c) * F.col("_sign")).alias(c) for c in DIGEST]
    return sides.groupBy("bucket").agg(*nets).where(" or ".join(f"{c} <> 0" for c in DIGEST)).select("bucket")


def _within(df: DataFrame, buckets: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """The rows in these buckets, before anything is shuffled: at most 2 ** bits numbers are broadcast."""
    marked = df.withColumn("_bucket_of_key", fine_bucket(keys, bits))
    chosen = buckets.select(F.col("bucket").alias("_bucket_of_key"))
    return marked.join(F.broadcast(chosen), "_bucket_of_key", "left_semi").select(*df.columns)


def reconcile(old: DataFrame, new: DataFrame, keys: Sequence[str], bits: int = FINE_BITS) -> DataFrame:
    """Keys that were added, removed, changed or repeated, as ``diff.keyed_diff`` names them; both must have the same columns.

    Two passes over either side. The first shuffles a row per bucket and task, the second only the rows
    of buckets that differ.
    """
    buckets = unequal(digests(old, keys, bits), digests(new.select(*old.columns), keys, bits))
    return keyed_diff(_within(old, buckets, keys, bits), _within(new, buckets, keys, bits), keys)


def write_digested(df: DataFrame, path: str, keys: Sequence[str], bits: int = FINE_BITS, coarse_bits: int = COARSE_BITS) -> None:
    """A version of a table in a folder of its own: rows by coarse bucket, and the digests, which are written last.

    A stopped write has no digests and can't be taken for a whole version; writing again replaces it.
    """
    rows = df.withColumn("coarse_bucket", coarse(fine_bucket(keys, bits), bits, coarse_bits))
    rows.hint("rebalance", "coarse_bucket").write.mode("overwrite").partitionBy("coarse_bucket").parquet(f"{path}/rows")
    digests(written(df.sparkSession, path), keys, bits).coalesce(1).write.mode("overwrite").parquet(f"{path}/digests")


def written(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop("coarse_bucket")


def reconcile_written(
    spark: SparkSession, old_path: str, new_path: str, keys: Sequence[str], bits: int = FINE_BITS, coarse_bits: int = COARSE_BITS
) -> DataFrame:
    """As `reconcile`, of two versions written by `write_digested` with the same keys and bits.

    Coarse digests decide which folders are read, fine ones which of their rows are compared. At most
    2 ** coarse_bits numbers reach the driver.
    """
    fine = [spark.read.parquet(f"{path}/digests") for path in (old_path, new_path)]
    above = unequal(*[level(f, bits, coarse_bits) for f in fine])
    folders = [r["bucket"] for r in above.collect()]
    below = [f.where(coarse(F.col("bucket"), bits, coarse_bits).isin(folders)) for f in fine]
    buckets = unequal(*below)
    sides = [
        spark.read.parquet(f"{path}/rows").where(F.col("coarse_bucket").isin(folders)).drop("coarse_bucket") for path in (old_path, new_path)
    ]
    return keyed_diff(*[_within(s, buckets, keys, bits) for s in sides], keys)
