"""Uniqueness of a batch against all that came before, deciding only on suspects.

Beside the keys of a history stands a filter of a fixed number of 64-bit words. A key sets four bits of one word; a key whose
bits aren't all set is new for certain and goes no further. What is left, a small share, meets the stored keys in a join, which
decides. Filters merge by OR, so every batch adds its own, and adding a batch again changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 1 << 20  # 12 MB are broadcast at most, however long the history
_MASK = " | ".join(f"shiftleft(1L, cast(shiftright(_spread, {shift}) & 63 as int))" for shift in (0, 6, 12, 18))


@dataclass(frozen=True)
class KeyHistory:
    """Keys and filter in a folder. ``words`` stays the same over the life of a history."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    words: int = WORDS

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows with the word and the bits of their key."""
        spread = rows.withColumn("_spread", F.xxhash64(F.lit(1), *self.keys))
        placed = spread.withColumn("_word", F.pmod(F.xxhash64(*self.keys), F.lit(self.words)).cast("int"))
        return placed.withColumn("_bits", F.expr(_MASK)).drop("_spread")

    def complete(self) -> Column:
        """Whether no part of the key is null."""
        return reduce(Column.__and__, [F.col(k).isNotNull() for k in self.keys])

    def _exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/keys")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def add(self, batch: DataFrame, batch_id: str) -> None:
        """Store the batch's filter, then its keys; a batch that is added again replaces itself.

        The filter comes first: a run that stops between leaves a filter that suspects more than there is, and no key
        that it doesn't know. Adding the batch again ends it.
        """
        keys = batch.select(*self.keys).where(self.complete()).distinct()
        bits = self._placed(keys).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
        for rows, name in ((bits, "filter"), (keys, "keys")):
            writer = rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("batch_id").parquet(f"{self.path}/{name}")

    def suspects(self, rows: DataFrame) -> DataFrame:
        """Rows whose key may be in the history: all that are, and few others."""
        complete = rows.where(self.complete())
        if not self._exists():
            return complete.limit(0)
        merged = self.spark.read.parquet(f"{self.path}/filter").groupBy("_word").agg(F.bit_or("_bits").alias("_known"))
        placed = self._placed(complete).join(F.broadcast(merged), "_word")
        return placed.where(F.col("_known").bitwiseAND(F.col("_bits")) == F.col("_bits")).select(*rows.columns)

    def seen(self, rows: DataFrame) -> DataFrame:
        """Rows whose key is in the history. Only suspects are shuffled of the rows; the stored keys are read as they lie
        where the suspects are few enough for Spark to broadcast."""
        found = self.suspects(rows)
        if not self._exists():
            return found
        stored = self.spark.read.parquet(f"{self.path}/keys").select(*self.keys)
        # The history is narrowed to the suspects first, from its side; then it is small.
        known = stored.join(found.select(*self.keys).distinct(), list(self.keys), "left_semi")
        return found.join(known, list(self.keys), "left_semi")


def incremental_unique(history: KeyHistory, batch: DataFrame) -> DataFrame:
    """Keys that break uniqueness: the keys, n_batch, seen_before. Keys with nulls are equal to none, and not listed."""
    counted = batch.where(history.complete()).groupBy(*history.keys).agg(F.count(F.lit(1)).alias("n_batch"))
    before = history.seen(counted).select(*history.keys, F.lit(True).alias("seen_before"))
    twice = counted.where("n_batch > 1").join(before, list(history.keys), "left_anti").withColumn("seen_before", F.lit(False))
    return counted.join(before, list(history.keys)).unionByName(twice)

