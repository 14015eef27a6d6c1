"""Mergeable profiles: quantiles and distinct counts of any span of days from what was stored a day.

Quantiles come from counts over buckets whose edges grow by a constant factor, so every estimate is within a stated
relative error of the exact value. Distinct counts come from the k least hashes of the values: exact below k,
and beyond it with a standard error of about 1 / sqrt(k). Both merge without the rows: counts add up, and
the k least of several days are among the k least of each.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from custodia.sources.writes import write_idempotent

RELATIVE_ERROR = 0.01
GROWTH = (1 + RELATIVE_ERROR) / (1 - RELATIVE_ERROR)
LEAST_HASHES = 1024
HASH_BITS = 52  # exact as a double
_OFFSET = 1 << 20  # beyond any bucket number of a double
QUANTITY, DISTINCT = "quantity", "distinct"


def bucket(value: Column) -> Column:
    """Number of the value's bucket, in the order of the values; zero has 0, nulls and NaN none."""
    place = F.ceil(F.log(F.abs(value)) / F.lit(math.log(GROWTH))) + _OFFSET
    known = value.isNotNull() & ~F.isnan(value)
    return F.when(known, F.when(value == 0, 0).when(value > 0, place).otherwise(-place)).cast("int")


def middle(number: Column) -> Column:
    """The value that is within the relative error of all in the bucket, to nine digits."""
    size = F.pow(F.lit(GROWTH), F.abs(number) - _OFFSET) * (2 / (GROWTH + 1))
    digits = F.lit(10.0) ** (F.lit(8) - F.floor(F.log10(size)))
    return F.when(number == 0, 0.0).otherwise(F.signum(number.cast("double")) * F.round(size * digits) / digits)


def hashed(value: Column) -> Column:
    """The first 52 bits of a SHA-256 of the value as text; null stays null."""
    return F.conv(F.substring(F.sha2(value.cast("string"), 256), 1, HASH_BITS // 4), 16, 10).cast("long")


def _least(rows: DataFrame, groups: Sequence[str], k: int) -> DataFrame:
    """The k least distinct hashes of each group; a task keeps k of a group before the shuffle."""
    order = Window.partitionBy(*groups).orderBy("item")
    return rows.distinct().withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= k).drop("_nth")


def sketched(df: DataFrame, groups: Sequence[str], value: str, identity: str, k: int = LEAST_HASHES) -> DataFrame:
    """Rows (groups, kind, item, n): counts by bucket of the value, and the least hashes of the identity."""
    quantity = df.select(*groups, bucket(F.col(value).cast("double")).cast("long").alias("item")).where("item is not null")
    counts = quantity.groupBy(*groups, "item").agg(F.count(F.lit(1)).alias("n"))
    distinct = df.select(*groups, hashed(F.col(identity)).alias("item")).where("item is not null")
    least = _least(distinct, groups, k).withColumn("n", F.lit(1).cast("long"))
    return counts.withColumn("kind", F.lit(QUANTITY)).unionByName(least.withColumn("kind", F.lit(DISTINCT))).select(*groups, "kind", "item", "n")


def store_days(df: DataFrame, path: str, day: str, groups: Sequence[str], value: str, identity: str) -> None:
    """The sketches of the days that the frame holds, in place of earlier ones of these days: a day comes whole."""
    write_idempotent(sketched(df, [day, *groups], value, identity), path, [day])


def merged(sketches: DataFrame, groups: Sequence[str], k: int = LEAST_HASHES) -> DataFrame:
    """One sketch a group from several, whatever they were of."""
    rows = sketches.select(*groups, "kind", "item", "n")
    counts = rows.where(F.col("kind") == QUANTITY).groupBy(*groups, "kind", "item").agg(F.sum("n").alias("n"))
    least = _least(rows.where(F.col("kind") == DISTINCT).select(*groups, "kind", "item"), [*groups, "kind"], k)
    return counts.unionByName(least.withColumn("n", F.lit(1).cast("long")))


def profile(sketch: DataFrame, groups: Sequence[str], quantiles: Sequence[float], k: int = LEAST_HASHES) -> DataFrame:
    """Rows (groups, n_values, q<percent>..., n_distinct) of merged sketches.

    A quantile q is the least value that q of the values don't exceed. Groups without values have nulls, without
    identities 0.
    """
    numbers = sketch.where(F.col("kind") == QUANTITY)
    ordered = Window.partitionBy(*groups).orderBy("item")
    whole = Window.partitionBy(*groups)
    running = numbers.withColumns({"_upto": F.sum("n").over(ordered), "_all": F.sum("n").over(whole)})
    reached = [
        F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * q), F.col("item"))).alias(f"_q{i}") for i, q in enumerate(quantiles)
    ]
    found = running.groupBy(*groups).agg(F.max("_all").alias("n_values"), *reached)
    named = [middle(F.col(f"_q{i}")).alias(f"q{round(100 * q)}") for i, q in enumerate(quantiles)]
    values = found.select(*groups, "n_values", *named)
    identities = sketch.where(F.col("kind") == DISTINCT).groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), F.max("item").alias("_last"))
    estimate = F.when(F.col("_n") < k, F.col("_n")).otherwise(F.round((k - 1) / ((F.col("_last") + 1) / 2**HASH_BITS)))
    counted = identities.select(*groups, estimate.cast("long").alias("n_distinct"))
    return values.join(counted, list(groups), "full").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0).cast("long")))


def read_days(spark: SparkSession, path: str, day: str, first: str, last: str) -> DataFrame:
    """The stored sketches from the first to the last day; other days are not read."""
    return spark.read.parquet(path).where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
