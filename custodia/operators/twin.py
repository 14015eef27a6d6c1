"""Synthetic twins of real tables: no value of a row stays, but keys join as they did and columns keep their shapes.

Keys go through a keyed permutation, the same for all columns of one domain, so equal keys stay equal and different
ones different, whatever table they are in. Numbers and times are drawn along the column's quantiles, short lists of texts by
their shares, other texts keep only the shape of their characters; nulls keep their share. What is drawn depends on
the row's identity and the secret alone, so a twin can be made again, in any order and partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUANTILES = 64  # steps of a column's quantile table
VALUES = 256  # texts of a column that are drawn by their shares; columns with more keep shapes
ROUNDS = 4


def permuted(key: Column, secret: int, bits: int = 64) -> Column:
    """A permutation of the whole numbers of that many bits, by a network of keyed hashes; null stays null."""
    half = bits // 2
    mask = F.lit((1 << half) - 1)
    number = key.cast("long")
    left, right = F.shiftrightunsigned(number, half).bitwiseAND(mask), number.bitwiseAND(mask)
    for turn in range(ROUNDS):
        left, right = right, left.bitwiseXOR(F.xxhash64(F.lit(secret), F.lit(turn), right).bitwiseAND(mask))
    joined = F.shiftleft(left, half).bitwiseOR(right)
    if bits == 32:  # the upper half of the numbers is the negative ones
        joined = F.when(joined >= 1 << 31, joined - (1 << 32)).otherwise(joined).cast("int")
    return F.when(key.isNotNull(), joined)


def domain_secret(secret: str, domain: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{len(domain)}:{domain}{secret}".encode()).digest()[:7], "big")


def _uniform(secret: int, *parts: Column) -> Column:
    """A number in [0, 1) that the parts determine."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(secret), *parts), 11) / F.lit(float(1 << 53))


def _drawn(uniform: Column, quantiles: Sequence[float]) -> Column:
    """The value at that share of the quantile table, straight between its entries."""
    steps = len(quantiles) - 1
    table = F.array(*[F.lit(float(q)) for q in quantiles])
    at = F.least(F.floor(uniform * steps), F.lit(steps - 1)).cast("int")
    low, high = F.get(table, at), F.get(table, at + 1)
    return low + (high - low) * (uniform * steps - at)


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _as_number(name: str, kind: T.DataType) -> Column:
    if _is_time(kind):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    return F.col(name).cast("double")


def twin(df: DataFrame, identity: Sequence[str], domains: Mapping[str, str], secret: str) -> DataFrame:
    """The table's twin with its columns and types. ``domains`` names the key columns (whole numbers) and what they are keys of.

    ``identity`` tells rows apart; rows that share it get the same values. Two passes: one for the quantiles, null shares and
    texts of all columns, one for the rows. At most QUANTILES numbers or VALUES texts a column reach the driver.
    Columns of other types than numbers, times and texts are null.
    """
    others = [f for f in df.schema.fields if f.name not in domains]
    shares = [k / QUANTILES for k in range(QUANTILES + 1)]
    measured = [f for f in others if _is_number(f.dataType) or _is_time(f.dataType)]
    texts = [f for f in others if isinstance(f.dataType, T.StringType)]
    facts = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(f.name).alias(f"n_{f.name}") for f in others],
        *[F.percentile_approx(_as_number(f.name, f.dataType), shares, 10_000).alias(f"q_{f.name}") for f in measured],
    ).first()
    own = domain_secret(secret, "values")
    who = [F.col(c).cast("string") for c in identity]

    def filled(name: str, value: Column) -> Column:
        share = 1 - facts[f"n_{name}"] / max(facts["n"], 1)
        return F.when(_uniform(own, F.lit(f"null {name}"), *who) >= share, value) if share else value

    def number(field: T.StructField) -> Column:
        quantiles = facts[f"q_{field.name}"]
        if not quantiles:
            return F.lit(None)
        value = _drawn(_uniform(own, F.lit(field.name), *who), quantiles)
        if isinstance(field.dataType, T.IntegralType):
            return F.round(value)
        return F.timestamp_micros(value.cast("long")) if _is_time(field.dataType) else value

    def text(field: T.StructField) -> Column:
        counts = df.groupBy(field.name).agg(F.count(F.lit(1)).alias("n")).where(F.col(field.name).isNotNull())
        found = counts.orderBy(F.desc("n"), field.name).limit(VALUES + 1).collect()
        if len(found) > VALUES:
            return F.mask(F.col(field.name))
        total, upto, edges = sum(r["n"] for r in found), 0, []
        for r in found:
            upto += r["n"]
            edges.append(upto / total)
        uniform = _uniform(own, F.lit(field.name), *who)
        place = F.size(F.filter(F.array(*[F.lit(e) for e in edges[:-1]]).cast("array<double>"), lambda e: e <= uniform))
        return F.get(F.array(*[F.lit(r[field.name]) for r in found]).cast("array<string>"), place) if found else F.lit(None)

    def made(field: T.StructField) -> Column:
        name = field.name
        if name in domains:
            bits = 64 if isinstance(field.dataType, T.LongType) else 32
            return permuted(F.col(name), domain_secret(secret, domains[name]), bits)
        if field in measured:
            return filled(name, number(field))
        return filled(name, text(field)) if field in texts else F.lit(None)

    return df.select(*[made(f).cast(f.dataType).alias(f.name) for f in df.schema.fields])
