"""Differences between versions: lines of texts, rows of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _lines(text: Column) -> Column:
    """Lines without their breaks; a closing break starts no further line."""
    whole = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(whole, r"\r?\n"))


def _versions(old: DataFrame, new: DataFrame, subject: str, text: str) -> DataFrame:
    """Both sides' texts in one table with ``_sign``, and on every row whether its subject ``changed``.

    Texts are compared by hash, as multisets. A subject without a text that is not empty on the new side was
    not rewritten: it has not changed. The texts are shuffled once, by subject, and all that follows stays there.
    """
    both = old.select(subject, F.col(text).alias("_text"), F.lit(-1).alias("_sign")).unionByName(
        new.select(subject, F.col(text).alias("_text"), F.lit(1).alias("_sign"))
    ).where(F.col("_text").isNotNull() | (F.col("_sign") == -1))
    digest = F.xxhash64(F.coalesce("_text", F.lit(""))).cast("decimal(20,0)") * F.col("_sign")
    rewritten = (F.col("_sign") == 1) & (F.col("_text") != "")
    whole = Window.partitionBy(subject)
    differs = (F.sum(digest).over(whole) != 0) | (F.sum("_sign").over(whole) != 0)
    return both.withColumn("changed", differs & F.coalesce(F.bool_or(rewritten).over(whole), F.lit(False)))


def _line_changes(old: DataFrame, new: DataFrame, subject: str, text: str) -> DataFrame:
    """Signed count of every line of the changed subjects; other subjects have one row, without a line.

    Every row counts, also of a subject that has several.
    """
    lines = F.when(F.col("changed"), _lines(F.coalesce("_text", F.lit(""))))
    each = _versions(old, new, subject, text).select(subject, "changed", "_sign", F.explode_outer(lines).alias("line"))
    return each.groupBy(subject, "changed", "line").agg(F.sum("_sign").alias("net"))


def line_diff(old: DataFrame, new: DataFrame, subject: str, text: str) -> DataFrame:
    """Lines added to or removed from every subject, with how many times."""
    net = F.col("net")
    return (
        _line_changes(old, new, subject, text)
        .where((net != 0) & F.col("line").isNotNull())
        .select(
            subject,
            F.when(net > 0, "added").otherwise("removed").alias("change"),
            "line",
            F.abs(net).alias("n"),
        )
    )


def diff_counts(old: DataFrame, new: DataFrame, subject: str, text: str) -> DataFrame:
    """Lines added and removed per subject, and whether its text changed; unchanged subjects stay, with zeros.

    A text can change without a line: by their order, or by the closing line break.
    """
    net = F.when(F.col("line").isNotNull(), F.col("net")).otherwise(0)
    return (
        _line_changes(old, new, subject, text)
        .groupBy(subject)
        .agg(
            F.sum(F.greatest(net, F.lit(0))).alias("added"),
            F.sum(F.greatest(-net, F.lit(0))).alias("removed"),
            F.bool_or("changed").alias("changed"),
        )
    )


def keyed_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows added, removed or changed between two versions of a table with a key.

    An aggregation, not a join: copies of a key shrink to one row before the shuffle and never multiply. What is
    shuffled of a row is its key and a 64-bit hash of each column. A key
    that holds different rows on a side is none: its change is ``repeated``, and no columns are named.
    """
    columns = [c for c in old.columns if c not in keys]
    sides = ("_old", "_new")

    def side(df: DataFrame, name: str) -> DataFrame:
        hashes = {f"{name}_{i}": _row_hash([c]) for i, c in enumerate(columns)}
        return df.select(*keys, _row_hash(columns).alias(f"{name}_row"), *[h.alias(n) for n, h in hashes.items()])

    names = [f"{n}_{i}" for n in sides for i in range(len(columns))]
    both = (
        side(old, "_old")
        .unionByName(side(new, "_new"), allowMissingColumns=True)
        .groupBy(*keys)
        .agg(
            *[F.min(f"{n}_row").alias(f"{n}_low") for n in sides],
            *[F.max(f"{n}_row").alias(f"{n}_high") for n in sides],
            *[F.max(n).alias(n) for n in names],
        )
    )
    repeated = F.lit(False)
    for n in sides:
        repeated = repeated | F.coalesce(F.col(f"{n}_low") != F.col(f"{n}_high"), F.lit(False))
    changed = F.concat_ws(
        ",", *[F.when(F.col(f"_old_{i}") != F.col(f"_new_{i}"), F.lit(c)) for i, c in enumerate(columns)]
    )
    return (
        both.select(
            *keys,
            F.when(repeated, "repeated")
            .when(F.col("_old_low").isNull(), "added")
            .when(F.col("_new_low").isNull(), "removed")
            .when(changed != "", "changed")
            .alias("change"),
            F.when(~repeated & F.col("_old_low").isNotNull() & F.col("_new_low").isNotNull(), changed).alias("columns"),
        )
        .where(F.col("change").isNotNull())
    )


def _row_hash(columns: Sequence[str], seed: int | None = None) -> Column:
    """A hash of the values and of which are null."""
    parts = [part for c in columns for part in (F.col(c), F.col(c).isNull())]
    return F.xxhash64(*([] if seed is None else [F.lit(seed)]), *parts)


def table_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Multiset difference both ways: how often a row is only left or only right.

    Rows are told by 128 bits of hash first, which is all that equal rows shuffle; only rows whose
    counts differ are fetched and compared as a whole.
    """
    signed = left.withColumn("_sign", F.lit(1)).unionByName(right.withColumn("_sign", F.lit(-1)))
    signed = signed.withColumns({"_first": _row_hash(left.columns), "_second": _row_hash(left.columns, seed=1)})
    net = F.col("_net")
    differ = signed.groupBy("_first", "_second").agg(F.sum("_sign").alias("_net")).where(net != 0)
    return (
        signed.join(differ.drop("_net"), ["_first", "_second"], "left_semi")
        .groupBy(*left.columns)
        .agg(F.sum("_sign").alias("_net"))
        .where(net != 0)
        .select(
            *left.columns,
            F.when(net > 0, "left").otherwise("right").alias("only_in"),
            F.abs(net).alias("copies"),
        )
    )
