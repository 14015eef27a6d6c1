"""Data-quality gates: one-pass suites, keys, schemas, enums, integrity, fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from custodia import vocab
from custodia.sources.tables import small_table


@dataclass(frozen=True)
class Expectation:
    """``failed`` makes a column that is true for a row that breaks the expectation.

    A factory, so suites can be declared before there is a session. With
    ``on_row_count`` it looks at the whole table's row count ``_n`` instead.
    """

    name: str
    failed: Callable[[], Column]
    on_row_count: bool = False


def not_null(column: str) -> Expectation:
    return Expectation(f"not_null({column})", lambda: F.col(column).isNull())


def accepted(column: str, values: Sequence) -> Expectation:
    return Expectation(f"accepted({column})", lambda: ~F.col(column).isin(*values))


def between(column: str, low, high) -> Expectation:
    return Expectation(f"between({column})", lambda: ~F.col(column).between(low, high))


def matches(column: str, regex: str) -> Expectation:
    return Expectation(f"matches({column})", lambda: ~F.col(column).rlike(regex))


def row_count_between(low: int, high: int) -> Expectation:
    return Expectation("row_count", lambda: ~F.col("_n").between(low, high), on_row_count=True)


def expect(df: DataFrame, suite: Sequence[Expectation]) -> DataFrame:
    """One row per expectation, from one scan and one aggregation."""
    per_row = [e for e in suite if not e.on_row_count]
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(e.failed()).alias(f"_f{i}") for i, e in enumerate(per_row)],
    )
    rows = [
        F.struct(F.lit(e.name).alias("expectation"), F.col("_n").alias("evaluated"), F.col(f"_f{i}").alias("failed"))
        for i, e in enumerate(per_row)
    ] + [
        F.struct(F.lit(e.name).alias("expectation"), F.lit(1).cast("bigint").alias("evaluated"),
                 e.failed().cast("bigint").alias("failed"))
        for e in suite
        if e.on_row_count
    ]
    return counts.select(F.inline_outer(F.array(*rows))).select(
        "*",
        F.when(F.col("evaluated") > 0, F.col("failed") / F.col("evaluated")).alias("share"),
        F.when(F.col("failed") > 0, "fail").otherwise("pass").alias("status"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row. Counted on the map side, so a hot key is one small row per task."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def dedup_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of every key in an explicit total order.

    Spark keeps one row per key and task before the shuffle (window group limit),
    so a key that holds a third of the table does not meet in one task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= 1).drop("_rank")


def check_enums(df: DataFrame, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows with a value outside its allowed set, and which columns those are; nulls are no violation."""
    named = F.concat_ws(
        ",", *[F.when(~F.col(c).isin(*values), F.lit(c)) for c, values in allowed.items()]
    )
    return df.withColumn("violations", named).where(F.col("violations") != "")


def check_required(
    df: DataFrame, required: Sequence[str], defaults: Mapping[str, str] | None = None
) -> DataFrame:
    """Nulls per required column, and the rows a default would fill; one pass."""
    defaults = dict(defaults or {})
    columns = [*required, *[c for c in defaults if c not in required]]
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in columns]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"_null_{c}").alias("n_null"),
                F.lit(defaults.get(c)).cast("string").alias("default_value"),
            )
            for c in columns
        ]
    )
    return counts.select(F.col("_n").alias("n_rows"), F.inline_outer(rows)).withColumn(
        "status",
        F.when((F.col("n_null") > 0) & F.col("default_value").isNull(), "fail")
        .when(F.col("n_null") > 0, "defaulted")
        .otherwise("pass"),
    )


def with_defaults(df: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def conformity(
    df: DataFrame, table: str, contract: Sequence[tuple[str, str, bool]]
) -> DataFrame:
    """Contract ``(column, type, nullable)`` against the schema and the data.

    Names and types come from the schema; forbidden nulls are counted in one pass
    over the columns that must not have any.
    """
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    strict = [c for c, _, nullable in contract if not nullable and c in actual]
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in strict]
    )

    def row(column: str, expected: str | None) -> Column:
        found = actual.get(column)
        nulls = F.col(f"_null_{column}") if column in strict else F.lit(0).cast("bigint")
        if found is None:
            verdict = F.lit("missing")
        elif expected is None:
            verdict = F.lit("extra")
        elif found != expected:
            verdict = F.lit("wrong_type")
        else:
            verdict = F.when(nulls > 0, "nulls").otherwise("ok")
        return F.struct(
            F.lit(column).alias("column_name"),
            F.lit(expected).cast("string").alias("expected_type"),
            F.lit(found).cast("string").alias("actual_type"),
            nulls.alias("n_null"),
            verdict.alias("verdict"),
        )

    wanted = [c for c, _, _ in contract]
    rows = [row(c, t) for c, t, _ in contract] + [row(c, None) for c in actual if c not in wanted]
    return counts.select(
        F.lit(table).alias("table_name"), F.col("_n").alias("n_rows"), F.inline_outer(F.array(*rows))
    )


@dataclass(frozen=True)
class Projection:
    df: DataFrame
    extra: tuple[str, ...]


def project(df: DataFrame, contract: Sequence[str]) -> Projection:
    """Explicit projection: fail on missing columns, drop and name the extra ones."""
    missing = [c for c in contract if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing from input: {', '.join(missing)}")
    return Projection(df.select(*contract), tuple(c for c in df.columns if c not in contract))


def with_audit(df: DataFrame, run_id: str, ts: str, source: str) -> DataFrame:
    """Add the three audit columns. The time is a parameter, so a repeated run writes equal rows."""
    return df.withColumns(
        {
            "_etl_run_id": F.lit(run_id),
            "_etl_timestamp": F.lit(ts).cast("timestamp_ntz"),
            "_etl_source": F.lit(source),
        }
    )


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows that name a parent which is not there."""
    return child.where(F.col(child_key).isNotNull()).join(parent, F.col(child_key) == F.col(parent_key), "left_anti")


def mark_cascade(
    children: DataFrame, purged: DataFrame, child_key: str, parent_key: str, mark: str = "purged"
) -> DataFrame:
    """All children, each with whether its parent is purged: one pass over them, one join."""
    gone = purged.select(F.col(parent_key).alias("_parent")).distinct().withColumn(mark, F.lit(True))
    marked = children.join(gone, F.col(child_key) == F.col("_parent"), "left").drop("_parent")
    return marked.withColumn(mark, F.coalesce(mark, F.lit(False)))


def cascade(
    children: DataFrame, purged: DataFrame, child_key: str, parent_key: str
) -> tuple[DataFrame, DataFrame]:
    """Children of purged parents, and the children to keep."""
    marked = mark_cascade(children, purged, child_key, parent_key, "_purged")
    return marked.where("_purged").drop("_purged"), marked.where("NOT _purged").drop("_purged")


def row_digest(columns: Sequence[str]) -> Column:
    """First 60 bits of a SHA-256 over the row; every value stands behind its length, so no two rows read alike."""
    texts = [F.col(c).cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.conv(F.substring(F.sha2(F.concat(*parts), 256), 1, 15), 16, 10).cast("decimal(38,0)")


def quick_digest(columns: Sequence[str]) -> Column:
    """A 64-bit hash of the row's values and of which are null: enough to compare two copies, and cheap."""
    return F.xxhash64(*[part for c in columns for part in (F.col(c), F.col(c).isNull())]).cast("decimal(38,0)")


def fingerprint(
    df: DataFrame,
    label: str,
    columns: Sequence[str] | None = None,
    digest: Callable[[Sequence[str]], Column] = row_digest,
) -> DataFrame:
    """Row count and order-free sum of row digests: equal tables have equal fingerprints."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(digest(columns or df.columns)), F.lit(0))
        .cast("decimal(38,0)")
        .cast("string")
        .alias("fingerprint"),
    ).select(F.lit(label).alias("table_name"), "*")


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows in passing: the count is there once any action has run over the frame."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("n_rows")), watch


def fingerprinted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Take count and quick fingerprint in passing: both are there once an action has run over the frame."""
    watch = Observation(name)
    total = F.coalesce(F.sum(quick_digest(df.columns)), F.lit(0)).cast("decimal(38,0)").cast("string")
    return df.observe(watch, F.count(F.lit(1)).alias("n_rows"), total.alias("fingerprint")), watch


def step_counts(
    df: DataFrame, steps: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]
) -> DataFrame:
    """Rows after the read and after every step of a transformation, from running it once."""
    current, watch = observed(df, "read")
    watches = [("read", watch)]
    for name, step in steps:
        current, watch = observed(step(current), name)
        watches.append((name, watch))
    current.write.format("noop").mode("overwrite").save()
    rows = [(i, name, watch.get["n_rows"]) for i, (name, watch) in enumerate(watches)]
    return small_table(df.sparkSession, rows, "step_no int, step string, n_rows bigint")


STORE_ENUMS = {
    "sessions": {c: vocab.ENUMS[c] for c in ("input_type", "target", "status")},
    "artifacts": {"artifact_type": vocab.ENUMS["artifact_type"]},
    "audit_log": {"severity": vocab.ENUMS["severity"]},
    "pii_reports": {"risk_level": vocab.ENUMS["risk_level"]},
    "messages": {"role": vocab.ENUMS["role"]},
}
