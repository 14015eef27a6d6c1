"""Schemas inferred from names, synthetic rows of any number, contract checks of jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from py4j.protocol import Py4JNetworkError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia import vocab
from custodia.functions import script as S
from custodia.operators.quality import observed
from custodia.sources.tables import small_table

# what Spark says when it lost the work, not when the work failed
LOST = ("ExecutorLostFailure", "FetchFailed", "SparkContext was shut down", "Connection refused")
EPOCH = "2020-01-01 00:00:00"


def inferred_type(name: Column, mode: str = "token") -> Column:
    """Type by name; the first rule that matches wins.

    ``reference`` looks for the words anywhere in the name (``status`` holds ``at``
    and becomes a timestamp); ``token`` compares the parts between underscores.
    """
    lower = F.lower(name)
    out = F.lit("string")
    for spark_type, words in reversed(vocab.TYPE_RULES):
        if mode == "reference":
            hit = S.contains_any(lower, words)
        else:
            hit = F.arrays_overlap(F.split(lower, "_"), S.array_of([w.strip("_") for w in words]))
        out = F.when(hit, spark_type).otherwise(out)
    return out


def infer_types(
    df: DataFrame,
    columns: Column,
    *ids: str,
    modes: Sequence[str] = ("token",),
    limit: int | None = None,
) -> DataFrame:
    """Inferred schema of every subject, by each mode: its columns, or the default schema when it has none.

    ``columns`` is a sorted array, computed once for all modes. ``limit`` keeps the first so many, as a
    dry-run schema of that width does.
    """
    names = df.select(*ids, S.once(_names=columns if limit is None else F.slice(columns, 1, limit)))

    def row(mode: str, position: Column, name: Column, spark_type: Column) -> Column:
        return F.struct(
            F.lit(mode).alias("mode"),
            position.cast("int").alias("position"),
            name.alias("column_name"),
            spark_type.alias("inferred_type"),
        )

    def typed(mode: str) -> Column:
        return F.transform("_names", lambda n, i: row(mode, i, n, inferred_type(n, mode)))

    default = F.array(
        *[row(m, F.lit(i), F.lit(n), F.lit(t)) for m in modes for i, (n, t) in enumerate(vocab.DEFAULT_SCHEMA)]
    )
    chosen = F.when(F.size("_names") > 0, F.concat(*[typed(m) for m in modes])).otherwise(default)
    return names.select(*ids, S.one_row_each(chosen))


def type_fit(
    df: DataFrame, table: str, inferred: Sequence[tuple[str, str]], try_values: bool = False
) -> DataFrame:
    """Inferred against actual types of a table, in one pass over its columns.

    ``try_values`` also casts every value whose type differs and counts what survives.
    """
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def castable(c: str, t: str) -> Column:
        return F.count(c if t == actual[c] else F.col(c).cast("string").try_cast(t))

    counts = df.agg(
        *[F.count(c).alias(f"_n_{c}") for c, _ in inferred],
        *([castable(c, t).alias(f"_c_{c}") for c, t in inferred] if try_values else []),
    )
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(t).alias("inferred_type"),
            F.lit(actual[c]).alias("actual_type"),
            F.lit(t == actual[c]).alias("same_type"),
            F.col(f"_n_{c}").alias("n_values"),
            *([F.col(f"_c_{c}").alias("n_castable")] if try_values else []),
        )
        for c, t in inferred
    ]
    return counts.select(F.lit(table).alias("table_name"), F.inline_outer(F.array(*rows)))


def type_by_name(name: str, mode: str = "token") -> str:
    """The same rule for one name of a schema at hand."""
    lower = name.lower()
    for spark_type, words in vocab.TYPE_RULES:
        if mode == "reference":
            hit = any(w in lower for w in words)
        else:
            hit = bool({w.strip("_") for w in words} & set(lower.split("_")))
        if hit:
            return spark_type
    return "string"


def synthetic_value(name: str, spark_type: str, i: Column) -> Column:
    if spark_type in ("bigint", "int", "smallint", "tinyint"):
        return (i + 1).cast(spark_type)
    if spark_type in ("double", "float") or spark_type.startswith("decimal"):
        return (i * F.lit(1.5)).cast(spark_type)
    if spark_type == "boolean":
        return i % 2 == 0
    if spark_type == "date":
        return F.date_add(F.lit(EPOCH).cast("date"), (i % 36500).cast("int"))
    if spark_type in ("timestamp", "timestamp_ntz"):
        return F.timestamp_add("HOUR", i, F.lit(EPOCH).cast(spark_type))
    return F.concat(F.lit(f"synthetic_{name}_"), i.cast("string"))


def synthetic_rows(spark: SparkSession, schema: Sequence[tuple[str, str]], n: int) -> DataFrame:
    """n rows with values that fit their types; made on the executors, a range at a time."""
    i = F.col("id")
    return spark.range(n).select(*[synthetic_value(c, t, i).alias(c) for c, t in schema])


def contract_check(
    spark: SparkSession,
    name: str,
    job: Callable[[DataFrame], DataFrame],
    schema: Sequence[tuple[str, str]],
    n: int,
    contract: Sequence[tuple[str, str]],
) -> DataFrame:
    """Run a job on synthetic rows and compare columns, types and success with its contract.

    Input and output rows are counted in passing while the job runs once.
    """
    missing: list[str] = []
    wrong: list[str] = []
    error, message, rows_in, rows_out = "", "", 0, 0
    try:
        source, seen_in = observed(synthetic_rows(spark, schema, n), f"{name}_in")
        result, seen_out = observed(job(source), f"{name}_out")
        actual = {f.name: f.dataType.simpleString() for f in result.schema.fields}
        missing = [c for c, _ in contract if c not in actual]
        wrong = [c for c, t in contract if c in actual and actual[c] != t]
        result.write.format("noop").mode("overwrite").save()
        rows_in, rows_out = seen_in.get["n_rows"], seen_out.get["n_rows"]
    except Exception as exc:  # a job that fails on its data is a result here; a lost executor is not
        if isinstance(exc, (Py4JNetworkError, ConnectionError)) or any(sign in str(exc) for sign in LOST):
            raise
        error, message = type(exc).__name__, str(exc).strip().split("\n", 1)[0]
    passed = not (missing or wrong or error)
    return small_table(
        spark,
        [(name, passed, ",".join(missing), ",".join(wrong), error, message, rows_in, rows_out)],
        "job string, passed boolean, missing string, wrong_type string, runtime_error string, "
        "error_message string, rows_in bigint, rows_out bigint",
    )
