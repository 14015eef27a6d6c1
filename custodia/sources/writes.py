"""Governed ingest and writes: schema-enforced, idempotent, append-only, reported."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custodia import vocab
from custodia.session import fresh_path


@dataclass(frozen=True)
class Ingest:
    good: DataFrame
    bad: DataFrame
    all: DataFrame
    drift: tuple[tuple[str, str], ...]


def ingest(df: DataFrame, expected: T.StructType) -> Ingest:
    """Cast every column to its declared type; rows where a cast loses a value are quarantined.

    A missing column or a null in a required one quarantines the row too. ``drift``
    names missing, extra and retyped columns; ``all`` holds both kinds with the reasons.
    """
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    drift = [(f.name, "missing") for f in expected.fields if f.name not in actual]
    drift += [
        (f.name, f"{actual[f.name]} -> {f.dataType.simpleString()}")
        for f in expected.fields
        if f.name in actual and actual[f.name] != f.dataType.simpleString()
    ]
    drift += [(c, "extra") for c in df.columns if c not in expected.fieldNames()]

    reasons: list[Column] = []
    typed: dict[str, Column] = {}
    for f in expected.fields:
        if f.name not in actual:
            typed[f.name] = F.lit(None).cast(f.dataType)
            if not f.nullable:
                reasons.append(F.lit(f"{f.name}:missing"))
            continue
        value = F.col(f.name)
        cast = value.try_cast(f.dataType) if actual[f.name] != f.dataType.simpleString() else value
        typed[f.name] = cast
        reasons.append(
            F.when(value.isNotNull() & cast.isNull(), F.lit(f"{f.name}:type")).when(
                _lossy(value, df.schema[f.name].dataType, cast, f.dataType), F.lit(f"{f.name}:lossy")
            )
        )
        if not f.nullable:
            reasons.append(F.when(value.isNull(), F.lit(f"{f.name}:null")))
    checked = df.withColumn("_reasons", F.concat_ws(",", *reasons) if reasons else F.lit(""))
    everything = checked.select(*[c.alias(n) for n, c in typed.items()], "_reasons")
    return Ingest(
        good=everything.where(F.col("_reasons") == "").drop("_reasons"),
        bad=checked.where(F.col("_reasons") != ""),
        all=everything,
        drift=tuple(drift),
    )


def _lossy(value: Column, source: T.DataType, cast: Column, target: T.DataType) -> Column:
    """Whether a cast that went through has changed the value: cast back, it is another number."""
    if source == target or not isinstance(target, T.NumericType):
        return F.lit(False)
    if isinstance(source, T.StringType):
        exact = value.try_cast("decimal(38,18)")
        rough = value.try_cast("double") != cast.cast("double")
        return F.coalesce(exact != cast.cast("decimal(38,18)"), rough, F.lit(False))
    return F.coalesce(cast.try_cast(source) != value, F.lit(False))


def write_idempotent(df: DataFrame, path: str, partition_cols: Sequence[str]) -> None:
    """Replace exactly the partitions the frame holds; a repeated run leaves the same table.

    That covers a plain repeat, where every row stays in its partition. Rows with a key that move between
    partitions need `write_keyed`.

    The rebalance hint sizes files at run time: it merges small partitions and
    splits a partition value that holds most of the rows.
    """
    (
        df.hint("rebalance", *partition_cols)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_cols)
        .parquet(path)
    )


def write_keyed(df: DataFrame, path: str, partition_cols: Sequence[str], keys: Sequence[str]) -> None:
    """As write_idempotent, for a table with a key whose rows may change partition.

    Every partition that holds an incoming key, in the table or in the frame, is written anew without the
    old rows of these keys; a partition that is left without rows goes. Other partitions are only
    read for their keys. A run that stops before such partitions are gone leaves the moved keys in both places, never in
    none; running it again ends it.
    """
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        write_idempotent(df, path, partition_cols)
        return
    batch = _staged(df, "keyed-batch")
    table = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    moved = _matching(table, batch, keys, "left_semi")
    touched = moved.select(*partition_cols).unionByName(batch.select(*partition_cols)).distinct()
    rest = _matching(_matching(table, touched, partition_cols, "left_semi"), batch, keys, "left_anti")
    # Only the rows that stay are staged; a plain repeat has none.
    new = _staged(rest, "keyed-rest").unionByName(batch)
    empty = _matching(touched, new, partition_cols, "left_anti").collect()  # partitions, not rows
    write_idempotent(new, path, partition_cols)
    for row in empty:
        _delete_partition(spark, path, {c: row[c] for c in partition_cols})


def _delete_partition(spark: SparkSession, path: str, values: dict[str, object]) -> None:
    named = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    folder = "/".join(named(c, None if v is None else str(v)) for c, v in values.items())
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _matching(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """Rows of left with (left_semi) or without (left_anti) equal values in right; nulls equal nulls."""
    other = right.select(*[F.col(c).alias(f"_other_{c}") for c in columns]).distinct()
    same = [left[c].eqNullSafe(other[f"_other_{c}"]) for c in columns]
    return left.join(other, same, how)


def _staged(df: DataFrame, label: str) -> DataFrame:
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """The rows of one run, beside those of other runs; a repeated run replaces its own, also if it has no rows now."""
    watch = Observation()
    write_idempotent(df.observe(watch, F.count(F.lit(1)).alias("n_rows")).withColumn("run_id", F.lit(run_id)), path, ["run_id"])
    if not watch.get["n_rows"]:
        _delete_partition(df.sparkSession, path, {"run_id": run_id})


def merge_upsert(
    target: DataFrame, updates: DataFrame, keys: Sequence[str], latest_by: Sequence[Column]
) -> DataFrame:
    """Target rows without an update, plus the latest update of every key.

    The result is a new version to be written next to the target, never over the
    path it is read from.
    """
    w = Window.partitionBy(*keys).orderBy(*latest_by)
    newest = (
        updates.withColumn("_rank", F.row_number().over(w))
        .where(F.col("_rank") <= 1)
        .select(*target.columns)
    )
    kept = target.join(newest.select(*keys), list(keys), "left_anti")
    return kept.select(*target.columns).unionByName(newest)


def checked_audit(df: DataFrame) -> DataFrame:
    """The audit entries; a severity outside its set fails the write before it commits."""
    severity = F.when(
        F.col("severity").isin(*vocab.ENUMS["severity"]), F.col("severity")
    ).otherwise(F.raise_error(F.concat(F.lit("unknown severity: "), F.col("severity"))))
    return df.withColumn("severity", severity)


def append_audit(df: DataFrame, path: str) -> None:
    """Append audit entries."""
    checked_audit(df).write.mode("append").parquet(path)


def write_reports(df: DataFrame, path: str, payload: Column, artifact_type: Column) -> None:
    """One JSON line per subject, partitioned by artifact type; types that the frame lacks stay as they are."""
    rows = df.select(payload.alias("report"), artifact_type.alias("artifact_type"))
    (
        rows.select(F.to_json("report").alias("value"), "artifact_type")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("artifact_type")
        .text(path)
    )


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    raw = spark.read.schema("value string, artifact_type string").text(path)
    return raw.select("artifact_type", F.from_json("value", schema).alias("report"))
