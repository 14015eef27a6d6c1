"""Streaming twins of the batch operators: same expressions, files in, files out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    DataType,
    LongType,
    MapType,
    StructField,
    StructType,
    TimestampType,
)

from custodia import vocab
from custodia.functions import text as T
from custodia.operators import gate as gates
from custodia.session import fresh_path


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder or one file of parquet as a stream with a declared schema; neighbours stay out.

    A stream watches folders, so a file is its folder with the file's exact name as the filter.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    literal = "".join(f"[{c}]" if c in "*?" else f"\\{c}" if c in "[]{}\\" else c for c in at.getName())
    return reader.option("pathGlobFilter", literal).parquet(at.getParent().toString())


def run_append(df: DataFrame, label: str) -> DataFrame:
    """Process all that is there, append to files, and return what was written."""
    spark = df.sparkSession
    out, state = fresh_path(spark, label), fresh_path(spark, f"{label}-state")
    query = (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def run_batches(
    df: DataFrame, label: str, write: Callable[[DataFrame, int, str], None], mode: str = "append"
) -> str:
    """Process all that is there, micro-batch by micro-batch; returns the output folder.

    ``write`` must be repeatable: after a failure Spark runs the last batch again.
    """
    spark = df.sparkSession
    out, state = fresh_path(spark, label), fresh_path(spark, f"{label}-state")
    query = (
        df.writeStream.foreachBatch(lambda batch, no: write(batch, no, out))
        .outputMode(mode)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return out


def run_updates(df: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    """Process all that is there in update mode and return the last row of every key.

    A batch writes what it changed into a folder of its own, so a repeated batch replaces itself, readers keep
    what they have open, and the state can forget what the watermark has passed.
    """

    def write(batch: DataFrame, no: int, out: str) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={no}")

    out = run_batches(df, label, write, "update")
    schema = StructType([*df.schema.fields, StructField("batch", LongType())])
    others = [c for c in df.columns if c not in keys]
    changed = df.sparkSession.read.schema(schema).parquet(out)
    last = changed.groupBy(*keys).agg(F.max(F.struct("batch", *others)).alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in df.columns])


def redacted(stream: DataFrame, subject: str, text: str) -> DataFrame:
    """Stateless scan and redaction of a stream of texts."""
    flagged = T.with_match_flags(stream.select(subject, text), text, vocab.PATTERNS)
    kinds = F.concat_ws(
        ",", *[F.when(F.col(T.match_column(p.kind, text)), p.kind) for p in vocab.PATTERNS]
    )
    staged = flagged.withColumn("entity_types", kinds).select(subject, text, "entity_types")
    return T.with_redaction(staged, text, "redacted").select(subject, "entity_types", "redacted")


def gated(stream: DataFrame, label: str, **options) -> str:
    """Gate a stream of submissions into ``passed=true`` and ``passed=false`` folders.

    One write per batch, into a folder of that batch, so a repeated batch replaces itself. Both folders' files are open at
    once: a task would sort all its rows by folder instead, whole scripts included.
    """

    def write(batch: DataFrame, no: int, out: str) -> None:
        batch.sparkSession.conf.set("spark.sql.maxConcurrentOutputFileWriters", "2")
        gates.gate(batch, **options).write.mode("overwrite").partitionBy("passed").parquet(
            f"{out}/batch={no}"
        )

    return run_batches(stream, label, write)


def audit_counts(
    audit: DataFrame, width: str = "1 hour", late: str = "2 hours", by: str = "severity"
) -> DataFrame:
    """Events per tumbling window and severity; what comes later than the watermark is dropped."""
    timed = audit.withColumn("event_time", F.col("event_time").cast("timestamp"))
    return (
        timed.withWatermark("event_time", late)
        .groupBy(F.window("event_time", width).alias("w"), by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), by, "n")
    )


def first_submissions(
    stream: DataFrame, key: str, ts: str, spread_by: str, within: str, salts: int = 32
) -> DataFrame:
    """One row per key within the watermark.

    Two steps: copies of a key are first reduced on (key, salt), so a key that
    holds a third of the stream is worked on by many tasks, then on the key.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, within)
    salted = timed.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    return salted.dropDuplicatesWithinWatermark([key, "_salt"]).dropDuplicatesWithinWatermark([key]).drop("_salt")


def token_cap(stream: DataFrame, cap: int, late: str = "40 days") -> DataFrame:
    """Days whose token spend is over the cap; a day is forgotten once the watermark has passed it."""
    timed = stream.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    return (
        timed.groupBy(F.window("created_at", "1 day").alias("w"))
        .agg(F.sum("tokens_used").alias("tokens"))
        .where(F.col("tokens") > cap)
        .select(F.to_date("w.start").alias("day"), "tokens")
    )


PANDAS_END = "2262-01-01"  # pandas has no times far beyond it; the watermark stays before
MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def as_text(name: str, kind: DataType) -> Column:
    """A value as text, from which ``from_text`` has it back; pandas would make numbers with nulls floats."""
    if isinstance(kind, TimestampType):
        return F.unix_micros(name).cast("string")
    if isinstance(kind, BinaryType):
        return F.hex(name)
    return F.to_json(name, MICROS) if isinstance(kind, (ArrayType, MapType, StructType)) else F.col(name).cast("string")


def from_text(name: str, kind: DataType) -> Column:
    if isinstance(kind, TimestampType):
        return F.timestamp_micros(F.col(name).cast("long"))
    if isinstance(kind, BinaryType):
        return F.unhex(name)
    return F.from_json(name, kind, MICROS) if isinstance(kind, (ArrayType, MapType, StructType)) else F.col(name).cast(kind)


def met(keys: pd.Series, at: np.ndarray, parent: np.ndarray, span: int) -> np.ndarray:
    """Which rows are children that have a parent of their key, and at most the span before or after them."""
    key = pd.factorize(keys)[0]
    order = np.lexsort((parent, np.where(parent, at, at - span), key))
    key, at, parent = key[order], at[order], parent[order]
    following = np.where(parent, np.arange(len(order)), len(order) - 1)
    following = np.minimum.accumulate(following[::-1])[::-1]  # the first parent from a child's earliest time on
    found = np.empty(len(order), bool)
    found[order] = ~parent & parent[following] & (key[following] == key) & (at[following] <= at + span)
    return found


def packed(rows: pd.DataFrame) -> bytes:
    table, out = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def unpacked(rows: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(rows).read_all().to_pandas()


def orphans(
    children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, child_ts: str, parent_ts: str, within: str,
    late: str, tell_apart: str, salts: int = 2, groups: int = 64,
) -> DataFrame:
    """Children whose parent doesn't come: none with their key, and a time within the span before or after theirs.

    Both sides wait for the other as long as the span and the watermarks say, so the state is bounded by what comes in
    that time. A child that has met a parent is forgotten at once, one that hasn't is given out once the watermark has passed
    its time and the span; what is later stays in the state for the next run. A parent that comes later than that is late, and
    its child an orphan. Children without a key name no parent and aren't listed.

    The state has a row for each of ``groups`` groups of keys in each slot of twice the span, of all that the group holds, packed:
    a join of streams has two for each child and parent. Slots, and salts by ``tell_apart``, keep a parent with a third of the
    children from being one task's; parents go to every salt, and to the one or two slots in which a child may meet them.
    """
    span = children.sparkSession.sql(f"SELECT INTERVAL {within} AS span").first()["span"] // timedelta(microseconds=1)
    kinds = {f"_{n}": (c, children.schema[c].dataType) for n, c in enumerate(children.columns)}
    held = ["_key", "_micros", "_parent", *kinds]

    def side(rows: DataFrame, key: str, ts: str, parent: bool, others: list[Column]) -> DataFrame:
        timed = rows.withColumn("_ts", F.col(ts).cast("timestamp")).where(F.col(key).isNotNull() & F.col("_ts").isNotNull())
        watched = F.least("_ts", F.lit(PANDAS_END).cast("timestamp")).alias("_at")
        own = [F.col(key).alias("_key"), F.unix_micros("_ts").alias("_micros"), F.lit(parent).alias("_parent")]
        return timed.select(*own, *others, watched).withWatermark("_at", late)

    texts = [as_text(c, t).alias(k) for k, (c, t) in kinds.items()]
    salt = F.pmod(F.xxhash64(tell_apart), F.lit(salts)).cast("int").alias("_salt")
    waiting = side(children, child_key, child_ts, False, [*texts, salt]).withColumn("_slot", F.expr(f"_micros div {2 * span}"))
    none = [F.lit(None).cast("string").alias(k) for k in kinds]
    there = side(parents, parent_key, parent_ts, True, [*none, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")])
    near = F.expr(f"sequence((_micros - {span}) div {2 * span}, (_micros + {span}) div {2 * span})")
    there = there.withColumn("_slot", F.explode(near))

    def settle(_, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        before = [unpacked(*state.get)] if state.exists else []
        rows = pd.concat([*before, *(f[held] for f in frames if len(f))], ignore_index=True)
        at, parent = rows["_micros"].to_numpy(), rows["_parent"].to_numpy()
        over = at + span <= state.getCurrentWatermarkMs() * 1000
        alone = ~met(rows["_key"], at, parent, span)
        yield rows.loc[alone & over & ~parent, [*kinds]]
        stays = alone & ~over
        if not stays.any():
            state.remove()
            return
        state.update((packed(rows[stays]),))
        wait = at[stays & ~parent]
        due = int(wait.min() if len(wait) else at[stays].max()) + span
        state.setTimeoutTimestamp(max(1, -(-due // 1000) - 1))  # called again when the watermark is past it

    grouped = waiting.union(there).withColumn("_group", F.pmod(F.xxhash64("_key"), F.lit(groups)).cast("int"))
    lost = grouped.groupBy("_group", "_slot", "_salt").applyInPandasWithState(
        settle, ", ".join(f"{k} string" for k in kinds), "held binary", "append", GroupStateTimeout.EventTimeTimeout
    )
    return lost.select(*[from_text(k, t).alias(c) for k, (c, t) in kinds.items()])
