"""What several operators share: reading, written intermediates, words, components of a link graph."""

from __future__ import annotations

import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia.session import fresh_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


BATCH_ROWS, BATCH_BYTES = 2000, 16 * 1024**2


def small_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python workers no more than so many rows and bytes at a time. Settings of the session, only ever lowered."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).removesuffix("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def staged(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read again.

    Cuts the lineage with files that outlive any executor, and makes sure that a
    costly or a drawn result is computed once.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


_paths: dict[int, str] = {}


def discard(*frames: DataFrame) -> None:
    """Delete the files behind staged rows that nothing reads any more."""
    for df in frames:
        path = _paths.pop(id(df), None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that df doesn't have, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    name = wish
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as bytes, A-Z lower-cased; no text has none."""
    return text.encode().lower().split() if text else []


def marked(rows: DataFrame, keys: DataFrame, column: str, flag: str, bits: int = 25) -> DataFrame:
    """The rows with a flag: whether `column` may be among that of keys. It is true for all that are, and few others.

    Goes before a join that decides, so that what has no partner isn't shuffled for it. Hashes of the keys are
    set in a field of 2 ** bits bits, kept as words of 64; so what is broadcast has a row a word, 2 ** (bits - 6) of
    16 bytes at most, however many keys there are. With very many keys it flags more. Nulls match nothing.
    """
    place, word, field = (free_name(rows, n) for n in ("_place", "_word", "_field"))

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn(place, F.pmod(F.xxhash64(column), F.lit(1 << bits))).withColumn(word, F.shiftright(place, 6).cast("int"))

    known = keys.select(column).where(F.col(column).isNotNull())
    held = placed(known).groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({place} & 63 as int))")).alias(field))
    some = placed(rows).join(F.broadcast(held), word, "left")
    hit = F.getbit(field, F.col(place).bitwiseAND(63).cast("int")) == 1
    return some.select(*rows.columns, (F.col(column).isNotNull() & F.coalesce(hit, F.lit(False))).alias(flag))


def may_match(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose `column` may be among that of keys; see `marked`."""
    flag = free_name(rows, "_may")
    return marked(rows, keys, column, flag).where(flag).drop(flag)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges between longs: rows (id, component).

    component is the smallest id that is connected. Every round hooks each vertex to the
    neighbour of least hashed rank and contracts what was hooked; ranks are spread by a hash, so
    that chains shrink by a constant share a round instead of by one vertex. Labels are found from
    the last round back, so a round's join has the vertices that were left then, and all rounds together some times
    the vertices. Rounds are written to the shared folder; only whether edges remain reaches the driver.
    Nulls have no edges. No edges give no rows.
    """
    left = staged(
        edges.where(f"{a} != {b}").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(),
        "edges",
    )
    labels = left.select(F.col("a").alias("id"), F.col("a").alias("label"))  # no rows, unless there is a round
    rounds: list[DataFrame] = []
    while left.limit(1).count():
        turn = len(rounds)

        def rank(c: str, turn: int = turn) -> Column:
            return F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("r"), F.col(c).alias("v"))

        both = left.select("a", "b").union(left.select("b", "a"))
        hooks = staged(
            both.groupBy("a")
            .agg(F.min(rank("b")).alias("m"))
            .select(F.col("a").alias("v"), F.least(F.col("m"), rank("a"))["v"].alias("to")),
            "hooks",
        )
        to = hooks.select(F.col("v").alias("a"), F.col("to").alias("x"))
        step = left.join(to, "a").select("x", "b")
        to = hooks.select(F.col("v").alias("b"), F.col("to").alias("y"))
        step = step.join(to, "b").where("x != y")
        rest = staged(step.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(left)
        left = rest
        rounds.append(hooks)
    for nth, hooks in enumerate(reversed(rounds)):
        if not nth:
            labels = hooks.select(F.col("v").alias("id"), F.col("to").alias("label"))
            continue
        later = labels.withColumnRenamed("id", "to")
        moved = staged(hooks.join(later, "to", "left").select(F.col("v").alias("id"), F.coalesce("label", "to").alias("label")), "labels")
        discard(labels)
        labels = moved
    if rounds:
        discard(left, *(rounds if len(rounds) > 1 else []))
    least = labels.groupBy("label").agg(F.min("id").alias("component"))
    return labels.join(least, "label").select("id", "component")
