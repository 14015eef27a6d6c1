"""Questions to the run store: sessions, artifacts, audit events, reports, messages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from custodia import vocab
from custodia.functions import text as T


def last_per_key(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of every key in the given order, with their rank.

    Every task keeps at most n rows of a key before the shuffle, so a key that holds a third of the rows
    stays cheap. Spark does so for n up to spark.sql.optimizer.windowGroupLimitThreshold (1000 by default);
    beyond it all rows of a key meet in one task.
    """
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def message_window(
    messages: DataFrame, session: str = "session_id", order: str = "id", n: int = vocab.MESSAGE_WINDOW
) -> DataFrame:
    """The last n messages of every session; ``position`` 1 is the oldest of them."""
    last = last_per_key(messages, session, [F.desc(order)], n)
    kept = Window.partitionBy(session).orderBy(order)
    return last.withColumn("position", F.row_number().over(kept)).drop("rank")


def latest(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Latest value of every key, the greatest of equally late ones; one candidate per key and task is shuffled."""
    last = df.groupBy(key).agg(F.max(F.struct(order, value)).alias("_last"))
    return last.select(key, f"_last.{value}", f"_last.{order}")


def recent(sessions: DataFrame, n: int = vocab.RECENT_LIMIT) -> DataFrame:
    """Newest runs first; ties by id. Each task keeps n rows, the driver merges n per task."""
    return sessions.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def history(df: DataFrame, user: str, item: str, order: str, n: int = vocab.RECENT_LIMIT) -> DataFrame:
    """Distinct items of every user, newest first, at most n."""
    seen = df.groupBy(user, item).agg(F.max(order).alias("last_seen"))
    return last_per_key(seen, user, [F.desc("last_seen"), F.col(item)], n)


def artifacts_of(
    sessions: DataFrame, artifacts: DataFrame, artifact_type: str | None = None
) -> DataFrame:
    """Artifacts of the given runs, all or of one type; the type filter reaches the scan."""
    if artifact_type is not None:
        artifacts = artifacts.where(F.col("artifact_type") == artifact_type)
    keys = sessions.select(F.col("id").alias("session_id"), "target", "status")
    return artifacts.join(keys, "session_id")


def report_of(sessions: DataFrame, reports: DataFrame, order: str) -> DataFrame:
    """Every run with its report, if it has one; the first report counts."""
    first = last_per_key(reports, "session_id", [F.col(order)], 1).drop("rank", order)
    return sessions.join(first, sessions["id"] == first["session_id"], "left").drop("session_id")


def trail(audit: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Audit entries in order, of all runs or of the given ones.

    Sorted by range on (session, id): a run with very many entries spans several tasks.
    """
    if sessions is not None:
        audit = audit.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    return audit.orderBy("session_id", "id")


def transitions(
    df: DataFrame, key: str, order: str, state: str, ties: Sequence[str] = (), chunk: int | None = None
) -> DataFrame:
    """Every row with the state before it (null for the first of its key).

    Rows are in the order of (order, ties, state), nulls first; order is a number or a time. A key is cut into
    stretches of ``chunk`` order values (30 days of a time), so no task sorts more than that. Inside a stretch
    the predecessor is a plain lag. The first row of a stretch follows the last row of the stretch before:
    one row of each end of each stretch is compared.
    """
    kind = df.schema[order].dataType
    timed = isinstance(kind, (DateType, TimestampType, TimestampNTZType))
    value = F.unix_micros(F.col(order).cast("timestamp")) if timed else F.col(order)
    width = chunk or (30 * 86_400_000_000 if timed else 5_000_000)
    kept = list(dict.fromkeys([key, order, *ties, state]))
    rows = df.select(*kept).withColumn("_chunk", F.floor(value / width))
    inside = Window.partitionBy(key, "_chunk").orderBy(order, *ties, state)
    numbered = rows.withColumns(
        {
            "previous": F.lag(state).over(inside),
            "_nth": F.row_number().over(inside),
            "_more": F.lead(F.lit(True)).over(inside),
        }
    )
    ends = numbered.where((F.col("_nth") == 1) | F.col("_more").isNull())
    across = (
        ends.groupBy(key, "_chunk")
        .agg(
            *[F.max(F.when(F.col("_nth") == 1, F.struct(*kept))).alias("_first")],
            F.max(F.when(F.col("_more").isNull(), F.struct(F.col(state)))).alias("_last"),
        )
        .withColumn("previous", F.lag(F.col(f"_last.{state}")).over(Window.partitionBy(key).orderBy("_chunk")))
        .select(*[F.col(f"_first.{c}").alias(c) for c in kept], "previous")
    )
    return numbered.where(F.col("_nth") > 1).select(*kept, "previous").unionByName(across)


LEGAL_TRANSITIONS = (
    ("pending", "running"),
    ("running", "failed"),
    ("running", "success"),
)


def is_legal(state: str, previous: str = "previous") -> Column:
    return reduce(
        lambda hit, pair: hit | ((F.col(previous) == pair[0]) & (F.col(state) == pair[1])),
        LEGAL_TRANSITIONS,
        F.lit(False),
    )


def transition_counts(pairs: DataFrame, state: str) -> DataFrame:
    return (
        pairs.where(F.col("previous").isNotNull())
        .groupBy("previous", state)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("legal", is_legal(state))
    )


def daily_tokens(sessions: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return sessions.groupBy(F.to_date("created_at").alias("day"), *extra).agg(
        F.sum("tokens_used").alias("tokens"), F.count(F.lit(1)).alias("runs")
    )


def token_cap(sessions: DataFrame, cap: int) -> DataFrame:
    """Token spend per day against a cap."""
    return daily_tokens(sessions).withColumn("over_cap", F.col("tokens") > cap)


def budget_running(sessions: DataFrame, budget: int) -> DataFrame:
    """Running token total of every month by day, what remains of its budget, and the alert flag.

    Rows are summed per day first, so a window never holds more than a month's days.
    """
    days = daily_tokens(sessions).withColumn("month", F.date_format("day", "yyyy-MM"))
    w = Window.partitionBy("month").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    running = days.withColumn("used", F.sum("tokens").over(w))
    share = F.least(F.col("used") / F.greatest(F.lit(budget), F.lit(1)), F.lit(1.0))
    return running.select(
        "month",
        "day",
        "tokens",
        "used",
        F.greatest(F.lit(budget) - F.col("used"), F.lit(0)).cast("bigint").alias("remaining"),
        share.alias("share"),
        (share >= vocab.BUDGET_ALERT_SHARE).alias("alert"),
    )


def metrics(sessions: DataFrame, group: str, text: str = "input_text") -> DataFrame:
    """Run counters by group; personal data is counted by kinds found in the input."""
    patterns = vocab.BASE_PATTERNS
    flagged = T.with_match_flags(
        sessions.select(group, "status", "tokens_used", "token_budget", text), text, patterns
    )
    found = sum((F.col(T.match_column(p.kind, text)).cast("bigint") for p in patterns), F.lit(0))
    return flagged.groupBy(group).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("status") == "success").alias("successes"),
        F.count_if(F.col("status") == "failed").alias("failures"),
        F.sum("tokens_used").alias("tokens"),
        F.count_if(F.col("tokens_used") > F.col("token_budget")).alias("over_budget"),
        F.sum(found).alias("pii_detections"),
    )


def duration_histogram(df: DataFrame, key: str, ts: str, bounds: Sequence[int]) -> DataFrame:
    """Runs by duration in seconds, counted per upper bound as cumulative buckets."""
    spans = df.groupBy(key).agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"))
    seconds = F.timestamp_diff("SECOND", F.col("_from"), F.col("_to"))
    counts = spans.select(seconds.alias("_s")).agg(
        *[F.count_if(F.col("_s") <= b).alias(f"_le{b}") for b in bounds], F.count(F.lit(1)).alias("_all")
    )
    rows = [
        F.struct(F.lit(str(b)).alias("le"), F.col(f"_le{b}").alias("runs")) for b in bounds
    ] + [F.struct(F.lit("+Inf").alias("le"), F.col("_all").alias("runs"))]
    return counts.select(F.inline_outer(F.array(*rows)))


def event_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("event_type", "severity").agg(F.count(F.lit(1)).alias("n"))
