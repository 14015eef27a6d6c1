"""Ordered differences of two versions of a text: hunks with headers, which applied to the old text give the new.

Patience diff: lines that both versions hold exactly once are anchors; of these the longest run in the same
order on both sides stays, and each gap between anchors is taken the same way. Where a gap has no anchor, equal lines at
its two ends are matched and the rest is removed and added.

Only which lines match is worked out in Python, for one subject at a time. Rows of lines, context, hunks and headers
are windows. Two shuffles: one brings the versions of a subject together, one the lines of those that changed.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custodia.functions import script as S
from custodia.functions.text import regex_extract_all

CONTEXT = 3
NO_BREAK = "\n\\ No newline at end of file\n"


def longest_rising(values: list[int]) -> list[int]:
    """Positions of a longest strictly rising subsequence; of several, the one whose values are least at the end."""
    ends: list[int] = []  # least last value of a run of each length
    at: list[int] = []  # where that value is
    before: list[int] = []
    for n, value in enumerate(values):
        k = bisect_left(ends, value)
        before.append(at[k - 1] if k else -1)
        if k == len(ends):
            ends.append(value)
            at.append(n)
        else:
            ends[k], at[k] = value, n
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(n)
        n = before[n]
    return out[::-1]


def matched(old: list[str], new: list[str]) -> list[int]:
    """For each old line the number of the new line it stays as, or -1; rising where it isn't."""
    out = [-1] * len(old)
    gaps = [(0, len(old), 0, len(new))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and old[a] == new[c]:
            out[a] = c
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
            out[b] = d
        if a == b or c == d:
            continue
        here, there = Counter(old[a:b]), Counter(new[c:d])
        place = {line: n for n, line in enumerate(new[c:d], c) if there[line] == 1}
        anchors = [(n, place[line]) for n, line in enumerate(old[a:b], a) if here[line] == 1 and line in place]
        if not anchors:
            continue
        kept = [anchors[n] for n in longest_rising([j for _, j in anchors])]
        for (i, j), (k, l) in zip([(a - 1, c - 1), *kept], [*kept, (b, d)], strict=True):
            gaps.append((i + 1, k, j + 1, l))
        for i, j in kept:
            out[i] = j
    return out


def steps(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """The lines in the order of the diff, as (number in old, number in new), -1 where a side doesn't have it."""
    out, j = [], 0
    for i, k in enumerate(matched(old, new)):
        if k >= 0:
            out += [(-1, n) for n in range(j, k)]
            j = k + 1
        out.append((i, k))
    return out + [(-1, n) for n in range(j, len(new))]


def lines_with_breaks(text: Column) -> Column:
    """The lines with their line breaks; only the last may have none."""
    return regex_extract_all(text, r"[^\n]*\n|[^\n]+")


def line_steps(old: DataFrame, new: DataFrame, subject: str, text: str) -> DataFrame:
    """Every line of every changed subject in the order of the diff: subject, place, kind (' ', '-' or '+'), line.

    A subject has changed if it has one text on the new side, not empty, and at most one other on the old. A null old text
    reads as empty. Subjects with several rows on a side have no order between these; ``diff.line_diff`` counts their lines.
    """
    none = F.lit(None).cast("string")
    sides = old.select(subject, F.coalesce(F.col(text), F.lit("")).alias("_old"), none.alias("_new")).unionByName(
        new.select(subject, none.alias("_old"), F.coalesce(F.col(text), F.lit("")).alias("_new"))
    )
    counted = [F.count(n).alias(f"_n{n}") for n in ("_old", "_new")]
    pairs = sides.groupBy(subject).agg(*counted, F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    pairs = pairs.where("_n_old <= 1 and _n_new = 1 and _new <> ''").withColumn("_old", F.coalesce("_old", F.lit("")))
    # Cut once a subject, not again for every line that is looked up.
    cut = S.once(**{n: lines_with_breaks(F.col(n)) for n in ("_old", "_new")})
    changed = pairs.where("_old <> _new").select(subject, cut)

    @F.pandas_udf("array<struct<i:int,j:int>>")
    def align(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"i": i, "j": j} for i, j in steps(list(x), list(y))] for x, y in zip(a, b, strict=True)])

    def line(step: Column) -> Column:
        kind = F.when(step["j"] < 0, "-").when(step["i"] < 0, "+").otherwise(" ")
        return F.struct(kind.alias("kind"), F.coalesce(F.get("_old", step["i"]), F.get("_new", step["j"])).alias("line"))

    # The lines move into the steps before these become rows, so that no row drags the whole texts along. The outer
    # form, because the plain one would run the alignment twice (see ``script.one_row_each``).
    placed = changed.withColumn("_steps", align("_old", "_new")).select(subject, F.transform("_steps", line).alias("_steps"))
    return placed.select(subject, F.posexplode_outer("_steps").alias("place", "_x")).select(subject, "place", "_x.kind", "_x.line")


def hunks(old: DataFrame, new: DataFrame, subject: str, text: str, context: int = CONTEXT) -> DataFrame:
    """A row per hunk: subject, hunk (from 1), old_start, old_lines, new_start, new_lines, header, body.

    The body has every line behind a blank, ``-`` or ``+``; a last line without a line break says so. Changes
    with at most 2 * context equal lines between them are in one hunk.
    """
    in_order = Window.partitionBy(subject).orderBy("place")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    # What is still to come, as what lies behind in the reverse order: a frame that only grows.
    still = Window.partitionBy(subject).orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    change = F.when(F.col("kind") != " ", F.col("place"))
    marked = line_steps(old, new, subject, text).withColumns(
        {
            "_old_no": F.sum((F.col("kind") != "+").cast("int")).over(so_far),
            "_new_no": F.sum((F.col("kind") != "-").cast("int")).over(so_far),
            "_last": F.max(change).over(so_far),
            "_next": F.min(change).over(still),
        }
    )
    near = (F.col("place") - F.col("_last") <= context) | (F.col("_next") - F.col("place") <= context)
    shown = marked.where(near)
    starts = F.coalesce(F.col("place") - F.lag("place").over(in_order) > 1, F.lit(True))
    shown = shown.withColumn("_starts", starts).withColumn("hunk", F.sum(F.col("_starts").cast("int")).over(so_far).cast("int"))
    ended = F.when(F.endswith("line", F.lit("\n")), F.col("line")).otherwise(F.concat("line", F.lit(NO_BREAK)))
    bodies = shown.groupBy(subject, "hunk").agg(
        F.min("_old_no").alias("_old_first"),
        F.min("_new_no").alias("_new_first"),
        F.count(F.when(F.col("kind") != "+", 1)).cast("int").alias("old_lines"),
        F.count(F.when(F.col("kind") != "-", 1)).cast("int").alias("new_lines"),
        F.min_by("kind", "place").alias("_kind"),
        F.sort_array(F.collect_list(F.struct("place", F.concat("kind", ended).alias("text")))).alias("_lines"),
    )

    def start(side: str, skipped: str) -> Column:
        # Running numbers already count the first line, unless it is only on the other side.
        first = F.col(f"_{side}_first") + F.when(F.col("_kind") == skipped, 1).otherwise(0)
        return F.when(F.col(f"{side}_lines") == 0, F.col(f"_{side}_first")).otherwise(first).cast("int").alias(f"{side}_start")

    found = bodies.select(
        subject, "hunk", start("old", "+"), "old_lines", start("new", "-"), "new_lines",
        F.array_join(F.transform("_lines", lambda x: x["text"]), "").alias("body"),
    )
    header = F.format_string("@@ -%d,%d +%d,%d @@", "old_start", "old_lines", "new_start", "new_lines")
    return found.withColumn("header", header)


def unified(
    old: DataFrame, new: DataFrame, subject: str, text: str, old_name: str = "original.py", new_name: str = "rewritten.py"
) -> DataFrame:
    """One text per changed subject, with file headers, as patch tools read it: subject, diff."""
    found = hunks(old, new, subject, text)
    parts = F.sort_array(F.collect_list(F.struct("hunk", F.concat("header", F.lit("\n"), "body").alias("text"))))
    whole = F.array_join(F.transform(parts, lambda x: x["text"]), "")
    return found.groupBy(subject).agg(F.concat(F.lit(f"--- {old_name}\n+++ {new_name}\n"), whole).alias("diff"))
