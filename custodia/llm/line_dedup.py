"""Near-duplicate lines by a segment-partition edit join.

A line is cut into threshold + 1 even segments; a line within the threshold of it has at least one of the segments
unchanged, at a place that is shifted by few characters. Every line indexes its segments under (its length,
segment number, content) and, for each length from its own down to threshold less, probes with the substrings that
could be such a segment: left of it at most as many edits as segments stand before it, right of it likewise.
Lines that meet under a key are verified by a banded bit-parallel edit distance, in blocks of bounded size;
components of what is similar are the classes. Equal lines are one vertex from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import components, discard, free_name, marked, may_match, staged

BLOCK = 128
ROWS_TOGETHER = 2000
WORD = r"[^\x20\x09-\x0D]"


def line_hash(line: str) -> int:
    """As xxhash64 in SQL."""
    return xxhash.xxh64_intdigest(line.encode(), 42)


@lru_cache(maxsize=65536)
def windows(length: int, threshold: int, least: int) -> tuple[tuple[int, int, int, int], ...]:
    """(partner length, segment number, place, size) of the substrings a line of that length is known by.

    At the line's own length these include its own segments.
    """
    out = []
    for partner in range(max(length - threshold, least), length + 1):
        longer = length - partner
        size, extra = divmod(partner, threshold + 1)
        place = 0
        for nth in range(threshold + 1):
            wide = size + (nth >= threshold + 1 - extra)
            low = max(place - nth, place + longer - (threshold - nth), 0)
            high = min(place + nth, place + longer + (threshold - nth), length - wide)
            out += [(partner, nth, at, wide) for at in range(low, high + 1)]
            place += wide
    return tuple(out)


def keys_of(line: str, threshold: int, least: int) -> list[int]:
    """Hashes of (partner length, segment number, content); shorter lines than `least` have none."""
    if len(line) < least:
        return []
    return [
        xxhash.xxh64_intdigest(line[at : at + wide].encode(), partner << 8 | nth)
        for partner, nth, at, wide in windows(len(line), threshold, least)
    ]


def distance(a: str, b: str, most: int) -> int:
    """The edit distance of a and b, or most + 1 if it is larger.

    Sets of states as bits: after j characters of b, bit r of reach[e] says that the first j - most + r characters of a
    can be matched with e edits at most. Only the 2 * most + 1 diagonals around the main one are kept.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    mask = (1 << (2 * most + 1)) - 1
    reach = [((2 << e) - 1) << most & mask for e in range(most + 1)]
    for j, c in enumerate(b):
        match = where.get(c, 0) << most >> j
        before, now = 0, 0
        for e in range(most + 1):
            old = reach[e]
            now = ((old & match) | before | before >> 1 | now << 1) & mask
            reach[e], before = now, old
        if not now:
            return most + 1
    last = len(a) - len(b) + most
    return next((e for e in range(most + 1) if reach[e] >> last & 1), most + 1)


def trimmed(a: str, b: str) -> tuple[str, str]:
    """Both without what they share at the start and at the end."""
    n = min(len(a), len(b))
    i = _shared(n, lambda k: a[:k] == b[:k])
    a, b = a[i:], b[i:]
    n = min(len(a), len(b))
    k = _shared(n, lambda k: k == 0 or a[-k:] == b[-k:])
    return a[: len(a) - k], b[: len(b) - k]


def _shared(most: int, holds) -> int:
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        if holds(middle):
            low = middle
        else:
            high = middle - 1
    return low


def similar(a: str, b: str, threshold: int) -> bool:
    return abs(len(a) - len(b)) <= threshold and distance(*trimmed(a, b), threshold) <= threshold


def signatures(docs: DataFrame, text: str, threshold: int, least: int) -> DataFrame:
    """Rows (key, vertex): the keys of every line, once for the lines that a batch repeats."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines: set[str] = set()
            for t in batch.column(0):
                if t.is_valid:
                    lines.update(x for x in t.as_py().split("\n") if len(x) >= least)
            keys: list[int] = []
            owners: list[int] = []
            counts: list[int] = []
            for line in lines:
                if not line.encode().strip():
                    continue
                found = keys_of(line, threshold, least)
                keys += found
                owners.append(line_hash(line))
                counts.append(len(found))
            vertex = np.repeat(np.array(owners, np.uint64), counts) if owners else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(vertex.view(np.int64))], names=["key", "vertex"]
            )

    return docs.select(text).mapInArrow(emit, "key long, vertex long")


def similar_edges(left: list[tuple[int, str]], right: list[tuple[int, str]] | None, threshold: int) -> list[tuple[int, int]]:
    """Edges (vertex, vertex) that connect all similar lines, within left or between left and right."""
    rows = left if right is None else left + right
    label = list(range(len(rows)))
    edges = []
    for i, (vertex, line) in enumerate(left):
        for j in range(i + 1 if right is None else len(left), len(rows)):
            if label[j] != label[i] and similar(line, rows[j][1], threshold):
                edges.append((vertex, rows[j][0]))
                old, new = label[j], label[i]
                label = [new if x == old else x for x in label]
    return edges


def links(docs: DataFrame, text: str, threshold: int, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (a, b): edges between the hashes of similar lines that connect their classes; staged rows they need.

    The lines under a key are dealt into blocks; a pair of blocks is compared at a time, and many small
    pairs share a group, whose number grows with the rows.
    """
    found = signatures(docs, text, threshold, least)
    shared = found.groupBy("key").agg(F.min("vertex").alias("low"), F.max("vertex").alias("high")).where("low != high")
    shared = staged(shared.select("key"), "keys")
    hits = staged(may_match(found, shared, "key").join(shared, "key").distinct(), "hits")
    wanted = hits.select("vertex").distinct()
    lines = docs.select(F.explode(F.split(text, "\n")).alias("line")).withColumn("vertex", F.xxhash64("line"))
    texts = may_match(lines, wanted, "vertex").groupBy("vertex").agg(F.first("line").alias("line"))
    sizes = hits.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    groups = -(-hits.count() // ROWS_TOGETHER) or 1
    dealt = (
        hits.join(sizes, "key")
        .join(texts, "vertex")
        .withColumn("block", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "vertex", "line")
        .withColumn("together", F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups)))
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        pairs: dict[tuple[int, int, int], tuple[list, list]] = {}
        for key, i, j, block, vertex, line in zip(
            rows["key"], rows["i"], rows["j"], rows["block"], rows["vertex"], rows["line"], strict=True
        ):
            pairs.setdefault((key, i, j), ([], []))[block != i].append((vertex, line))
        edges = []
        for (_, i, j), (left, right) in pairs.items():
            edges += similar_edges(sorted(left), None if i == j else sorted(right), threshold)
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64").drop_duplicates()

    return dealt.groupBy("together").applyInPandas(compare, "a long, b long"), [shared, hits]


def duplicate_lines(
    docs: DataFrame, threshold: int = 2, least: int = 24, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows (doc_id, text_hash, position, exact): lines whose class has an earlier line, in order of (doc_id, text_hash, position).

    Equal lines are of one class, and lines of `least` code points or more that are connected by edit distances up to
    the threshold. Lines without a word are of none. exact: an equal line came before, else only a similar one. Null texts have
    no lines; null ids come first in the order; rows equal in id and text are one document. An
    empty table gives no rows.
    """
    lines = (
        docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("position", "line"))
        .where(F.col("line").rlike(WORD))
        .select("doc_id", "text_hash", "position", F.xxhash64("line").alias("vertex"))
    )
    edges, spent = links(docs, text, threshold, least)
    edges = staged(edges, "line_links")
    linked = components(edges)
    discard(edges, *spent)
    place = F.struct("doc_id", "text_hash", "position")
    exact = lines.groupBy("vertex").agg(F.min(place).alias("own"))
    classed = exact.join(linked, exact["vertex"] == linked["id"], "left").select(
        "vertex", "own", F.coalesce("component", "vertex").alias("class")
    )
    classed = staged(classed, "classes")
    first = staged(classed.groupBy("class").agg(F.min("own").alias("first")), "first")
    known = classed.join(first, "class").select("vertex", "own", "first")
    return (
        lines.withColumn("here", place)
        .join(known, "vertex")
        .where("here != first")
        .select("doc_id", "text_hash", "position", (F.col("here") != F.col("own")).alias("exact"))
    )


def removed_lines(docs: DataFrame, threshold: int = 2, least: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document that loses lines: doc_id, text_hash, positions (ascending), n_exact."""
    found = duplicate_lines(docs, threshold, least, doc_id, text).distinct()
    return found.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_list("position")).alias("positions"), F.count_if("exact").alias("n_exact")
    )


def report(docs: DataFrame, threshold: int = 2, least: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines (with a word), n_removed, n_exact, removed (positions from 0, comma-joined)."""
    gone = removed_lines(docs, threshold, least, doc_id, text)
    sizes = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.coalesce(F.array_size(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))), F.lit(0)).cast("long").alias("n_lines"),
    )
    sizes, gone = sizes.alias("s"), gone.alias("g")
    same = F.expr("s.doc_id <=> g.doc_id and s.text_hash = g.text_hash")
    none = F.lit(0).cast("long")
    return sizes.join(gone, same, "left").select(
        "s.doc_id",
        "n_lines",
        F.coalesce(F.array_size("positions").cast("long"), none).alias("n_removed"),
        F.coalesce("n_exact", none).alias("n_exact"),
        F.coalesce(F.concat_ws(",", F.col("positions").cast("array<string>")), F.lit("")).alias("removed"),
    )


def without_duplicates(docs: DataFrame, threshold: int = 2, least: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all their columns, without the removed lines.

    A document that had lines with words and lost all of them goes; others stay, with what is left of their text.
    """
    gone = removed_lines(docs, threshold, least, doc_id, text).select(
        F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_text"), F.col("positions").alias("_gone")
    )
    gone = staged(gone.toDF(*(free_name(docs, c) for c in gone.columns)), "gone")
    gone_id, gone_text, positions = gone.columns
    # Documents that lose nothing pass where they are; the hash of id and text tells them apart.
    flag = free_name(docs, "_loses")
    own = free_name(docs, "_own")
    keys = gone.select(F.xxhash64(gone_id, gone_text).alias(own))
    flagged = marked(docs.withColumn(own, F.xxhash64(F.col(doc_id), F.xxhash64(text))), keys, own, flag).drop(own)
    passed, losing = flagged.where(~F.col(flag)).drop(flag), flagged.where(flag).drop(flag)
    split = F.split(F.col(text), "\n")
    kept = F.filter(split, lambda x, i: ~F.array_contains(F.col(positions), i))
    left = F.when(F.col(positions).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    joined = losing.join(gone, losing[doc_id].eqNullSafe(F.col(gone_id)) & (F.xxhash64(text) == F.col(gone_text)), "left")
    rest = joined.withColumn(text, left).where(F.col(positions).isNull() | F.col(text).rlike(WORD))
    return passed.unionByName(rest.select(*docs.columns))
