"""Repeated passages by content-defined chunking with a gear rolling hash.

A text's bytes run through a gear hash, whose value at a place depends on the 32 bytes before it only. Where its
top bits are zero a chunk ends, unless it would be too short; a chunk that grows too long is cut. So chunk edges
depend on content alone, and behind an insertion they fall into step again after a chunk or two. Chunks are compared by
digest over all documents; neighbouring chunks that other documents have too form repeated passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custodia.llm.common import free_name, may_match, staged

BITS, SHORTEST, LONGEST = 5, 16, 80  # chunks of some 45 bytes on average
GEAR = np.random.default_rng(2).integers(0, 2**32, 256, dtype=np.uint32)
CHUNKS = "doc_id long, text_hash long, digests array<long>, ends array<int>"


def chunk_ends(raw: bytes) -> list[int]:
    """Byte places behind each chunk; never inside a character."""
    data = np.frombuffer(raw, np.uint8)
    h = GEAR[data]
    for reach in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[reach:] = h[:-reach] << np.uint32(reach)
        h = h + shifted
    starts = np.append((data[1:] & 0xC0) != 0x80, True)  # the next byte begins a character
    ends: list[int] = []
    last = 0
    for end in (np.flatnonzero((h >> np.uint32(32 - BITS) == 0) & starts) + 1).tolist() + [len(raw)]:
        while end - last > LONGEST:
            cut = last + LONGEST
            while not starts[cut - 1]:
                cut -= 1
            ends.append(cut)
            last = cut
        if end - last >= SHORTEST or end == len(raw) > last:
            ends.append(end)
            last = end
    return ends


def chunks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (doc_id, text_hash, digests, ends): each text's chunks, with their ends in code points."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests: list[int] = []
            places: list[np.ndarray] = []
            for cell in batch.column(2):
                raw = cell.as_py().encode()
                ends = chunk_ends(raw) if raw else []
                start = 0
                for end in ends:
                    digests.append(xxhash.xxh3_64_intdigest(raw[start:end]))
                    start = end
                points = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                places.append(points[np.array(ends, np.int64) - 1].astype(np.int32))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int32))
            flat = pa.array(np.concatenate(places) if places else np.zeros(0, np.int32))
            hashes = pa.array(np.array(digests, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, hashes), pa.ListArray.from_arrays(offsets, flat)],
                names=["doc_id", "text_hash", "digests", "ends"],
            )

    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return named.where("doc_id is not null and text != ''").mapInArrow(cut, CHUNKS)


def _passages(docs: DataFrame, least: int, doc_id: str, text: str) -> DataFrame:
    """The rows of `repeated_passages`, by id and text: rows that share an id have passages each of its own."""
    row = ["doc_id", "text_hash"]
    cut = staged(chunks(docs, doc_id, text), "chunks")
    each = cut.select(
        *row,
        F.inline(
            F.zip_with(
                F.arrays_zip("digests", "ends"),
                F.concat(F.array(F.lit(0)), "ends"),
                lambda c, start: F.when(
                    c.isNotNull(), F.struct(c["digests"].alias("digest"), start.alias("start"), c["ends"].alias("end"))
                ),
            )
        ),
    ).where("digest is not null")
    shared = each.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first != last")
    shared = staged(shared.drop("last"), "digests")
    hits = may_match(each, shared, "digest").join(shared, "digest").select(*row, "start", "end", "first").distinct()
    in_order = Window.partitionBy(*row).orderBy("start", "end", "first")
    opens = F.when(F.lag("end").over(in_order) >= F.col("start"), 0).otherwise(1)
    own = F.col("first") == F.col("doc_id")
    turns = F.when(F.lag(own).over(in_order) == own, F.col("opens")).otherwise(1)
    runs = hits.withColumn("opens", opens).withColumn("turns", turns)
    runs = runs.withColumn("run", F.sum("opens").over(in_order)).withColumn("part", F.sum("turns").over(in_order))
    parts = runs.groupBy(*row, "run", "part").agg(
        F.min("start").cast("long").alias("start"),
        F.max("end").cast("long").alias("end"),
        F.count("*").alias("n"),
        F.min("first").alias("first"),
    )
    copy = F.when(F.col("first") != F.col("doc_id"), F.struct("start", "end"))
    return (
        parts.groupBy(*row, "run")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sum("n").alias("n_chunks"),
            F.min("first").alias("first_doc_id"),
            F.sort_array(F.collect_list(copy)).alias("copied"),
        )
        .where(F.col("end") - F.col("start") >= least)
        .withColumn("is_first", F.col("first_doc_id") == F.col("doc_id"))
        .select(*row, "start", "end", "n_chunks", "first_doc_id", "is_first", "copied")
    )


def repeated_passages(docs: DataFrame, least: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, start, end, n_chunks, first_doc_id, is_first, copied): maximal runs of chunks that other documents have too.

    Offsets are code points, the end exclusive; runs under `least` code points are left out. is_first: no chunk of the run is in
    a document of a smaller id. first_doc_id is the smallest id that has any of its chunks. copied: the parts (start, end) of the run
    whose chunks are all in documents of smaller ids; the rest of the run is first seen here, and only copied parts may go. What a document
    repeats within itself only does not count, nor what only rows of one id share; rows that repeat an id have runs each for its
    own text, equal ones once. Rows with null ids take no part, null and
    empty texts have no chunks. An empty table gives no rows. Digests have 64 bits: a run of
    `least` code points has two chunks or more, so a chance match of digests makes none.
    """
    return _passages(docs, least, doc_id, text).drop("text_hash")


def without_passages(docs: DataFrame, least: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all their columns, without the passages that a document of a smaller id has too.

    Passages are cut from the text they were found in, also where other rows have the same id.
    """
    copies = _passages(docs, least, doc_id, text).where(~F.col("is_first"))
    of_text = copies.groupBy(F.col("doc_id").alias("_copy_id"), F.col("text_hash").alias("_copy_text"))
    spans = of_text.agg(F.sort_array(F.flatten(F.collect_list("copied"))).alias("_copies"))
    spans = spans.toDF(*(free_name(docs, c) for c in spans.columns))
    copy_id, copy_text, cuts = spans.columns

    @F.pandas_udf("string")
    def rest(texts: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for t, places in zip(texts, gone, strict=True):
            if places is not None and t is not None:
                parts, at = [], 0
                for place in places:
                    parts.append(t[at : place["start"]])
                    at = max(at, place["end"])
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pd.Series(out, dtype=object)

    same = (docs[doc_id].cast("long") == F.col(copy_id)) & (F.xxhash64(docs[text]) == F.col(copy_text))
    joined = docs.join(spans, same, "left")
    return joined.withColumn(text, F.when(F.col(cuts).isNull(), F.col(text)).otherwise(rest(F.col(text), F.col(cuts)))).select(*docs.columns)
