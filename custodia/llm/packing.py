"""Packing documents into fixed-length token sequences, shortest pack first over the length histogram.

1. Tokenise once, cut each document into pieces of the full length and a rest, write the pieces.
2. Count the pieces by length (at most `capacity` rows, whatever the input) and plan packing
   patterns on the driver: lengths longest first, each into the open pattern with most room.
3. Every slot of a pattern takes a range of ranks of its length; a piece finds its slot by its
   rank among the pieces of its length.

The rank needs no sort of all rows: a length is dealt over salts, counts by (length, salt) give each
salt its first rank, and rows are numbered within (length, salt).
"""

from __future__ import annotations

import base64
import json
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custodia.llm.common import staged

END_ID = 0  # closes every document
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


@lru_cache(maxsize=2)
def encoder(ranks_path: str):
    """Byte-level BPE from a file of ranks, and the added tokens of the vocabulary's JSON file beside it."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(ranks_path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that look at what is around them")
    special = {t["content"]: t["id"] for t in added}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_bytes(text: str | None, ranks_path: str) -> bytes:
    """Little-endian unsigned 32-bit ids of the text and the end id behind; added tokens have their own ids, null reads as empty."""
    ids = encoder(ranks_path).encode(text, allowed_special="all") if text else []
    ids.append(END_ID)
    return array("I", ids).tobytes()


def pieces(docs: DataFrame, ranks_path: str, capacity: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens): full-length pieces and the rest of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
        )
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_bytes(words.as_py(), ranks_path)
                tokens = len(ids) // 4
                for start in range(0, tokens, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for column, value in zip(out, (doc, start, len(part) // 4, zlib.crc32(part), tokens), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema, strict=True)], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns (how often, lengths in it) that hold every length as often as the histogram says.

    Longest lengths first. A length goes into the open patterns with most room, as many of them as it has
    pieces; where no open pattern has room, new ones open, with as many of the length as fit.
    """
    room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)  # free places -> (count, lengths)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        free = max(room, default=0)
        while left:
            while free >= length and not room.get(free):
                free -= 1
            if free < length:
                fit = capacity // length
                if left // fit:
                    room[capacity - fit * length].append((left // fit, [length] * fit))
                if left % fit:
                    room[capacity - left % fit * length].append((1, [length] * (left % fit)))
                break
            count, lengths = room[free].pop()
            many = min(count, left)
            if count > many:
                room[free].append((count - many, lengths))
            room[free - length].append((many, [*lengths, length]))
            left -= many
    return [entry for _, entries in sorted(room.items()) for entry in entries]


def slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank behind the last, sequence of the first, offset) for each place of each pattern."""
    taken: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            out.append((length, taken[length], taken[length] + count, sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    return out


def pack(docs: DataFrame, ranks_path: str, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and then END_ID, so an empty or null text is one token. Rows that repeat a
    document, and rows with a null doc_id, are packed each for itself. Other columns are not looked at.
    An empty table gives no rows. Long texts are cut every `capacity` ids.
    """
    spark = docs.sparkSession
    cut = staged(pieces(docs, ranks_path, capacity, doc_id, text), "pieces")
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = staged(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        salted.withColumn("nth", F.row_number().over(within) - 1)
        .join(first, ["length", "salt"])
        .withColumn("rank", F.col("first_rank") + F.col("nth"))
    )
    places = spark.createDataFrame(
        slots(plan_patterns(histogram, capacity)),
        "length int, lo long, hi long, first_sequence long, offset long",
    )
    # For each length the slots' ranges in order of rank; at most a few thousand slots in all, whatever
    # the input, as the plan has no more patterns than twice the capacity.
    ranges = places.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "first_sequence", "offset"))).alias("slots"))
    return (
        ranked.join(F.broadcast(ranges), "length")
        .withColumn("slot", F.filter("slots", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"]))[0])
        .select(
            "doc_id",
            "start",
            F.col("length").cast("long").alias("length"),
            "ids_crc32",
            "doc_tokens",
            (F.col("slot.first_sequence") + F.col("rank") - F.col("slot.lo")).alias("sequence_id"),
            F.col("slot.offset").alias("offset"),
        )
    )
