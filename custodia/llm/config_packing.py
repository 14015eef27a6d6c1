"""Packing whole documents into fixed-length sequences by a configuration linear program over the length histogram.

1. Tokenise once; only documents longer than a sequence are cut. Pieces are written with their number among the
   pieces of their length in the same task, so that ranks need no sort.
2. The histogram (at most `capacity` rows, whatever the input) goes to the driver. The linear program asks for the least
   number of sequences whose patterns cover every length. It is solved by multiplicative weights: a length's price falls
   with the share of it that is covered, a knapsack dynamic program finds the patterns of highest price, and
   each round covers a small share of all lengths by the best patterns that hold them.
3. Rounding: the whole parts of the pattern counts, then their fractions added up, never more of a length than there is; what is
   left goes best-fit into the gaps of the patterns and into new sequences.
4. Every slot of a pattern takes a range of ranks of its length; a piece finds its slot by its rank.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custodia.llm.common import staged
from custodia.llm.word_encoder import word_encoder

END_ID = 1  # closes every document
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, doc_tokens long, part int, nth long"
PIECES_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())]
    + [("doc_tokens", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())]
)

Patterns = list[tuple[int, dict[int, int]]]  # how many sequences, and how often each length is in one


def pieces(docs: DataFrame, vocabulary: str, capacity: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece; (part, length, nth) is unique, nth counts from 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        part = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for batch in batches:
            rows = []
            for doc, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = (encoder.encode(words.as_py() or "").tobytes()) + END_ID.to_bytes(4, "little")
                tokens = len(ids) // 4
                for nth, start in enumerate(range(0, tokens, capacity)):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    length = len(piece) // 4
                    rows.append((doc, nth, start, length, zlib.crc32(piece), tokens, part, seen[length]))
                    seen[length] += 1
            columns = zip(*rows, strict=True) if rows else [[] for _ in PIECES_ARROW]
            arrays = [pa.array(c, t.type) for c, t in zip(columns, PIECES_ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=PIECES_ARROW)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best total price within each capacity, and the length put in last there (0: a place stays free)."""
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    room = np.empty(capacity)
    for c in range(1, capacity + 1):
        options = np.add(prices[1 : c + 1], best[c - 1 :: -1], out=room[:c])
        k = int(options.argmax())
        if options[k] > best[c - 1]:
            best[c], pick[c] = options[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, pick


def traced(pick: np.ndarray, room: int) -> dict[int, int]:
    """The lengths of the best pattern within the room."""
    found: dict[int, int] = {}
    while room:
        length = int(pick[room])
        found[length] = found.get(length, 0) + (length > 0)
        room -= length or 1
    found.pop(0, None)
    return found


def covered(pick: np.ndarray, starts: np.ndarray, capacity: int) -> np.ndarray:
    """How much of each length is used when `starts[l]` sequences begin with length l and go on as the table says."""
    used, flow = starts.astype(float).copy(), np.zeros(capacity + 1)
    lengths = np.arange(capacity + 1)
    np.add.at(flow, capacity - lengths, starts)
    for room in range(capacity, 0, -1):
        if flow[room]:
            length = int(pick[room])
            used[length] += flow[room]
            flow[room - (length or 1)] += flow[room]
    used[0] = 0
    return used


class Program:
    """The linear program, solved on the whole: patterns with their counts, and a lower bound of its optimum.

    Every length starts with its size as its price; a price falls with the exponential of the share of the length that
    is covered so far. A round puts the best pattern that holds it beside every length whose pattern is `near` the best,
    as many times as moves no length by more than `share`. The counts are scaled at the end so that they use as many tokens as
    there are; single lengths are then covered too often or not often enough, which the rounding settles.
    """

    def __init__(
        self, histogram: np.ndarray, capacity: int, rounds: int = 64, share: float = 0.1, near: float = 0.02, fall: float = 5.0
    ):
        there = np.flatnonzero(histogram)
        need = histogram.astype(float)
        cover = np.zeros(capacity + 1)
        lengths = np.arange(capacity + 1)
        counts: list[np.ndarray] = []
        self.picks: list[np.ndarray] = []
        self.bound = 0.0
        for _ in range(rounds if len(there) else 0):
            lag = cover[there] / need[there]
            prices = np.full(capacity + 1, -1.0)
            prices[there] = there / capacity * np.exp(-fall * (lag - lag.min()))
            best, pick = knapsack(prices, capacity)
            self.bound = max(self.bound, float(prices[there] @ need[there]) / best[capacity])
            # The best pattern that holds a length is that length and what the table puts beside it.
            holding = np.where(prices > 0, prices + best[capacity - lengths], 0)
            starts = np.where(holding >= (1 - near) * best[capacity], need, 0)
            used = covered(pick, starts, capacity)
            step = share / (used[there] / need[there]).max()
            cover += step * used
            counts.append(step * starts)
            self.picks.append(pick)
        scale = float(lengths @ need) / float(lengths @ cover) if counts else 0.0
        self.counts, self.capacity = [scale * c for c in counts], capacity

    def rounded(self, histogram: np.ndarray, plan_size: int = 65_536) -> Patterns:
        """Whole numbers of sequences that hold every length exactly as often as the histogram says."""
        left = histogram.astype(np.int64).copy()
        open_patterns: dict[int, Patterns] = defaultdict(list)  # by free places

        def take(turn: int, length: int, many: int) -> None:
            pattern = traced(self.picks[turn], self.capacity - length)
            pattern[length] = pattern.get(length, 0) + 1
            many = min(many, *(int(left[l]) // k for l, k in pattern.items()))
            if many > 0:
                for l, k in pattern.items():
                    left[l] -= many * k
                open_patterns[self.capacity - sum(l * k for l, k in pattern.items())].append((many, pattern))

        order = [(float(row[l]), turn, int(l)) for turn, row in enumerate(self.counts) for l in np.flatnonzero(row)]
        order = sorted(order, key=lambda x: (-x[0], x[1], x[2]))[:plan_size]
        for count, turn, length in order:
            if count < 1:
                break
            take(turn, length, int(count))
        rest = 0.0
        for count, turn, length in order:
            rest += count % 1
            if rest >= 1:
                rest -= 1
                take(turn, length, 1)
        return best_fit(left, open_patterns, self.capacity)


def best_fit(left: np.ndarray, open_patterns: dict[int, Patterns], capacity: int) -> Patterns:
    """Put what is left, longest first, where least room stays free, then into new sequences."""
    free = np.zeros(capacity + 1, np.int64)  # patterns with so many free places
    for room, found in open_patterns.items():
        free[room] = len(found)
    for length in range(capacity, 0, -1):
        need = int(left[length])
        while need:
            fitting = np.flatnonzero(free[length:])
            if not len(fitting):
                fit = capacity // length
                for many, each in ((need // fit, fit), (min(1, need % fit), need % fit)):
                    if many:
                        open_patterns[capacity - each * length].append((many, {length: each}))
                        free[capacity - each * length] += 1
                break
            room = length + int(fitting[0])
            many, pattern = open_patterns[room].pop()
            free[room] -= 1
            fit = min(room // length, need)
            taken = min(many, need // fit)
            if many > taken:
                open_patterns[room].append((many - taken, pattern))
                free[room] += 1
            open_patterns[room - fit * length].append((taken, {**pattern, length: pattern.get(length, 0) + fit}))
            free[room - fit * length] += 1
            need -= taken * fit
    return [p for _, found in sorted(open_patterns.items()) for p in found]


class Slots:
    """Where the piece of some length and rank goes. Sorted arrays with a row per pattern and length in it."""

    SHIFT = np.int64(1) << np.int64(48)  # ranks are below it

    def __init__(self, patterns: Patterns):
        taken: dict[int, int] = defaultdict(int)
        rows, sequence = [], 0
        for count, pattern in patterns:
            offset = 0
            for length, each in sorted(pattern.items(), reverse=True):
                rows.append((length, taken[length], each, sequence, offset))
                taken[length] += count * each
                offset += length * each
            sequence += count
        rows.sort()
        self.sequences = sequence
        self.length, self.first, self.each, self.sequence, self.offset = (
            np.array([r[n] for r in rows], np.int64) for n in range(5)
        )
        self.key = self.length * self.SHIFT + self.first

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length.astype(np.int64) * self.SHIFT + rank, side="right") - 1
        past = rank - self.first[at]
        return self.sequence[at] + past // self.each[at], self.offset[at] + past % self.each[at] * self.length[at]


def plan(histogram: dict[int, int], capacity: int) -> Patterns:
    """Patterns for a histogram of lengths; full-length pieces fill a sequence each."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    whole, counts[capacity] = int(counts[capacity]), 0
    found = Program(counts, capacity).rounded(counts)
    return ([(whole, {capacity: 1})] if whole else []) + found


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, doc_tokens.

    A document is its token ids and then END_ID, so an empty or null text is one token. Documents of at most
    `capacity` tokens stay in one piece, longer ones are cut every `capacity` ids. Rows that repeat a document, and rows with a
    null doc_id, are packed each for itself. Other columns are not looked at. An empty table gives no rows.

    What is broadcast is the plan: at most 65,536 patterns of the program and those of the best fit, two for each length.
    """
    spark = docs.sparkSession
    cut = staged(pieces(docs, vocabulary, capacity, doc_id, text), "pieces")
    counts = staged(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    slots = spark.sparkContext.broadcast(Slots(plan(histogram, capacity)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = slots.value(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = cut.join(first, ["part", "length"]).withColumn("at", place("length", F.col("first_rank") + F.col("nth")))
    return ranked.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "at.sequence_id", "at.offset", "doc_tokens"
    )
