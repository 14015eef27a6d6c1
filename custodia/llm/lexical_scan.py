"""Ranked lexical search by scanning the texts with one automaton of all items' terms, without an index of the documents.

A text is mapped byte by byte: letters A-Z lower-cased, every other character up to U+007F that can't be in a term
made a guard. The keys of the Aho-Corasick automaton are terms with a guard on either side, so a hit is a whole term; hits may
share a guard, as the automaton finds overlapping keys. A hit's output is the number of its term, and the term's
postings name the items that hold it.

The texts are scanned twice: for the number of documents that hold each term and the lengths, and for the
scores, which need those. Nothing of a text is stored or shuffled: a task sends one count a term,
then its best documents of each item.

The items are taken in blocks whose terms stay within a bound, each scanning all texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from heapq import heappush, heapreplace
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custodia.llm.common import staged

GUARD = " "
MAPPED = bytes(b if b > 0x7F or chr(b).isalnum() else ord(GUARD) for b in bytes(range(256)).lower())
BLOCK_BYTES = 32_000_000  # of the terms of one automaton, counted for every item that holds them
STATISTICS = "term int, n long"
N_DOCUMENTS, N_TERMS = -1, -2  # rows of the statistics that aren't about a term


def mapped(text: str | None) -> bytes:
    """The text between two guards, every character outside terms made a guard; null is empty."""
    return b" %b " % (text or "").encode().translate(MAPPED)


def terms_of(text: str | None) -> list[str]:
    """The terms of a text in order, with repeats."""
    return [t.decode() for t in mapped(text).split()]


class Scan:
    """The automaton of some items' terms, and which items hold each."""

    def __init__(self, items: list[list[str]]):
        self.items = len(items)
        numbers: dict[str, int] = {}
        holders: list[list[int]] = []
        for item, terms in enumerate(items):
            for term in sorted(set(terms)):
                at = numbers.setdefault(term, len(numbers))
                if at == len(holders):
                    holders.append([])
                holders[at].append(item)
        self.terms = list(numbers)
        self.starts = np.cumsum([0, *map(len, holders)])
        self.holders = np.array([i for h in holders for i in h], np.int64)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}

    @property
    def automaton(self):
        """Built once in each Python worker, from the terms that were broadcast."""
        if "_automaton" not in self.__dict__:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for number, term in enumerate(self.terms):
                self._automaton.add_word(GUARD + term + GUARD, number)
            if self.terms:
                self._automaton.make_automaton()
        return self._automaton

    def counts(self, guarded: bytes) -> Counter[int]:
        """How often each term is in the text, by number."""
        return Counter(map(itemgetter(1), self.automaton.iter(guarded.decode()))) if self.terms else Counter()


def statistics(docs: DataFrame, scan) -> DataFrame:
    """Rows (term, n): documents that hold the term; documents with a term, and all their terms, under negative numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0):
                guarded = mapped(text.as_py())
                if n := len(guarded.split()):
                    found.update(scan.value.counts(guarded).keys())
                    found[N_DOCUMENTS] += 1
                    found[N_TERMS] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    return docs.select("text").mapInArrow(count, STATISTICS).groupBy("term").agg(F.sum("n").alias("n"))


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def contribution(weights: np.ndarray, found: Counter[int], length_part: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a document, and what each adds to the score of an item that holds it."""
    terms = np.fromiter(found.keys(), np.int64, len(found))
    tf = np.fromiter(found.values(), np.int64, len(found))
    return terms, weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * length_part))


class Best:
    """The k best documents of each item that a task has seen; ties go to the smaller id, a null id being the last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.zeros(items, np.int64)  # below it nothing enters
        self.heaps: list[list[tuple]] = [[] for _ in range(items)]

    def offer(self, scores: np.ndarray, doc: int | None) -> None:
        place = -math.inf if doc is None else -doc
        for item in np.flatnonzero((scores > 0) & (scores >= self.least)).tolist():
            heap, entry = self.heaps[item], (int(scores[item]), place, doc)
            if len(heap) < self.k:
                heappush(heap, entry)
            elif entry[:2] > heap[0][:2]:
                heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[item] = heap[0][0]


def best_of_tasks(docs: DataFrame, scan, weights, documents: int, all_terms: int, k: int) -> DataFrame:
    """Rows (item, doc_id, score): of each task at most k an item."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scan.value
        best = Best(own.items, k)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                guarded = mapped(text.as_py())
                found = own.counts(guarded)
                if not found:
                    continue
                length_part = 10 + 90 * len(guarded.split()) * documents // all_terms
                terms, adds = contribution(weights.value, found, length_part)
                sizes = own.starts[terms + 1] - own.starts[terms]
                at = np.repeat(own.starts[terms] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                scores = np.zeros(own.items, np.int64)
                np.add.at(scores, own.holders[at], np.repeat(adds, sizes))
                best.offer(scores, doc)
        rows = [(item, doc, n) for item, heap in enumerate(best.heaps) for n, _, doc in heap]
        for start in range(0, len(rows), 10_000):
            columns = zip(*rows[start : start + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "score"]
            )

    return docs.mapInArrow(score, "item int, doc_id long, score long")


def blocks_of(items: DataFrame, item_id: str, text: str, block_bytes: int) -> DataFrame:
    """Rows (item_id, terms, block): each item's distinct terms, dealt into blocks of bounded size. Written to the shared folder."""

    @F.pandas_udf("array<string>")
    def split(texts):
        return texts.map(lambda t: sorted(set(terms_of(t))))

    rows = items.select(F.col(item_id).alias("item_id"), F.explode(split(F.col(text))).alias("term")).distinct()
    held = rows.groupBy("item_id").agg(F.collect_list("term").alias("terms"), F.sum(F.octet_length("term") + 16).alias("bytes"))
    held = staged(held, "items")
    total = held.agg(F.sum("bytes")).first()[0] or 0
    blocks = -(-total // block_bytes) if total else 0
    dealt = F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks))).cast("int")
    return held.withColumn("block", dealt)


def search(
    items: DataFrame, docs: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text",
    doc_id: str = "doc_id", doc_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): each item's k best documents with a score above 0.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased; an item's
    terms count once each. Rows that repeat an item_id are one item with the terms of all, a null item_id being an id
    too; rows that repeat a doc_id are documents of their own. Null and empty texts have no terms: such items give no
    rows, such documents count for nothing. Equal scores go by doc_id, a null one last. No items or no
    documents give no rows. Extra columns are not looked at.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text"))
    dealt = blocks_of(items, item_id, text, block_bytes)
    kind = dealt.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for row in dealt.select("block").distinct().orderBy("block").toLocalIterator():
        block = dealt.where(F.col("block") == row["block"]).select("item_id", "terms").collect()
        scan = Scan([r["terms"] for r in block])
        sent = spark.sparkContext.broadcast(scan)
        known = {r["term"]: r["n"] for r in statistics(named, sent).collect()}
        documents, all_terms = known.get(N_DOCUMENTS, 0), known.get(N_TERMS, 0)
        if not documents:
            break
        weights = np.array([weight(documents, known.get(t, 0)) for t in range(len(scan.terms))], np.int64)
        found = best_of_tasks(named, sent, spark.sparkContext.broadcast(weights), documents, all_terms, k)
        names = spark.createDataFrame([(n, r["item_id"]) for n, r in enumerate(block)], f"item int, item_id {kind}")
        found = staged(found.join(F.broadcast(names), "item").drop("item"), "best")
        best_first = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
        out = out.unionByName(ranked.select("item_id", "rank", "doc_id", "score"))
    return out
