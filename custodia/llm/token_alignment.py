"""Alignment of two tokenizers' tokens by diagonal run skipping, and counts of linked ids over the corpus.

Both tokenizations spell the same bytes, so tokens are told by where they end. Where i tokens of one and j of the
other lie behind, the index shift j - i stays as it is as long as tokens end together one by one: stretches of that kind are
jumped by comparing slices of the two end arrays at the current shift, each twice as long as the last, and
halved again at the first that differs. What doesn't pair one to one is walked token by token up to the next common
end, which sets the new shift.

Two passes: the alignment writes for every document its linked id pairs with how often; the counts over
the corpus are an aggregation of that, from which each document reads its sums. The most frequent pairs,
a bounded number, are broadcast; what a document holds of others meets its counts in a join.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import discard, staged

WIDEST = 1 << 16  # ids of both vocabularies are below it
HEAD = 1_000_000  # pairs that are broadcast, 17 bytes each
ALIGNED = (
    "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<long>, times array<long>"
)


FIRST_PROBE = 4


def aligned(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the tokens whose bytes overlap, in order; a and b hold the ends of the tokens, the last ones equal."""
    runs: list[int] = []  # first token of A, first of B, how many that go on one by one
    i = j = 0
    n = len(a)
    while i < n:
        x, y = a[i], b[j]
        if x == y:
            # A stretch at this shift: slices twice as long each time, then shorter ones again.
            start, width = i, FIRST_PROBE
            i, j = i + 1, j + 1
            while i + width <= n and a[i : i + width] == b[j : j + width]:
                i, j, width = i + width, j + width, 2 * width
            while width > 1:
                width //= 2
                if i + width <= n and a[i : i + width] == b[j : j + width]:
                    i, j = i + width, j + width
            runs += (start, start + j - i, i - start)
            continue
        runs += (i, j, 1)
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
            runs += (i, j, 1)
        i, j = i + 1, j + 1
    left, right, lengths = np.array(runs, np.int64).reshape(-1, 3).T
    steps = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.repeat(left, lengths) + steps, np.repeat(right, lengths) + steps


class Vocabulary:
    """The bytes of each id, and its number as text within a group and at the group's end."""

    def __init__(self, pieces: list[bytes], end: str):
        self.pieces = np.array([*pieces, None], object)[:-1]
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.names = np.array([f"{n}{mark}" for mark in (",", end) for n in range(len(pieces))], object)

    def spelled(self, ids: np.ndarray) -> bytes:
        return b"".join(self.pieces[ids].tolist())

    def named(self, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The ids as texts; `last` are the places that end a group."""
        ids = ids.copy()
        ids[last] += len(self.pieces)
        return self.names[ids]


class Pair:
    """Both tokenizers: A by ranks of byte strings, B by a piece model."""

    def __init__(self, ranks_path: str, model_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.first = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, number in ranks.items():
            pieces[number] = piece
        self.a = Vocabulary(pieces, "|")
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.second = model

        def spelled(number: int) -> bytes:
            piece = model.id_to_piece(number)
            return bytes([int(piece[3:5], 16)]) if model.is_byte(number) else piece.replace("▁", " ").encode()

        self.b = Vocabulary([spelled(n) for n in range(model.get_piece_size())], ";")
        if max(len(self.a.pieces), len(self.b.pieces)) > WIDEST:
            raise ValueError(f"ids of {WIDEST} and over don't fit a pair")

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both tokenizers, or none where the text is empty or either doesn't spell a space and the text."""
        if not text:
            return None
        a = self.first.encode_to_numpy(" " + text, disallowed_special=())
        b = np.array(self.second.encode(text, num_threads=1), np.int64)
        whole = b" " + text.encode()
        if self.a.spelled(a) != whole or self.b.spelled(b) != whole:
            return None
        return a.astype(np.int64), b

    def align(self, text: str | None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links, groups_sha256, and the linked id pairs with how often."""
        found = self.tokens(text)
        if found is None:
            none = np.zeros(0, np.int64)
            return 0, 0, 0, 0, "", none, none
        a, b = found
        ends_a, ends_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        left, right = aligned(ends_a.tolist(), ends_b.tolist())
        closing = np.flatnonzero(ends_a[left] == ends_b[right])
        last_a, last_b = left[closing], right[closing]
        pairs, times = np.unique(a[left] * WIDEST + b[right], return_counts=True)
        return len(a), len(b), len(closing), len(left), self.digest(a, b, last_a, last_b), pairs, times

    def digest(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """SHA-256 of the groups: ids of A, a bar, ids of B, semicolons between. last_a, last_b: the last token of each group."""
        behind_b = np.concatenate([[0], last_b[:-1] + 1])  # tokens of B before each group
        behind_a = last_a + 1  # tokens of A up to the end of each group
        parts = np.empty(len(a) + len(b), object)
        parts[np.arange(len(a)) + np.repeat(behind_b, np.diff(last_a, prepend=-1))] = self.a.named(a, last_a)
        parts[np.arange(len(b)) + np.repeat(behind_a, np.diff(last_b, prepend=-1))] = self.b.named(b, last_b)
        return hashlib.sha256("".join(parts.tolist())[:-1].encode()).hexdigest()


@lru_cache(maxsize=1)
def pair(ranks_path: str, model_path: str) -> Pair:
    return Pair(ranks_path, model_path)


def alignments(docs: DataFrame, ranks_path: str, model_path: str) -> DataFrame:
    """A row per document with its counts, digest and linked id pairs; row_id tells rows apart that share a doc_id."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(ranks_path, model_path)
        row = TaskContext.get().partitionId() << 33
        kinds = [pa.int64()] * 6 + [pa.string()] + [pa.list_(pa.int64())] * 2
        names = ["row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = both.align(text.as_py())
                rows.append((row, doc, *found))
                row += 1
                held += len(found[-1])
                if held > 1_000_000:
                    yield _batch(rows, kinds, names)
                    rows, held = [], 0
            yield _batch(rows, kinds, names)

    return docs.mapInArrow(align, ALIGNED)


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


class Head:
    """The most frequent pairs: sorted, their counts, and whether a pair's count is the highest of its B id."""

    def __init__(self, rows: pa.Table):
        order = np.argsort(pairs := rows["pair"].to_numpy())
        self.pairs, self.counts = pairs[order], rows["n"].to_numpy()[order]
        self.best = rows["best"].to_numpy(zero_copy_only=False)[order]

    def find(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each pair is, and whether it is there at all."""
        at = np.searchsorted(self.pairs, pairs)
        at[at == len(self.pairs)] = 0
        return at, self.pairs[at] == pairs if len(self.pairs) else np.zeros(len(pairs), bool)


def pair_counts(rows: DataFrame) -> DataFrame:
    """Rows (pair, n, best) over the corpus; a B id's highest count is one row an id, whatever the input."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    counts = staged(each.groupBy("pair").agg(F.sum("n").alias("n")), "pair_counts")
    of_b = F.pmod("pair", F.lit(WIDEST)).alias("b")
    highest = counts.groupBy(of_b).agg(F.max("n").alias("highest"))
    marked = counts.withColumn("b", of_b).join(F.broadcast(highest), "b")
    return marked.select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def least_count(counts: DataFrame, most: int) -> int:
    """The smallest count that no more than `most` pairs reach, in steps of an eighth of a power of two."""
    step = F.floor(8 * F.log2("n")).cast("int").alias("step")
    sizes = {r["step"]: r["n"] for r in counts.groupBy(step).agg(F.count("*").alias("n")).collect()}
    held, least = 0, None
    for at in sorted(sizes, reverse=True):
        held += sizes[at]
        if held > most:
            return least if least is not None else 2**62
        least = int(2 ** (at / 8)) if at else 0
    return 0


def align(
    docs: DataFrame, ranks_path: str, model_path: str, doc_id: str = "doc_id", text: str = "text", head: int = HEAD
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A's tokens are those of a space and the text, B's those of the text; strings of special tokens are plain text. Null and
    empty texts, and texts that either tokenizer doesn't spell byte by byte, have no tokens: zeros and an empty digest. Rows
    that repeat a doc_id or have a null one are documents of their own. Extra columns are not looked at. An empty
    table gives no rows.

    `head` bounds the pairs that are broadcast; the result doesn't depend on it.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = staged(alignments(named, ranks_path, model_path), "aligned")
    counts = staged(pair_counts(rows), "counted")
    least = least_count(counts, head)
    sent = spark.sparkContext.broadcast(Head(counts.where(F.col("n") >= least).toArrow()))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            spans = batch["pairs"]
            starts = spans.offsets.to_numpy()
            pairs = spans.values.to_numpy()
            times = batch["times"].values.to_numpy()
            at, there = known.find(pairs)
            sums = np.zeros((2, len(pairs) + 1), np.int64)
            if len(known.pairs):
                np.cumsum(np.where(there, times * known.counts[at], 0), out=sums[0, 1:])
                np.cumsum(np.where(there & known.best[at], times, 0), out=sums[1, 1:])
            count_sum, n_best = sums[:, starts[1:]] - sums[:, starts[:-1]]
            missing = np.concatenate([[0], np.cumsum(~there)])[starts]
            offsets = pa.array(missing.astype(np.int32))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~there])) for x in (pairs, times)]
            kept = [batch[c] for c in ("row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(n_best), pa.array(count_sum), *rest],
                names=["row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "pairs", "times"],
            )

    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = rows.mapInArrow(look_up, ALIGNED.replace("groups_sha256 string", "groups_sha256 string, n_best long, count_sum long"))
    if not least:
        return found.select(*columns)
    found = staged(found, "looked_up")
    discard(rows)
    rest = found.select("row_id", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "row_id", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")
    )
    met = rest.join(counts.where(F.col("n") < least), "pair")
    more = met.groupBy("row_id").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
    )
    none = F.lit(0).cast("long")
    return (
        found.join(more, "row_id", "left")
        .withColumn("n_best", F.col("n_best") + F.coalesce("more_best", none))
        .withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", none))
        .select(*columns)
    )
