"""Language-model scores from n-gram counts in a log-frequency Bloom filter.

Documents are dealt into blocks of bounded size. A block sends its distinct words, with their counts in its training
documents, and its distinct training word pairs to shards by the hash of the (first) word; so a shard
has everything about its words. It adds up exact word counts, answers every block, and puts quantised
pair counts into its part of the filter: an n-gram of level q is entered q times, as (n-gram, 1) to (n-gram, q),
and read back by probing level after level until one is missing. How many different words follow a word is kept
likewise; Witten-Bell smoothing needs it.

Filter parts are broadcast to the workers, at most `broadcast_bytes` at a time; a larger filter is
taken in several passes over the documents, each summing the tokens whose history is in its parts. Shards and
blocks grow in number with the input, not in size.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import staged, words_of

BLOCK_BYTES = 3 << 20
SHARD_BYTES = 3 << 20  # of text for each shard
BITS_PER_ITEM, PROBES = 10, 6
LEVELS_PER_DOUBLING = 2
START, END = b" start", b" end"  # no word holds a space
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_FOLLOWED = np.uint64(0xA5A5A5A5)  # marks the items that hold a word's number of followers

GATHERED = "shard int, block long, words binary, counts binary, followers binary, pairs binary, pair_counts binary"
REDUCED = "shard int, block long, counts binary, tokens long, types long, bits long, filter binary"
SCORED = (
    "block long, nth long, doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double"
)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K[1]
    x = (x ^ (x >> np.uint64(27))) * _K[3]
    return x ^ (x >> np.uint64(31))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * _K[0] + mixed(second + _K[2]))


def hashed(items: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First position and step, before the modulus, of the probes for (item, level)."""
    h = mixed(items + np.uint64(level) * _K[2])
    return h, (h >> np.uint64(32)) | np.uint64(1)


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 1 for one, then so many levels a doubling; 0 for none."""
    return np.where(counts > 0, 1 + np.floor(LEVELS_PER_DOUBLING * np.log2(np.maximum(counts, 1)) + 1e-9), 0).astype(int)


def count_of(level: np.ndarray) -> np.ndarray:
    """The least count of a level, a whole number."""
    return np.where(level > 0, np.ceil(2.0 ** ((level - 1) / LEVELS_PER_DOUBLING) - 1e-9), 0.0)


def make_filter(items: np.ndarray, level: np.ndarray) -> tuple[int, bytes]:
    """(bits, filter) with every item entered once for each of its levels."""
    bits = max(64, -(-int(level.sum()) * BITS_PER_ITEM // 64) * 64)
    field = np.zeros(bits, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        h, step = hashed(items[level >= j], j)
        for i in range(PROBES):
            field[(h + np.uint64(i) * step) % np.uint64(bits)] = True
    return bits, np.packbits(field, bitorder="little").tobytes()


class Filters:
    """Filter parts by shard, laid end to end."""

    def __init__(self, parts: Iterable[tuple[int, int, bytes]], shards: int) -> None:
        """parts: (shard, bits, filter), in any order."""
        self.bits = np.ones(shards, np.uint64)
        self.start = np.zeros(shards, np.uint64)
        self.held = np.zeros(shards, bool)
        data = bytearray()
        for shard, bits, part in parts:
            self.bits[shard], self.start[shard], self.held[shard] = bits, 8 * len(data), True
            data += part
        self.data = np.frombuffer(data, np.uint8)

    def level(self, items: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """The level of each item: the number of levels found before the first that is missing."""
        out = np.zeros(len(items), int)
        left, j = np.flatnonzero(self.held[shard]), 0
        while len(left):
            j += 1
            h, step = hashed(items[left], j)
            bits, start = self.bits[shard[left]], self.start[shard[left]]
            alive = np.arange(len(left))
            for i in range(PROBES):
                bit = (h[alive] + np.uint64(i) * step[alive]) % bits[alive] + start[alive]
                set_here = (self.data[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
                alive = alive[set_here == 1]
            left = left[alive]
            out[left] = j
        return out


class Block:
    """The words of some texts: ranks by (shard, hash), and the token sequence of all texts."""

    def __init__(self, texts: list[str | None], shards: int) -> None:
        ids: dict[bytes, int] = {START: 0, END: 1}
        flat, lengths = [], []
        for text in texts:
            words = words_of(text)
            flat += [ids.setdefault(w, len(ids)) for w in words]
            flat.append(1)
            lengths.append(len(words) + 1)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, ids), np.uint64, len(ids))
        shard = (mixed(hashes) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((hashes, shard))
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        self.hashes, self.shard = hashes[order], shard[order]
        self.start, self.end = int(rank[0]), int(rank[1])
        self.tokens = rank[np.array(flat, np.int64)]
        self.lengths = np.array(lengths, np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)
        self.previous = np.empty_like(self.tokens)
        self.previous[1:] = self.tokens[:-1]
        self.previous[np.cumsum(self.lengths) - self.lengths] = self.start


def gather(block: int, texts: list[str | None], trained: np.ndarray, shards: int) -> pd.DataFrame:
    """What a block sends to each shard."""
    b = Block(texts, shards)
    size = len(b.hashes)
    use = trained[b.doc]
    counts = np.bincount(b.tokens[use], minlength=size)
    counts[b.start] = int(trained.sum())
    keys, often = np.unique(b.previous[use] * size + b.tokens[use], return_counts=True)
    first, second = keys // size, keys % size
    pairs = pair_hashes(b.hashes[first], b.hashes[second])
    followers = np.bincount(first, minlength=size)
    edge = np.searchsorted(b.shard, np.arange(shards + 1))
    pair_edge = np.searchsorted(first, edge)
    rows = []
    for s in range(shards):
        w, p = slice(edge[s], edge[s + 1]), slice(pair_edge[s], pair_edge[s + 1])
        if edge[s] < edge[s + 1]:
            arrays = (b.hashes[w], counts[w].astype("<u4"), followers[w].astype("<u4"), pairs[p], often[p].astype("<u4"))
            rows.append((s, block, *(a.tobytes() for a in arrays)))
    return pd.DataFrame(rows, columns=["shard", "block", "words", "counts", "followers", "pairs", "pair_counts"])


def joined(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def reduce_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Answers to every block, and the shard's part of the filter with its share of N and V."""
    words, counts, followers = joined(rows["words"], "<u8"), joined(rows["counts"], "<u4"), joined(rows["followers"], "<u4")
    known, which = np.unique(words, return_inverse=True)
    total = np.bincount(which, counts, len(known)).astype(np.int64)
    answers, at = [], 0
    for data in rows["words"]:
        answers.append(total[which[at : at + len(data) // 8]].astype("<i8").tobytes())
        at += len(data) // 8
    first = np.repeat(words, followers)
    pairs, where, which = np.unique(joined(rows["pairs"], "<u8"), return_index=True, return_inverse=True)
    often = np.bincount(which, joined(rows["pair_counts"], "<u4"), len(pairs))
    followed, different = np.unique(first[where], return_counts=True)
    items = np.concatenate([pairs, mixed(followed + _FOLLOWED)])
    bits, data = make_filter(items, levels(np.concatenate([often, different])))
    token = known != xxhash.xxh64_intdigest(START)
    shard = int(rows["shard"].iloc[0])
    out = [(shard, b, a, 0, 0, 0, None) for b, a in zip(rows["block"], answers, strict=True)]
    out.append((shard, None, None, int(total[token].sum()), int((total[token] > 0).sum()), bits, data))
    return pd.DataFrame(out, columns=["shard", "block", "counts", "tokens", "types", "bits", "filter"]).astype({"block": "Int64"})


def score_block(docs: pd.DataFrame, answers: pd.DataFrame, shards: int, n: int, v: int, filters: Filters) -> pd.DataFrame:
    """Base scores, and the model's share that these filter parts hold."""
    docs = docs.sort_values(["doc_id", "text"], na_position="first")
    b = Block(docs["text"].tolist(), shards)
    count = joined(answers.sort_values("shard")["counts"], "<i8").astype(float)
    base = (count + 0.5) / (n + 0.5 * (v + 1))
    keys, which = np.unique(b.previous * len(count) + b.tokens, return_inverse=True)
    first, second = keys // len(count), keys % len(count)
    histories, history = np.unique(first, return_inverse=True)
    different = count_of(filters.level(mixed(b.hashes[histories] + _FOLLOWED), b.shard[histories]))[history]
    often = count_of(filters.level(pair_hashes(b.hashes[first], b.hashes[second]), b.shard[first]))
    often = np.minimum(often, count[first])
    weight = count[first] + different
    p = np.where(different > 0, (often + different * base[second]) / np.maximum(weight, 1), base[second])
    log_p = np.where(filters.held[b.shard[first]], np.log10(p), 0.0)[which]
    size = len(docs)
    return pd.DataFrame(
        {
            "block": docs["block"].to_numpy(),
            "nth": np.arange(size),
            "doc_id": docs["doc_id"].array,
            "held_out": docs["held_out"].to_numpy(),
            "n_tokens": b.lengths,
            "n_known": np.bincount(b.doc, count[b.tokens] > 0, size).astype(np.int64),
            "train_tokens": n,
            "base_score": np.bincount(b.doc, np.log10(base)[b.tokens], size),
            "score": np.bincount(b.doc, log_p, size),
        }
    )


def passes(sizes: dict[int, int], most: int) -> list[list[int]]:
    """Shards in groups whose filter parts have that many bytes together at most, or a single part."""
    groups: list[list[int]] = []
    room = -1
    for shard, size in sorted(sizes.items()):
        if size > room:
            groups.append([])
            room = most
        groups[-1].append(shard)
        room -= size
    return groups


def judge(shared, shards: int, n: int, v: int):
    """The function for a block's documents and answers, with the broadcast filter parts."""

    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return score_block(docs, answers, shards, n, v, shared.value)

    return run


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_bytes: int = 256 << 20) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32(id as text) mod 5 is not 1 (a null id reads as an empty text) and scores all.
    Tokens are the words, A-Z lower-cased, and an end; null texts are an end alone. Repeated rows count
    as often as they occur. Without training rows every token has base probability 1. Extra columns are not looked at.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 1
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), held.alias("held_out"))
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, shards = max(1, math.ceil(total / BLOCK_BYTES)), max(1, math.ceil(total / SHARD_BYTES))
    dealt = named.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def send(rows: pd.DataFrame) -> pd.DataFrame:
        trained = ~rows["held_out"].to_numpy(bool)
        return gather(int(rows["block"].iloc[0]), rows["text"].tolist(), trained, shards)

    sent = dealt.groupBy("block").applyInPandas(send, GATHERED)
    reduced = staged(sent.groupBy("shard").applyInPandas(reduce_shard, REDUCED), "ngrams")
    sums = reduced.agg(F.sum("tokens"), F.sum("types")).first()
    n, v = sums[0] or 0, sums[1] or 0
    parts = reduced.where("filter is not null")
    sizes = {r["shard"]: r["size"] for r in parts.select("shard", F.octet_length("filter").alias("size")).collect()}
    answers = reduced.where("block is not null").select("block", "shard", "counts")
    out = None
    groups = passes(sizes, broadcast_bytes)
    for group in groups:
        # One partition of parts at a time passes through the driver's JVM.
        held_here = parts.where(F.col("shard").between(group[0], group[-1])).select("shard", "bits", "filter")
        filters = Filters(((r["shard"], r["bits"], r["filter"]) for r in held_here.toLocalIterator()), shards)
        shared = spark.sparkContext.broadcast(filters)
        del filters
        scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(judge(shared, shards, n, v), SCORED)
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        out = spark.createDataFrame([], SCORED)
    if len(groups) > 1:
        same = [F.first(c).alias(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")]
        out = out.groupBy("block", "nth").agg(*same, F.sum("score").alias("score"))
    return out.drop("block", "nth")
