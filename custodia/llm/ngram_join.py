"""Jaccard self-join on word shingles with PartEnum signatures.

Sets of similar size share a band. Within a band, sets that reach the Jaccard threshold differ in at
most k elements. The elements' domain is cut by a hash into groups, so that in one group at least two such sets differ in
at most `errors` elements; each group is cut into more parts than that, and leaving out any `errors` of them
leaves one choice on which both sets agree. The hash of what a set has in such a choice is a signature:
sets that reach the threshold share one, for certain.

Sets that share signatures under one tag, directly or over others, form families. Equal sets are one vertex from the start. Each
family is compared exactly, in blocks of bounded rows and shingles: first every block with itself and the family's first
block, which connects what a family has in common; then only the sets outside the family's largest component, with
all others, by a field of parities first. Components of the edges found are the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custodia.llm.common import components, discard, free_name, marked, may_match, small_batches, staged, words_of

BLOCK = 256  # sets of a family compared at a time with as many others,
BLOCK_SHINGLES = 250_000  # and their shingles, 8 bytes each
FIRST_SHARE = 8  # one in so many sets of a family's first block meets all other blocks
GRID_ROWS, GRID_SHINGLES = 4096, 8_000_000  # compared at a time by parities, a byte a shingle
MOST_PLACES = 1 << 17
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
MOST_HELD = np.uint64((1 << 24) - 1)
FEW_WEAK = 1e-3
SETS = "doc_id long, n_shingles long, vertex long, nodes array<long>"
ROWS_AT_ONCE = 200_000
EDGES = "a long, b long"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K[1]
    x = (x ^ (x >> np.uint64(27))) * _K[3]
    return x ^ (x >> np.uint64(31))


def _wrapped(a: int, b: np.uint64) -> np.uint64:
    return np.uint64(a * int(b) % 2**64)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words make one shingle, none make none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(width, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mixed(out * _K[0] + ids[k : n + k])
    return np.unique(out)


def vertex_of(elements: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(elements.tobytes())).astype(np.int64))


@lru_cache(maxsize=4096)
def band(size: int, numerator: int, denominator: int) -> tuple[int, int]:
    """(number, largest size) of the band of a size: sets that reach the threshold are in one or in adjacent bands."""
    number, low = 0, 1
    while True:
        high = low * denominator // numerator
        if size <= high:
            return number, high
        number, low = number + 1, high + 1


@dataclass(frozen=True)
class Layout:
    """How the domain is cut for a band: groups of parts, and which parts a signature keeps of a group."""

    groups: int
    parts: int
    choices: tuple[tuple[int, ...], ...]
    spare: int  # groups more than the guarantee needs


def _weak_share(size: int, groups: int, parts: int, errors: int, spare: int) -> float:
    """About the share of sets of that size with more than `spare` groups in which some choice has no element."""
    none = math.exp(-size / groups * (parts - errors) / parts)
    mean = groups * min(1.0, math.comb(parts, errors) * none)
    term = total = math.exp(-mean)
    for n in range(1, spare + 1):
        term *= mean / n
        total += term
    return max(0.0, 1 - total)


@lru_cache(maxsize=4096)
def layout(smallest: int, largest: int, numerator: int, denominator: int) -> Layout:
    """The layout with fewest signatures, of those with few weak sets; sizes are those that the band's pairs have.

    Any layout is exact. Two sets that reach the threshold differ in at most k elements, so with
    k // (errors + 1) + 1 groups one has at most `errors` differences, and with spare groups more than `spare` have.
    """
    # |A| + |B| - 2 |A & B| is at most (1 - t) / (1 + t) (|A| + |B|) for a Jaccard threshold t.
    most = 2 * largest * (denominator - numerator) // (denominator + numerator)
    if not most:
        return Layout(1, 1, ((0,),), 0)
    best = None
    for errors in sorted({e for e in (0, 1, 2, 3, most) if e <= min(most, 3)}):
        for parts in sorted({errors + 1, errors + 2, errors + 3, 2 * errors + 2} if errors else {1}):
            for spare in sorted({*range(13), *(most * share // 100 for share in range(2, 62, 3))}):
                groups = most // (errors + 1) + 1 + spare
                signs = groups * math.comb(parts, errors)
                weak = _weak_share(smallest, groups, parts, errors, spare)
                rank = (weak > FEW_WEAK, signs if weak <= FEW_WEAK else weak + signs / 1000, signs)
                if signs <= 4 * most + 64 and (best is None or rank < best[0]):
                    best = (rank, groups, parts, errors, spare)
    _, groups, parts, errors, spare = best
    return Layout(groups, parts, tuple(combinations(range(parts), parts - errors)), spare)


def tags_of(size: int, numerator: int, denominator: int) -> list[tuple[int, int]]:
    """(number, largest size) of the set's own band and of the next: it meets larger sets under the latter."""
    number, high = band(size, numerator, denominator)
    return [(number, high), (number + 1, band(high + 1, numerator, denominator)[1])]


def node_of(vertex: int, tag: int) -> int:
    """A set as it takes part under a tag, so that families don't reach from band to band."""
    return int(mixed(np.array([vertex], np.int64).view(np.uint64) ^ _wrapped(tag + 1, _K[0])).view(np.int64)[0])


def signatures(elements: np.ndarray, numerator: int, denominator: int) -> list[np.ndarray]:
    """The set's signatures under each of its tags.

    A choice of parts ranks by how many elements the set has in it, then by a hash of them, and a group as its least choice. A
    set of this size differs from any partner so little that more than `spare` of the groups have a choice on which both
    agree. So each set leaves out as many groups, those of least rank, and signs the choices that rank no lower than what
    is left: an agreeing choice ranks the same in both, so the higher of two sets' limits is one that both
    have signed above. What has the fewest elements, which unrelated sets share by chance, goes first. A choice without
    elements is never signed. A set with so many of these that it can't leave them all out, short ones mostly, signs all others,
    and its least elements besides, so many that two such sets that reach the threshold share one: they differ in too
    few elements to have none of these in common. So of a pair, either one keeps the guarantee, or both have these.
    """
    if not len(elements):
        return []
    every = []
    size = len(elements)
    for tag, largest in tags_of(size, numerator, denominator):
        out, ranks = [], []
        low = -(-largest * numerator // denominator)
        plan = layout(max(1, low * numerator // denominator), largest, numerator, denominator)
        groups, parts = plan.groups, plan.parts
        place = (mixed(elements + _wrapped(tag + 1, _K[2])) % np.uint64(groups * parts)).astype(np.int64)
        sums = np.zeros(groups * parts, np.uint64)
        np.add.at(sums, place, elements)
        sums = sums.reshape(groups, parts)
        counts = np.bincount(place, minlength=groups * parts).reshape(groups, parts).astype(np.uint64)
        first = (np.arange(groups, dtype=np.uint64) + np.uint64(1)) * _K[0] + _wrapped(tag, _K[1])
        for nth, choice in enumerate(plan.choices):
            kept = np.full(groups, nth + 1, np.uint64)
            held = np.zeros(groups, np.uint64)
            for part in choice:
                kept = mixed(kept * _K[0] + sums[:, part])
                held += counts[:, part]
            ranks.append(np.where(held > 0, (np.minimum(held, MOST_HELD) << np.uint64(40)) | (kept >> np.uint64(24)), np.uint64(0)))
            out.append(mixed(kept + first))
        partner = min(largest, size * denominator // numerator)
        differ = (size + partner) * (denominator - numerator) // (denominator + numerator)
        spare = groups - differ // (parts - len(plan.choices[0]) + 1) - 1
        limit = np.partition(np.minimum.reduce(ranks), spare)[spare]
        out = [signed[rank >= max(limit, np.uint64(1))] for signed, rank in zip(out, ranks, strict=True)]
        if not limit:
            least = size + 1 - -(-size * numerator // denominator)
            out.append(mixed(elements[:least] * _K[1] + _wrapped(tag + 1, _K[3])))
        every.append(np.concatenate(out))
    return every


def sets_of(docs: DataFrame, width: int, numerator: int, denominator: int) -> DataFrame:
    """Rows (doc_id, n_shingles, vertex, nodes); vertex is a hash of the set, null for an empty set."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, vertices, nodes = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), width)
                vertex = vertex_of(found) if len(found) else None
                sizes.append(len(found))
                vertices.append(vertex)
                tags = tags_of(len(found), numerator, denominator) if len(found) else []
                nodes.append([node_of(vertex, tag) for tag, _ in tags])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(vertices, pa.int64()), pa.array(nodes, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "vertex", "nodes"],
            )

    return docs.mapInArrow(measure, SETS)


def signatures_of(docs: DataFrame, width: int, numerator: int, denominator: int) -> DataFrame:
    """Rows (signature, node) of the texts, once for the sets that a batch repeats.

    Nothing of it is stored: signatures are many and cost less to compute again.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            signs, nodes, counts, held = [], [], [], 0
            for text in batch.column(0):
                found = shingles(text.as_py(), width)
                vertex = vertex_of(found) if len(found) else None
                if vertex is None or vertex in seen:
                    continue
                seen.add(vertex)
                tags = tags_of(len(found), numerator, denominator)
                for (tag, _), own in zip(tags, signatures(found, numerator, denominator), strict=True):
                    signs.append(own)
                    nodes.append(node_of(vertex, tag))
                    counts.append(len(own))
                    held += len(own)
                if held > ROWS_AT_ONCE:
                    yield _signed(signs, nodes, counts)
                    signs, nodes, counts, held = [], [], [], 0
            if signs:
                yield _signed(signs, nodes, counts)

    return docs.mapInArrow(sign, "signature long, node long")


def _signed(signs: list[np.ndarray], nodes: list[int], counts: list[int]) -> pa.RecordBatch:
    owners = np.repeat(np.array(nodes, np.int64), counts)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(signs).view(np.int64)), pa.array(owners)], names=["signature", "node"])


def linked_edges(sets: list[np.ndarray], vertex: list[int], numerator: int, denominator: int) -> list[tuple[int, int]]:
    """Edges that connect, over one another, all sets that reach the threshold.

    A set connected to all it may be compared with is not looked at again.
    """
    sizes = np.array([len(s) for s in sets])
    _, where = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    held = np.zeros(where.max(initial=0) + 1, bool)
    label = np.arange(len(sets))
    edges = []
    for i in range(len(sets)):
        others = np.arange(i + 1, len(sets))
        others = others[label[others] != label[i]]
        fits = np.minimum(sizes[others], sizes[i]) * denominator >= numerator * np.maximum(sizes[others], sizes[i])
        others = others[fits]
        if not len(others):
            continue
        own = where[starts[i] : starts[i] + sizes[i]]
        held[own] = True
        lengths = sizes[others]
        at = np.repeat(starts[others] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        common = np.add.reduceat(held[where[at]].astype(np.int64), np.cumsum(lengths) - lengths)
        held[own] = False
        union = lengths + sizes[i] - common
        for j in others[denominator * common >= numerator * union]:
            if label[j] != label[i]:
                edges.append((vertex[i], vertex[j]))
                label[label == label[j]] = label[i]
    return edges


def _elements(rows: DataFrame, width: int) -> DataFrame:
    """The rows with their text's shingles as bytes in its place, and the vertex taken from them: rows may share an id."""
    kept = [c for c in rows.columns if c not in ("text", "vertex")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = {name: batch[name] for name in kept}
            texts = batch["text"]
            for start in range(0, batch.num_rows, 64):
                found = [shingles(t.as_py(), width) for t in texts[start : start + 64]]
                yield pa.RecordBatch.from_pydict(
                    {
                        **{n: c[start : start + 64] for n, c in table.items()},
                        "vertex": pa.array([vertex_of(f) for f in found], pa.int64()),
                        "elements": pa.array([f.tobytes() for f in found], pa.binary()),
                    }
                )

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept]
    return rows.mapInArrow(measure, ", ".join([*kinds, "vertex long, elements binary"]))


def _unpacked(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(e, np.uint64) for e in rows["elements"]]


def _dealt(rows: DataFrame, blocks: str, block: str, most_rows: int, most_shingles: int) -> DataFrame:
    """Members of each family dealt into numbered blocks that hold so many rows and shingles on average at most."""
    wanted = F.greatest(F.ceil(F.count("*") / most_rows), F.ceil(F.sum("n_shingles") / most_shingles)).cast("int")
    sizes = rows.groupBy("family").agg(wanted.alias(blocks))
    return rows.join(sizes, "family").withColumn(block, F.pmod(F.xxhash64(F.lit(block), "vertex"), F.col(blocks)).cast("int"))


def _parities(rows: DataFrame) -> DataFrame:
    """The rows with their elements as parities: of each place the elements fall on, whether they are an odd number.

    Two sets' parities differ in no more places than the sets differ in elements.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for places, held in zip(batch["places"].to_pylist(), batch["elements"], strict=True):
                on = np.frombuffer(held.as_buffer(), np.uint64) % np.uint64(places)
                found.append(np.packbits(np.bincount(on.astype(np.int64), minlength=places).astype(np.uint8) & 1).tobytes())
            table = {n: batch[n] for n in ("family", "vertex", "known", "n_shingles")}
            yield pa.RecordBatch.from_pydict({**table, "parities": pa.array(found, pa.binary())})

    return rows.mapInArrow(measure, "family long, vertex long, known long, n_shingles long, parities binary")


def _close_pairs(rows: pd.DataFrame, numerator: int, denominator: int) -> pd.DataFrame:
    """Pairs of one set outside the largest component and another whose parities don't rule the threshold out."""
    left, right = rows[~rows["other"]], rows[rows["other"]]
    pairs: list[tuple[int, int]] = []
    if len(left) and len(right):
        field = np.frombuffer(b"".join(right["parities"]), np.uint64).reshape(len(right), -1)
        sizes, known, vertices = (right[c].to_numpy() for c in ("n_shingles", "known", "vertex"))
        for own, size, label, vertex in zip(left["parities"], left["n_shingles"], left["known"], left["vertex"], strict=True):
            fits = np.minimum(sizes, size) * denominator >= numerator * np.maximum(sizes, size)
            fits = np.flatnonzero(fits & (known != label))
            apart = np.bitwise_count(field[fits] ^ np.frombuffer(own, np.uint64)).sum(axis=1, dtype=np.int64)
            close = fits[apart * (denominator + numerator) <= (denominator - numerator) * (sizes[fits] + size)]
            pairs += [(min(vertex, v), max(vertex, v)) for v in vertices[close].tolist()]
    return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")


def _linked_pairs(pairs: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Those of the rows (a, b, left, right) whose elements reach the threshold."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["left"], batch["right"], strict=True):
                own, other = (np.frombuffer(e.as_buffer(), np.uint64) for e in (x, y))
                common = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(denominator * common >= numerator * (len(own) + len(other) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch[c].filter(mask) for c in ("a", "b")], names=["a", "b"])

    return pairs.mapInArrow(verify, EDGES)


def family_links(members: DataFrame, docs: DataFrame, width: int, numerator: int, denominator: int) -> DataFrame:
    """Edges (a, b) between the vertices of each family. members: (family, vertex, n_shingles, doc_id), docs: (doc_id, text).

    The members of a family are dealt into blocks. In the first round each block meets some sets of the family's first block, so
    that all other sets are sent once. In the second, the sets outside the largest component
    that each family has then meet all others of another component, by their parities, an eighth of the
    elements' size; what these don't rule out is compared. A task's size is bounded however large the family.
    """
    # Another row may have the same id: vertices are taken from the texts again.
    docs = may_match(docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")), members, "doc_id")
    dealt = staged(_dealt(members, "blocks", "block", BLOCK, BLOCK_SHINGLES), "dealt")

    def with_elements(rows: DataFrame) -> DataFrame:
        return _elements(rows.join(docs, "doc_id"), width)

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vertex").drop_duplicates("vertex")
        found = linked_edges(_unpacked(rows), rows["vertex"].tolist(), numerator, denominator)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    of_first = (F.col("block") == 0) & (F.pmod(F.xxhash64(F.lit("first"), "vertex"), F.lit(FIRST_SHARE)) == 0)
    everywhere = F.explode(F.when(of_first, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block")))
    sent = with_elements(dealt).select("family", everywhere.alias("task"), "vertex", "elements")
    first = staged(sent.groupBy("family", "task").applyInPandas(within, EDGES), "links")

    several = dealt.where("blocks > 1").drop("blocks", "block")
    if not several.limit(1).count():
        return first
    known = components(first).select(F.col("id").alias("vertex"), F.col("component").alias("known"))
    labelled = staged(several.join(known, "vertex", "left").withColumn("known", F.coalesce("known", "vertex")), "labelled")
    sizes = labelled.groupBy("family", "known").agg(F.count("*").alias("n"), F.max("n_shingles").alias("longest"))
    largest = sizes.groupBy("family").agg(
        F.max_by("known", F.struct("n", "known")).alias("largest"), F.count("*").alias("parts"), F.max("longest").alias("longest")
    )
    # Eight places an element, as a power of two.
    places = F.least(F.lit(MOST_PLACES), 64 * F.pow(F.lit(2), F.ceil(F.log2(F.col("longest") / 8))))
    largest = staged(largest.where("parts > 1").select("family", "largest", F.greatest(F.lit(64), places).cast("int").alias("places")), "largest")
    open_ones = labelled.join(largest, "family")
    elements = staged(with_elements(open_ones.select("family", "known", "n_shingles", "doc_id", "places", "largest")), "elements")
    grid = staged(_parities(elements), "parities").join(largest, "family")
    grid = _dealt(grid, "blocks", "block", GRID_ROWS, GRID_SHINGLES)
    rest = _dealt(grid.where("known != largest"), "rest_blocks", "rest_block", GRID_ROWS, GRID_SHINGLES)
    rest_sizes = rest.select("family", "rest_blocks").distinct()
    columns = ["family", "vertex", "known", "n_shingles", "parities", "i", "j", "other"]
    outside = rest.select(
        "*", F.col("rest_block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(False).alias("other")
    ).select(columns)
    inside = grid.join(rest_sizes, "family").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1)).alias("i"), F.col("block").alias("j"), F.lit(True).alias("other")
    ).select(columns)
    tasks = outside.unionByName(inside).groupBy("family", "i", "j")
    pairs = staged(tasks.applyInPandas(lambda rows: _close_pairs(rows, numerator, denominator), EDGES).distinct(), "close")
    held = elements.groupBy("vertex").agg(F.first("elements").alias("elements"))
    met = pairs.join(held.select(F.col("vertex").alias("a"), F.col("elements").alias("left")), "a")
    met = met.join(held.select(F.col("vertex").alias("b"), F.col("elements").alias("right")), "b")
    return first.unionByName(_linked_pairs(met.select("a", "b", "left", "right"), numerator, denominator))


def placed_classes(docs: DataFrame, width: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, vertex (a hash of its set, null without words), class (the same for linked sets).

    Rows with a null id are in no class.
    """
    common = math.gcd(percent, 100)
    numerator, denominator = percent // common, 100 // common
    small_batches(docs.sparkSession)
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = staged(sets_of(named, width, numerator, denominator), "sets")
    usable = found.where("doc_id is not null and vertex is not null")
    signs = signatures_of(named.where("doc_id is not null").select("text"), width, numerator, denominator)
    shared = signs.groupBy("signature").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high")
    shared = staged(shared.select("signature", "low"), "shared")
    near = may_match(signs, shared, "signature")
    stars = near.join(shared, "signature").where("node != low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    stars = staged(stars, "candidates")
    families = components(stars)
    discard(shared)
    first = usable.groupBy("vertex", "nodes", "n_shingles").agg(F.min("doc_id").alias("doc_id"))
    members = first.select("vertex", "n_shingles", "doc_id", F.explode("nodes").alias("id")).join(families, "id")
    members = staged(members.select(F.col("component").alias("family"), "vertex", "n_shingles", "doc_id"), "families")
    edges = staged(family_links(members, named.where("doc_id is not null"), width, numerator, denominator), "links")
    discard(stars)
    linked = components(edges).select(F.col("id").alias("vertex"), F.col("component").alias("class"))
    placed = found.drop("nodes").join(linked, "vertex", "left").withColumn("class", F.coalesce("class", "vertex"))
    placed = staged(placed.withColumn("class", F.when(F.col("doc_id").isNotNull(), F.col("class"))), "placed")
    discard(found, members, edges)
    return placed


def classes(
    docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest doc_id that it is linked to over others.

    Two documents are linked when 100 * |A & B| >= percent * |A | B| for their sets of `width`-word shingles, A-Z
    lower-cased; fewer words make one shingle. Documents without words, null ones included, are linked
    with nothing, and so are rows with a null id, whose component_id is null. Repeated rows are linked with each other. Extra
    columns are not looked at. An empty table gives no rows. Elements and sets are compared by 64-bit hashes.
    """
    placed = placed_classes(docs, width, percent, doc_id, text)
    least = placed.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    least = staged(least, "least")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return placed.join(least, "class", "left").select("doc_id", "n_shingles", own.alias("component_id"))


def one_of_each_class(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, one of each class of linked ones: that of the smallest id, of its rows the one of the least set hash and text.

    A row is told by its id and its set, so rows that share an id with an unrelated text are decided each for
    itself. Rows without words and rows with a null id stay.
    """
    placed = placed_classes(docs, width, percent, doc_id, text).where("class is not null")
    rows = placed.groupBy("class", "doc_id", "vertex").agg(F.count("*").alias("n"))
    least = rows.groupBy("class").agg(F.min(F.struct("doc_id", "vertex")).alias("least"))
    goes = F.col("least") != F.struct("doc_id", "vertex")
    decided = rows.join(least, "class").select("doc_id", "vertex", "n", goes.alias("goes")).where("n > 1 or goes")
    looked_at = staged(decided, "looked_at")
    flag, vertex, copies, gone, nth = (free_name(docs, n) for n in ("_looked_at", "_vertex", "_n", "_goes", "_nth"))

    @F.pandas_udf("long")
    def vertex_udf(texts: pd.Series) -> pd.Series:
        found = (shingles(t, width) for t in texts)
        return pd.Series([vertex_of(f) if len(f) else None for f in found], dtype="Int64")

    # Only rows whose id is looked at have to meet the decisions; the others pass where they are.
    flagged = marked(docs, looked_at.select(F.col("doc_id").alias(doc_id)), doc_id, flag)
    passed, rest = flagged.where(~F.col(flag)).drop(flag), flagged.where(flag).drop(flag)
    keyed = rest.withColumn(vertex, vertex_udf(F.col(text)))
    known = looked_at.select(F.col("doc_id").alias(f"{vertex}id"), F.col("vertex").alias(f"{vertex}of"), F.col("n").alias(copies), F.col("goes").alias(gone))
    same = (keyed[doc_id] == known[f"{vertex}id"]) & (keyed[vertex] == known[f"{vertex}of"])
    met = keyed.join(known, same, "left")
    alone = met.where(F.col(copies).isNull()).select(*docs.columns)
    others = F.to_json(F.struct(*[c for c in docs.columns if c != text] or [F.lit(1)]))
    order = Window.partitionBy(doc_id, vertex).orderBy(text, others)
    first = met.where(~F.col(gone)).withColumn(nth, F.row_number().over(order)).where(F.col(nth) <= 1).select(*docs.columns)
    return passed.unionByName(alone).unionByName(first)
