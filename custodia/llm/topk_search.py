"""Exact top-k by inner product over vectors bucketed by length.

Vectors are dealt into buckets of similar length and the buckets into tiles of bounded size; queries into tiles of
their own. A bounded set of the longest vectors gives every query a first lower bound of its k-th score. A tile
of vectors and a tile of queries meet in one task. There the bound, divided by the query's length and the longest vector of
the tile, is a local cosine threshold: above 1 the whole tile is skipped; near 1 the query's largest
coordinates bound what a partner's coordinates may be (coordinate pruning); else vectors that
are too short are cut off (length pruning). What remains is verified by exact integer products.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custodia.llm.common import staged

BUCKETS_PER_DOUBLING = 8
COORDINATE_FROM = 0.8  # local cosine threshold from which coordinates prune
FOCUS = 6  # coordinates looked at
SLACK = 1e-9
FOUND = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, taken as a double."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, and no component null or not finite."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False)))


def matrix(rows, width: int) -> np.ndarray:
    """Integer rows; shorter vectors are filled up with zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of a with all rows of b."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    wide = a.astype(object) @ b.T.astype(object)
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


def tile_best(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """Rows (query_id, vec_id, score): for each query the k best of the tile that reach its bound."""
    empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    if not len(queries) or not len(vectors):
        return empty
    width = max(max(map(len, queries["v"])), max(map(len, vectors["v"])), 1)
    vectors = vectors.sort_values(["norm", "vec_id"], ascending=[False, True])
    ids, norms = vectors["vec_id"].to_numpy(), vectors["norm"].to_numpy()
    grid, asked = matrix(vectors["v"].tolist(), width), matrix(queries["v"].tolist(), width)
    unit = grid / np.maximum(norms, 1e-300)[:, None]
    longest = norms[0]
    parts = []
    for i, (query_id, length, bound) in enumerate(zip(queries["vec_id"], queries["norm"], queries["bound"], strict=True)):
        reach = np.flatnonzero(ids != query_id)
        if bound > 0:
            if not length or bound / length > longest * (1 + SLACK):
                continue  # the whole tile is too short
            local = bound / (length * longest)
            if local >= COORDINATE_FROM:
                own = asked[i] / length
                focus = np.argsort(-np.abs(own))[:FOCUS]
                t = max(0.0, local - SLACK)
                slack = np.sqrt(np.maximum(0, 1 - own[focus] ** 2) * max(0.0, 1 - t * t)) + SLACK
                # For cosines of at least t, a coordinate lies between the two edges of a cone around the query.
                top = np.where(own[focus] >= t, 1.0, own[focus] * t + slack) + SLACK
                low = np.where(own[focus] <= -t, -1.0, own[focus] * t - slack) - SLACK
                near = unit[reach][:, focus]
                reach = reach[((near <= top) & (near >= low)).all(axis=1)]
            else:
                reach = reach[norms[reach] * (1 + SLACK) >= bound / length]
        if not len(reach):
            continue
        score = products(asked[i : i + 1], grid[reach])[0]
        good = score >= bound
        reach, score = reach[good], score[good]
        order = np.lexsort((ids[reach], -score.astype(float) if np.abs(score).max(initial=0) < 2**53 else [-int(s) for s in score]))[:k]
        parts.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[reach][order], "score": score[order]}))
    return pd.concat(parts) if parts else empty


def first_bounds(queries: DataFrame, longest: list, k: int) -> DataFrame:
    """The queries with `bound`, a lower bound of their k-th score: their k-th score among these vectors."""
    width = max((len(r["v"]) for r in longest), default=0)
    ids, grid = np.array([r["vec_id"] for r in longest], np.int64), matrix([r["v"] for r in longest], width)

    def bound(batches):
        for b in batches:
            wide = max(width, max(map(len, b["v"]), default=0), 1)
            score = products(matrix(b["v"].tolist(), wide), np.pad(grid, ((0, 0), (0, wide - width)))).astype(np.float64)
            score[b["vec_id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
            kth = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(b), -np.inf)
            # a double may round a score up: stay below
            yield b.assign(bound=np.where(np.abs(kth) < 2**53, kth, kth - np.abs(kth) * 1e-12))

    return queries.mapInPandas(bound, "vec_id long, v array<long>, norm double, bound double")


def length_of(vector: str) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def search(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = 1024,
    tile_vectors: int = 512,
    tile_queries: int = 1024,
    seeds: int = 2048,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k best partners, ties to the smaller vec_id.

    queries is a condition on the id column; every other row is a candidate of each query. Vectors that are null or
    hold null or non-finite components, and null ids, take no part. Vectors of different widths are compared as if
    the shorter had zeros behind. Rows that repeat an id are candidates of their own, for queries of other ids; such an id
    asks once, with its smallest vector. An empty table gives no rows. `seeds` vectors, the longest, reach the driver for the first bounds; they bound work, not results.
    """
    spark = vectors.sparkSession
    valid = (
        vectors.where(F.col(vec_id).isNotNull() & usable(F.col(vector)))
        .select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(vector), scale).alias("v"))
        .withColumn("norm", length_of("v"))
        .withColumn("bucket", F.when(F.col("norm") > 0, F.floor(F.log2("norm") * BUCKETS_PER_DOUBLING)).otherwise(-1).cast("int"))
    )
    valid = staged(valid, "vectors")
    longest = valid.select("vec_id", "v", "norm").orderBy(F.desc("norm"), "vec_id").limit(seeds).collect()
    asking = valid.where(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("norm", length_of("v"))
    asked = staged(first_bounds(asking, longest, k), "queries")
    query_tiles = max(1, -(-asked.count() // tile_queries))
    # Tiles of each length bucket; the table has a row a bucket, and doubles have at most some 17,000 of them.
    sizes = valid.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest"))
    sizes = sizes.withColumn("tiles", F.ceil(F.col("n") / tile_vectors).cast("int"))
    sizes = staged(sizes.select("bucket", "tiles", "longest"), "buckets")
    dealt = (
        valid.join(sizes, "bucket")
        .withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_tiles - 1))))
        .select("bucket", "tile", "part", "vec_id", "v", "norm")
    )
    # A query goes to every tile but those of buckets whose longest vector cannot reach its bound.
    visits = (
        asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(query_tiles)).cast("int"))
        .join(sizes.hint("broadcast"), (F.col("bound") <= 0) | (F.col("bound") <= F.col("norm") * F.col("longest") * (1 + SLACK)))
        .withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("bucket", "tile", "part", "vec_id", "v", "norm", "bound")
    )
    keys = ["bucket", "tile", "part"]
    found = (
        visits.groupBy(*keys)
        .cogroup(dealt.groupBy(*keys))
        .applyInPandas(lambda q, v: tile_best(q, v, k), FOUND)
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
