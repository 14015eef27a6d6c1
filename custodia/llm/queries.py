"""Registered queries of the training-data operators; importing this module makes the two tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia.llm import (
    bloom_lm,
    chunk_dedup,
    config_packing,
    lexical_scan,
    license_scan,
    line_dedup,
    ngram_join,
    packing,
    piece_nbest,
    quality_rules,
    secret_scan,
    token_alignment,
    topk_search,
)
from custodia.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), 1024)


@query
def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.report(table(spark, folder, "documents"))


@query
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    forest = quality_rules.fit(docs, table(spark, folder, "labels"))
    return quality_rules.judged(docs, forest)


@query
def op8_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return topk_search.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


CHECKS["op8_topk_search"] = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM valid q JOIN valid c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""


@query
def op10_bloom_lm(spark: SparkSession, folder: str) -> DataFrame:
    return bloom_lm.score(table(spark, folder, "documents"))


@query
def op6_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.classes(table(spark, folder, "documents"), width=3, percent=90)


@query
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.report(table(spark, folder, "documents"), threshold=2, least=24)


@query
def op4_piece_nbest(spark: SparkSession, folder: str) -> DataFrame:
    found = piece_nbest.segmentations(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), n=4)
    return found.select("doc_id", "rank", "score", "n_pieces", F.crc32("ids").alias("ids_crc32"), "round_trip")


@query
def op2_chunk_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_dedup.repeated_passages(table(spark, folder, "documents"), least=100)


@query
def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return license_scan.notices(docs, license_scan.train(docs))


@query
def op11_lexical_scan(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_scan.search(table(spark, folder, "benchmark"), table(spark, folder, "documents"), k=10)


CHECKS["op11_lexical_scan"] = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), lengths AS (
  SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), totals AS (
  SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS terms FROM lengths
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), held AS (
  SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM held, totals GROUP BY term, documents
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // terms)))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""


@query
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return token_alignment.align(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_config_packing(spark: SparkSession, folder: str) -> DataFrame:
    return config_packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096)


CHECKS["op6_ngram_join"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS shingle FROM split
), sizes AS (
  SELECT doc_id, count(shingle) AS n FROM split LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY ALL
), edges AS (
  SELECT x, y FROM links JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * common >= 90 * (p.n + q.n - common)
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT reached.doc_id, y FROM reached JOIN edges ON other = x
)
SELECT doc_id, n AS n_shingles, min(other) AS component_id FROM sizes JOIN reached USING (doc_id) GROUP BY doc_id, n"""
