"""From raw documents to packed sequences: quality, repeated lines, near duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as the next one's
docs. All but the last return the columns of docs; what a stage drops is gone for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia.llm import line_dedup, ngram_join, packing, quality_rules, secret_scan
from custodia.llm.common import free_name, small_batches, staged, table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, is the length of the text again."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts fail them."""
    small_batches(spark)
    forest = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "_verdict")
    judged = docs.withColumn(name, quality_rules.verdict(F.col("text"), forest))
    return judged.where(F.col(name)["kept"]).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document or place has; documents that keep none of their lines go."""
    return _counted(line_dedup.without_duplicates(docs, threshold=2, least=24))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id; rows with a null id stay."""
    return ngram_join.one_of_each_class(docs, width=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked."""
    return _counted(docs.withColumn("text", secret_scan.masked(F.col("text"))).select(*docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1024."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=1024)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("packing", pack),
]

#: Trees, edit distances and tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
