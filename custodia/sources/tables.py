"""Table and corpus scans with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from custodia.sources import shelves, views

# Declared, never inferred: a column of another type fails at the scan, a missing one reads as
# nulls. `Dataset.as_written` has the schema of the files, for checks against a contract.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


ONE_ROW_GROUP = 128 * 1024**2  # what writers put into one by default


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table of one small file out to all cores before costly work per row.

    Such a file mostly is one row group, and then one task whatever the number of its splits. What is shuffled is
    ONE_ROW_GROUP at most, however many cores there are; every other input passes through untouched.
    """
    files = len(df.inputFiles())
    if files:
        one_task = files == 1 and int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= ONE_ROW_GROUP
    else:
        one_task = df.rdd.getNumPartitions() == 1
    if not one_task:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def write_scripts(scripts: DataFrame, path: str) -> None:
    """One text file per script_id, below shelf=<n>/script_id=<id>.

    Making files is the work, however few bytes they have, so the number of tasks is fixed, not taken from the bytes.
    Every shelf is one task's, which a commit moves as a whole, and which a scan lists in a task.
    """
    folder = shelves.mounted(scripts.sparkSession, path)
    if folder:
        return shelves.write(scripts, folder)
    dealt = scripts.repartition(shelves.SHELVES, "script_id").withColumn("shelf", F.spark_partition_id())
    dealt.write.partitionBy("shelf", "script_id").text(path)


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """One row per script file, in folders of any depth: whole text, with the file name as its source."""
    folder = shelves.mounted(spark, path)
    filled = shelves.shelves_of(folder) if folder else []
    if filled:
        files = shelves.read(spark, filled)
    else:
        whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
        files = whole.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("code"))
    return files.select(F.xxhash64("path").alias("script_id"), "code", "path")


TEXTS = ("documents", "pages", "conversations", "part", "customer")


class Dataset:
    """The tables of one folder, and the views derived from them, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.path(name), SCHEMAS[name])

    def as_written(self, name: str) -> DataFrame:
        """The table with the schema that its files have."""
        return self.spark.read.parquet(self.path(name))

    def view(self, name: str) -> DataFrame:
        text, inputs = views.VIEWS[name]
        return self.spark.sql(text, **{i: self.get(i) for i in inputs})

    def get(self, name: str) -> DataFrame:
        if name in views.VIEWS:
            return self.view(name)
        return self.texts(name) if name in TEXTS else self.table(name)

    def texts(self, name: str) -> DataFrame:
        """A table whose rows get costly text work."""
        return spread(self.table(name))


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table. Spark knows its exact size, so it may choose to broadcast it."""

    def literal(value) -> Column:
        if isinstance(value, (list, tuple)):
            return F.array(*[F.lit(v) for v in value])
        return F.lit(value)

    fields = StructType.fromDDL(schema).fields
    structs = [F.struct(*[literal(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows]
    return spark.range(1).select(F.inline_outer(F.array(*structs)))
