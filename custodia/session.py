"""Session settings and the folder that outlives single tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Left to Spark on purpose: join strategy (size-checked broadcast), skew-join
# splitting and partition coalescing are decided at run time from real sizes.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def cluster_settings(shuffle_bytes: int, bytes_per_task: int = 200 * 1024**2) -> dict[str, str]:
    """Settings for a job that shuffles about that much: enough partitions to fit in memory.

    Run-time planning merges what turns out too small, so the number errs on the high side.
    """
    partitions = max(200, -(-shuffle_bytes // bytes_per_task))
    return {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions)}


_fallback: dict[str, str] = {}


def local_session(cores: int | str = "*", app: str = "custodia", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A machine-local folder is only ever used when the whole of Spark runs on
    this one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _fallback:
        _fallback["dir"] = tempfile.mkdtemp(prefix="custodia-")
    return _fallback["dir"]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, never handed out twice."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
