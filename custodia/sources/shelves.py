"""Script files by shelves, where tasks make, list and open the files themselves.

Hadoop's local file system starts a process to set the mode of every file and of its checksum, and Spark's scan lists every
file to the driver and packs some thirty into a task. Where the machines mount the folder as files, neither is needed.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHELVES = 512
BATCH_BYTES, BATCH_FILES = 16 * 1024**2, 2000


def mounted(spark: SparkSession, path: str) -> str | None:
    """The folder as the machines mount it, or None in a store of another kind."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


SHOWN = re.compile(r"(?!\.|_[^=]*$)(?!.*\._COPYING_$)", re.S)  # names of files and folders that Spark's scans look at


def shelves_of(folder: str) -> list[str]:
    """The shelves of a folder that holds nothing else."""
    if not os.path.isdir(folder):
        return []
    with os.scandir(folder) as found:
        entries = [e for e in found if SHOWN.match(e.name)]
    only = all(e.name.startswith("shelf=") and e.is_dir() for e in entries)
    return sorted(e.path for e in entries) if only else []


def write(scripts: DataFrame, folder: str) -> None:
    """A shelf appears as a whole, when its task has made all of its files; of two attempts at one the first stays."""
    os.makedirs(folder)

    def folder_name(value: str | None) -> str:
        """What Spark's writers call the folder of a value."""
        if not value:
            return "__HIVE_DEFAULT_PARTITION__"
        return re.sub("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]", lambda c: f"%{ord(c[0]):02X}", value)

    def shelve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, draft, files = None, f"{folder}/_draft-{uuid.uuid4().hex}", 0
        for batch in batches:
            for shelf, script, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = f"{draft}/script_id={folder_name(script)}"
                os.makedirs(at, exist_ok=True)
                with open(f"{at}/part-{shelf:05d}.txt", "ab") as file:
                    file.write((code or b"") + b"\n")
                files += 1
        if files:
            try:
                os.rename(draft, f"{folder}/shelf={shelf}")
            except OSError:
                if not os.path.isdir(f"{folder}/shelf={shelf}"):
                    raise
                shutil.rmtree(draft)
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    dealt = scripts.repartition(SHELVES, "script_id").select(
        F.spark_partition_id().alias("shelf"), F.col("script_id").cast("string"), F.col("code").cast("binary")
    )
    dealt.mapInArrow(shelve, "files long").agg(F.sum("files")).collect()
    with os.scandir(folder) as found:
        for draft in [e.path for e in found if e.name.startswith("_draft-")]:  # of attempts that failed
            shutil.rmtree(draft, ignore_errors=True)
    open(f"{folder}/_SUCCESS", "w").close()


def read(spark: SparkSession, shelves: list[str]) -> DataFrame:
    """(path, code) of every file on the shelves, a task a shelf; files and folders that Spark's scans leave out stay out."""

    def named(path: str) -> str:
        """As Spark's scans name the file."""
        return "file:" + re.sub("[\x00-\x20\"#%<>?\\[\\\\\\]^`{|}\x7f-\xa0\\s]", lambda c: quote(c[0]), path)

    def fail(error: OSError) -> None:
        raise error

    def rows(paths: list[str], codes: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(codes, pa.binary())], names=["path", "code"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: list[str] = []
        codes: list[bytes] = []
        size = 0
        for shelf in (shelves[i] for batch in batches for i in batch.column(0).to_pylist()):
            for at, folders, files in os.walk(shelf, onerror=fail, followlinks=True):
                folders[:] = sorted(filter(SHOWN.match, folders))
                for name in sorted(filter(SHOWN.match, files)):
                    with open(f"{at}/{name}", "rb") as file:
                        codes.append(file.read())
                    paths.append(named(f"{at}/{name}"))
                    size += len(codes[-1])
                    if size >= BATCH_BYTES or len(codes) >= BATCH_FILES:
                        yield rows(paths, codes)
                        paths, codes, size = [], [], 0
        yield rows(paths, codes)

    found = spark.range(0, len(shelves), 1, len(shelves)).mapInArrow(scan, "path string, code binary")
    return found.select("path", F.col("code").cast("string").alias("code"))
