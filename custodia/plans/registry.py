"""Named queries and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from custodia.sources.tables import Dataset

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(check: str | None = None, name: str | None = None):
    """Register a function of a Dataset, under its own name unless given another, with its checking SQL."""

    def register(build: Callable[[Dataset], DataFrame]):
        key = name or build.__name__
        QUERIES[key] = lambda spark, folder: build(Dataset(spark, folder))
        if check is not None:
            CHECKS[key] = check
        return build

    return register


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def any_of(words) -> str:
    """A regular expression for any of the words, quoted."""
    return quoted("|".join(re.escape(w) for w in words))


def str_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


DUCK_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "TIMESTAMP": "timestamp_ntz", "FLOAT[]": "array<float>",
}


def actual_type_sql(column: str) -> str:
    """The type a column has in its file, under Spark's name."""
    cases = " ".join(f"WHEN '{duck}' THEN '{name}'" for duck, name in DUCK_TYPES.items())
    return f"CASE any_value(typeof({column})) {cases} END"
