"""Lineage of a script corpus: which datasets each script reads and writes, and what reaches what over several scripts.

Paths and table names are read from the code without its comments and docstrings. A script carries a column from each
dataset it reads to each it writes if it names the column, or takes all columns. Edges of one column chain
to lineage: the closure holds every source and sink of a column with the least number of scripts between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.functions import lexical as X
from custodia.functions import script as S
from custodia.functions.text import regex_extract_all
from custodia.session import fresh_path

ALL_COLUMNS = "*"
FORMATS = "parquet|csv|json|orc|text|load|table"
# .read, options and formats in any order, and the call that names the dataset; or a table by name.
READ = (
    r"\.read(?:\s*\.\s*\w+\s*\([^()]*\))*?\s*\.\s*(?:" + FORMATS + r")\s*\(\s*['\"]([^'\"]+)['\"]"
    r"|\bspark\s*\.\s*table\s*\(\s*['\"]([^'\"]+)['\"]"
)
WRITE = (
    r"\.write(?:\s*\.\s*\w+\s*\([^()]*\))*?\s*\.\s*(?:parquet|csv|json|orc|text|save|saveAsTable|insertInto)\s*\(\s*['\"]([^'\"]+)['\"]"
    r"|\.writeTo\s*\(\s*['\"]([^'\"]+)['\"]"
)
STAR = r"\.\s*select\s*\(\s*['\"]\*['\"]"


def _code(tokens: Column) -> Column:
    """The code without comments and strings in triple quotes."""
    long = lambda t: F.startswith(t, F.lit('"""')) | F.startswith(t, F.lit("'''"))
    return F.array_join(F.transform(tokens, lambda t: F.when(F.startswith(t, F.lit("#")) | long(t), "").otherwise(t)), "")


def _named(code: Column, regex: str) -> Column:
    both = F.concat(regex_extract_all(code, regex, 1), regex_extract_all(code, regex, 2))
    return F.array_distinct(F.array_remove(both, ""))


def endpoints(df: DataFrame, subject: str, code: str = "code") -> DataFrame:
    """A row per script that reads or writes: subject, reads, writes, columns (``*`` if it takes all)."""
    cut = df.select(subject, S.once(_tokens=X.tokens(F.col(code))))
    cut = cut.select(subject, "_tokens", S.once(_code=_code(F.col("_tokens"))))
    named = S.once(reads=_named(F.col("_code"), READ), writes=_named(F.col("_code"), WRITE), _words=X.columns(F.col("_tokens")))
    found = cut.select(subject, "_code", named).where((F.size("reads") > 0) | (F.size("writes") > 0))
    words = F.array_except("_words", F.concat("reads", "writes"))
    columns = F.when(F.col("_code").rlike(STAR), F.array(F.lit(ALL_COLUMNS))).otherwise(words)
    return found.select(subject, "reads", "writes", columns.alias("columns"))


def edges(df: DataFrame, subject: str, code: str = "code") -> DataFrame:
    """Rows (column_name, source, sink): a script carries the column from the one dataset to the other. Distinct."""
    ends = endpoints(df, subject, code)
    return (
        ends.select("writes", "columns", F.explode("reads").alias("source"))
        .select("source", "columns", F.explode("writes").alias("sink"))
        .select("source", "sink", F.explode("columns").alias("column_name"))
        .select("column_name", "source", "sink")
        .distinct()
    )


def _written(df: DataFrame) -> DataFrame:
    path = fresh_path(df.sparkSession, "lineage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closure(direct: DataFrame) -> DataFrame:
    """Rows (column_name, source, sink, distance): everything that a column reaches, with the least number of scripts.

    Edges of ``*`` carry every column that some script names, and are not followed by themselves. Each round
    follows what the last one found by one more edge and drops what is known, so rings end; there are as many rounds as
    the longest of the shortest ways has edges. Rounds are written to the shared folder. A dataset that reaches itself
    over others is listed. The result is as large as lineage is: all pairs that are connected.
    """
    named = direct.where(F.col("column_name") != ALL_COLUMNS)
    any_column = direct.where(F.col("column_name") == ALL_COLUMNS).select("source", "sink")
    columns = named.select("column_name").distinct()
    step = _written(named.unionByName(columns.join(any_column, F.lit(True))).distinct())
    found = frontier = _written(step.withColumn("distance", F.lit(1)))
    distance = 1
    while frontier.limit(1).count():
        distance += 1
        onward = step.select("column_name", F.col("source").alias("sink"), F.col("sink").alias("_next"))
        reached = frontier.join(onward, ["column_name", "sink"]).select("column_name", "source", F.col("_next").alias("sink")).distinct()
        frontier = _written(reached.join(found, ["column_name", "source", "sink"], "left_anti").withColumn("distance", F.lit(distance)))
        found = found.unionByName(frontier)
    return found


def column_lineage(df: DataFrame, subject: str, code: str = "code") -> DataFrame:
    return closure(edges(df, subject, code))
