"""Facts about a corpus of scripts; one row in, one row out, until something is counted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia import vocab
from custodia.functions import lexical as X
from custodia.functions import script as S
from custodia.functions import text as T
from custodia.operators import pii


def facts(df: DataFrame, code: str = "code") -> DataFrame:
    """Add every fact the other operators read: imports, functions, transforms, columns, flags."""
    c = F.col(code)
    parsed = df.withColumns(
        {
            "imports": S.imports(c),
            "functions": S.functions(c),
            "transforms": S.transforms(c),
            "columns": S.columns(c),
        }
    )
    return parsed.withColumns(
        {
            "job_type": S.job_type(F.col("functions")),
            "line_count": T.line_count(c),
            "has_spark_session": S.contains(c, "SparkSession"),
            "has_schema_def": S.has_schema(c),
            "has_write": S.has_write(F.col("transforms")),
            "tasks": S.names_with_decorator(F.col("functions"), "task"),
            "flows": S.names_with_decorator(F.col("functions"), "flow"),
        }
    )


LEXICAL_FACT = "array<struct<kind:string,name:string,line_no:int,decorators:string,args:string>>"


def lexical_facts(df: DataFrame, code: str, subject: str) -> DataFrame:
    """Imports, top-level functions and column-like strings, a row each, as the syntax tree has them.

    Text in strings and comments is no statement, and text in comments no column. Scripts without any of them, null ones
    included, have no rows. ``facts`` searches the raw text instead, which is cheaper.
    """
    logical = F.col("_logical")

    def fact(kind: str, name: Column, *rest: Column) -> Column:
        return F.struct(F.lit(kind), name, *(rest or (F.lit(None),) * 3))

    every = F.concat(
        F.transform(X.imports(logical), lambda m: fact("import", m)).cast(LEXICAL_FACT),
        F.transform(
            X.functions(logical),
            lambda f: fact("function", f["name"], f["line_no"], S.joined(f["decorators"]), S.joined(f["args"])),
        ).cast(LEXICAL_FACT),
        F.transform(X.columns(F.col("_tokens")), lambda c: fact("column", c)).cast(LEXICAL_FACT),
    )
    found = X.lexed(df.select(subject, code), code).select(subject, S.one_row_each(every))
    return found.where(F.col("kind").isNotNull())


def items(df: DataFrame, values: Column, name: str, *ids: str) -> DataFrame:
    """One row per subject and array element; subjects without elements have no rows.

    Outer explode and a filter after it: the plain one would compute the array twice
    (see ``script.one_row_each``).
    """
    return df.select(*ids, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def column_index(df: DataFrame, code: str = "code", subject: str = "script_id") -> DataFrame:
    """Inverted index as postings ``(column_name, subject)``.

    Rows, not lists: a column every script mentions would make a list as long as
    the corpus. A subject names a column at most once, so no distinct is needed.
    """
    return items(df, S.columns(F.col(code)), "column_name", subject)


def top(df: DataFrame, values: Column, name: str, k: int) -> DataFrame:
    """The k most used values over the corpus, ties by name."""
    used = items(df, values, name)
    return (
        used.groupBy(name).agg(F.count(F.lit(1)).alias("uses")).orderBy(F.desc("uses"), name).limit(k)
    )


def duplicates(df: DataFrame, text: str, subject: str) -> DataFrame:
    """Groups of equal texts: hash, size, first subject. Copies are counted before the shuffle."""
    return (
        df.select(T.content_hash(F.col(text)).alias("content_hash"), subject)
        .groupBy("content_hash")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(subject).alias(f"first_{subject}"))
        .where(F.col("copies") > 1)
    )


def pii_columns_by_subject(
    df: DataFrame, code: str, subject: str, names: Sequence[str] = vocab.COLUMN_NAMES
) -> DataFrame:
    found = df.select(subject, S.once(pii_columns=pii.pii_columns(F.col(code), names)))
    return found.where(F.size("pii_columns") > 0)


def phi_columns(
    df: DataFrame,
    code: str,
    subject: str,
    phi: Sequence[str] = vocab.PHI_NAMES,
    names: Sequence[str] = vocab.COLUMN_NAMES,
) -> DataFrame:
    """Health-information columns among the personal ones, and whether the script masks at all."""
    lower = F.transform(pii.pii_columns(F.col(code), names), lambda c: F.lower(c))
    found = df.select(
        subject,
        S.once(
            phi_columns=F.sort_array(F.array_intersect(lower, S.array_of(phi))),
            masked=S.contains(F.col(code), "mask_pii"),
        ),
    )
    return found.where(F.size("phi_columns") > 0)


def missing_audit_columns(code: Column) -> Column:
    return F.array_except(S.array_of(vocab.AUDIT_COLUMNS), S.present(code, vocab.AUDIT_COLUMNS))


def import_violations(
    df: DataFrame, code: str, subject: str, allowed: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Imported modules that are not on an allow-list, for each of the named lists, in one pass."""
    lists = {"gate": vocab.GATE_IMPORTS} if allowed is None else allowed
    found = df.select(subject, S.once(_imports=S.imports(F.col(code))))
    each = F.array(
        *[
            F.struct(F.lit(name).alias("allow_list"), F.array_except("_imports", S.array_of(modules)).alias("_outside"))
            for name, modules in lists.items()
        ]
    )
    listed = found.select(subject, S.one_row_each(each))
    return items(listed, F.col("_outside"), "module", "allow_list", subject)


def dangerous_patterns(df: DataFrame, code: str, subject: str) -> DataFrame:
    """Every dangerous pattern of every script, not only the first."""
    c = F.col(code)
    extra = F.array(
        F.when(S.write_open(c), "write-mode open"),
        F.when(S.contains_any(c, vocab.NETWORK), "network call"),
    )
    return items(
        df, S.without_nulls(F.concat(S.present(c, vocab.DANGEROUS), extra)), "pattern", subject
    )
