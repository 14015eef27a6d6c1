"""Column expressions that read facts out of a script's text, one pass per fact."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from custodia import vocab
from custodia.functions.text import regex_extract_all

# A statement starts a line or follows ; or : on it. The code is searched with a line
# break put before it, so that one character class tells where a match can start.
# Every character beyond ASCII counts as part of a name: what Python makes of it by
# normalising is for the allow-list to refuse, not for the pattern to overlook.
NAME = r"[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_.\x{80}-\x{10FFFF}]*"
IMPORT_STATEMENT = (
    r"[\n\r;:][ \t\f]*(?:import[ \t\f]+[^\n\r;#]+|from(?:[ \t\f]+\.*|\.+)[ \t\f]*" + NAME + r"[ \t\f]+import\b)"
)
IMPORT_LIST = r"^[\n\r;:][ \t\f]*import[ \t\f]+([^\n\r;#]+)"
IMPORT_FROM = r"^[\n\r;:][ \t\f]*from[ \t\f.]*(" + NAME + ")"
LISTED_NAME = r"(?:^|,)[ \t\f(]*(" + NAME + ")"
CONTINUED = r"\\\r?\n"
# a quoted word of any alphabet; captured if it has two or more characters and starts otherwise than _
QUOTED_COLUMN = r"""(?U)['"](?:_\w*|\w|([^\W_]\w+))['"]"""

# What may stand in brackets: strings, other text, and brackets again, eight levels deep.
_ITEM = r"""(?:[^()'"]++|'[^'\n]*+'|"[^"\n]*+"|['"])"""
for _ in range(8):
    _ITEM = r"""(?:[^()'"]++|'[^'\n]*+'|"[^"\n]*+"|['"]|\(""" + _ITEM + r"*+\))"
DEF = r"^def[ \t]+\w+[ \t]*\("
# decorators, with comments and blank lines between them and before the function
DEF_BLOCK = (
    r"(?m)(?:^@[^\n(]*(?:\(" + _ITEM + r"*+\)[^\n]*)?\n(?:^[ \t]*(?:#[^\n]*)?\n)*)*^def[ \t]+\w+[ \t]*\("
)
DEF_NAME = r"(?m)^def[ \t]+(\w+)"
DEF_ARGS = r"(?m)^def[ \t]+\w+[ \t]*\((" + _ITEM + "*+)"
FUNCTION_TYPE = "array<struct<name:string,decorators:array<string>,line_no:int,args:array<string>>>"
DECORATOR = r"(?m)^@([\w.]+)[ \t]*(?:#.*)?$"
STRING_OR_COMMENT = r"""'[^'\n]*'|"[^"\n]*"|#[^\n]*"""
INNERMOST = r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}"


def array_of(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def without_nulls(values: Column) -> Column:
    """Distinct values in order, without nulls."""
    return F.array_except(values, F.array(F.lit(None).cast("string")))


def sorted_set(values: Column) -> Column:
    return F.sort_array(F.array_distinct(values))


def top_module(dotted: Column) -> Column:
    return F.substring_index(dotted, ".", 1)


def _statements(code: Column) -> Column:
    return regex_extract_all(F.concat(F.lit("\n"), code), IMPORT_STATEMENT)


def imported_names(code: Column) -> Column:
    """Dotted module names in order, ``import a, b.c as d`` and ``from e.f import g`` alike.

    A backslash at the end of a line continues the statement, unless a comment holds it. Both
    readings are searched, so that neither hides a statement from the other.
    """
    continued = contains(code, "\\")
    found = F.concat(
        F.when(continued, _statements(F.regexp_replace(code, CONTINUED, " "))).otherwise(
            F.array().cast("array<string>")
        ),
        _statements(code),
    )
    return names_of_statements(found)


def names_of_statements(statements: Column) -> Column:
    """Dotted module names that import statements name, in order."""
    return F.flatten(
        F.transform(
            statements,
            lambda s: F.when(
                s.rlike(IMPORT_LIST), regex_extract_all(F.regexp_extract(s, IMPORT_LIST, 1), LISTED_NAME, 1)
            ).otherwise(F.array(F.regexp_extract(s, IMPORT_FROM, 1))),
        )
    )


def imports(code: Column) -> Column:
    """Top-level modules, sorted."""
    return sorted_set(F.transform(imported_names(code), top_module))


def functions(code: Column) -> Column:
    """Top-level functions: name, decorators (called decorators are not named), line, arguments.

    Defaults may hold strings, commas and brackets up to eight levels deep.
    """
    blocks = regex_extract_all(code, DEF_BLOCK)
    args = regex_extract_all(code, DEF_ARGS, 1)
    lines = F.filter(
        F.transform(F.split(code, "\n"), lambda line, i: F.struct((i + 1).alias("no"), line.alias("line"))),
        lambda x: x["line"].rlike(DEF),
    )

    def names(part: Column) -> Column:
        plain = F.regexp_replace(part, STRING_OR_COMMENT, "")
        for _ in range(8):
            plain = F.regexp_replace(plain, INNERMOST, "")
        plain = F.regexp_replace(plain, r"(?s)(?:^|,)\s*\*.*", "")
        return F.filter(
            F.transform(F.split(plain, ","), lambda a: F.regexp_extract(a, r"^\s*(\w+)", 1)),
            lambda a: a != "",
        )

    found = F.transform(
        F.arrays_zip(blocks.alias("block"), lines.alias("at"), args.alias("args")),
        lambda f: F.struct(
            F.regexp_extract(f["block"], DEF_NAME, 1).alias("name"),
            F.transform(
                regex_extract_all(f["block"], DECORATOR, 1), lambda d: F.substring_index(d, ".", -1)
            ).alias("decorators"),
            f["at"]["no"].cast("int").alias("line_no"),
            names(F.coalesce(f["args"], F.lit(""))).alias("args"),
        ),
    )
    none = F.from_json(F.lit("[]"), FUNCTION_TYPE)
    return F.when(contains(code, "def "), found).otherwise(none)


def names_with_decorator(found: Column, decorator: str) -> Column:
    return F.transform(
        F.filter(found, lambda f: F.array_contains(f["decorators"], decorator)), lambda f: f["name"]
    )


def transforms(code: Column) -> Column:
    """Recognised method calls: a dot, the name, an opening bracket."""
    called = regex_extract_all(code, r"\.(\w+)\s*\(", 1)
    return F.sort_array(F.array_intersect(called, array_of(vocab.TRANSFORMS)))


def columns(code: Column) -> Column:
    """Quoted words of two or more characters that do not start with an underscore."""
    return sorted_set(F.array_remove(regex_extract_all(code, QUOTED_COLUMN, 1), ""))


def job_type(found: Column) -> Column:
    used = F.flatten(F.transform(found, lambda f: f["decorators"]))
    return F.when(F.arrays_overlap(used, array_of(("flow", "task"))), "prefect").otherwise("pyspark")


def has_schema(code: Column) -> Column:
    return F.contains(code, F.lit("StructType")) | F.contains(code, F.lit("schema="))


def has_write(used: Column) -> Column:
    return F.arrays_overlap(used, array_of(("save", "saveAsTable", "write")))


def contains(code: Column, word: str) -> Column:
    return F.contains(code, F.lit(word))


def contains_any(code: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | contains(code, word)
    return hit


def write_open(code: Column) -> Column:
    return contains(code, "open") & code.rlike(vocab.WRITE_OPEN)


def select_star(code: Column) -> Column:
    return contains(code, "select") & code.rlike(vocab.SELECT_STAR)


def whole_words(words: Sequence[str]) -> str:
    return r"\b(?:" + "|".join(re.escape(w) for w in words) + r")\b"


def present(code: Column, words: Sequence[str]) -> Column:
    """The given words that occur in the code, in the given order, as an array."""
    return without_nulls(F.array(*[F.when(contains(code, w), w) for w in words]))


def one_row_each(values: Column) -> Column:
    """Rows from an array of structs that is never empty.

    The outer form, because the plain one makes Spark ask for ``size(array) > 0``
    below the projection, and with that compute the whole array a second time.
    """
    return F.inline_outer(values)


def once(**columns: Column) -> Column:
    """Columns computed once, although a filter and the output both read them.

    A filter on a computed column moves below the projection and takes a copy of the
    expression along; it cannot move below a generator.
    """
    return one_row_each(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


def joined(values: Column) -> Column:
    return F.array_join(values, ",")
