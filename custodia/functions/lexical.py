"""Facts of a script that don't fall for text in strings and comments: one token expression, then a state along the lines.

1. `TOKEN` cuts a script into strings (plain and triple-quoted), comments, continued line ends and the rest.
2. Strings become `""` and comments nothing; line breaks inside strings, and continued ones, stay between a bracket pair of
   their own kind.
3. A state of bracket depth goes along the lines; lines under an open bracket belong to the line that opened it.

What is left are logical lines with the number of their first physical line, where a statement is a statement. The
repetitions of the expressions are possessive, so that a long string needs no deep stack. Strings nested in an
f-string in its own quotes (valid since Python 3.12) are read as ending there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.functions import script as S
from custodia.functions.text import regex_extract_all

# No valid script has these outside strings and comments.
BREAK, OPEN, CLOSE = MARKS = "\ue000\ue001\ue002"
TOKEN = (
    r'(?s)"""(?:[^"\\]++|\\.|"(?!""))*+"""|'
    r"'''(?:[^'\\]++|\\.|'(?!''))*+'''|"
    r'"(?:[^"\\\n]++|\\.)*+"|'
    r"'(?:[^'\\\n]++|\\.)*+'|"
    r"#[^\n]*+|\\\n|[^\"'#\\]++|."
)
COLUMN_TOKEN = r"""(?U)^(?:'([^\W_]\w+)'|"([^\W_]\w+)")$"""
BLANK = r"^[ \t\f\x{E000}-\x{E002}]*$"
TOP_LEVEL = r"^(?:@|(?:def|async|class)[ \t\f\x{E000}-\x{E002}])"
DECORATOR = r"(?U)^@[ \t\f]*\(?[ \t\f]*((?:\w+[ \t\f]*\.[ \t\f]*)*\w+)[ \t\f]*\)?[ \t\f]*$"
DEF_NAME = r"(?U)^def[ \t\f]+(\w+)"
ARGUMENT_TOKEN = r"[()\[\]{},]|[^()\[\]{},]++"
ARGUMENT_NAME = r"(?U)^[ \t\f]*(\w+)"
LAMBDA_OPEN = r"(?s)\blambda\b[^:]*$"
LOGICAL_TYPE = "array<struct<no:int,text:string>>"
SPAN_STATE = "struct<depth:int,since:int,after:int,spans:array<struct<after:int,since:int,to:int>>>"
ARGUMENT_STATE = "struct<depth:int,inside:boolean,done:boolean,fresh:boolean,closed:boolean,within_lambda:boolean,names:array<string>>"
FUNCTION_STATE = f"struct<decorators:array<string>,found:{S.FUNCTION_TYPE}>"


def tokens(code: Column) -> Column:
    return regex_extract_all(F.regexp_replace(code, r"\r\n?", "\n"), TOKEN)


def _masked(token: Column) -> Column:
    quoted = (F.startswith(token, F.lit('"')) | F.startswith(token, F.lit("'"))) & (F.length(token) > 1)
    kept = F.when(quoted, '""').when(F.startswith(token, F.lit("#")), "").when(token == "\\\n", "").otherwise(token)
    breaks = F.regexp_replace(token, r"[^\n]++", "")
    within = (quoted | (token == "\\\n")) & (breaks != "")
    return F.when(within, F.concat(kept, F.lit(OPEN), breaks, F.lit(CLOSE))).otherwise(kept)


def _net_brackets(line: Column) -> Column:
    return F.length(F.translate(line, ")]}" + CLOSE, "")) - F.length(F.translate(line, "([{" + OPEN, ""))


def _spaced(text: Column) -> Column:
    return F.translate(text, MARKS, " " * len(MARKS))


def _spans(lines: Column) -> Column:
    """Lines from the one that opens a bracket to the one that closes the last, and where the lines before begin."""
    moving = F.filter(
        F.transform(lines, lambda line, i: F.struct(i.alias("i"), _net_brackets(line).alias("net"))), lambda x: x["net"] != 0
    )
    start = F.from_json(F.lit('{"depth": 0, "since": 0, "after": 0, "spans": []}'), SPAN_STATE)

    def step(state: Column, x: Column) -> Column:
        depth = F.greatest(state["depth"] + x["net"], F.lit(0))
        opens, closes = (state["depth"] == 0) & (depth > 0), (state["depth"] > 0) & (depth == 0)
        span = F.struct(state["after"].alias("after"), state["since"].alias("since"), x["i"].alias("to"))
        return F.struct(
            depth.alias("depth"),
            F.when(opens, x["i"]).otherwise(state["since"]).alias("since"),
            F.when(closes, x["i"] + 1).otherwise(state["after"]).alias("after"),
            F.when(closes, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        ).cast(SPAN_STATE)

    return F.aggregate(moving, start, step)


def _joined_lines(lines: Column, state: Column) -> Column:
    numbered = F.transform(lines, lambda line, i: F.struct((i + 1).cast("int").alias("no"), line.alias("text")))

    def with_lines_before(span: Column) -> Column:
        whole = F.array_join(F.slice(lines, span["since"] + 1, span["to"] - span["since"] + 1), BREAK)
        head = F.struct((span["since"] + 1).cast("int").alias("no"), whole.alias("text"))
        return F.concat(F.slice(numbered, span["after"] + 1, span["since"] - span["after"]), F.array(head))

    rest = F.slice(numbered, state["after"] + 1, F.size(lines))
    return F.concat(F.flatten(F.transform(state["spans"], with_lines_before)), rest).cast(LOGICAL_TYPE)


def lexed(df: DataFrame, code: str = "code") -> DataFrame:
    """Add ``_tokens``, and ``_logical``: the logical lines that aren't blank. Null code gives nulls."""
    cut = df.select("*", S.once(_tokens=tokens(F.col(code))))
    lines = F.split(F.array_join(F.transform("_tokens", _masked), ""), "\n")
    cut = cut.select("*", S.once(_lines=lines))
    cut = cut.select("*", S.once(_state=_spans(F.col("_lines"))))
    logical = F.filter(_joined_lines(F.col("_lines"), F.col("_state")), lambda x: ~x["text"].rlike(BLANK))
    return cut.select("*", S.once(_logical=logical)).drop("_lines", "_state")


def imports(logical: Column) -> Column:
    """Top-level modules of the import statements, sorted."""
    having = F.filter(logical, lambda x: S.contains(x["text"], "import"))
    plain = F.transform(having, lambda x: F.concat(F.lit("\n"), _spaced(x["text"])))
    statements = F.flatten(F.transform(plain, lambda text: regex_extract_all(text, S.IMPORT_STATEMENT)))
    return S.sorted_set(F.transform(S.names_of_statements(statements), S.top_module))


def argument_names(definition: Column) -> Column:
    """Names of the plain arguments: not those before a lone ``/`` nor behind a ``*``. Brackets of any depth, lambdas too."""
    parts = regex_extract_all(definition, ARGUMENT_TOKEN)
    start = F.from_json(
        F.lit('{"depth":0,"inside":false,"done":false,"fresh":true,"closed":false,"within_lambda":false,"names":[]}'), ARGUMENT_STATE
    )

    def step(state: Column, part: Column) -> Column:
        opens, closes = part.isin("(", "[", "{"), part.isin(")", "]", "}")
        depth = state["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        inside = state["inside"] | ((part == "(") & (state["depth"] == 0))
        listed = state["inside"] & ~state["done"] & (state["depth"] == 1)
        comma = listed & (part == ",")
        word = listed & ~opens & ~closes & (part != ",")
        begins = word & state["fresh"] & ~state["within_lambda"]
        trimmed = F.trim(part)
        name = F.regexp_extract(part, ARGUMENT_NAME, 1)
        star = begins & F.startswith(trimmed, F.lit("*"))
        names = (
            F.when(begins & (trimmed == "/"), F.array().cast("array<string>"))
            .when(begins & ~state["closed"] & ~star & (name != ""), F.concat(state["names"], F.array(name)))
            .otherwise(state["names"])
        )
        in_lambda = F.when(word, part.rlike(LAMBDA_OPEN) | (state["within_lambda"] & ~F.contains(part, F.lit(":")))).otherwise(
            state["within_lambda"]
        )
        blank = trimmed == ""
        return F.struct(
            depth.alias("depth"),
            inside.alias("inside"),
            (state["done"] | (state["inside"] & (depth == 0))).alias("done"),
            F.when(comma, ~state["within_lambda"]).when(word & ~blank, False).otherwise(state["fresh"]).alias("fresh"),
            (state["closed"] | star).alias("closed"),
            in_lambda.alias("within_lambda"),
            names.alias("names"),
        ).cast(ARGUMENT_STATE)

    return F.aggregate(parts, start, step, lambda state: state["names"])


def functions(logical: Column) -> Column:
    """Top-level functions as in ``script.functions``: name, decorators that aren't called, line of the def, arguments."""
    heads = F.transform(
        F.filter(logical, lambda x: x["text"].rlike(TOP_LEVEL)),
        lambda x: F.struct(x["no"].alias("no"), _spaced(x["text"]).alias("text")),
    )
    start = F.from_json(F.lit('{"decorators": [], "found": []}'), FUNCTION_STATE)

    def step(state: Column, x: Column) -> Column:
        named = F.regexp_replace(F.regexp_extract(x["text"], DECORATOR, 1), r"[ \t\f]", "")
        decorates = F.startswith(x["text"], F.lit("@"))
        defines = F.startswith(x["text"], F.lit("def"))
        found = F.struct(
            F.regexp_extract(x["text"], DEF_NAME, 1).alias("name"),
            state["decorators"].alias("decorators"),
            x["no"].alias("line_no"),
            argument_names(x["text"]).alias("args"),
        )
        last = F.substring_index(named, ".", -1)
        return F.struct(
            F.when(decorates & (named != ""), F.concat(state["decorators"], F.array(last)))
            .when(decorates, state["decorators"])
            .otherwise(F.array().cast("array<string>"))
            .alias("decorators"),
            F.when(defines, F.concat(state["found"], F.array(found))).otherwise(state["found"]).alias("found"),
        ).cast(FUNCTION_STATE)

    return F.aggregate(heads, start, step, lambda state: state["found"])


def columns(found: Column) -> Column:
    """Strings that are one word of two or more characters and don't start with an underscore, sorted."""
    words = F.transform(found, lambda t: F.concat(F.regexp_extract(t, COLUMN_TOKEN, 1), F.regexp_extract(t, COLUMN_TOKEN, 2)))
    return S.sorted_set(F.array_remove(words, ""))
