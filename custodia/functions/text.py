"""Column expressions over text: pattern matches, redaction, hashes, token estimates, JSON.

All of them are built-in Spark expressions. The pattern scans first ask cheap
questions ("is there an @", "are there digits at all") so that most rows never
reach the costly expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia import vocab

# Necessary for every kind that is made of digits: two digits with a digit, dot or
# dash between them. A text without it can only hold e-mail addresses.
DIGITS_HINT = r"[0-9][0-9.\-][0-9]"


def regex_extract_all(text: Column, regex: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(group))


def _possible(pattern: vocab.Pattern, text: Column, digits: Column) -> Column:
    """Cheap condition without which a text cannot hold a match of the pattern."""
    out = digits if pattern.digits else text.isNotNull()
    for literal in pattern.holds:
        out = out & F.contains(text, F.lit(literal))
    return out


def match_column(kind: str, text: str) -> str:
    return f"_match_{text}_{kind}"


def _digits_column(text: str) -> str:
    return f"_digits_{text}"


def _with_digits(df: DataFrame, texts: Iterable[str]) -> DataFrame:
    return df.withColumns({_digits_column(t): F.col(t).rlike(DIGITS_HINT) for t in texts})


def _per_pattern(
    df: DataFrame,
    texts: Sequence[str],
    patterns: Sequence[vocab.Pattern],
    make: Callable[[vocab.Pattern, Column, Column], Column],
) -> DataFrame:
    return _with_digits(df, texts).withColumns(
        {
            match_column(p.kind, t): make(p, F.col(t), _possible(p, F.col(t), F.col(_digits_column(t))))
            for t in texts
            for p in patterns
        }
    )


def with_matches(
    df: DataFrame, texts: Sequence[str], patterns: Sequence[vocab.Pattern]
) -> DataFrame:
    """Add one array of matches per text column and pattern; null where the hint fails."""
    return _per_pattern(
        df, texts, patterns, lambda p, t, possible: F.when(possible, regex_extract_all(t, p.regex))
    )


def with_match_counts(
    df: DataFrame, texts: Sequence[str], patterns: Sequence[vocab.Pattern]
) -> DataFrame:
    """Add one match count per text column and pattern (0 when there is none)."""
    return _per_pattern(
        df,
        texts,
        patterns,
        lambda p, t, possible: F.coalesce(
            F.when(possible, F.regexp_count(t, F.lit(p.regex))), F.lit(0)
        ),
    )


def with_match_flags(
    df: DataFrame, text: str, patterns: Sequence[vocab.Pattern]
) -> DataFrame:
    """Add one boolean per pattern; stops at the first match."""
    return _per_pattern(
        df,
        [text],
        patterns,
        lambda p, t, possible: F.coalesce(possible & t.rlike(p.regex), F.lit(False)),
    )


def with_redaction(
    df: DataFrame,
    text: str,
    into: str,
    patterns: Sequence[vocab.Pattern] = vocab.REDACTION_PATTERNS,
) -> DataFrame:
    """Replace every match by ``[KIND]``, pattern after pattern in the given order.

    The hints look at the original text: a replacement brings in no digit and no
    ``@``, so a pattern that was ruled out stays ruled out.
    """
    out = _with_digits(df, [text]).withColumn(into, F.col(text))
    for p in patterns:
        replaced = F.regexp_replace(F.col(into), F.lit(p.regex), F.lit(f"[{p.kind}]"))
        possible = _possible(p, F.col(text), F.col(_digits_column(text)))
        out = out.withColumn(into, F.when(possible, replaced).otherwise(F.col(into)))
    return out.drop(_digits_column(text))


def sample(first: Column, width: int = 8) -> Column:
    return F.concat(F.substring(first, 1, width), F.lit("…"))


def risk_level(max_score: Column, critical: Column) -> Column:
    return (
        F.when(critical | (max_score >= 4), "critical")
        .when(max_score == 3, "high")
        .when(max_score == 2, "medium")
        .otherwise("low")
    )


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / vocab.CHARS_PER_TOKEN).cast("bigint")


def strip_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\x00"), F.lit(""))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def fenced_code(text: Column) -> Column:
    """The first fenced block that is plain or marked python, else the whole text; both trimmed."""
    regex = r"(?s)```(?:python)?\s*\n(.*?)```"
    block = F.regexp_extract(text, regex, 1)
    return F.when(F.regexp_like(text, F.lit(regex)), strip_blank(block)).otherwise(strip_blank(text))


def strip_blank(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalise_name(name: Column, strip_prefix: bool = False) -> Column:
    plain = F.lower(F.trim(name))
    return F.regexp_replace(plain, r"^[a-z]{1,2}_", "") if strip_prefix else plain


def profile_list(csv: Column) -> Column:
    return F.filter(
        F.transform(F.split(csv, ","), lambda p: F.lower(F.trim(p))), lambda p: F.length(p) > 0
    )


def payload_ok(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def run_id(source: Column, target: Column, version: Column, day: Column) -> Column:
    return F.sha2(F.concat_ws("|", source, target, version.cast("string"), day.cast("string")), 256)


def line_count(text: Column) -> Column:
    """Lines as a text editor counts them: a closing line break starts no further line."""
    other = r"[\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
    unified = F.when(text.rlike(other), F.regexp_replace(text, rf"\r\n|{other}", "\n")).otherwise(text)
    breaks = F.length(unified) - F.length(F.replace(unified, F.lit("\n"), F.lit("")))
    open_end = (F.length(unified) > 0) & ~F.endswith(unified, F.lit("\n"))
    return (breaks + F.when(open_end, 1).otherwise(0)).cast("int")


def age_days(ts: Column, as_of: str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), F.to_date(ts)).cast("int")
