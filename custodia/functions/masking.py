"""Masking strategies for columns, and the replaceable ``mask_pii`` SQL function."""

from __future__ import annotations

import hmac
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia import vocab
from custodia.functions import text as T


def redact(value: Column) -> Column:
    return F.when(value.isNotNull(), F.lit("***"))


def partial(value: Column, keep: int = 4) -> Column:
    """Stars for all but the last characters; a value no longer than those is all stars."""
    hidden = F.greatest(F.length(value) - keep, F.lit(0))
    return F.when(F.length(value) <= keep, F.repeat(F.lit("*"), F.length(value))).otherwise(
        F.concat(F.repeat(F.lit("*"), hidden), F.right(value, F.lit(keep)))
    )


def token(value: Column) -> Column:
    return F.sha2(value, 256)


@dataclass(frozen=True)
class Keyring:
    """Secrets by version; the newest, or the one given, makes pseudonyms. Domains have keys of their own, derived from it.

    Equal values of one domain have equal pseudonyms in every table, so masked tables join as the plain ones do. Values can't be
    found by trial without the secret. A secret is a literal in the plan: keep plans and event logs as closed as keys.
    """

    secrets: Mapping[int, bytes]

    def key(self, domain: str, version: int | None = None) -> bytes:
        return hmac.digest(self.secrets[max(self.secrets) if version is None else version], domain.encode(), "sha256")

    def pseudonym(self, value: Column, domain: str, version: int | None = None, digits: int = 32) -> Column:
        """HMAC-SHA-256 of the value as text, its first hex digits behind the version; null stays null."""
        number = max(self.secrets) if version is None else version
        block = self.key(domain, number).ljust(64, b"\0")
        inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
        message = F.sha2(F.concat(inner, F.encode(value.cast("string"), "UTF-8")), 256)
        code = F.sha2(F.concat(outer, F.unhex(message)), 256)
        return F.concat(F.lit(f"{number}."), F.left(code, F.lit(digits)))


def pseudonymise(df: DataFrame, domains: Mapping[str, str], keys: Keyring, version: int | None = None) -> DataFrame:
    """Columns replaced by pseudonyms of their domain: columns that hold the same kind of value have the same domain."""
    missing = sorted(set(domains) - set(df.columns))
    if missing:
        raise ValueError(f"columns to mask are missing: {', '.join(missing)}")
    return df.withColumns({c: keys.pseudonym(F.col(c), domain, version) for c, domain in domains.items()})


def crosswalk(values: DataFrame, column: str, domain: str, keys: Keyring, old: int, new: int) -> DataFrame:
    """Rows (old_pseudonym, new_pseudonym) of the distinct values, to carry stored tables over to a new secret."""
    known = values.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    return known.select(
        keys.pseudonym(F.col("value"), domain, old).alias("old_pseudonym"), keys.pseudonym(F.col("value"), domain, new).alias("new_pseudonym")
    )


def rotated(df: DataFrame, column: str, walk: DataFrame) -> DataFrame:
    """The table with its old pseudonyms exchanged; those that the crosswalk lacks stay."""
    return (
        df.join(walk, df[column] == walk["old_pseudonym"], "left")
        .withColumn(column, F.coalesce("new_pseudonym", column))
        .select(*df.columns)
    )


def erase(value: Column) -> Column:
    return F.nullif(value, value)


def shape(value: Column) -> Column:
    """Keep the shape of the value: X for upper case, x for lower case, n for digits."""
    return F.mask(value)


STRATEGIES: dict[str, Callable[[Column], Column]] = {
    "redact": redact,
    "partial": partial,
    "token": token,
    "null": erase,
    "shape": shape,
}


def mask_columns(
    df: DataFrame, plan: Mapping[str, str | Callable[[Column], Column]]
) -> DataFrame:
    """Replace columns by their masked form; a strategy is a name or a Column factory."""
    unknown = sorted(set(plan) - set(df.columns))
    if unknown:
        raise ValueError(f"columns to mask are missing: {', '.join(unknown)}")
    factories = {c: STRATEGIES[s] if isinstance(s, str) else s for c, s in plan.items()}
    return df.withColumns({c: make(F.col(c).cast("string")) for c, make in factories.items()})


# What each strategy, and each field type of mask_pii, makes of a value. A shape has no letter and digit
# but its own, and one of them.
MASKED_FORMS = {
    "redact": r"\*\*\*",
    "partial": r"\*{1,4}|\*+.{4}",
    "token": r"[0-9a-f]{64}",
    "null": r"(?!)",
    "shape": r"(?=.*[Xxn])(?:[Xxn]|[^\p{L}\p{Nd}])+",
    "text": r"\[[A-Z_]+\]",
    "email": r"\*\*\*(?:@.*)?",
    "phone": r"[^0-9]*#[^0-9]*",
    "name": r".?\*\*\*",
    "ssn": r"\*\*\*-\*\*-.{0,4}",
}


def looks_masked(value: Column, strategy: str | None = None) -> Column:
    """True where a value is null, or a whole result of the strategy; of any strategy if none is named."""
    forms = [MASKED_FORMS[strategy]] if strategy else MASKED_FORMS.values()
    return value.isNull() | value.rlike("(?s)^(?:" + "|".join(f"(?:{form})" for form in forms) + r")\z")


MASK_PII = r"""
CREATE OR REPLACE TEMPORARY FUNCTION mask_pii(value STRING, field_type STRING)
RETURNS STRING
RETURN CASE WHEN value IS NULL THEN NULL ELSE CASE lower(field_type)
  WHEN 'email' THEN regexp_replace(value, '^[^@]*', '***')
  WHEN 'phone' THEN regexp_replace(value, '[0-9]', '#')
  WHEN 'name' THEN concat(left(value, 1), '***')
  WHEN 'ssn' THEN concat('***-**-', right(value, 4))
  ELSE '***'
END END
"""


def register_mask_pii(spark: SparkSession, definition: str = MASK_PII) -> None:
    """Install ``mask_pii(value, field_type)``; pass another definition to replace it.

    A SQL function is inlined into the plan, so it costs what its body costs.
    """
    spark.sql(definition)


def redact_text(
    df: DataFrame,
    text: str,
    into: str | None = None,
    patterns: Sequence[vocab.Pattern] = vocab.REDACTION_PATTERNS,
) -> DataFrame:
    """Free-text redaction; ``into`` defaults to the text column itself."""
    if into and into != text:
        return T.with_redaction(df, text, into, patterns)
    redacted = T.with_redaction(df, text, "_redacted", patterns)
    return redacted.withColumn(text, F.col("_redacted")).drop("_redacted")
