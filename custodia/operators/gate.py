"""Admission gate: the first stage that objects names the reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia import vocab
from custodia.functions import script as S
from custodia.functions import text as T


def _first_dangerous(code: Column, mode: str) -> Column:
    """The first dangerous name in the code. Reference mode matches inside longer words too."""
    if mode == "strict":
        word = F.regexp_extract(code, S.whole_words(vocab.DANGEROUS), 0)
        return F.when(S.contains_any(code, vocab.DANGEROUS), F.nullif(word, F.lit("")))
    return F.coalesce(*[F.when(S.contains(code, w), w) for w in vocab.DANGEROUS])


def _filled(rule: str, *found: Column) -> Column:
    """The rule's message with what was found put in."""
    return F.format_string(vocab.GATE_MESSAGES[rule].replace("{}", "%s"), *found)


def gate(
    df: DataFrame,
    code: str = "code",
    max_tokens: int = vocab.MAX_TOKENS,
    mode: str = "reference",
    allowed: Sequence[str] = vocab.GATE_IMPORTS,
) -> DataFrame:
    """Add ``passed, error_code, error_message, rule_violated, sanitized_code``.

    Stages: size, encoding, dangerous name, write-mode open, network call,
    imports, path traversal. Costly stages only see rows the cheap ones let through. A null
    script is no script: it is not admitted.
    """
    if mode not in ("reference", "strict"):
        raise ValueError(f"unknown gate mode: {mode}")
    clean, raw = F.col("_clean"), F.col(code)
    tokens = T.token_estimate(raw)
    cheap = (
        F.when(raw.isNull(), "MISSING_CODE")
        .when(tokens > max_tokens, "SIZE_CHECK")
        .when(~F.is_valid_utf8(raw), "ENCODING_CHECK")
        .when(F.col("_danger").isNotNull(), "DANGEROUS_PATTERN")
        .when(S.write_open(clean), "DANGEROUS_WRITE")
        .when(S.contains_any(clean, vocab.NETWORK), "NETWORK_CALL")
    )
    # Imports are read once, for the rule and for its message, and only where nothing before them objects.
    first_outside = F.get(F.filter(S.imported_names(clean), lambda m: ~S.top_module(m).isin(*allowed)), F.lit(0))
    checked = df.select("*", S.once(_clean=T.strip_nul(raw)))
    checked = checked.select("*", S.once(_danger=_first_dangerous(clean, mode)))
    checked = checked.select("*", S.once(_cheap=cheap))
    checked = checked.select("*", S.once(_outside=F.when(F.col("_cheap").isNull(), first_outside)))
    rule = F.coalesce(
        F.col("_cheap"),
        F.when(F.col("_outside").isNotNull(), "IMPORT_WHITELIST").when(S.contains_any(clean, vocab.TRAVERSAL), "PATH_TRAVERSAL"),
    )
    checked = checked.select("*", S.once(rule_violated=rule))
    rule = F.col("rule_violated")
    found = {
        "SIZE_CHECK": (tokens, F.lit(max_tokens)),
        "DANGEROUS_PATTERN": (F.col("_danger"),),
        "IMPORT_WHITELIST": (F.col("_outside"),),
    }
    message = F.coalesce(
        *[F.when(rule == name, _filled(name, *found.get(name, ()))) for name in vocab.GATE_MESSAGES]
    )
    return checked.withColumns(
        {
            "passed": rule.isNull(),
            "error_code": F.when(rule == "SIZE_CHECK", "E002").when(rule.isNotNull(), "E001"),
            "error_message": message,
            "sanitized_code": F.when(rule.isNull(), clean),
            "nul_stripped": clean != raw,
        }
    ).drop("_clean", "_danger", "_cheap", "_outside")


def split(gated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Admitted and quarantined rows."""
    return gated.where("passed"), gated.where("NOT passed")


def stats(gated: DataFrame) -> DataFrame:
    """Rows per rejection reason; admitted rows count under PASSED."""
    return gated.groupBy(F.coalesce("rule_violated", F.lit("PASSED")).alias("rule_violated")).agg(
        F.count(F.lit(1)).alias("n")
    )
