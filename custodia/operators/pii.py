"""Personal data in texts, column names and literals: findings, risk, reports, profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia import vocab
from custodia.functions import script as S
from custodia.functions import text as T
from custodia.sources.tables import small_table


def dictionary(spark: SparkSession, extended: bool = False) -> DataFrame:
    """Column-name dictionary as a table ``(name, score)``; pass your own to replace it."""
    names = vocab.COLUMN_NAMES_EXTENDED if extended else vocab.COLUMN_NAMES
    rows = [(n, 4 if n in vocab.STRONG_COLUMN_NAMES else 3) for n in names]
    return small_table(spark, rows, "name string, score int")


def scan_text(
    df: DataFrame, ids: Sequence[str], text: str, patterns: Sequence[vocab.Pattern] = vocab.BASE_PATTERNS
) -> DataFrame:
    """One row per subject and kind found: how often, how bad, and the start of the first match.

    Row-local: no shuffle, and the text itself leaves the plan before rows multiply.
    """
    matched = T.with_matches(df.select(*ids, text), [text], patterns).drop(text)
    found = F.array(
        *[
            F.struct(
                F.lit(p.kind).alias("type"),
                F.size(F.col(T.match_column(p.kind, text))).cast("bigint").alias("n"),
                F.lit(p.score).alias("score"),
                F.get(F.col(T.match_column(p.kind, text)), F.lit(0)).alias("first"),
            )
            for p in patterns
        ]
    )
    return (
        matched.select(*ids, S.one_row_each(found))
        .where(F.col("n") > 0)
        .select(*ids, "type", "n", "score", T.sample(F.col("first")).alias("sample"), F.lit("regex").alias("source"))
    )


def _any(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


def _max_of(flags: Sequence[tuple[Column, int]]) -> Column:
    """Highest score among the flags that hold, 0 when none does."""
    out = F.lit(0)
    for score in sorted({s for _, s in flags}):
        out = F.when(_any([f for f, s in flags if s == score]), score).otherwise(out)
    return out


def _flag(p: vocab.Pattern, text: str) -> Column:
    return F.col(T.match_column(p.kind, text))


def flagged_risk(
    text: str, patterns: Sequence[vocab.Pattern], columns: str | None = None
) -> tuple[Column, Column]:
    """Highest score and risk level from the match flags, and from found column names if given."""
    flags = [(_flag(p, text), p.score) for p in patterns]
    if columns is not None:
        strong = F.exists(columns, lambda c: T.normalise_name(c).isin(*vocab.STRONG_COLUMN_NAMES))
        flags += [(F.size(columns) > 0, 3), (strong, 4)]
    critical = _any([_flag(p, text) for p in patterns if p.critical])
    score = _max_of(flags)
    return score, T.risk_level(score, critical)


def text_risk(
    df: DataFrame,
    ids: Sequence[str],
    text: str,
    patterns: Sequence[vocab.Pattern] = vocab.BASE_PATTERNS,
) -> DataFrame:
    """Risk level of every subject; asks only whether a kind occurs, never how often."""
    flagged = T.with_match_flags(df.select(*ids, text), text, patterns)
    score, risk = flagged_risk(text, patterns)
    return flagged.select(*ids, score.alias("max_score"), risk.alias("risk_level"))


def report(
    df: DataFrame,
    ids: Sequence[str],
    text: str,
    patterns: Sequence[vocab.Pattern] = vocab.BASE_PATTERNS,
    names: Sequence[str] = vocab.COLUMN_NAMES,
) -> DataFrame:
    """One report row per subject: pattern findings plus quoted column names, and the risk of both.

    ``entities`` lists every kind and name found, with count, score, sample and source.
    """
    matched = T.with_matches(df.select(*ids, text), [text], patterns).withColumn(
        "_columns", pii_columns(F.col(text), names)
    )
    size = {p.kind: F.coalesce(F.size(_flag(p, text)), F.lit(0)) for p in patterns}
    found = matched.select(
        *ids,
        "_columns",
        *[F.when(size[p.kind] > 0, size[p.kind]).otherwise(0).cast("bigint").alias(f"_n_{p.kind}") for p in patterns],
        *[F.get(_flag(p, text), F.lit(0)).alias(f"_first_{p.kind}") for p in patterns],
    ).withColumns({T.match_column(p.kind, text): F.col(f"_n_{p.kind}") > 0 for p in patterns})

    def entity(kind: Column, n: Column, score: Column, sample: Column, source: str) -> Column:
        return F.struct(
            kind.alias("type"), n.cast("bigint").alias("n"), score.cast("int").alias("score"), sample.alias("sample"),
            F.lit(source).alias("source"),
        )

    by_pattern = F.filter(
        F.array(
            *[
                entity(F.lit(p.kind), F.col(f"_n_{p.kind}"), F.lit(p.score), T.sample(F.col(f"_first_{p.kind}")), "regex")
                for p in patterns
            ]
        ),
        lambda e: e["n"] > 0,
    )
    by_name = F.transform(
        "_columns",
        lambda c: entity(
            F.lit("COLUMN_NAME"),
            F.lit(1),
            F.when(T.normalise_name(c).isin(*vocab.STRONG_COLUMN_NAMES), 4).otherwise(3),
            c,
            "heuristic",
        ),
    )
    count = sum((_flag(p, text).cast("bigint") for p in patterns), F.size("_columns").cast("bigint"))
    _, risk = flagged_risk(text, patterns, "_columns")
    return found.select(
        *ids,
        F.concat(by_pattern, by_name).alias("entities"),
        count.alias("entity_count"),
        (count > 0).alias("has_pii"),
        risk.alias("risk_level"),
        F.concat_ws(",", *[F.when(_flag(p, text), p.kind) for p in patterns]).alias("entity_types"),
        F.col("_columns").alias("pii_column_names"),
    )


def pii_columns(code: Column, names: Sequence[str] = vocab.COLUMN_NAMES) -> Column:
    """The quoted column names of a text that the dictionary knows."""
    return F.filter(S.columns(code), lambda c: T.normalise_name(c).isin(*names))


def scan_columns(
    catalog: DataFrame, names: DataFrame, column: str = "column_name", strip_prefix: bool = False
) -> DataFrame:
    """Look every column name up in the dictionary; names it does not know stay, with a null score.

    No hint: the join broadcasts the dictionary as long as Spark finds it small enough.
    """
    key = T.normalise_name(F.col(column), strip_prefix)
    known = names.select(F.col("name").alias("normalised"), "score").distinct()
    return (
        catalog.withColumn("normalised", key)
        .join(known, "normalised", "left")
        .withColumn("is_pii", F.col("score").isNotNull())
    )


def exposure(
    df: DataFrame, table: str, columns: Sequence[str], flagged: Sequence[str]
) -> DataFrame:
    """The columns of a table with its row count, and the filled values of the flagged ones.

    One pass that reads the flagged columns and no other.
    """
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"_v_{c}") for c in flagged]
    )
    unknown = F.lit(None).cast("bigint")
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                (F.col(f"_v_{c}") if c in flagged else unknown).alias("n_values"),
            )
            for c in columns
        ]
    )
    return counts.select(F.lit(table).alias("table_name"), F.col("_n").alias("n_rows"), S.one_row_each(rows))


def profile(
    df: DataFrame,
    table: str,
    columns: Sequence[str],
    patterns: Sequence[vocab.Pattern] = vocab.PATTERNS,
) -> DataFrame:
    """Matches and rows hit for every string column and pattern.

    One scan for any number of columns: a row becomes one (column, value) pair per column, every
    pattern is counted once in the plan, and sums combine before the shuffle.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("_value")) for c in columns])
    counted = T.with_match_counts(df.select(S.one_row_each(pairs)), ["_value"], patterns)
    cells = [(p, T.match_column(p.kind, "_value")) for p in patterns]
    totals = counted.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.sum(m).alias(f"{m}_sum") for _, m in cells],
        *[F.count_if(F.col(m) > 0).alias(f"{m}_hit") for _, m in cells],
    )
    # an empty table has columns all the same
    named = F.explode(F.array(*[F.lit(c) for c in columns])).alias("column_name")
    every = df.sparkSession.range(1).select(named).join(totals, "column_name", "left")
    rows = F.array(
        *[
            F.struct(
                F.lit(p.kind).alias("type"),
                F.lit(p.score).alias("score"),
                F.lit(p.critical).alias("critical"),
                F.coalesce(F.col(f"{m}_sum"), F.lit(0)).cast("bigint").alias("n_matches"),
                F.coalesce(F.col(f"{m}_hit"), F.lit(0)).cast("bigint").alias("rows_hit"),
            )
            for p, m in cells
        ]
    )
    n_rows = F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows")
    long = every.select(F.lit(table).alias("table_name"), "column_name", n_rows, S.one_row_each(rows))
    hit = F.col("rows_hit") > 0
    return long.select(
        "table_name",
        "column_name",
        "type",
        "n_rows",
        "rows_hit",
        "n_matches",
        F.when(F.col("n_rows") > 0, F.col("rows_hit") / F.col("n_rows")).alias("share"),
        T.risk_level(F.when(hit, F.col("score")).otherwise(0), hit & F.col("critical")).alias("risk_level"),
    )


def summary(
    df: DataFrame, group: str, text: str, patterns: Sequence[vocab.Pattern] = vocab.PATTERNS
) -> DataFrame:
    """Per group and kind: subjects hit, matches, distinct values.

    Spark first counts on (group, kind, value), before and after the shuffle, so a
    group that holds most rows spreads over its values.
    """
    matched = T.with_matches(df.select(group, text), [text], patterns).drop(text)
    lists = F.array(
        *[
            F.struct(F.lit(p.kind).alias("type"), _flag(p, text).alias("values"))
            for p in patterns
        ]
    )
    values = (
        matched.select(group, S.one_row_each(lists))
        .where(F.size("values") > 0)
        .select(group, "type", F.posexplode_outer("values").alias("_pos", "_value"))
    )
    return values.groupBy(group, "type").agg(
        F.count_if(F.col("_pos") == 0).alias("subjects_hit"),
        F.count(F.lit(1)).alias("matches"),
        F.countDistinct("_value").alias("distinct_values"),
    )


def scan_terms(
    df: DataFrame, ids: Sequence[str], text: str, terms: DataFrame, max_literals: int | None = None
) -> DataFrame:
    """Named terms inside quoted literals of ten or more characters, each place once per term.

    ``terms`` is ``(term, label)``; a term may have several words and is found by its first one,
    then compared as a whole. Terms inside longer terms are found too. ``max_literals`` takes
    only the first so many literals of a text.
    """
    literals = T.regex_extract_all(F.col(text), r"""["']([^"']{10,})["']""", 1)
    if max_literals is not None:
        literals = F.slice(literals, 1, max_literals)
    split = (
        df.select(*ids, F.posexplode_outer(literals).alias("literal_no", "_literal"))
        .where(F.col("_literal").isNotNull())
        .select(*ids, "literal_no", F.split("_literal", r"\W+").alias("_words"))
    )
    words = split.select(*ids, "literal_no", "_words", F.posexplode_outer("_words").alias("word_no", "_first")).where(
        F.col("_first") != ""
    )
    wanted = terms.select(
        "term", "label", F.filter(F.split("term", r"\W+"), lambda w: w != "").alias("_term")
    ).distinct().withColumn("_first", F.get("_term", F.lit(0)))
    whole = F.slice("_words", F.col("word_no") + 1, F.size("_term")) == F.col("_term")
    return words.join(wanted, "_first").where(whole).select(
        *ids,
        "literal_no",
        "word_no",
        F.concat(F.lit("NER_"), F.col("label")).alias("type"),
        F.col("term").alias("text"),
        F.lit(2).alias("score"),
        F.lit("terms").alias("source"),
    )


PREFIX_BITS = 20  # 131 kB, whatever the number of terms


def _phrases(terms: DataFrame) -> DataFrame:
    """Distinct terms with their words, at least one."""
    split = terms.select("term", "label", F.filter(F.split("term", r"\W+"), lambda w: w != "").alias("_term")).distinct()
    return split.where(F.size("_term") > 0)


def _place_of(phrase: Column) -> Column:
    return F.pmod(F.xxhash64(phrase), F.lit(1 << PREFIX_BITS)).cast("int")


def _held(bits: bytes, phrase: Column) -> Column:
    """Whether the field has the phrase's bit."""
    place = _place_of(phrase)
    byte = F.conv(F.hex(F.substring(F.lit(bits), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, place.bitwiseAND(7)) == 1


def prefix_table(terms: DataFrame) -> tuple[bytes, bytes, int]:
    """Of the terms' words: a bit field of all their prefixes, one of the whole terms, and the most words of a term."""
    words = _phrases(terms)
    longest = words.agg(F.max(F.size("_term"))).first()[0] or 0

    def field(phrases: Column) -> bytes:
        place = _place_of(F.col("p"))
        rows = words.select(F.explode(phrases).alias("p")).select(F.shiftright(place, 3).alias("at"), place.bitwiseAND(7).alias("bit"))
        bits = bytearray(1 << (PREFIX_BITS - 3))
        for r in rows.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1, bit)")).alias("byte")).collect():  # as many as the field has bytes
            bits[r["at"]] = r["byte"]
        return bytes(bits)

    prefixes = F.transform(F.sequence(F.lit(1), F.size("_term")), lambda k: F.array_join(F.slice("_term", 1, k), " "))
    return field(prefixes), field(F.array(F.array_join("_term", " "))), longest


def scan_phrases(df: DataFrame, ids: Sequence[str], text: str, terms: DataFrame) -> DataFrame:
    """As ``scan_terms`` with its results, for many terms: a prefix table decides before words become rows.

    Along a literal's words a phrase grows while the field of prefixes has it, and is a candidate where the field of whole
    terms has it too. Fields may have bits of other phrases, so candidates meet the terms in a join, by the whole phrase.
    """
    prefixes, wholes, longest = prefix_table(terms)
    literals = T.regex_extract_all(F.col(text), r"""["']([^"']{10,})["']""", 1)
    split = (
        df.select(*ids, F.posexplode_outer(literals).alias("literal_no", "_literal"))
        .where(F.col("_literal").isNotNull())
        .select(*ids, "literal_no", S.once(_words=F.split("_literal", r"\W+")))
    )
    size = F.size("_words")

    def phrase(at: Column, n: Column) -> Column:
        return F.array_join(F.slice("_words", at + 1, n), " ")

    starts = F.filter(F.sequence(F.lit(0), size - 1), lambda at: _held(prefixes, F.get("_words", at)))
    begun = split.select(*ids, "literal_no", "_words", S.once(_starts=starts)).where(F.size("_starts") > 0)

    def ends(at: Column) -> Column:
        """Numbers of words after which a term may end."""
        lengths = F.sequence(F.lit(1), F.least(F.lit(max(longest, 1)), size - at))
        start = F.struct(F.lit(True).alias("on"), F.array().cast("array<int>").alias("ends"))

        def step(state: Column, n: Column) -> Column:
            on = state["on"] & _held(prefixes, phrase(at, n))
            ended = F.when(on & _held(wholes, phrase(at, n)), F.concat(state["ends"], F.array(n))).otherwise(state["ends"])
            return F.struct(on.alias("on"), ended.alias("ends"))

        found = F.aggregate(lengths, start, step, lambda state: state["ends"])
        return F.transform(found, lambda n: F.struct(at.alias("word_no"), phrase(at, n).alias("_phrase")))

    candidates = begun.select(*ids, "literal_no", F.explode_outer(F.flatten(F.transform("_starts", ends))).alias("_x")).where(
        F.col("_x").isNotNull()
    )
    wanted = _phrases(terms).select("term", "label", F.array_join("_term", " ").alias("_phrase"))
    return candidates.select(*ids, "literal_no", "_x.word_no", "_x._phrase").join(wanted, "_phrase").select(
        *ids,
        "literal_no",
        "word_no",
        F.concat(F.lit("NER_"), F.col("label")).alias("type"),
        F.col("term").alias("text"),
        F.lit(2).alias("score"),
        F.lit("terms").alias("source"),
    )


def all_findings(text: DataFrame, columns: DataFrame, terms: DataFrame) -> DataFrame:
    """Put the three detectors' findings into one table; what a detector lacks is null."""
    parts = [
        text.select("subject", "type", F.col("sample").alias("match_sample"), "n", "score", "source"),
        columns.select(
            "subject", F.lit("COLUMN_NAME").alias("type"), F.col("column_name").alias("column"),
            "score", F.lit("heuristic").alias("source"),
        ),
        terms.select("subject", "type", F.col("text").alias("match_sample"), "score", "source"),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
