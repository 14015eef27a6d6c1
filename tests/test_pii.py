from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from custodia import vocab
from custodia.functions import masking
from custodia.functions import text as T
from custodia.operators import pii
from tests.conftest import rows, scripts


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string")


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("ssn = '123-45-6789'", "SSN"),
        ("mail test@example.com now", "EMAIL"),
        ("call 555-123-4567", "PHONE"),
        ("card 4111111111111111", "CREDIT_CARD"),
        ("host 192.168.1.100", "IP_ADDRESS"),
        ("doc AB1234567", "PASSPORT"),
        ("GB82WEST12345698765432", "IBAN"),
        ("NPI 1234567890", "NPI"),
    ],
)
def test_kinds(spark, text, kind):
    found = {r["type"] for r in pii.scan_text(texts(spark, text), ["id"], "text", vocab.PATTERNS).collect()}
    assert kind in found


def test_clean_text_has_no_findings(spark):
    clean = texts(spark, "df = df.groupBy('region').agg(F.sum('revenue'))", "", None)
    assert pii.scan_text(clean, ["id"], "text").count() == 0


def test_count_and_sample(spark):
    found = pii.scan_text(texts(spark, "a@b.co, c@d.org and longname@example.com"), ["id"], "text")
    row = found.where("type = 'EMAIL'").first()
    assert (row["n"], row["score"], row["sample"]) == (3, 3, "a@b.co…")


def test_accented_neighbour_is_no_boundary(spark):
    assert pii.scan_text(texts(spark, "é123-45-6789"), ["id"], "text").where("type = 'SSN'").count() == 0


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.text(alphabet="aZ019 -.@+()\nNPISGB", max_size=40).map(
            lambda s: s + " 123-45-6789 x@y.io 4111111111111111"[: len(s)]
        ),
        min_size=1,
        max_size=8,
    )
)
def test_hints_lose_nothing(spark, values):
    """The guarded scan finds what a plain search over the same text finds."""
    got = {
        (r["id"], r["type"]): r["n"]
        for r in pii.scan_text(texts(spark, *values), ["id"], "text", vocab.PATTERNS).collect()
    }
    expected = {
        (i, p.kind): len(re.findall(p.regex, v, re.ASCII))
        for i, v in enumerate(values)
        for p in vocab.PATTERNS
        if re.search(p.regex, v, re.ASCII)
    }
    assert got == expected


def test_risk(spark):
    df = texts(spark, "nothing", "10.0.0.1", "a@b.co", "123-45-6789", "4111111111111111", "AB123456")
    got = [r["risk_level"] for r in pii.text_risk(df, ["id"], "text").orderBy("id").collect()]
    assert got == ["low", "medium", "high", "critical", "critical", "critical"]


def test_report_counts_columns_and_kinds(spark):
    df = scripts(spark, "df.select('email', 'SSN', 'region') # 10.0.0.1", "df.select('region')")
    a, b = pii.report(df, ["script_id"], "code").orderBy("script_id").collect()
    assert (a["entity_count"], a["has_pii"], a["risk_level"]) == (3, True, "critical")
    assert a["pii_column_names"] == ["SSN", "email"] and a["entity_types"] == "IP_ADDRESS"
    assert (b["entity_count"], b["has_pii"], b["risk_level"]) == (0, False, "low")


def test_column_names(spark):
    names = spark.createDataFrame(
        [(n,) for n in ("email", "ssn", "dob", " MRN ", "product_id", "quantity", "revenue", "region")],
        "column_name string",
    )
    got = {r["column_name"]: r["score"] for r in pii.scan_columns(names, pii.dictionary(spark)).collect()}
    assert got == {
        "email": 3, "ssn": 4, "dob": 3, " MRN ": 4,
        "product_id": None, "quantity": None, "revenue": None, "region": None,
    }
    assert len(vocab.COLUMN_NAMES) == 52 and len(vocab.COLUMN_NAMES_EXTENDED) == 77


def test_own_dictionary_and_prefix(spark):
    own = spark.createDataFrame([("badge", 4)], "name string, score int")
    names = spark.createDataFrame([("c_badge",), ("badge",)], "column_name string")
    got = {r["column_name"]: r["is_pii"] for r in pii.scan_columns(names, own, strip_prefix=True).collect()}
    assert got == {"c_badge": True, "badge": True}
    assert pii.scan_columns(names, own).where("is_pii").count() == 1


def test_own_pattern(spark):
    badge = vocab.Pattern("BADGE", 4, r"\bB-\d{3}\b", critical=True)
    df = texts(spark, "B-123 and B-456")
    assert rows(pii.scan_text(df, ["id"], "text", [badge]))[0][1:4] == ("BADGE", 2, 4)
    assert pii.text_risk(df, ["id"], "text", [badge]).first()["risk_level"] == "critical"
    assert masking.redact_text(df, "text", patterns=[badge]).first()["text"] == "[BADGE] and [BADGE]"


def test_redaction_order(spark):
    df = texts(spark, "NPI 1234567890, call 555-123-4567, mail a@b.co", "plain", None)
    got = [r["text"] for r in masking.redact_text(df, "text").orderBy("id").collect()]
    assert got == ["[NPI], call [PHONE], mail [EMAIL]", "plain", None]
    assert pii.scan_text(masking.redact_text(df, "text"), ["id"], "text", vocab.PATTERNS).count() == 0


def test_literals_limit(spark):
    quoted = " ".join(f'"somewhere in Paris {i}"' for i in range(60))
    terms = spark.createDataFrame([("Paris", "GPE")], "term string, label string")
    df = texts(spark, quoted)
    assert pii.scan_terms(df, ["id"], "text", terms, max_literals=50).count() == 50
    assert pii.scan_terms(df, ["id"], "text", terms).count() == 60
    short = texts(spark, '"Paris"')
    assert pii.scan_terms(short, ["id"], "text", terms).count() == 0


def test_terms_of_several_words(spark):
    terms = spark.createDataFrame([("New York", "GPE"), ("York", "GPE"), ("New York City Hall Annex", "FAC")], "term string, label string")
    df = texts(spark, '"he left New York, for York" and "New Yorkers"', '"the New York City Hall Annex"')
    got = [tuple(r) for r in pii.scan_terms(df, ["id"], "text", terms).select("id", "word_no", "text").orderBy("id", "word_no", "text").collect()]
    assert got == [(0, 2, "New York"), (0, 3, "York"), (0, 5, "York"), (1, 1, "New York"), (1, 1, "New York City Hall Annex"), (1, 2, "York")]


def test_profile_of_wide_and_empty_tables(spark):
    wide = spark.createDataFrame([tuple("a@b.co" if i == 7 else "x" for i in range(40))], ", ".join(f"c{i} string" for i in range(40)))
    found = pii.profile(wide, "wide", wide.columns)
    assert found.count() == 40 * len(vocab.PATTERNS)
    assert [r["column_name"] for r in found.where("n_matches > 0").collect()] == ["c7"]
    assert pii.profile(wide.limit(0), "none", ["c1"]).where("n_rows = 0").count() == len(vocab.PATTERNS)


def test_masks(spark):
    df = spark.createDataFrame([("Ann", "12345678", "abc", "Ab1", None)], "a string, b string, c string, d string, e string")
    got = masking.mask_columns(df, {"a": "redact", "b": "partial", "c": "null", "d": "shape", "e": "token"}).first()
    assert tuple(got) == ("***", "****5678", None, "Xxn", None)
    own = masking.mask_columns(df, {"a": lambda c: F.upper(c)}).first()
    assert own["a"] == "ANN"
    with pytest.raises(ValueError, match="missing"):
        masking.mask_columns(df, {"zz": "redact"})
    tokens = masking.mask_columns(df, {"a": "token"}).where(masking.looks_masked(F.col("a")))
    assert tokens.count() == 1


def test_every_strategy_is_recognised_and_near_misses_are_not(spark):
    masking.register_mask_pii(spark)
    df = spark.createDataFrame([("Joe Smith", "joe@y.com", "555-123-4567", "123-45-6789")], "n string, e string, p string, s string")
    made = [masking.STRATEGIES[k](F.col("n")).alias(k) for k in masking.STRATEGIES]
    made += [F.expr(f"mask_pii({c}, '{k}')").alias(k) for c, k in (("n", "name"), ("e", "email"), ("p", "phone"), ("s", "ssn"))]
    forms = df.select(*made)
    for column in forms.columns:
        strategy = column if column in masking.MASKED_FORMS else None
        assert forms.where(masking.looks_masked(F.col(column), strategy)).count() == 1, column
    plain = spark.createDataFrame([("*Bob",), ("Joe",), ("a@b.c",), ("X1",), ("abc***d",)], "v string")
    assert plain.where(masking.looks_masked(F.col("v"), "partial")).count() == 0
    assert [r["v"] for r in plain.where(masking.looks_masked(F.col("v"))).collect()] == []
    assert spark.sql("SELECT mask_pii(CAST(NULL AS STRING), 'other')").first()[0] is None


def test_redaction_leaves_no_half_address(spark):
    df = texts(spark, "john.smith-123-45-6789@corp.com")
    assert masking.redact_text(df, "text").first()["text"] == "[EMAIL]"


def test_mask_function_is_replaceable(spark):
    masking.register_mask_pii(spark)
    assert spark.sql("SELECT mask_pii('x@y.io', 'email')").first()[0] == "***@y.io"
    masking.register_mask_pii(
        spark,
        "CREATE OR REPLACE TEMPORARY FUNCTION mask_pii(value STRING, field_type STRING) RETURNS STRING RETURN field_type",
    )
    assert spark.sql("SELECT mask_pii('x', 'email')").first()[0] == "email"
    masking.register_mask_pii(spark)


@pytest.mark.parametrize(
    ("answer", "code"),
    [
        ("text\n```python\nx = 1\n```\nmore", "x = 1"),
        ("```\n y\n```", "y"),
        ("  no fence \n", "no fence"),
        ("```python\n\n```", ""),
        ("```python\na\n```\n```python\nb\n```", "a"),
    ],
)
def test_fenced_code(spark, answer, code):
    assert texts(spark, answer).select(T.fenced_code(F.col("text"))).first()[0] == code


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\nb", "a\r\nb\r\n", "a\rb", "a\x0bb\x0c", "\n\n", "a b"])
def test_line_count(spark, text):
    assert texts(spark, text).select(T.line_count(F.col("text"))).first()[0] == len(text.splitlines())


def test_profile_of_empty_table(spark):
    got = pii.profile(texts(spark).where("id < 0"), "t", ["text"]).collect()
    assert len(got) == 8 and all(r["n_rows"] == 0 and r["n_matches"] == 0 and r["share"] is None for r in got)
