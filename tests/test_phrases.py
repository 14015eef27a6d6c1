from __future__ import annotations

import random

from custodia.operators import pii
from tests.conftest import rows


def made(spark, seed=3, n_terms=10_000):
    rng = random.Random(seed)

    def word():
        return "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 6)))

    terms = [(" ".join(word() for _ in range(rng.choice([1, 1, 2, 3, 5]))), rng.choice(["ORG", "GPE"])) for _ in range(n_terms)]
    terms += [("New  York, City", "GPE"), ("New York", "GPE"), ("York", "GPE"), ("", "ORG"), (" - ", "ORG"), ("New York", "ORG"), ("New York", "GPE")]
    texts = []
    for i in range(60):
        parts = [rng.choice(terms)[0] if rng.random() < 0.3 else word() for _ in range(rng.randrange(0, 40))]
        texts.append((i, f'a "{" ".join(parts)}" b \'{", ".join(parts[::-1])}\' "short"'))
    texts += [(100, '"to New York City, York" "(New York.)" \'New York City \''), (101, None), (102, ""), (103, '"          "')]
    return spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(terms, "term string, label string")


def test_phrases_as_terms(spark):
    df, terms = made(spark)
    order = ("id", "literal_no", "word_no", "text", "type")
    want = rows(pii.scan_terms(df, ["id"], "text", terms), *order)
    got = pii.scan_phrases(df.repartition(4), ["id"], "text", terms)
    assert got.columns == pii.scan_terms(df, ["id"], "text", terms).columns
    assert rows(got, *order) == want and len(want) > 300
    assert {r[4] for r in want if r[0] == 100} >= {"New  York, City", "New York", "York"}


def test_words_without_a_term_become_no_rows(spark):
    df, terms = made(spark)
    found = pii.scan_phrases(df.where("id < 100"), ["id"], "text", terms.where("term like '%é%é%é%'"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1  # literals only; words never are rows
    prefixes, wholes, longest = pii.prefix_table(terms)
    assert longest >= 5 and sum(b.bit_count() for b in wholes) <= terms.count()


def test_no_terms_and_no_texts(spark):
    df, terms = made(spark, n_terms=10)
    assert pii.scan_phrases(df, ["id"], "text", terms.limit(0)).collect() == []
    assert pii.scan_phrases(df.limit(0), ["id"], "text", terms).collect() == []
