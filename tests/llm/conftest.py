from __future__ import annotations

import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Names that the operators use inside, as extra columns of the input.
CLASHING = ["text_hash", "words", "block", "vertex", "key", "_verdict", "_gone", "_copies", "n", "start", "lang"]
SCHEMA = StructType(
    [StructField("doc_id", LongType()), StructField("text", StringType()), StructField("n_chars", LongType())]
    + [StructField(c, StringType()) for c in CLASHING]
)


def frame(spark, rows):
    """Documents from (doc_id, text), with the extra columns."""
    extra = [None if i % 2 else "x" for i in range(len(CLASHING))]
    return spark.createDataFrame([(i, t, len(t) if t is not None else None, *extra) for i, t in rows], SCHEMA)


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    out, line = [], []
    for _ in range(words):
        n = rng.randrange(vocabulary)
        line.append("".join("abcdefghijklmnoprstuvé"[(n * k + k) % 22] for k in range(1, 3 + n % 7)))
        if rng.random() < 0.08:
            out.append(" ".join(line).capitalize() + ".")
            line = []
    return "\n".join([*out, " ".join(line)])


def edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join("zz" + w if rng.random() < share else w for w in text.split(" "))


def odd_rows() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and very long texts, ties, repeated rows, copies, near copies, odd white space."""
    rng = random.Random(4)
    base = [prose(rng, rng.choice([3, 20, 60, 150, 400])) for _ in range(25)]
    rows: list[tuple[int | None, str | None]] = [(10 * i, t) for i, t in enumerate(base)]
    rows += [(1, None), (2, ""), (None, base[3]), (None, None), (3, " \n\t "), (4, "one"), (5, "two words"), (6, "One")]
    rows += [(10, base[1]), (10, base[1]), (301, base[1]), (302, base[1]), (303, "a" * 5000), (304, "é" * 3000)]
    rows += [(400 + i, edited(rng, base[i % 5], 0.01 * (1 + i % 6))) for i in range(30)]
    rows += [(500, "the " * 300), (501, "x y z \x1c w\x85v"), (502, "tab\tnew\x0bline\r\nend  double"), (503, prose(rng, 9000))]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, odd_rows()).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)
