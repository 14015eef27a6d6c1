"""Notices are found however often the table's own paragraphs carry them."""

from __future__ import annotations

import random

import pytest

from custodia.llm import license_scan
from tests.llm.conftest import frame

MIT = "Released under the MIT License."
GRANT = license_scan.TEMPLATES["MIT"][3]
APACHE = license_scan.TEMPLATES["Apache"][1]


def plain(rng):
    return "\n".join(" ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(12)) for _ in range(6))


def notice_rows(kind):
    rng = random.Random(31)
    if kind == "small":
        return {0: MIT, 5: APACHE, 9: GRANT}, [(i, plain(rng)) for i in range(12)]
    often = MIT if kind == "often" else GRANT
    return {i: often for i in range(0, 300, 3)} | {100: APACHE}, [(i, plain(rng)) for i in range(300)]


@pytest.mark.parametrize("kind", ["small", "often", "often without the word"])
def test_train_keeps_frequent_notices(spark, kind):
    notices, rows = notice_rows(kind)
    docs = frame(spark, [(i, f"{t}\n{notices[i]}" if i in notices else t) for i, t in rows])
    found = {(r["doc_id"], r["family"]) for r in license_scan.notices(docs, license_scan.train(docs)).collect() if r["confirmed"]}
    assert found == {(i, "Apache" if t == APACHE else "MIT") for i, t in notices.items()}


def test_usual_words_of_ordinary_text_are_no_anchors():
    rng = random.Random(32)
    ordinary = [f"{plain(rng)} under the software" for _ in range(400)]
    model = license_scan.fit(ordinary + [MIT] * 200)
    assert not {"under", "software"} & set(model.anchors) and {"license", "mit", "released", "copyright"} <= set(model.anchors)
