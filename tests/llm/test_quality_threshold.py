"""The trees' threshold with a few wrong labels."""

from __future__ import annotations

import random

import numpy as np
import pytest

from custodia.llm import quality_rules
from tests.llm.conftest import frame
from tests.llm.test_text_operators import junk


def labelled(flipped):
    rng = random.Random(41)
    rows, labels = [], []
    for i in range(1200):
        bad = i % 4 == 0
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(60)]
        rows.append((i, junk(rng) if bad else " ".join(words) + "."))
        labels.append((i, int(bad == (rng.random() < flipped))))
    return rows, labels


@pytest.mark.parametrize("flipped", [0.0, 0.01, 0.03])
def test_wrong_labels_do_not_open_the_filter(spark, flipped):
    rows, labels = labelled(flipped)
    docs = frame(spark, rows)
    forest = quality_rules.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    rng = random.Random(42)
    unseen = [quality_rules.statistics(junk(rng))[1] for _ in range(200)]
    assert (forest.score(np.array(unseen)) >= forest.threshold).sum() <= 2
    good = [quality_rules.statistics(t)[1] for i, t in rows if i % 4]
    assert (forest.score(np.array(good)) >= forest.threshold).mean() > 0.99
    assert quality_rules.LEAST_ODDS <= forest.threshold <= 0


def test_threshold_is_a_quantile_of_good_rows_that_pass_the_base_rules(monkeypatch):
    class FirstFeature:
        score = staticmethod(lambda x: x[:, 0])

    monkeypatch.setattr(quality_rules, "grow", lambda x, y: FirstFeature)
    x, y = -np.arange(1.0, 21.0)[:, None] / 100, np.ones(20)
    passed = np.arange(20) < 18
    y[17] = 0
    assert quality_rules.threshold(x, y, passed, 0.999) == -0.17
    assert quality_rules.threshold(x, y, passed, 0.8) == -0.14
    assert quality_rules.threshold(10 * x, y, passed, 0.999) == quality_rules.LEAST_ODDS
    assert quality_rules.threshold(x + 1, y, passed, 0.999) == 0
    assert quality_rules.threshold(x, y, passed & (y == 0), 0.999) == 0
