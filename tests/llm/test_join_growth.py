"""What grows with the input alone: chance candidates of the n-gram join, rows of the component rounds."""

from __future__ import annotations

import numpy as np
import pytest

from custodia.llm import common, ngram_join


def drawn(rng, n):
    return rng.integers(0, 2**63, n).astype(np.uint64)


def shared(a, b, numerator, denominator):
    x, y = (set(np.concatenate(ngram_join.signatures(np.unique(s), numerator, denominator)).tolist()) for s in (a, b))
    return len(x & y)


def test_sets_with_a_few_common_elements_are_no_candidates():
    """What has the fewest elements is left out first, so that an eighth in common makes few pairs candidates."""
    rng = np.random.default_rng(2)
    met = 0
    for n in range(300):
        common_ones = drawn(rng, 40)
        a, b = (np.concatenate([common_ones, drawn(rng, 300 + n % 40)]) for _ in range(2))
        met += shared(a, b, 4, 5) > 0
    assert met <= 30  # 117 when every choice with an element was signed


@pytest.mark.parametrize(("numerator", "denominator"), [(4, 5), (9, 10), (1, 2)])
def test_sets_at_the_threshold_share_a_signature(numerator, denominator):
    """As different as the threshold allows, in each way of dealing the difference to the two sets."""
    rng = np.random.default_rng(3)
    for size in [*range(1, 40), 90, 150, 283, 566, 1062]:
        a = np.unique(drawn(rng, size))
        for share in (0, 0.5, 1):
            gone = 0
            while True:
                less = gone + 1
                removed, added = round(less * share), less - round(less * share)
                if (len(a) - removed) * denominator < numerator * (len(a) + added):
                    break
                gone = less
            removed = round(gone * share)
            kept = rng.permutation(a)[: len(a) - removed]
            b = np.concatenate([kept, drawn(rng, gone - removed)])
            assert shared(a, b, numerator, denominator)


def test_component_rounds_carry_what_is_left(spark, monkeypatch):
    """Labels aren't written for all vertices in every round."""
    written = {}
    stage = common.staged

    def counted(df, label):
        out = stage(df, label)
        written[label] = written.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(common, "staged", counted)
    edges = spark.range(1500).selectExpr("id AS a", "id + 1 AS b")
    found = common.components(edges)
    assert found.where("component = 0").count() == found.count() == 1501
    assert written["labels"] <= 3 * 1501 and written["hooks"] <= 3 * 1501  # 16511 labels when every round had them all
    assert common.components(edges.limit(0)).collect() == []
