"""Segmentation of units without an edge, as long as a text."""

from __future__ import annotations

import random
import time

import public_tokenizers
import pytest

from custodia.llm import piece_nbest

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "日本語中文字大小上下", "ab"])
def test_long_units_take_time_in_proportion(alphabet):
    rng = random.Random(1)
    table = piece_nbest.pieces_of(MODEL, 4)
    text = "".join(rng.choice(alphabet) for _ in range(200_000))
    start = time.process_time()
    best = table.best_of(text)
    assert time.process_time() - start < 20
    assert table.decode(best[0][2]) == text
    scores = [score for score, _, _ in best]
    assert scores == sorted(scores, reverse=True)


def test_search_gives_the_n_best_where_all_are_equal():
    table = piece_nbest.pieces_of(MODEL, 4)
    unit = "▁" + "abcdefgh" * 6
    found = table.search(unit, 50)
    assert len({ids for _, ids in found}) == 50
    scores = [score for score, _ in found]
    assert scores == sorted(scores, reverse=True) and scores[0] == table.best_and_gap(unit)[0]
    assert scores[0] - scores[1] == table.best_and_gap(unit)[2]
