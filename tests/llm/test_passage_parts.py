"""Runs that join chunks first seen elsewhere with chunks first seen here."""

from __future__ import annotations

import random

from custodia.llm import chunk_dedup
from tests.llm.conftest import frame, prose
from tests.llm.test_pair_operators import chunks_of


def test_every_chunk_survives_in_its_first_document(spark):
    rng = random.Random(21)
    a, b, c = (prose(rng, 150) for _ in range(3))
    rows = [(3, a), (5, a + b), (9, a + b), (12, c + b), (15, b + c), (20, prose(rng, 80))]
    docs = frame(spark, rows)
    left = {r["doc_id"]: r["text"] for r in chunk_dedup.without_passages(docs).collect()}
    first = {}
    for i, t in rows:
        for _, _, chunk in chunks_of(t):
            first.setdefault(chunk, i)
    lost = [(i, chunk) for chunk, i in first.items() if chunk.decode() not in left[i]]
    assert lost == []
    assert len(left[5]) < len(rows[1][1]) - len(a) + 100 and len(left[9]) < 100
    (run,) = [r for r in chunk_dedup.repeated_passages(docs).collect() if r["doc_id"] == 5]
    assert run["first_doc_id"] == 3 and len(run["copied"]) == 1 and run["end"] - run["copied"][0]["end"] > len(b) - 200
