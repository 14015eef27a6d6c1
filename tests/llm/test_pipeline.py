"""The pipeline against the same steps in plain Python, and its stages' contract."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from custodia.llm import ngram_join, quality_rules, secret_scan
from tests.llm.conftest import frame, odd_rows, prose
from tests.llm.test_pair_operators import WORDS, plain_removed


def documents():
    rng = random.Random(12)
    rows = odd_rows()
    shared = prose(rng, 30).replace("\n", " ")
    rows += [(600 + i, prose(rng, 60) + "\n" + shared + ("x" if i % 2 else "") + "\n" + f"password=abc{i}def9 " + prose(rng, 30)) for i in range(8)]
    rows += [(700 + i, " | ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(80))) for i in range(12)]
    return rows


def written(spark, folder, rows):
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0 if 700 <= i < 720 else 1, 0) for i, _ in rows if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def expected(spark, folder, docs, rows):
    forest = quality_rules.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = []
    for i, t in rows:
        base, features = quality_rules.statistics(t)
        if base[0] >= 20 and 100 * base[4] <= 30 * base[0] and forest.score(np.array([features]))[0] >= forest.threshold:
            kept.append((i, t))
    assert not any(i is not None and 700 <= i < 720 for i, _ in kept)
    removed = plain_removed(kept, 2, 24)
    lined = []
    for i, t in kept:
        gone = set(removed[i, t])
        rest = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)
        if not gone or WORDS.search(rest):
            lined.append((i, rest if gone else t))
    chosen = [*one_of_each(lined), *[(i, t) for i, t in lined if i is None]]
    return [(i, secret_scan.mask(t, secret_scan.find_spans(t))) for i, t in chosen]


def one_of_each(rows):
    """Of every class of linked rows the one with the least id, then set, then text."""
    named = [(i, t, ngram_join.shingles(t, 5)) for i, t in rows if i is not None]
    label = list(range(len(named)))
    for x, (_, _, a) in enumerate(named):
        for y, (_, _, b) in enumerate(named[:x]):
            common = len(np.intersect1d(a, b))
            if label[x] != label[y] and 100 * common >= 80 * (len(a) + len(b) - common):
                label = [label[x] if k == label[y] else k for k in label]
    best = {}
    for k, (i, t, s) in zip(label, named, strict=True):
        best[k] = min(best.get(k, (float("inf"),)), (i, ngram_join.vertex_of(s), t))
    return [(i, t) for i, _, t in best.values()]


def test_rows_that_share_an_id_are_decided_each_for_itself(spark):
    rng = random.Random(7)
    a, b, c = (prose(rng, 80) for _ in range(3))
    rows = [(5, a), (5, b), (5, b), (3, b + " end"), (9, a + " end"), (4, c), (4, None), (4, ""), (None, a)]
    for order in (rows, rows[::-1]):
        kept = sorted(((r["doc_id"], r["text"]) for r in ngram_join.one_of_each_class(frame(spark, order), 5, 80).collect()), key=str)
        assert kept == sorted([(5, a), (3, b + " end"), (4, c), (4, None), (4, ""), (None, a)], key=str)


def test_extra_columns_of_any_type_stay(spark):
    df = spark.createDataFrame([(1, "a b c d e f", {"k": 1}), (1, "a b c d e f", {"j": 2}), (2, "x y z u v w", None)], "doc_id long, text string, m map<string,int>")
    kept = ngram_join.one_of_each_class(df).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2]


def test_pipeline_against_plain_steps(spark, tmp_path):
    rows = documents()
    docs = written(spark, str(tmp_path), rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in expected(spark, str(tmp_path), docs, rows):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        for start in range(0, len(ids), 1024):
            part = ids[start : start + 1024]
            want[(i, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids))] += 1
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == want
    assert "password" not in str(want)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    docs = written(spark, str(tmp_path), [(1, None)])
    for nth, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs.limit(0), str(tmp_path))
        assert out.collect() == []
        if nth < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
