"""Licence notices: an n-gram classifier of paragraphs, confirmed by comparison with templates.

The classifier is a multinomial logistic regression over word 1- and 2-grams with an anchor word, that is a word of the
templates which ordinary paragraphs (those that don't read like a notice) seldom use. A paragraph without an anchor has no feature and is
unknown, so it is never expanded. It is fitted on the driver, from the templates below, pieces of them, and a bounded sample of the
table's own paragraphs as the unknown class; proximal steps keep the weights sparse, and a temperature found on
held-out paragraphs calibrates the probabilities. The scan itself is DataFrame operations only.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Families and notices that are usual for them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file for details.",
        "This project is licensed under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Released under the Apache 2.0 license.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Distributed under the GNU GPL version 2 or later.",
        "Released under the GPLv3 license.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the LGPL, the GNU Lesser General Public License.",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL, the GNU Affero General Public License.",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the 2-clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Published under the CC BY-SA 4.0 licence, Creative Commons Attribution-ShareAlike.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Published under the CC BY-NC-SA 4.0 licence, Creative Commons Attribution-NonCommercial-ShareAlike.",
    ),
    "CC0": (
        "Released under CC0 1.0 Universal, the Creative Commons public domain dedication.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "proprietary": (
        "Copyright. All rights reserved.",
        "All rights reserved. No part of this work may be reproduced without written permission of the copyright owner.",
        "This software is confidential and proprietary and may not be distributed.",
    ),
}
# Paragraphs that speak of the same words without being notices.
OTHER = (
    "His driver's license was renewed in May.",
    "The licence fee pays for the broadcaster.",
    "The police noted the license plate of the car.",
    "An Apache helicopter landed near the public road.",
    "She gave permission to leave and granted him a copy of the key, free of charge.",
    "The general public may use the source of the river.",
    "Students at MIT released a new version of the software.",
    "The library has creative works in common use.",
    "The law is subject to the terms of the contract, provided that the conditions are met.",
)
UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *TEMPLATES)
# Anchors however many ordinary paragraphs have them; and how many at least must have another word to end it as one.
ALWAYS = {"license", "licence", "licensed", "copyright", "reserved"}
LEAST_USUAL = 5
SPLIT = r"[^a-z0-9]+"
_WORD = re.compile("[a-z0-9]+")


def words_of(paragraph: str) -> list[str]:
    """As the expression `words` has them: A-Z lower-cased, runs of a-z and 0-9."""
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), paragraph))


def grams_of(words: list[str], anchors: set[str]) -> set[str]:
    """1- and 2-grams with an anchor word in them."""
    pairs = {f"{a} {b}" for a, b in zip(words, words[1:]) if a in anchors or b in anchors}
    return pairs | {w for w in words if w in anchors}


def _pairs_in(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


_TEMPLATE_PAIRS = [_pairs_in(words_of(t)) for texts in TEMPLATES.values() for t in texts]


def reads_like_notice(paragraph: str) -> bool:
    """Whether it speaks of licences or rights, or shares half of its 2-grams, or of a template's, and three at least."""
    if re.search("licen[sc]|copyright|rights reserved", paragraph, re.IGNORECASE):
        return True
    own = _pairs_in(words_of(paragraph))
    return any(len(own & t) >= max(3, 0.5 * min(len(own), len(t))) for t in _TEMPLATE_PAIRS)


@dataclass
class Model:
    anchors: list[str]
    weights: dict[str, list[float]]  # by gram, a weight for each of FAMILIES
    bias: list[float]


def _examples(rng: np.random.Generator) -> list[tuple[str, int]]:
    """Templates, and pieces of them: stretches of two thirds of the words or more, with or without other words around."""
    out = [(text, 0) for text in OTHER for _ in range(4)]
    for nth, family in enumerate(TEMPLATES, 1):
        for text in TEMPLATES[family]:
            out += [(text, nth)] * 3
            words = text.split()
            for _ in range(5):
                size = max(min(4, len(words)), int(len(words) * rng.uniform(0.67, 1)))
                at = int(rng.integers(0, len(words) - size + 1))
                out.append((" ".join(words[at : at + size]), nth))
    return out


def fit(paragraphs: list[str], seed: int = 5, steps: int = 400, rate: float = 0.5, sparse: float = 2e-4) -> Model:
    """The classifier from the templates, and these paragraphs of no licence."""
    rng = np.random.default_rng(seed)
    # Sampled paragraphs that read like a notice may be one: they teach nothing, and their words are not usual for it.
    quiet = [p for p in paragraphs if not reads_like_notice(p)]
    usual: dict[str, int] = {}
    for p in quiet:
        for w in set(words_of(p)):
            usual[w] = usual.get(w, 0) + 1
    most = max(0.01 * len(quiet), LEAST_USUAL)
    common = {"the", "of", "and", "to", "in", "a", "this", "is", "or", "be", "that", "it", "you", "at", "any", "may", "not", "by", "are", "with"}
    anchors = {w for texts in TEMPLATES.values() for t in texts for w in words_of(t) if w in ALWAYS or usual.get(w, 0) <= most} - common
    rows = _examples(rng) + [(p, 0) for p in quiet]
    grams = [grams_of(words_of(t), anchors) for t, _ in rows]
    names = sorted(set().union(*grams))
    place = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, g in enumerate(grams):
        x[i, [place[k] for k in g]] = 1
    y = np.array([label for _, label in rows])
    held = rng.random(len(rows)) < 0.2
    share = np.bincount(y, minlength=len(FAMILIES)).astype(float)
    weight = (len(rows) / np.maximum(share, 1) / len(FAMILIES))[y]
    w, b = np.zeros((len(names), len(FAMILIES))), np.zeros(len(FAMILIES))
    target = np.eye(len(FAMILIES))[y]
    xt, wt = x[~held], weight[~held, None]
    # Rows without features only move the bias; they are kept together as one weighted row.
    for _ in range(steps):
        p = _softmax(xt @ w + b)
        error = (p - target[~held]) * wt / wt.sum()
        w -= 20 * rate * (xt.T @ error)
        b -= 2 * rate * error.sum(axis=0)
        w = np.sign(w) * np.maximum(np.abs(w) - sparse * 20 * rate, 0)
    scores = x[held] @ w + b
    heat = min(np.geomspace(0.25, 4, 41), key=lambda t: -np.log(_softmax(scores / t)[np.arange(len(scores)), y[held]] + 1e-12).sum())
    kept = np.flatnonzero(np.abs(w).sum(axis=1) > 0)
    return Model(sorted(anchors), {names[i]: (w[i] / heat).round(6).tolist() for i in kept}, (b / heat).round(6).tolist())


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, text: str = "text", sample_docs: int = 200, sample_paragraphs: int = 2000) -> Model:
    """The classifier with at most `sample_paragraphs` paragraphs, of the `sample_docs` different texts of least hash, as unknown ones.

    The hashes are chosen first, so that no text is sorted or sent that isn't in the sample. Null and empty texts and repeated
    rows give nothing more.
    """
    texts = docs.select(F.col(text).alias("t")).where(F.col("t") != "")
    hashed = F.xxhash64("t")
    chosen = texts.select(hashed.alias("h")).groupBy("h").agg(F.lit(1).alias("one")).orderBy("h").limit(sample_docs).select("h")
    found = texts.withColumn("h", hashed).join(F.broadcast(chosen), "h", "left_semi").dropDuplicates(["h"])
    lines = found.select(F.explode(F.split("t", "\n")).alias("p")).where(F.length(F.trim("p")) > 0)
    return fit(sorted(r["p"] for r in lines.orderBy(F.xxhash64("p"), "p").limit(sample_paragraphs).collect()))


def words(paragraph: Column) -> Column:
    lower = F.translate(paragraph, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, SPLIT), lambda w: w != "")


def _literal_rows(spark: SparkSession, rows: list, kind: str) -> DataFrame:
    """Driver-made rows without a Python scan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")))


def _pairs(of: Column) -> Column:
    """2-grams of an array of words; none of fewer than two words."""
    return F.zip_with(F.slice(of, 1, F.greatest(F.size(of) - 1, F.lit(0))), F.slice(of, 2, F.greatest(F.size(of) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def notices(
    docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", least_probability: float = 0.5, least_overlap: float = 0.5
) -> DataFrame:
    """Rows (doc_id, position, family, probability, overlap, confirmed): the paragraphs that aren't unknown.

    A paragraph is a line of the text, by its position from 0. It is of the family of greatest probability (ties to
    the first listed), unknown unless that reaches `least_probability`. overlap: of the 2-grams of the family's
    nearest template, the share that the paragraph has, or of the paragraph's the share that the template has, whichever is greater;
    from `least_overlap` on the prediction is confirmed. Null and empty texts have no paragraphs. Null ids and repeated
    rows are kept, equal rows (id and text) as one. Extra columns are not looked at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    anchors = F.from_json(F.lit(json.dumps(model.anchors)), "array<string>")
    lines = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("position", "line")
    )
    lines = lines.select("doc_id", "text_hash", "position", words(F.col("line")).alias("words"))
    near = lines.where(F.arrays_overlap("words", anchors))
    grams = F.array_distinct(F.concat(F.filter("words", lambda w: F.array_contains(anchors, w)), _pairs(F.col("words"))))
    names = [f"w{i}" for i in range(len(FAMILIES))]
    weights = _literal_rows(
        spark, [{"gram": g, **dict(zip(names, w, strict=True))} for g, w in model.weights.items()], "gram:string," + ",".join(f"{n}:double" for n in names)
    )
    key = ["doc_id", "text_hash", "position"]
    scored = (
        near.select(*key, "words", F.explode(grams).alias("gram"))
        .join(F.broadcast(weights), "gram")
        .groupBy(*key)
        .agg(*[F.sum(n).alias(n) for n in names], F.first("words").alias("words"), F.count("*").alias("n"), F.count_distinct("gram").alias("d"))
    )
    # Equal rows double every gram: their sums are divided by how often each came.
    times = F.col("n") / F.col("d")
    scores = F.array(*[F.struct((F.col(n) / times + F.lit(b)).alias("score"), F.lit(-i).alias("order"), F.lit(f).alias("family")) for i, (n, b, f) in enumerate(zip(names, model.bias, FAMILIES, strict=True))])
    top = F.array_max("scores")
    whole = F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.exp(x["score"] - F.col("top.score")))
    said = (
        scored.withColumn("scores", scores)
        .withColumn("top", top)
        .withColumn("probability", 1 / whole)
        .where((F.col("top.family") != UNKNOWN) & (F.col("probability") >= least_probability))
        .select(*key, "words", F.col("top.family").alias("family"), "probability")
    )
    models = _literal_rows(
        spark,
        [{"family": f, "templates": [sorted({f"{a} {b}" for a, b in zip(w, w[1:])}) for w in map(words_of, texts)]} for f, texts in TEMPLATES.items()],
        "family:string,templates:array<array<string>>",
    )
    own = F.array_distinct(_pairs(F.col("words")))

    def overlap(template: Column) -> Column:
        return F.size(F.array_intersect(F.col("own"), template)) / F.greatest(F.least(F.size("own"), F.size(template)), F.lit(1))

    return (
        said.withColumn("own", own)
        .join(F.broadcast(models), "family")
        .withColumn("overlap", F.array_max(F.transform("templates", overlap)))
        .select("doc_id", "position", "family", F.round("probability", 6).alias("probability"), "overlap", (F.col("overlap") >= least_overlap).alias("confirmed"))
    )
