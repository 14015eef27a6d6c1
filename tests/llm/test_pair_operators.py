"""Operators that compare documents with one another, against comparisons of all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from custodia.llm import chunk_dedup, line_dedup, ngram_join, topk_search
from custodia.llm.common import components, discard, marked, may_match, staged
from tests.llm.conftest import edited, frame, odd_rows, prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def classes(nodes, linked):
    """The smallest node that each node is connected to."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


# -- components --------------------------------------------------------------------------------------------------


def test_components_of_chains_stars_and_nothing(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 5000), (-3, 7000), (7000, -3)]
    edges += [(rng.randrange(9000, 9060), rng.randrange(9000, 9060)) for _ in range(40)]
    own = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert own == classes(nodes, [(a, b) for a, b in edges if a != b])
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_marks_miss_nothing(spark):
    rows = spark.range(5000).selectExpr("id", "if(id % 10 = 0, null, cast(id as string)) AS k", "id AS _place")
    keys = spark.range(0, 5000, 7).selectExpr("cast(id as string) AS k").unionByName(spark.createDataFrame([(None,)], "k string"))
    found = {r["id"]: r["f"] for r in marked(rows, keys, "k", "f").collect()}
    assert len(found) == 5000
    assert all(found[i] for i in range(0, 5000, 7) if i % 10) and not any(found[i] for i in range(0, 5000, 10))
    assert sum(found.values()) < 700
    assert may_match(rows, keys.limit(0), "k").collect() == [] and may_match(rows, keys, "k").columns == rows.columns


def test_discarded_files_are_gone(spark):
    import os

    kept, spent = staged(spark.range(3), "test"), staged(spark.range(3), "test")
    (path,) = {os.path.dirname(f) for f in spent.inputFiles()}
    discard(spent)
    assert not os.path.exists(path.removeprefix("file://").removeprefix("file:")) and kept.count() == 3


# -- n-gram join -------------------------------------------------------------------------------------------------


def shingle_sets(rows, width):
    for i, t in rows:
        words = [w.encode().lower() for w in WORDS.findall(t or "")]
        size = min(width, len(words))
        yield i, frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if words else frozenset()


def plain_classes(rows, width, percent):
    sets = list(shingle_sets(rows, width))
    named = [(n, s) for n, (i, s) in enumerate(sets) if i is not None]
    linked = [(a, b) for k, (a, x) in enumerate(named) for b, y in named[k + 1 :] if x and 100 * len(x & y) >= percent * len(x | y)]
    least = {}
    part = classes([n for n, _ in named], linked)
    for n, _ in named:
        least[part[n]] = min(least.get(part[n], sets[n][0]), sets[n][0])
    return Counter((i, len(s), least[part[n]] if i is not None else None) for n, (i, s) in enumerate(sets))


def test_join_of_odd_documents(odd, nothing):
    for width, percent in ((3, 90), (5, 80)):
        found = ngram_join.classes(odd, width, percent)
        assert Counter(map(tuple, found.collect())) == plain_classes(odd_rows(), width, percent)
    assert ngram_join.classes(nothing, 3, 90).collect() == []


def test_families_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(7)
    base = prose(rng, 120)
    rows = [(i, edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.05]))) for i in range(90)]
    found = ngram_join.classes(frame(spark, rows), 3, 90)
    assert Counter(map(tuple, found.collect())) == plain_classes(rows, 3, 90)


def test_short_unrelated_sets_make_no_family():
    """Sets whose layout leaves choices empty share no signature for being short alone."""
    rng = np.random.default_rng(4)
    held = Counter()
    for n in range(3000):
        elements = np.unique(rng.integers(0, 2**63, 4 + n % 12).astype(np.uint64))
        held.update({s for tag in ngram_join.signatures(elements, 4, 5) for s in tag.tolist()})
    assert max(held.values()) == 1


def test_family_of_two_kinds_over_many_blocks(spark, monkeypatch):
    """Sets outside the largest component of a family meet all of its blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 6)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 400)
    monkeypatch.setattr(ngram_join, "GRID_ROWS", 16)
    rng = random.Random(11)
    bases = [prose(rng, 60) for _ in range(3)]
    rows = [(i, edited(rng, bases[i % 3], rng.choice([0, 0.02, 0.06, 0.1]))) for i in range(75)]
    docs = frame(spark, rows)
    named = docs.select("doc_id", "text")
    found = ngram_join.sets_of(named, 3, 4, 5).dropDuplicates(["vertex"])
    members = found.select(F.lit(1).cast("long").alias("family"), "vertex", "n_shingles", "doc_id")
    edges = [tuple(r) for r in ngram_join.family_links(members, named, 3, 4, 5).collect()]
    vertices = {r["doc_id"]: r["vertex"] for r in ngram_join.sets_of(named, 3, 4, 5).collect()}
    part = classes(list(set(vertices.values())), edges)
    least = {}
    for i in sorted(vertices):
        least.setdefault(part[vertices[i]], i)
    assert {i: least[part[v]] for i, v in vertices.items()} == {i: c for i, _, c in plain_classes(rows, 3, 80)}


@given(size=st.integers(1, 400), cut=st.integers(0, 40), add=st.integers(0, 40), seed=st.integers(0, 10**6))
@settings(max_examples=300, deadline=None)
def test_similar_sets_share_a_signature(size, cut, add, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
    b = np.unique(np.concatenate([a[min(cut, len(a) - 1) :], rng.integers(0, 2**63, add, dtype=np.uint64)]))
    common = len(np.intersect1d(a, b))
    for numerator, denominator in ((9, 10), (4, 5)):
        if denominator * common >= numerator * (len(a) + len(b) - common):
            own, other = ({x for tag in ngram_join.signatures(s, numerator, denominator) for x in tag.tolist()} for s in (a, b))
            assert own & other


# -- lines ---------------------------------------------------------------------------------------------------------


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


@given(a=st.text("abc", max_size=12), edits=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 12), st.sampled_from("abc")), max_size=4), most=st.integers(0, 3))
@settings(max_examples=600, deadline=None)
def test_edit_distance_and_keys(a, edits, most):
    b = list(a)
    for kind, at, c in edits:
        if kind == 0:
            b.insert(at, c)
        elif at < len(b):
            b[at : at + 1] = [c] if kind == 1 else []
    b = "".join(b)
    real = edit_distance(a, b)
    assert line_dedup.distance(a, b, most) == min(real, most + 1)
    assert line_dedup.similar(a, b, most) == (real <= most)
    if real <= most and min(len(a), len(b)) > most:
        assert set(line_dedup.keys_of(a, most, most + 1)) & set(line_dedup.keys_of(b, most, most + 1))


def line_rows():
    rng = random.Random(3)
    lines = [prose(rng, 12, 60).replace("\n", " ") for _ in range(40)]

    def vary(line):
        at = rng.randrange(len(line))
        return line[:at] + rng.choice(["", "x", "yz"]) + line[at + rng.choice([0, 1]) :]

    rows = [(i, "\n".join(vary(rng.choice(lines)) if rng.random() < 0.6 else rng.choice(lines) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    return rows + [(70, None), (71, ""), (72, "\n \n"), (None, lines[0]), (0, rows[0][1]), (73, "short\nshort\nshorx"), (74, lines[0] + "\r\n\n" + lines[1])]


def plain_removed(rows, threshold, least):
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None))
    lines = sorted({x for _, t in docs for x in (t or "").split("\n") if WORDS.search(x)})
    long = [x for x in lines if len(x) >= least]
    linked = [(x, y) for k, x in enumerate(long) for y in long[k + 1 :] if abs(len(x) - len(y)) <= threshold and edit_distance(x, y) <= threshold]
    part, seen, out = classes(lines, linked), {}, {}
    for i, t in docs:
        split = (t or "").split("\n")
        own = [p for p, x in enumerate(split) if x in part and seen.setdefault(part[x], (i, p)) != (i, p)]
        out[i, t] = own
    return out


def test_lines_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    rows = line_rows()
    expected = plain_removed(rows, 2, 16)
    docs = frame(spark, rows)
    found = line_dedup.report(docs, 2, 16).collect()
    assert Counter((r["doc_id"], r["removed"]) for r in found) == Counter((i, ",".join(map(str, expected[i, t]))) for i, t in rows)
    assert any(r["n_removed"] > r["n_exact"] for r in found)
    left = line_dedup.without_duplicates(docs, 2, 16)
    assert left.columns == docs.columns
    texts = Counter((r["doc_id"], r["text"]) for r in left.collect())
    kept = Counter()
    for i, t in rows:
        gone = set(expected[i, t])
        rest = "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in gone)
        if not gone or WORDS.search(rest):
            kept[i, t if not gone else rest] += 1
    assert texts == kept


def test_lines_of_odd_documents(odd, nothing):
    assert Counter(r["doc_id"] for r in line_dedup.report(odd).collect()) == Counter(i for i, _ in odd_rows())
    assert line_dedup.report(nothing).collect() == []
    assert line_dedup.without_duplicates(nothing).collect() == []


# -- passages -------------------------------------------------------------------------------------------------------


def chunks_of(text):
    raw, start, out = text.encode(), 0, []
    for end in chunk_dedup.chunk_ends(raw) if raw else []:
        out.append((len(raw[:start].decode()), len(raw[:end].decode()), raw[start:end]))
        start = end
    assert b"".join(c for _, _, c in out) == raw
    return out


@given(text=st.text(max_size=300), at=st.integers(0, 300))
@settings(max_examples=200, deadline=None)
def test_chunks_cover_and_stay_in_characters(text, at):
    chunks_of(text)
    assert all(len(c) <= chunk_dedup.LONGEST for _, _, c in chunks_of(text))


def test_chunks_resist_insertions():
    rng = random.Random(9)
    text = prose(rng, 2000)
    moved = text[:500] + "inserted" + text[500:]
    own, other = {c for _, _, c in chunks_of(text)}, {c for _, _, c in chunks_of(moved)}
    assert len(own & other) > 0.95 * len(own)


def plain_passages(rows, least):
    holders, parts = defaultdict(set), defaultdict(set)
    for i, t in rows:
        if i is not None and t:
            for c in chunks_of(t):
                holders[c[2]].add(i)
                parts[i, t].add(c)
    out = set()
    for (i, _), own in parts.items():
        run = []
        for c in [*sorted(own, key=lambda c: c[:2]), None]:
            shared = c is not None and len(holders[c[2]]) > 1
            if run and not (shared and c[0] <= run[-1][1]):
                if run[-1][1] - run[0][0] >= least:
                    first = min(min(holders[x[2]]) for x in run)
                    out.add((i, run[0][0], run[-1][1], len(run), first, first == i))
                run = []
            if shared:
                run.append(c)
    return out


def passage_rows():
    rng = random.Random(8)
    shared = prose(rng, 70)
    rows = [(i, prose(rng, 120) + "\n" + (shared if i % 7 == 0 else "") + "\n" + prose(rng, 80)) for i in range(30)]
    return rows + [(40, None), (41, ""), (None, shared), (5, rows[5][1]), (42, "short"), (43, rows[3][1])]


def test_passages(spark):
    rows = passage_rows()
    docs = frame(spark, rows)
    found = {tuple(r) for r in chunk_dedup.repeated_passages(docs).select("doc_id", "start", "end", "n_chunks", "first_doc_id", "is_first").collect()}
    assert found == plain_passages(rows, 100)
    assert {i for i, *_ in found} == {0, 3, 7, 14, 21, 28, 43}
    left = chunk_dedup.without_passages(docs)
    assert left.columns == docs.columns and left.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert texts[0] == rows[0][1] and len(texts[7]) < len(rows[7][1]) - 100 and texts[40] is None


def test_passages_of_odd_documents(odd, nothing):
    found = chunk_dedup.repeated_passages(odd).select("doc_id", "start", "end", "n_chunks", "first_doc_id", "is_first")
    assert {tuple(r) for r in found.collect()} == plain_passages(odd_rows(), 100)
    assert chunk_dedup.repeated_passages(nothing).collect() == []


def test_passages_are_cut_from_their_own_text_only(spark):
    rng = random.Random(9)
    shared, other, more = (prose(rng, n) for n in (90, 150, 60))
    rows = [(1, shared), (5, more + "\n" + shared), (5, other), (5, None)]
    left = {(r["doc_id"], r["text"]) for r in chunk_dedup.without_passages(frame(spark, rows)).collect()}
    assert {(1, shared), (5, other), (5, None)} < left and len(left) == 4
    (cut,) = [t for i, t in left if i == 5 and t not in (None, other)]
    assert cut.startswith(more) and len(cut) < len(more) + 150


def test_rows_of_one_id_are_candidates_each(spark):
    vectors = spark.createDataFrame([(100, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 0.0])], "vec_id long, embedding array<float>")
    found = topk_search.search(vectors, F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, found.collect())) == [(100, 1, 1, 1048576), (100, 2, 1, 524288)]


# -- top k -----------------------------------------------------------------------------------------------------------


def plain_best(rows, k):
    usable = defaultdict(list)
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            usable[i].append([int(np.floor(1024 * float(np.float32(x)))) for x in v])
    own = {i: min(vs) for i, vs in usable.items()}
    for q, a in own.items():
        if q % 10 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, vs in usable.items() if i != q for b in vs)
            yield from ((q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1))


def vector_rows():
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.01, 0.3, 1, 8])).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(40)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (310, [float("inf")] * 6)]
    return rows + [(320, [0.0] * 6), (330, []), (340, [1.0, 2.0]), (None, rows[0][1]), (10, rows[11][1]), (-20, rows[3][1])]


def test_top_k_against_all_products(spark):
    rows = vector_rows()
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, bound string")
    for seeds, tile in ((4, 16), (64, 40), (1, 500)):
        found = topk_search.search(vectors, F.col("vec_id") % 10 == 0, k=5, tile_vectors=tile, tile_queries=7, seeds=seeds)
        assert Counter(map(tuple, found.collect())) == Counter(plain_best(rows, 5))
    few = vectors.where("vec_id in (0, 1, 10)")
    assert Counter(map(tuple, topk_search.search(few, F.col("vec_id") % 10 == 0, k=5).collect())) == Counter(
        plain_best([r for r in rows if r[0] in (0, 1, 10)], 5)
    )
    assert topk_search.search(vectors.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_coordinate_pruning_with_near_copies(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.02 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(400)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = topk_search.search(vectors, F.col("vec_id") % 10 == 0, k=5, tile_vectors=50, seeds=300)
    assert Counter(map(tuple, found.collect())) == Counter(plain_best(rows, 5))


def test_products_stay_exact():
    big = np.array([[2**30, -(2**30), 3]], np.int64)
    assert topk_search.products(big, big).tolist() == [[2**61 + 9]]
    huge = np.array([[2**62]], np.int64)
    assert topk_search.products(huge, huge).tolist() == [[2**63 - 1]]


