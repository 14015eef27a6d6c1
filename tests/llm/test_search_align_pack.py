"""Lexical scan, token alignment and configuration packing against plain versions of their definitions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from custodia.llm import config_packing, lexical_scan, token_alignment
from custodia.llm.word_encoder import word_encoder
from tests.llm.conftest import bag, frame, odd_rows, prose

RANKS, MODEL, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "word_bpe_49k.json"))
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- lexical scan


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(items, docs, k):
    counted = [(doc, Counter(plain_terms(t))) for doc, t in docs]
    counted = [(doc, c) for doc, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(plain_terms(text))
    out = []
    for item, terms in asked.items():
        found = []
        for doc, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t]
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [
    (1, "one Two two, ONE"), (2, None), (3, ""), (4, "the é v "), (5, "nowhere-at-all"), (6, "1234 x1 y"), (7, "two\nwords"),
    (8, "  ..."), (1, "words"), (9, "İx \U0001f600  "), (None, "tab line"),
]


@pytest.mark.parametrize("block_bytes", [lexical_scan.BLOCK_BYTES, 150])
def test_scan_is_the_definition(spark, odd, block_bytes):
    rng = random.Random(5)
    rows = odd_rows()
    items = [*ITEMS, *((20 + i, " ".join(rng.choice([t for _, t in rows if t]).split()[:12])) for i in range(12))]
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    got = lexical_scan.search(asked, odd, k=4, block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert bag(got) == plain_search(items, rows, 4)


def test_terms_with_guards():
    texts = ["a b a\nB.c_d", "\x00x\x7fy\x80z", "é É", "a  a a", "", None, "x y z 　"]
    for text in texts:
        assert lexical_scan.terms_of(text) == plain_terms(text)
        scan = lexical_scan.Scan([["a", "b", "é", "x"], ["c", "x y z", "\x80z"]])
        found = scan.counts(lexical_scan.mapped(text))
        assert {scan.terms[n]: c for n, c in found.items()} == {t: c for t, c in Counter(plain_terms(text)).items() if t in scan.terms}


def test_scan_of_nothing(spark, odd, nothing):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical_scan.search(items, nothing).collect() == []
    assert lexical_scan.search(items.limit(0), odd).collect() == []


def test_ties_and_repeated_documents_of_many_tasks(spark):
    docs = [(i % 40, "same words here") for i in range(200)] + [(None, "same words here")] + [(900 + i, "other") for i in range(300)]
    items = [(1, "words same"), (2, "here")]
    got = lexical_scan.search(spark.createDataFrame(items, "item_id long, text string"), frame(spark, docs).repartition(7), k=10)
    assert bag(got) == plain_search(items, docs, 10)


# --- token alignment


def spelled(second, n):
    piece = second.id_to_piece(n)
    return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()


@pytest.fixture(scope="module")
def tokenizers_of_both():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True  # the contract: strings of special tokens are plain text here
    return first, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def plain_alignment(rows, both):
    from custodia.llm.word_encoder import byte_letters

    first, second = both
    letters = byte_letters()
    docs = []
    for doc, text in rows:
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in first.id_to_token(n)) for n in a]
        bytes_b = [spelled(second, n) for n in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
            docs.append((doc, [], [], [], []))
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            ends = np.cumsum([len(p) for p in parts]).tolist()
            spans.append(list(zip([0, *ends], ends)))
        links = []
        for i, (s, e) in enumerate(spans[0]):
            links += [(i, j) for j, (p, q) in enumerate(spans[1]) if p < e and s < q]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, at_a, at_b = [], 0, 0
        for cut in cuts:
            to_a = next(n for n, (_, e) in enumerate(spans[0]) if e == cut) + 1
            to_b = next(n for n, (_, e) in enumerate(spans[1]) if e == cut) + 1
            groups.append(",".join(map(str, a[at_a:to_a])) + "|" + ",".join(map(str, b[at_b:to_b])))
            at_a, at_b = to_a, to_b
        docs.append((doc, a, b, groups, [(a[i], b[j]) for i, j in links]))
    counts = Counter(p for *_, links in docs for p in links)
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return sorted(
        (
            (
                doc, len(a), len(b), len(groups), len(links), sum(counts[p] == highest[p[1]] for p in links),
                sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
            )
            for doc, a, b, groups, links in docs
        ),
        key=repr,
    )


ALIGN_ROWS = [
    *[r for r in odd_rows() if r[1] is None or len(r[1]) < 1200],
    (700, "<|endoftext|> <s> </s> <unk> <0x41>"), (701, "a ▁ b"), (702, "  two  spaces   \n\n tabs\t\t"), (703, "\U0001f600\U0001f601 日本語 テスト"),
    (704, " leading"), (705, " "), (706, " x y"), (707, "é ﬁ Ａ"), (708, "\x00\x01"), (709, "a" * 700),
]


@pytest.mark.parametrize("head", [token_alignment.HEAD, 40, 0])
def test_alignment_is_the_definition(spark, tokenizers_of_both, head):
    got = token_alignment.align(frame(spark, ALIGN_ROWS).repartition(3), RANKS, MODEL, head=head)
    assert bag(got) == plain_alignment(ALIGN_ROWS, tokenizers_of_both)


def test_some_texts_are_not_spelled(tokenizers_of_both):
    both = token_alignment.pair(RANKS, MODEL)
    assert both.tokens("a ▁ b") is None and both.tokens("plain") is not None


def test_runs_are_skipped_and_nothing_is_missed():
    rng = random.Random(3)
    for _ in range(300):
        total = rng.choice([1, 2, 7, 60, 400])
        shared = [n for n in range(1, total) if rng.random() < rng.choice([0.2, 0.95])]
        a = sorted({*shared, *(n for n in range(1, total) if rng.random() < 0.05), total})
        b = sorted({*shared, *(n for n in range(1, total) if rng.random() < 0.05), total})
        left, right = (x.tolist() for x in token_alignment.aligned(a, b))
        ranges = [list(zip([0, *x], x)) for x in (a, b)]
        want = [(i, j) for i, (s, e) in enumerate(ranges[0]) for j, (p, q) in enumerate(ranges[1]) if p < e and s < q]
        assert list(zip(left, right)) == want


def test_alignment_of_nothing_and_of_a_long_text(spark, nothing, tokenizers_of_both):
    assert token_alignment.align(nothing, RANKS, MODEL).collect() == []
    text = prose(random.Random(2), 60_000)
    found = token_alignment.align(frame(spark, [(1, text)]), RANKS, MODEL).first()
    assert found["n_a"] + found["n_b"] - found["n_groups"] == found["n_links"] > 60_000


# --- configuration packing


def plain_ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def check_packing(rows, pieces, library, capacity):
    """Every id in one piece, sequences gapless; the number of sequences."""
    want = Counter()
    for doc, text in rows:
        ids = plain_ids(library, text)
        for nth, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start : start + capacity], "<u4")
            want[(doc, nth, start, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    got = Counter((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces)
    assert got == want
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing_holds_every_id_once(spark, odd, library, capacity):
    rows = odd_rows()
    found = config_packing.pack(odd.repartition(5), WORDS, capacity).collect()
    total = sum(len(plain_ids(library, t)) for _, t in rows)
    assert check_packing(rows, found, library, capacity) <= math.ceil(1.005 * total / capacity)


def test_packing_of_nothing_and_of_empty_texts(spark, nothing, library):
    assert config_packing.pack(nothing, WORDS).collect() == []
    rows = [(None, None)] * 50 + [(1, "")] * 50
    found = config_packing.pack(frame(spark, rows).repartition(3), WORDS, 16).collect()
    assert check_packing(rows, found, library, 16) == math.ceil(100 / 16)


def least_sequences(lengths, capacity):
    """By trying every place, longest first."""
    best = [len(lengths)]

    def place(at, free):
        if len(free) >= best[0]:
            return
        if at == len(lengths):
            best[0] = len(free)
            return
        for room in sorted(set(free)):
            if room >= lengths[at]:
                k = free.index(room)
                place(at + 1, [*free[:k], room - lengths[at], *free[k + 1 :]])
        place(at + 1, [*free, capacity - lengths[at]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best[0]


def test_plans_against_the_least_number_of_sequences():
    rng = random.Random(1)
    more = 0
    for _ in range(60):
        capacity = rng.choice([10, 30])
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 11))]
        patterns = config_packing.plan(Counter(lengths), capacity)
        held = Counter()
        for many, pattern in patterns:
            assert sum(n * k for n, k in pattern.items()) <= capacity
            for n, k in pattern.items():
                held[n] += many * k
        assert held == Counter(lengths)
        more += sum(n for n, _ in patterns) - least_sequences(lengths, capacity)
    assert 0 <= more <= 2


def test_plan_of_large_counts_comes_near_the_bound_and_beats_best_fit():
    rng = np.random.default_rng(2)
    histogram = np.bincount(rng.integers(230, 380, 50_000), minlength=1025)
    program = config_packing.Program(histogram, 1024)
    got = sum(n for n, _ in program.rounded(histogram))
    plain = sum(n for n, _ in config_packing.best_fit(histogram.copy(), defaultdict(list), 1024))
    assert program.bound <= got < plain and got < 1.05 * program.bound


def test_knapsack_is_exact():
    rng = np.random.default_rng(3)
    prices = np.full(41, -1.0)
    prices[[3, 7, 11, 20]] = rng.random(4)
    best, pick = config_packing.knapsack(prices, 40)
    for room in range(41):
        most = max(
            a * prices[3] + b * prices[7] + c * prices[11] + d * prices[20]
            for a in range(14) for b in range(6) for c in range(4) for d in range(3) if 3 * a + 7 * b + 11 * c + 20 * d <= room
        )
        pattern = config_packing.traced(pick, room)
        assert math.isclose(best[room], most) and math.isclose(sum(prices[n] * k for n, k in pattern.items()), most)
        assert sum(n * k for n, k in pattern.items()) <= room


def test_word_encoder_gives_the_library_s_ids(library):
    encoder = word_encoder(WORDS)
    texts = [t for _, t in odd_rows() if t]
    for c in [*range(0x350), 0x1100, 0x2028, 0x212B, 0x3A3, 0x1F600]:
        texts += [form.replace("%", chr(c)) for form in ("a%b", "%", " %1 2", "%'s x", ".%'", "é%%s'll", "'%re")]
    texts += ["<|endoftext|> a<|startoftext|>b", "it's 'twas we'll '''s don''t", "İSTANBUL Ⱥ ſ ŉ", "12½³", "_a_b__", "ΣΣ"]
    for text in texts:
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_token_of_the_vocabulary_encodes_to_itself(library):
    """What the ranks rest on."""
    model = library.model
    for token, number in library.get_vocab(with_added_tokens=False).items():
        if token.endswith("</w>"):
            assert [t.id for t in model.tokenize(token.removesuffix("</w>"))] == [number]
