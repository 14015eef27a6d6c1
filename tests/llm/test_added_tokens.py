"""Added tokens of the vocabulary inside texts have the ids of the JSON file's library."""

from __future__ import annotations

import zlib
from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from custodia.llm import packing
from tests.llm.conftest import frame

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["<|endoftext|>", "<|endoftext|", "<|", "|>", " ", "\n", "\t", "  ", "a", " the", "é", "中", "'s", "1", "!", "x\x85", "　", "endoftext"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


@given(parts=st.lists(st.sampled_from(PARTS), max_size=14))
@settings(max_examples=500, deadline=None)
def test_ids_with_added_tokens(tokenizer, parts):
    text = "".join(parts)
    assert array("I", packing.token_bytes(text, RANKS)).tolist() == ids_of(tokenizer, text)


def test_pack_with_added_tokens(spark, tokenizer):
    texts = {1: "a <|endoftext|> b", 2: "<|endoftext|><|endoftext|>\n", 3: "no such token <|endoftext"}
    assert ids_of(tokenizer, texts[1]) == [64, 220, 50256, 275, 0]
    want = {(i, len(ids), zlib.crc32(array("I", ids).tobytes())) for i, ids in ((i, ids_of(tokenizer, t)) for i, t in texts.items())}
    found = packing.pack(frame(spark, list(texts.items())), RANKS).collect()
    assert {(r["doc_id"], r["length"], r["ids_crc32"]) for r in found} == want
