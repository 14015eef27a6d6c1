"""Ids of a word-level byte-pair vocabulary (lower case, white space dropped, words end in a mark), quickly.

The vocabulary's own library takes four times as long on texts whose words are mostly new. Here the same merges
run as ranks of byte strings: the end mark is a space behind each word, a byte that no word holds. That gives the same
ids as long as every token's own string encodes to that token alone, which `ranks` checks for what it reads.
Texts with characters from U+0300 on, with the separators U+001C to U+001F, or with an added token go to the
vocabulary's library, whose normalising of those isn't rebuilt here.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

END = "</w>"
_LOW = [chr(c) for c in range(0x300)]


def _class(wanted) -> str:
    return "[" + "".join(re.escape(c) for c in _LOW if wanted(c)) + "]"


def _sign(c: str) -> bool:
    return not c.isspace() and unicodedata.category(c)[0] not in "LN" and not "\x1c" <= c <= "\x1f"


BEYOND = re.compile("[̀-\U0010ffff\x1c-\x1f]")
NUMBER = re.compile(_class(lambda c: unicodedata.category(c)[0] == "N"))
SIGNS = re.compile(_class(lambda c: _sign(c) and c != "'") + "+")
#: With apostrophes the order of the alternatives counts; marks above U+0300 come from lower-casing.
PARTS = re.compile("'(?:[stmd]|re|ve|ll)|(?:" + _class(_sign) + "|̇)+|" + NUMBER.pattern)


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, and the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.added = [t["content"] for t in stored["added_tokens"]]
        ranks, ids = self.ranks(stored["model"])
        self.ids = np.array(ids, np.uint32)
        self.merger = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def ranks(model: dict) -> tuple[dict[bytes, int], list[int]]:
        letters, vocabulary = byte_letters(), model["vocab"]

        def string(token: str) -> bytes:
            whole = token.removesuffix(END)
            return bytes(letters[c] for c in whole) + (b" " if whole != token else b"")

        ranks: dict[bytes, int] = {}
        ids: list[int] = []
        singles = sorted(letters, key=letters.get)
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        for token in [*singles, *(c + END for c in singles), *merged]:
            if ranks.setdefault(string(token), len(ids)) != len(ids):
                raise ValueError(f"two merges give {token!r}; ranks of strings can't tell them apart")
            ids.append(vocabulary[token])
        return ranks, ids

    def encode(self, text: str) -> np.ndarray:
        """Unsigned 32-bit ids of the text; added tokens in it have their own."""
        if BEYOND.search(text) or any(t in text for t in self.added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        lower = text.lower()
        if "'" in lower or "̇" in lower:
            lower = PARTS.sub(r" \g<0> ", lower)
        else:
            lower = NUMBER.sub(r" \g<0> ", SIGNS.sub(r" \g<0> ", lower))
        words = lower.split()
        if not words:
            return np.zeros(0, np.uint32)
        return self.ids[self.merger.encode_to_numpy(" ".join(words) + " ")]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
