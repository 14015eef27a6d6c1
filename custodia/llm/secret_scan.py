"""Secrets in texts: keyword automaton first, anchored patterns only at its hits, checksums last.

One pass of an Aho-Corasick automaton over the lower-cased text finds every place where a
pattern with a literal start could match; only there the pattern is tried, anchored. Runs of hex digits have
no literal start: the text is mapped to one symbol per class and searched for a run of the least
length, which is a keyword of that alphabet. Tokens that carry a checksum count only if it is right.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in their order, key words and patterns.
ASSIGN, ACCESS, HEX, GITHUB, NPM = KINDS = ("assign", "access", "hex", "github", "npm")
BASE = (ASSIGN, ACCESS, HEX)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
GITHUB_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
ASSIGN_PATTERN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS_PATTERN = re.compile("AKIA[A-Z0-9]+")
CHECKED_PATTERN = re.compile(r"(gh[pousr]_|npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
LEAST = {ASSIGN: 6, ACCESS: 20, HEX: 24}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_CLASS = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(" ") for b in range(256))
HEX_RUN = re.compile(b"h{%d,}" % LEAST[HEX])

Span = tuple[int, int, str]  # start, end, kind


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in ((ASSIGN, ASSIGN_WORDS), (ACCESS, ("akia",)), (GITHUB, GITHUB_WORDS), (NPM, ("npm_",))):
        for word in words:
            found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def checksum_ok(body: str, tail: str) -> bool:
    """The tail is the CRC-32 of the body in base 62, six digits, zeros in front."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits == tail


def find_spans(text: str | None) -> list[Span]:
    """(start, end, kind) of every secret, by start and then kind as listed; null reads as empty.

    Offsets are code points, the end exclusive. A match that fails its least length still takes its
    characters from later matches of its kind.
    """
    if not text:
        return []
    raw = text.encode()
    plain = len(raw) == len(text)
    lower = raw.lower()
    spans: list[Span] = []
    free = dict.fromkeys(KINDS, 0)
    hits = sorted((end - size + 1, kind) for end, (size, kind) in automaton().iter(lower.decode()))
    for start, kind in hits:
        if start < free[kind]:
            continue
        if kind == ASSIGN:
            if m := ASSIGN_PATTERN.match(text, start):
                free[kind] = m.end()
                if len(m[2]) >= LEAST[kind]:
                    spans.append((start, m.end(), kind))
        elif kind == ACCESS:
            if m := ACCESS_PATTERN.match(text, start):
                free[kind] = m.end()
                if m.end() - start >= LEAST[kind]:
                    spans.append((start, m.end(), kind))
        elif (m := CHECKED_PATTERN.match(text, start)) and checksum_ok(m[2], m[3]):
            free[kind] = m.end()
            spans.append((start, m.end(), kind))
    mapped = raw.translate(HEX_CLASS)
    if b"h" * LEAST[HEX] in mapped:
        for m in HEX_RUN.finditer(mapped):
            start = m.start() if plain else len(raw[: m.start()].decode())
            spans.append((start, start + m.end() - m.start(), HEX))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def mask(text: str | None, spans: list[Span], mark: str = "[SECRET]") -> str | None:
    """The text with every stretch that spans cover, alone or together, replaced by the mark."""
    if not spans:
        return text
    out, at = [], 0
    covered = -1
    for start, end, _ in spans:
        if start >= covered:
            out += [text[at:start], mark]
        covered = max(covered, end)
        at = covered
    return "".join([*out, text[at:]])


FOUND = "array<struct<start:long,end:long,kind:string>>"


def spans_of(text: Column) -> Column:
    """The spans of a text column; an empty list for null and for empty texts."""

    @F.pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b, "kind": k} for a, b, k in find_spans(t)])

    return find(text)


def masked(text: Column) -> Column:
    """The text with its secrets replaced; null stays null."""

    @F.pandas_udf("string")
    def replace(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: mask(t, find_spans(t)), na_action="ignore")

    return replace(text)


REPORT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long"


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, counts and base_sha256 of the base kinds, all spans, n_checked.

    Null and empty texts have no spans, and the digest of an empty text. Null ids, repeated rows and extra columns
    do not matter: each row is looked at for itself. An empty table gives no rows.
    """

    @F.pandas_udf(REPORT)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            spans = find_spans(t)
            base = [s for s in spans if s[2] in BASE]
            kinds = [s[2] for s in spans]
            rows.append(
                (
                    *(kinds.count(k) for k in BASE),
                    hashlib.sha256(joined(base).encode()).hexdigest(),
                    joined(spans),
                    len(spans) - len(base),
                )
            )
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked"])

    return docs.select(F.col(doc_id).alias("doc_id"), scan(F.col(text)).alias("found")).select("doc_id", "found.*")
