"""Quality rules: fixed rules first, then boosted trees over document statistics.

The trees are grown here, on the driver, from a bounded sample of labelled rows: logistic loss,
histogram splits, and a direction for chosen features, which splits may not break. A grown forest is
one set of numpy arrays over all nodes; scoring walks a whole batch of documents level by level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
WINDOW = 8  # words
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent
FOLDS = 5
LEAST_ODDS = -1.0  # log odds; no label makes the threshold fall below

FEATURES = (
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share",
    "digit_share", "punct_share", "distinct_share", "line_words", "top_word_share", "mark_share",
)
#: +1: quality may only rise with the feature, -1: only fall.
DIRECTIONS = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "top_word_share": -1, "mark_share": -1}

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_PUNCT = b".,;:!?-()'\""
_MARKS = b"!?"
_SPACE = b" \t\n\x0b\x0c\r"
_ODD = np.random.default_rng(8).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of that many words which the text holds twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += ids[k : n + k] * _ODD[k]
    ordered = np.sort(rolled)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    _, which, counts = np.unique(rolled, return_inverse=True, return_counts=True)
    often = np.flatnonzero(counts[which] > 1)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, often, 1)
    np.add.at(steps, often + width, -1)
    return int((np.cumsum(steps)[:-1] > 0).sum())


def _count(raw: bytes, of: bytes) -> int:
    return len(raw) - len(raw.translate(None, of))


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """([n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words], features); null reads as empty."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - _count(raw, _SPACE)
    symbols = _count(raw, SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    dup = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    c, w, k = max(chars, 1), max(n, 1), max(len(lines), 1)
    return [n, chars, symbols, dup, repeated], [
        math.log1p(n),
        chars / w,
        symbols / c,
        dup / k,
        repeated / w,
        _count(raw, _UPPER) / c,
        _count(raw, _DIGITS) / c,
        _count(raw, _PUNCT) / c,
        len(distinct) / math.sqrt(w),
        min(n / k, 200.0),
        max(distinct.values(), default=0) / w,
        _count(raw, _MARKS) / c,
    ]


def fails(base: list[int]) -> bool:
    """Whether a text of these base statistics fails the base rules."""
    return base[0] < LEAST_WORDS or 100 * base[4] > MOST_REPEATED * base[0]


@dataclass
class Forest:
    """All trees in one set of node arrays; a leaf is its own child."""

    base: float = 0.0
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    depth: int = 0
    threshold: float = -math.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of good quality for each row of features."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)


def _split(hist_g, hist_h, directions, low, high, least_h, ridge):
    """The best (gain, feature, bin, left value, right value, middle) of a node, or None."""
    best = None
    g, h = hist_g.sum(axis=1), hist_h.sum(axis=1)
    for f in range(len(hist_g)):
        gl, hl = np.cumsum(hist_g[f])[:-1], np.cumsum(hist_h[f])[:-1]
        gr, hr = g[f] - gl, h[f] - hl
        vl = np.clip(-gl / (hl + ridge), low, high)
        vr = np.clip(-gr / (hr + ridge), low, high)
        whole = np.clip(-g[f] / (h[f] + ridge), low, high)
        loss = lambda a, b, v: a * v + 0.5 * (b + ridge) * v * v
        gain = loss(g[f], h[f], whole) - loss(gl, hl, vl) - loss(gr, hr, vr)
        gain[(hl < least_h) | (hr < least_h) | (directions[f] * (vr - vl) < 0)] = 0
        b = int(np.argmax(gain))
        if gain[b] > 1e-9 and (best is None or gain[b] > best[0]):
            best = (gain[b], f, b, vl[b], vr[b], (vl[b] + vr[b]) / 2)
    return best


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Forest:
    """Boosted trees with logistic loss. One class only, or no rows: no trees, every document passes."""
    if not len(y) or y.min() == y.max():
        return Forest()
    directions = [DIRECTIONS.get(f, 0) for f in FEATURES]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    share = y.mean()
    out = Forest(base=float(np.log(share / (1 - share))), depth=depth)
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        at = len(value)
        for column, v in ((feature, 0), (cut, 0.0), (left, at), (right, at), (value, 0.0)):
            column.append(v)
        return at

    total = np.full(len(y), out.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        root = node()
        roots.append(root)
        open_nodes = [(root, np.arange(len(y)), -math.inf, math.inf)]
        for _ in range(depth):
            following = []
            for at, rows, low, high in open_nodes:
                hist_g = np.stack([np.bincount(binned[f, rows], grad[rows], bins) for f in range(len(edges))])
                hist_h = np.stack([np.bincount(binned[f, rows], hess[rows], bins) for f in range(len(edges))])
                best = _split(hist_g, hist_h, directions, low, high, 1.0, ridge)
                if best is None or best[2] >= len(edges[best[1]]):
                    continue
                _, f, b, vl, vr, middle = best
                feature[at], cut[at], left[at], right[at] = f, float(edges[f][b]), node(), node()
                goes_left = binned[f, rows] <= b
                up, down = (directions[f] > 0, directions[f] < 0)
                following.append((left[at], rows[goes_left], middle if down else low, middle if up else high))
                following.append((right[at], rows[~goes_left], middle if up else low, middle if down else high))
                value[left[at]], value[right[at]] = vl * rate, vr * rate
            open_nodes = following
        arrays = [np.array(c) for c in (feature, cut, left, right, value)]
        one = Forest(0.0, np.array([root]), *arrays, depth)
        total += one.score(x)
    out.roots = np.array(roots, np.int32)
    out.feature, out.cut = np.array(feature, np.int32), np.array(cut)
    out.left, out.right, out.value = np.array(left, np.int32), np.array(right, np.int32), np.array(value)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, keep_good: float = 0.999, doc_id: str = "doc_id", text: str = "text") -> Forest:
    """Trees from at most `sample_rows` labelled documents, those whose hashed id is least.

    Only their features reach the driver. All of them grow the trees; the threshold comes from scores by trees of
    other rows (`FOLDS` shares, each scored by trees of the rest): as high as lets at least `keep_good` of the rows pass that
    are labelled good and pass the base rules, but never above even odds, and never below LEAST_ODDS, as so bad a score
    speaks against the label. Labels with a null id or quality, and
    ids without a document, are left out; a repeated label or document counts as often as it occurs.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("label"))
        .where("label_id is not null and label in (0, 1)")
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(sample_rows)
    )
    named = docs.select(F.col(doc_id).alias("label_id"), F.col(text).alias("body"))
    schema = "label int, nth long, failed boolean, " + ", ".join(f"{f} double" for f in FEATURES)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [statistics(t) for t in b.body]
            rows = [(q, i, fails(base), *f) for q, i, (base, f) in zip(b.label, b.label_id, found, strict=True)]
            yield pd.DataFrame(rows, columns=["label", "nth", "failed", *FEATURES])

    found = named.join(chosen, "label_id").select("label", "label_id", "body").mapInPandas(measure, schema)
    rows = found.toPandas().sort_values(["nth", "label", *FEATURES])
    x, y = rows[list(FEATURES)].to_numpy(float), rows["label"].to_numpy(float)
    forest = grow(x, y)
    if len(forest.roots):
        forest.threshold = threshold(x, y, ~rows["failed"].to_numpy(bool), keep_good)
    return forest


def threshold(x: np.ndarray, y: np.ndarray, passed: np.ndarray, keep_good: float) -> float:
    """The least score to keep, from cross-fitted scores of the good rows that pass the base rules; see `fit`."""
    score = np.zeros(len(y))
    fold = np.arange(len(y)) % FOLDS
    for k in range(FOLDS):
        score[fold == k] = grow(x[fold != k], y[fold != k]).score(x[fold == k])
    good = np.sort(score[passed & (y == 1)])
    if not len(good):
        return 0.0
    return float(np.clip(good[int((1 - keep_good) * len(good))], LEAST_ODDS, 0.0))


VERDICT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, score double"
)


def verdict(text: Column, forest: Forest) -> Column:
    """A struct of the base statistics, base_failed, kept and the trees' score.

    Null reads as empty, and an empty text fails the base rules, as every text under 20 words does.
    """

    @F.pandas_udf(VERDICT)
    def judge(texts: pd.Series) -> pd.DataFrame:
        found = [statistics(t) for t in texts]
        base = np.array([b for b, _ in found], np.int64).reshape(-1, 5)
        score = forest.score(np.array([f for _, f in found]).reshape(-1, len(FEATURES)))
        failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
        out = pd.DataFrame(base, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
        return out.assign(base_failed=failed, kept=~failed & (score >= forest.threshold), score=score)

    return judge(text)


def judged(docs: DataFrame, forest: Forest, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and the fields of `verdict`."""
    return docs.select(F.col(doc_id).alias("doc_id"), verdict(F.col(text), forest).alias("q")).select("doc_id", "q.*")
