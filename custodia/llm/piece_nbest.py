"""N-best segmentations over the piece lattice of a SentencePiece vocabulary, and back to text.

Every piece that matches the text is an arc of the lattice; a segmentation's score is the sum of its pieces' scores.
The forward Viterbi pass gives the best score from the start to each place. Read backward, it is the exact
rest of the way, so A* search from the end opens only what leads to one of the next best segmentations.

No piece goes on behind a character with a space mark, none holds a line break, and where the vocabulary allows it none
goes on with a sign behind a letter or digit; there the lattice falls apart into units. Units repeat, so
each task keeps what it has found for those it has met. The N best of the whole text differ from the best only
in the N - 1 units whose second best costs least; only these are searched for N.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"  # stands for a space
NEVER = -1e8  # pieces of lower scores are kept for the sake of their ids, and don't set the unknown's score
SEGMENTS = "doc_id long, rank int, score double, n_pieces long, ids binary, decoded string, round_trip boolean"
BATCH_BYTES = 16 * 1024**2  # of ids and decoded texts, handed on at a time


def _units(pieces: Iterable[str]) -> re.Pattern:
    """The pattern of units: space marks, then what are no letters, then letters, each as many as there are.

    A new unit begins at a mark, and at what is no letter behind a letter. A character that some piece has in such
    a place goes on with the unit instead, so no piece goes over an edge.
    """
    odd = "".join(sorted({c for p in pieces for c in p if re.match("[^\\W\\d_]", c) and not c.isalpha()}))
    letter, other = f"[^\\W\\d_{odd}]", f"(?:[^\\w{MARK}\\n]|[\\d_{odd}])"
    is_letter = re.compile(letter).match
    inside = {b for p in pieces for a, b in zip(p, p[1:]) if is_letter(a) and not is_letter(b) and b != MARK}
    go_on = f"(?:[{re.escape(''.join(sorted(inside)))}]{other}*{letter}*)*" if inside else ""
    return re.compile(f"{MARK}+{other}*{letter}*{go_on}|{other}+{letter}*{go_on}|{letter}+{go_on}|\\n")


_SCORE, _COUNT, _GAP, _IDS = map(itemgetter, range(4))


class Met(dict):
    """What was found for the units met.

    When full it becomes the old generation, from which what is still in use comes back.
    """

    LIMIT = 300_000

    def __init__(self, find: Callable[[str], object], limit: int | None = None) -> None:
        super().__init__()
        self.find, self.old = find, {}
        self.LIMIT = limit or self.LIMIT

    def __missing__(self, unit: str):
        found = self.old.get(unit)
        if found is None:
            found = self.find(unit)
        if len(unit) <= 64:
            if len(self) >= self.LIMIT:
                self.old = dict(self)
                self.clear()
            self[unit] = found
        return found


class Pieces:
    """The vocabulary of a model file, and the segmentations of the units met so far."""

    def __init__(self, model: str, n: int) -> None:
        import sentencepiece

        read = sentencepiece.SentencePieceProcessor(model_file=model)
        self.n = n
        raw: list[bytes] = []  # what an id stands for, marks as spaces
        self.ids: dict[str, tuple[int, float]] = {}
        byte_id = [0] * 256
        for i in range(read.get_piece_size()):
            piece = read.id_to_piece(i)
            raw.append(bytes((int(piece[3:5], 16),)) if read.is_byte(i) else piece.replace(MARK, " ").encode())
            if read.is_byte(i):
                byte_id[raw[i][0]] = i
            elif not (read.is_control(i) or read.is_unknown(i) or read.is_unused(i)):
                self.ids[piece] = ((i,), read.get_score(i))
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.lengths = np.array(list(map(len, raw)), np.int32)
        self.starts = np.cumsum(self.lengths, dtype=np.int32) - self.lengths
        # A node: (getter of next nodes by character, ids of the piece that ends here or None, its score)
        below: dict[str, dict] = {"": {}}
        for piece, (own, score) in sorted(self.ids.items()):
            for end in range(1, len(piece) + 1):
                if piece[:end] not in below:
                    below[piece[:end]] = {}
                    below[piece[: end - 1]][piece[end - 1]] = (below[piece[:end]].get, *self.ids.get(piece[:end], (None, 0.0)))
        self.trie = below[""].get
        self.longest = max(map(len, self.ids))
        self.unknown = min(s for _, s in self.ids.values() if s > NEVER) - 10
        self.byte_ids = byte_id
        self.units = _units(self.ids)
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("the vocabulary has pieces over the edges of units")
        self.met, self.searched = Met(self._measured), Met(lambda unit: self.search(unit, n), 20_000)

    def arcs(self, unit: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For each place the arcs that end there: (start, ids, score).

        A character that is no piece by itself can be spelled in bytes, at the unknown's score.
        """
        out: list[list[tuple[int, tuple[int, ...], float]]] = [[] for _ in range(len(unit) + 1)]
        for start in range(len(unit)):
            below, end = self.trie, start
            for c in unit[start : start + self.longest]:
                node = below(c)
                if node is None:
                    break
                end += 1
                below, own, score = node
                if own is not None:
                    out[end].append((start, own, score))
            if not out[start + 1] or out[start + 1][-1][0] != start:
                out[start + 1].append((start, tuple(self.byte_ids[b] for b in unit[start].encode()), self.unknown))
        return out

    def best_and_gap(self, unit: str) -> tuple[float, list[int], float]:
        """(best score, its ids, how much worse the second best is) of a unit, in one pass.

        Every place has the best two scores of the ways to it; the second is of another way, though it may be equal.
        """
        size, longest, root, unknown, known = len(unit), self.longest, self.trie, self.unknown, self.ids
        first = [0.0] + [-math.inf] * size
        second = [-math.inf] * (size + 1)
        into: list[tuple[int, tuple[int, ...]]] = [(0, ())] * (size + 1)
        for start in range(size):
            below, end, here, there = root, start, first[start], second[start]
            for c in unit[start : start + longest]:
                node = below(c)
                if node is None:
                    break
                end += 1
                below, own, score = node
                if own is not None:
                    way = here + score
                    if way > first[end]:
                        second[end] = max(first[end], there + score)
                        first[end], into[end] = way, (start, own)
                    elif way > second[end]:
                        second[end] = way
            if unit[start] not in known:
                end, way = start + 1, here + unknown
                if way > first[end]:
                    second[end] = max(first[end], there + unknown)
                    first[end], into[end] = way, (start, tuple([self.byte_ids[b] for b in unit[start].encode()]))
                elif way > second[end]:
                    second[end] = way
        parts: list[tuple[int, ...]] = []
        at = size
        while at:
            at, piece = into[at]
            parts.append(piece)
        return first[size], [i for piece in reversed(parts) for i in piece], first[size] - second[size]

    def _measured(self, unit: str) -> tuple[float, int, float, bytes]:
        """(best score, its number of ids, what the second best costs more, its ids as bytes) of a unit."""
        score, ids, gap = self.best_and_gap(unit)
        return score, len(ids), gap, array("I", ids).tobytes()

    def search(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of a unit, best first; equal scores in the order in which the search finds them.

        A place is opened n times at most: what comes to it later ends behind the n ways that came before. Scores are
        whole numbers in the vocabularies at hand, so sums from either side are equal; where they aren't, a way may be
        taken for another that is better by less than rounding.
        """
        arcs = self.arcs(unit)
        best = [0.0]
        for here in arcs[1:]:
            best.append(max([best[start] + score for start, _, score in here]))
        found: list[tuple[float, tuple[int, ...]]] = []
        heap: list = [(-best[-1], 0, len(unit), 0.0, None)]
        made = 0
        opened = [0] * (len(unit) + 1)
        while heap and len(found) < n:
            _, _, place, behind, path = heappop(heap)
            opened[place] += 1
            if opened[place] > n:
                continue
            if not place:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                found.append((behind, tuple(ids)))
                continue
            for start, piece, score in arcs[place]:
                if opened[start] >= n:
                    continue
                made += 1
                so_far = behind + score
                heappush(heap, (-(best[start] + so_far), made, start, so_far, (piece, path)))
        return found

    def best_of(self, text: str | None) -> list[tuple[float, int, bytes]]:
        """The n best of a text as (score, number of ids, ids as bytes).

        Null and empty texts have one segmentation, of no pieces. Among equal scores the one comes first whose
        last unit that isn't the best is further in front.
        """
        if not text:
            return [(0.0, 0, b"")]
        names = self.units.findall(MARK + text.replace(" ", MARK))
        units = list(map(self.met.__getitem__, names))
        score, count = sum(map(_SCORE, units)), sum(map(_COUNT, units))
        gaps, parts = list(map(_GAP, units)), list(map(_IDS, units))
        nearest = []
        for _ in range(min(self.n - 1, len(units))):
            least = min(gaps)
            if least == math.inf:
                break
            nearest.append(gaps.index(least))
            gaps[nearest[-1]] = math.inf
        combined: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        options = {i: self.searched[names[i]] for i in nearest}
        for i, found in options.items():  # of several best ones, the search's first
            parts[i] = array("I", found[0][1]).tobytes()
            count += len(found[0][1]) - units[i][1]
        for i in sorted(nearest):
            first = options[i][0][0]
            grown = [
                (loss + first - option[0], ((i, r), *changes) if r else changes)
                for loss, changes in combined
                for r, option in enumerate(options[i])
            ]
            combined = sorted(grown)[: self.n]
        out = []
        for loss, changes in combined:
            pieces = count
            for i, r in changes:
                parts[i] = array("I", options[i][r][1]).tobytes()
                pieces += len(options[i][r][1]) - len(options[i][0][1])
            out.append((score - loss, pieces, b"".join(parts)))
            for i, _ in changes:
                parts[i] = array("I", options[i][0][1]).tobytes()
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: marks become spaces, the first one goes; bytes that are no UTF-8 become U+FFFD."""
        numbers = np.frombuffer(ids, np.uint32)
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        if not len(ends):
            return ""
        at = np.repeat(self.starts[numbers] - ends + lengths, lengths) + np.arange(ends[-1], dtype=np.int32)
        return self.raw[at].tobytes().decode(errors="replace").replace(MARK, " ")[1:]

    def rows_of(self, text: str | None) -> list[tuple[int, float, int, bytes, str, bool]]:
        """The n best of a text as (rank, score, number of ids, ids as bytes, what they decode to, whether that is the text)."""
        plain = (text or "").replace(MARK, " ")
        return [
            (rank, score, count, ids, back := self.decode(ids), back == plain)
            for rank, (score, count, ids) in enumerate(self.best_of(text), 1)
        ]


@lru_cache(maxsize=2)
def pieces_of(model: str, n: int) -> Pieces:
    return Pieces(model, n)


def segmentations(docs: DataFrame, model: str, n: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Up to n rows per document: doc_id, rank (from 1), score, n_pieces, ids, decoded, round_trip.

    ids are the segmentation as unsigned little-endian 32-bit numbers, decoded is the row's own ids as text. round_trip: that is the
    text, a space mark in it read as a space. Null and empty texts have one row without pieces. A text with fewer
    segmentations has fewer rows. Null ids and repeated rows are segmented each for itself; extra columns
    are not looked at; an empty table gives no rows.
    """

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces_of(model, n)
        names = ["doc_id", "rank", "score", "n_pieces", "ids", "decoded", "round_trip"]
        types = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.string(), pa.bool_()]

        def handed(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

        for batch in batches:
            out: list[list] = [[] for _ in names]
            size = 0
            for doc, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in table.rows_of(cell.as_py()):
                    for column, value in zip(out, (doc, *row), strict=True):
                        column.append(value)
                    size += len(row[3]) + len(row[4])
                if size >= BATCH_BYTES:
                    yield handed(out)
                    out, size = [[] for _ in names], 0
            yield handed(out)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(segment, SEGMENTS)
