"""Problem 5: splitting oversized texts at natural boundaries.

Content-defined chunking: rolling-hash landmarks choose about where to cut, and
each landmark snaps to the nearest natural boundary (paragraph, sentence, line,
word) within the smallest and largest step. A cut depends on the text near it
and on the cut before it, and the landmarks bring the cuts back into step after
an edit, so that an edit alters only neighbouring pieces.

Defined cases: null and blank texts give no piece; a text within the limit is
one piece; outer white space belongs to no piece; a text without any boundary
is cut between characters; exact duplicate rows give their pieces once; rows of
one name with different texts give the pieces of each; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .rolling import rolling_hash, starts_character


@dataclass(frozen=True)
class PieceRule:
    limit: int = 2048  # most bytes of a piece
    overlap: int = 256  # most bytes that a piece shares with the one before
    least: int = 768  # least bytes that a piece adds
    average: int = 400  # one landmark in so many bytes, from ``least`` on
    reach: tuple[int, int, int, int] = (384, 256, 192, 128)  # how far a landmark snaps: paragraph, sentence, line, word

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.limit - self.least or self.least < 1:
            raise ValueError("overlap and least must fit in the limit")


_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[ord(c) for c in ".!?"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in " \t\r\n"]] = True


def _boundaries(data: np.ndarray) -> list[np.ndarray]:
    """Positions after which a piece may end: paragraphs, sentences, lines, words; ascending."""
    blank = _BLANK[data]
    newline = np.flatnonzero(data == 10)
    paragraph = np.empty(0, np.int64)
    if len(newline):
        text = np.flatnonzero(~blank)
        before = np.searchsorted(text, newline)  # two line ends with the same text before them: an empty line
        again = np.flatnonzero(before[1:] == before[:-1]) + 1
        paragraph = newline[again] + 1
    word = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    after = np.flatnonzero(_SENTENCE_END[data[:-1]] & blank[1:]) + 2
    return [paragraph, after, newline + 1, word]


def _nearest(at: np.ndarray, target: int, low: int, high: int) -> int | None:
    k = int(np.searchsorted(at, target))
    best = None
    for j in (k - 1, k):
        if 0 <= j < len(at) and low <= at[j] <= high and (best is None or abs(at[j] - target) < abs(best - target)):
            best = int(at[j])
    return best


def split(data: np.ndarray, rule: PieceRule) -> list[tuple[int, int]]:
    """(start, end) byte offsets of the pieces of a UTF-8 text without outer white space."""
    n = len(data)
    if n <= rule.limit:
        return [(0, n)] if n else []
    h, kinds, first = rolling_hash(data), _boundaries(data), starts_character(data)
    marks = np.flatnonzero(h < np.uint32((1 << 32) // rule.average)) + 1
    pieces, start, done = [], 0, 0  # done: end of the piece before
    while n - start > rule.limit:
        low, high = done + rule.least, start + rule.limit
        k = int(np.searchsorted(marks, low))
        mark = int(marks[k]) if k < len(marks) and marks[k] <= high else low + int(np.argmin(h[low - 1 : high]))
        end = None
        for at, reach in zip(kinds, rule.reach, strict=True):
            end = _nearest(at, mark, max(low, mark - reach), min(high, mark + reach))
            if end:
                break
        for at in kinds if not end else ():
            end = _nearest(at, mark, low, high)
            if end:
                break
        if not end:
            end = min(mark, high)
            while not first[end]:
                end -= 1
        pieces.append((start, end))
        # the overlap begins at a sentence, else at a word, else at a character
        begin = end
        if rule.overlap:
            for at in (kinds[1], kinds[3]):
                k = int(np.searchsorted(at, end - rule.overlap))
                if k < len(at) and at[k] < end and at[k] > start:
                    begin = int(at[k])
                    break
            else:
                begin = max(start + 1, end - rule.overlap)
                while not first[begin]:
                    begin += 1
        start, done = min(begin, end), end
    pieces.append((start, n))
    return pieces


def pieces(texts: DataFrame, key: str, text: str, rule: PieceRule | None = None, with_text: bool = True) -> DataFrame:
    """(key, piece_no, n_pieces, start_byte, end_byte[, piece]): pieces of each text, offsets in the text's UTF-8 bytes."""
    rule = rule or PieceRule()
    schema = f"`{key}` string, piece_no int, n_pieces int, start_byte long, end_byte long" + (", piece string" if with_text else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                inner = t.strip() if t else ""
                if not inner:
                    continue
                shift = len(t[: len(t) - len(t.lstrip())].encode())
                raw = inner.encode()
                spans = split(np.frombuffer(raw, np.uint8), rule)
                for no, (a, b) in enumerate(spans):
                    for column, value in zip(rows, (k, no, len(spans), a + shift, b + shift), strict=False):
                        column.append(value)
                    if with_text:
                        rows[5].append(raw[a:b].decode())
            types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            names = [key, "piece_no", "n_pieces", "start_byte", "end_byte", "piece"]
            width = 6 if with_text else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows[:width], types[:width], strict=True)], names[:width])

    return texts.select(texts[key].cast("string"), text).where(texts[text].isNotNull()).mapInArrow(cut, schema)
