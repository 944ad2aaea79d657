"""Splitting oversized items at natural boundaries.

Content-defined chunking: a rolling hash over a window of characters gives landmarks; a cut snaps from its landmark to the
nearest natural boundary between a minimum and a maximum size, so an edit alters only neighbouring pieces. Boundaries are
sentence ends, else clause ends, else white space, else any character.

Cases: null gives no piece; a text within the limit is one piece; a text of one endless word is cut at characters; repeated
rows give repeated results.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa

from vellumine.llm.sentences import sentence_starts

LIMIT, OVERLAP_LEAST, OVERLAP_MOST = 1900, 100, 200
LEVELS = ("sentence", "clause", "space", "char")
_CLAUSE = re.compile(r"(?:(?<!\d)[,:]|[,:](?!\d)|[;，；：、､؛،﹐﹑﹔﹕·;])[\"”’»)\]』」]*\s*")
_SPACE = re.compile(r"\s+")
_WINDOW, _BASE, _MOD = 32, 257, (1 << 61) - 1


def boundaries(text: str) -> list[list[int]]:
    """Offsets behind which a piece may begin, for sentences, clauses and spaces; each level holds those before it."""
    sent = sentence_starts(text)
    clause = sorted({*sent, *(m.end() for m in _CLAUSE.finditer(text))} - {0, len(text)})
    space = sorted({*clause, *(m.end() for m in _SPACE.finditer(text))} - {0, len(text)})
    return [sent, clause, space]


def _longest(text: str, cuts: list[int]) -> int:
    ends = [0, *cuts, len(text)]
    return max(len(text[a:b].strip()) for a, b in zip(ends, ends[1:]))


def cut_level(text: str, limit: int = LIMIT, levels: list[list[int]] | None = None) -> str:
    """The best kind of boundary at which every stretch of the text keeps within the limit."""
    for name, cuts in zip(LEVELS, boundaries(text) if levels is None else levels):
        if _longest(text, cuts) <= limit:
            return name
    return "char"


def _landmark(text: str, lo: int, hi: int) -> int:
    """The offset between lo and hi whose window of characters before it has the least rolling hash."""
    top = pow(_BASE, _WINDOW, _MOD)
    h, best, at = 0, None, hi
    for i in range(max(0, lo - _WINDOW), hi):
        h = (h * _BASE + ord(text[i])) % _MOD
        if i >= lo - _WINDOW + _WINDOW and i >= _WINDOW:
            h = (h - ord(text[i - _WINDOW]) * top) % _MOD
        if i + 1 >= lo:
            x = h * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
            if best is None or x < best:
                best, at = x, i + 1
    return at


def split_oversized(text: str | None, limit: int = LIMIT, least: int = OVERLAP_LEAST, most: int = OVERLAP_MOST, levels: list[list[int]] | None = None) -> list[tuple[int, int, str]]:
    """(begin, end, cut_at) of the pieces in order; each after the first begins least to most characters before its cut."""
    if text is None:
        return []
    n = len(text)
    if n <= limit:
        return [(0, n, "whole")]
    levels = levels or boundaries(text)
    pieces: list[tuple[int, int, str]] = []
    pos = begin = 0
    while n - begin > limit:
        room = begin + limit
        floor = pos + 1 if pieces else min(pos + max(most + 1, limit // 3), room)
        cut, kind = room, "char"
        for name, cuts in zip(LEVELS, levels):
            lo = bisect_left(cuts, max(pos + limit // 2, floor, begin + most))
            hi = bisect_right(cuts, room)
            if lo < hi:
                inside = cuts[lo:hi]
                mark = _landmark(text, inside[0], inside[-1])
                cut, kind = min(inside, key=lambda x: (abs(x - mark), x)), name
                break
            lo = bisect_left(cuts, max(floor, begin + most))
            if lo < hi:
                cut, kind = cuts[hi - 1], name
                break
        pieces.append((begin, cut, kind))
        pos = cut
        # The overlap begins at a word where there is one.
        spaces = levels[2]
        lo, hi = bisect_left(spaces, cut - most), bisect_right(spaces, cut - least)
        inside = spaces[lo:hi]
        begin = min(inside, key=lambda x: (abs(x - (cut - (least + most) // 2)), x)) if inside else cut - (least + most) // 2
    pieces.append((begin, n, "end"))
    return pieces


def fallen_level(text: str, limit: int = LIMIT) -> str:
    """The best kind of boundary that suffices, from the level the chunker had to fall to.

    A piece and its overlap keep within the limit together, so no stretch of the fallen level exceeds it; only the overlap can
    have made the chunker fall further than the text itself requires. The exact check therefore tries better levels alone.
    """
    levels = boundaries(text)
    fallen = max((LEVELS.index(kind) for _, _, kind in split_oversized(text, limit, levels=levels)[:-1]), default=0)
    better = cut_level(text, limit, levels[:fallen])
    return better if better != "char" else LEVELS[fallen]


def level_batches(keys: list[str], text_column: str = "text", limit: int = LIMIT):
    """A mapInArrow function giving (keys..., cut_at) of every text beyond the limit, by chunking it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_column).to_pylist()
            over = [i for i, t in enumerate(texts) if t is not None and len(t) > limit]
            idx = pa.array(over, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(k).take(idx) for k in keys] + [pa.array([fallen_level(texts[i], limit) for i in over], pa.string())], names=[*keys, "cut_at"])

    return run


def piece_batches(keys: list[str], text_column: str = "text", limit: int = LIMIT):
    """A mapInArrow function giving (keys..., piece INT, begin INT, cut_at STRING, piece_text STRING) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take: list[int] = []
            rows: list[tuple[int, int, str, str]] = []
            for i, t in enumerate(batch.column(text_column).to_pylist()):
                for k, (a, b, kind) in enumerate(split_oversized(t, limit)):
                    take.append(i)
                    rows.append((k, a, kind, t[a:b]))
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string()]
            idx = pa.array(take, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(k).take(idx) for k in keys] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=[*keys, "piece", "begin", "cut_at", "piece_text"])

    return run
