"""Splitting oversized items at natural boundaries (problem 1)."""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE_END = re.compile(r"\r\n|\n|\r")
DECLARATION = re.compile(r"(?:export |public |private |protected |static |async |abstract |pub |default )*(?:def|class|function|func|fn|interface|struct|enum|impl|trait|type|module|package|namespace|const|let|var|create|#{1,6}|@\w+)(?!\w)", re.I)
SENTENCE = re.compile(r"[.!?;:,}\])]\s+")
SPACE = re.compile(r"\s+")
#: Strength of a place to cut at, from the strongest: before an outermost declaration, before an inner one, after a blank line, at a line end, after punctuation, at white space.
OUTER, INNER, PARAGRAPH, LINE, MARK, BLANK = 6, 5, 4, 3, 2, 1
#: Pieces beyond the least number that are tried for places at line ends.
WEAK_TRIES = 2


def boundaries(text: str) -> tuple[list[int], list[int], list[int]]:
    """(places, strengths, line starts) at which a text may be cut at a line, in order."""
    places, strengths, starts, blank, at = [], [], [0], False, 0
    for m in LINE_END.finditer(text):
        starts.append(m.end())
    for i, s in enumerate(starts):
        line = text[s : starts[i + 1] if i + 1 < len(starts) else len(text)]
        body = line.strip()
        if s:
            indent = len(line) - len(line.lstrip())
            if body and DECLARATION.match(body):
                strength = OUTER if indent == 0 else INNER
            else:
                strength = PARAGRAPH if blank and body else LINE
            places.append(s)
            strengths.append(strength)
        blank = not body
    return places, strengths, starts


def _inline(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Places within a line, for text that has no line end where one is needed."""
    got = [(m.end(), BLANK) for m in SPACE.finditer(text, lo, hi)]
    marks = {m.end() for m in SENTENCE.finditer(text, lo, hi)}
    return [(p, MARK if p in marks else s) for p, s in got if lo < p <= hi]


def _safe(text: str, p: int) -> int:
    """p, moved back so as not to part a line end of two characters or a letter from the marks that combine with it."""
    import unicodedata

    q = p
    while q > 1 and (text[q - 1 : q + 1] == "\r\n" or q < len(text) and (unicodedata.combining(text[q]) or text[q] in "‍️" or text[q - 1] == "‍")) and p - q < 64:
        q -= 1
    return q if p - q < 64 else p


def _start(text: str, p: int) -> int:
    """p, moved on so as not to start within a line end of two characters or on marks that combine with the letter before."""
    import unicodedata

    q = p
    while 0 < q < len(text) and q - p < 64 and (text[q - 1 : q + 1] == "\r\n" or unicodedata.combining(text[q]) or text[q] in "\u200d\ufe0f" or text[q - 1] == "\u200d"):
        q += 1
    return q


def cuts(text: str, limit: int, overlap: int) -> list[int]:
    """Where to cut, so that each piece with the `overlap` characters before it has at most `limit` characters.

    Starts from the least possible number of pieces at equal lengths; each target moves to the strongest boundary near
    it, ties to the nearest. Pieces are added while any is over the limit, and up to WEAK_TRIES more while a target finds
    no line end; of the numbers tried the one with the fewest weak places counts.
    """
    size, room = len(text), limit - overlap
    if size <= limit:
        return []
    places, strengths, _ = boundaries(text)
    least = math.ceil((size - overlap) / room)
    best: list[int] | None = None
    best_weak = None
    n = least
    while best is None or best_weak and n <= least + WEAK_TRIES:
        if n > size:  # no number of pieces fits
            break
        got, weak, prev = [], 0, 0
        for i in range(1, n):
            target = prev + (size - prev) / (n - i + 1)
            reach = max(0.35 * size / n, 1)
            lo = max(prev + 1, math.ceil(size - (n - i) * room), math.ceil(target - reach))
            hi = min(prev + room + (overlap if prev == 0 else 0), size - 1, math.floor(target + reach))
            lo = min(lo, hi)
            a, b = bisect.bisect_left(places, lo), bisect.bisect_right(places, hi)
            near = [(strengths[k], -abs(places[k] - target), places[k]) for k in range(a, b)]
            if not near:
                weak += 1
                near = [(s, -abs(p - target), p) for p, s in _inline(text, lo, hi)]
            if near:
                cut = max(near)[2]
            else:
                cut = _safe(text, min(max(round(target), lo), hi))
                cut = cut if cut > prev else hi
            got.append(cut)
            prev = cut
        n += 1
        if size - prev + (overlap if prev else 0) > limit:  # the last piece is too long at this number
            continue
        if best is None or weak < best_weak:
            best, best_weak = got, weak
    if best is None:  # a limit so small that letters and their marks don't fit: cut at the limit
        best, prev = [], 0
        while size - prev + (overlap if prev else 0) > limit:
            cut = _safe(text, prev + (room if prev else limit))
            prev = cut if cut > prev else prev + room
            best.append(prev)
    return best


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
    """(start, end, overlap, first line, last line) of each piece, lines counted from 0. The text itself if it is short enough."""
    starts = [0, *(m.end() for m in LINE_END.finditer(text))]
    ends = [*cuts(text, limit, overlap), len(text)]
    out, prev = [], 0
    for e in ends:
        s = min(_start(text, max(0, prev - overlap)), prev) if prev else 0
        out.append((s, e, prev - s, bisect.bisect_right(starts, s) - 1, bisect.bisect_right(starts, max(e - 1, s)) - 1))
        prev = e
    return out


def _splitter(id_col: str, limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text, first in zip(b[id_col], b["_text"], b["_first"]):
                for k, (s, e, o, a, z) in enumerate(pieces(text, limit, overlap), 1):
                    base = 0 if pd.isna(first) else int(first)
                    rows.append((key, k, s, o, base + a, base + z, text[s:e]))
            yield pd.DataFrame(rows, columns=[id_col, "piece", "start_char", "overlap_chars", "start_line", "end_line", "content"])

    return run


def split_oversized(df: DataFrame, id_col: str, text_col: str, start_line_col: str, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """(id, piece, start_char, overlap_chars, start_line, end_line, content) of every row, in pieces of at most `limit` code points.

    A row within the limit comes out as one piece, untouched. Consecutive pieces share `overlap` characters (a few
    less where these would start within a CRLF or a letter with its marks), which the later one repeats at its start; without them the pieces join to the text again. Lines end at CRLF, LF or
    CR; start_line counts from the row's own (0 where that is null), end_line is the line of the last character. Null
    text gives no piece, empty text one empty piece. Only rows over the limit leave the JVM.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("_text"), F.col(start_line_col).alias("_first"))
    schema = f"{id_col} {kind}, piece int, start_char int, overlap_chars int, start_line int, end_line int, content string"
    large = rows.where(F.length("_text") > limit).mapInPandas(_splitter(id_col, limit, overlap), schema)
    breaks = F.length(F.regexp_replace(F.regexp_replace("_text", "\r\n|\r", "\n"), "[^\n]+", "")) - F.when(F.col("_text").rlike("[\r\n]$"), 1).otherwise(0)
    base = F.coalesce(F.col("_first"), F.lit(0)).cast("int")
    zero = F.lit(0)
    small = rows.where(F.length("_text") <= limit).select(id_col, F.lit(1).alias("piece"), zero.alias("start_char"), zero.alias("overlap_chars"), base.alias("start_line"), (base + breaks).cast("int").alias("end_line"), F.col("_text").alias("content"))
    return large.union(small)
