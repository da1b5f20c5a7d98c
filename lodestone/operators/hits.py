"""Shaping of hits: merging adjacent code ranges and query-aware snippets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.stem import STOP_WORDS, analyze, stem

#: Lines that a merged range may span; fragments, words of a fragment, characters looked at, divider and marks of a snippet.
MAX_SPAN = 120
FRAGMENTS, LEAST_WORDS, MOST_WORDS, LOOKED_AT, DIVIDER, MARK = 2, 8, 20, 50_000, " … ", "**"


def merge_ranges(ranges: list[tuple[int, int]], most: int = MAX_SPAN) -> list[tuple[int, int, int, int]]:
    """(leader, start, end, count) of ranges of one file in rank order, by leader.

    Each range joins the first survivor that it touches or overlaps within the span; a survivor that grew takes in, from
    the first on, every other one that it now may, until there is none.
    """
    left: list[list[int]] = []

    def fits(a: list[int], b: list[int]) -> bool:
        return a[1] <= b[2] + 1 and b[1] <= a[2] + 1 and max(a[2], b[2]) - min(a[1], b[1]) + 1 <= most

    def take(a: list[int], b: list[int]) -> None:
        a[1], a[2], a[3] = min(a[1], b[1]), max(a[2], b[2]), a[3] + b[3]

    for i, (s, e) in enumerate(ranges):
        new = [i, s, e, 1]
        host = next((x for x in left if fits(x, new)), None)
        if host is None:
            left.append(new)
            continue
        take(host, new)
        while (other := next((x for x in left if x is not host and fits(host, x)), None)) is not None:
            take(host, other)
            left.remove(other)
    return sorted(tuple(x) for x in left)


def merge_adjacent(hits: DataFrame, keys: list[str], rank_col: str, start_col: str, end_col: str, most: int = MAX_SPAN) -> DataFrame:
    """(keys, rank, start_line, end_line, merged): hits of a result list merged per file; a list is short, so a file's hits are one group."""
    schema = ", ".join(f"`{k}` {hits.schema[k].dataType.simpleString()}" for k in keys) + ", rank long, start_line int, end_line int, merged int"

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(rank_col, kind="stable")
        got = merge_ranges(list(zip(g[start_col].astype(int), g[end_col].astype(int))), most)
        ranks = g[rank_col].tolist()
        return pd.DataFrame([(*key, ranks[i], s, e, n) for i, s, e, n in got], columns=[*keys, "rank", "start_line", "end_line", "merged"])

    return hits.select(*keys, rank_col, start_col, end_col).dropna(subset=[rank_col, start_col, end_col]).groupBy(*keys).applyInPandas(run, schema)


def fragments(query: str, text: str) -> str | None:
    """Up to two windows of the text around words of the query, those marked; None if no word of the query occurs."""
    terms = {t for t, _ in analyze(query)}
    spans = [(m.start(), m.end()) for m in re.finditer(r"\S+", text[:LOOKED_AT])]
    hit = []
    for s, e in spans:
        words = [w for w in re.findall(r"[a-z0-9]+", text[s:e].lower()) if w not in STOP_WORDS]
        hit.append(any(stem(w) in terms for w in words))
    at = [i for i, h in enumerate(hit) if h]
    if not at:
        return None
    out, reach, n = [], -1, len(spans)
    for i in sorted(at, key=lambda i: (-sum(hit[i : i + MOST_WORDS]), i)):
        last = max((j for j in at if i <= j < i + MOST_WORDS), default=i)
        lo, hi = i, last + 1
        while hi - lo < LEAST_WORDS and (hi < n or lo > 0):
            hi, lo = (hi + 1, lo) if hi < n else (hi, lo - 1)
        if all(hi <= a or lo >= b for a, b in out):
            out.append((lo, hi))
        if len(out) == FRAGMENTS:
            break
    show = lambda k: f"{MARK}{text[spans[k][0]:spans[k][1]]}{MARK}" if hit[k] else text[spans[k][0] : spans[k][1]]
    return DIVIDER.join(" ".join(show(k) for k in range(a, b)) for a, b in sorted(out))


def query_snippets(hits: DataFrame, id_col: str, text_col: str, query_col: str) -> DataFrame:
    """(id, query, snippet): fragments around the words of the row's query, else the first 180 characters; a row that fails keeps those."""
    kind = hits.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for q, t in zip(b[query_col], b[text_col]):
                t = t or ""
                try:
                    s = fragments(q or "", t)
                except Exception:
                    s = None
                got.append(s if s is not None else re.sub(r"\s+", " ", t)[:180])
            yield pd.DataFrame({id_col: b[id_col], "query": b[query_col], "snippet": got})

    return hits.select(id_col, text_col, query_col).mapInPandas(run, f"`{id_col}` {kind}, query string, snippet string")
