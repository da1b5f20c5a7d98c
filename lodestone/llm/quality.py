"""Per-document text quality statistics and the split of running prose from lists, tables and junk (problem 10)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What may stand before a sentence: quotes, bullets, numbers, check boxes, comment signs, times, levels, speakers.
PREFIX = re.compile(r"^(?:\s+|[>|#*+•·–—/;%-]+(?=\s|$)|\(?\d{1,3}[.)](?=\s)|\(?[a-z][.)](?=\s)|\[[ xX]?\]|\[[\d:. TZ-]+\]|\d{4}-\d\d-\d\d[T ]?[\d:.,]*Z?|\d\d:\d\d(?::\d\d)?[.,\d]*|(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b:?|(?:\w{2,12}):(?=\s)|<[^<>\n]{1,80}>)+")
LIST_MARK = re.compile(r"^\s*(?:[-*+•·–]\s|\(?\d{1,3}[.)]\s|\(?[a-z][.)]\s|\[[ xX]?\]\s)")
#: A word: what stands between white space, quotes, brackets and marks, without signs at its ends.
WORD = re.compile(r"[^\s'’\"“”()\[\]{}<>|,;:!?.\-_*#=/\\`~](?:[^\s'’\"“”()\[\]{}<>|,;:!?]*[^\s'’\"“”()\[\]{}<>|,;:!?.\-_*#=/\\`~])?")
SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()-]")
TERMINAL = tuple(".!?…:\"')”’")
#: Signs of code and records; a line with two of them, or with one at its end, is no sentence.
CODE = re.compile(r"[{};=$|<>\\\t]")
#: The head of a block of code, and what starts a comment behind code in a line.
BLOCK_HEAD = re.compile(r"(?:if|elif|else|for|while|with|def|class|try|except|switch|case|func|fn)\b.*(?:[:{]|;\s*(?:do|then))$")
COMMENTS = (" // ", "; -- ", " # ")
CAPITALS = re.compile("[A-ZÀ-Þ]{2}")
PARAGRAPH = re.compile(r"\n\s*\n")
#: A line reads as sentence text if it has at least this many words, of which so many distinct common ones and this share of them are common words of the document's language.
LEAST_WORDS, LEAST_COMMON, COMMON_SHARE = 4, 2, 0.18
#: A document is prose if at least this share of its characters is in such lines, repetitions not counted,
PROSE_SHARE = 0.5
#: and none of its repetitions dominates it: shares of the characters in lines and in paragraphs that occurred before, and in the most frequent n-gram,
MOST_REPEATED_LINES, MOST_REPEATED_PARAGRAPHS, MOST_NGRAM = 0.3, 0.3, 0.35
#: and it is no list with few common words: share of list lines from which, and of common words up to which it is one.
LIST_LINES, LIST_COMMON = 0.5, 0.2
NGRAM = 3
#: Words of a run that counts as filler where it stood before in the sentences of the document.
RUN = 6

FIELDS = [("n_chars", "long"), ("n_words", "long"), ("mean_word_length", "double"), ("symbol_ratio", "double"), ("terminal_line_share", "double"), ("common_word_share", "double"), ("list_line_share", "double"), ("duplicate_line_share", "double"), ("duplicate_paragraph_share", "double"), ("ngram_coverage", "double"), ("prose_share", "double"), ("language", "string"), ("is_prose", "boolean")]


def _repeated(units: list[str]) -> float:
    """Share of the characters that are in units which occurred before."""
    total = sum(map(len, units))
    return 1 - sum(map(len, set(units))) / total if total else 0.0


def _fresh(ws: list[str], before: list[str], runs: set[tuple[str, ...]]) -> float:
    """Share of the characters of the words ws, which follow those of `before`, outside runs of RUN words that are in `runs`; adds the runs that end in ws."""
    all_ws = before + ws
    new = list(zip(*(all_ws[i:] for i in range(RUN))))
    distinct = set(new)
    if len(distinct) == len(new) and runs.isdisjoint(distinct):
        runs |= distinct
        return 1.0
    at, old, until = len(before), [False] * len(all_ws), 0
    for start, run in enumerate(new):
        if run in runs:
            end = start + RUN
            until = max(until, start)
            old[until:end] = [True] * (end - until)
            until = end
        else:
            runs.add(run)
    total = sum(map(len, ws))
    return 1 - sum(len(w) for w, o in zip(ws, old[at:]) if o) / total if total else 1.0


def _without_filler(sentences: list[tuple[int, int, list[str]]]) -> float:
    """Characters of the sentence lines of a document, but for runs of words that stood before in it, across lines and whether or not they end in marks."""
    whole = [w for _, _, ws in sentences for w in ws]
    if len(whole) < RUN or len(set(zip(*(whole[i:] for i in range(RUN))))) == len(whole) - RUN + 1:
        return sum(n + p for n, p, _ in sentences)
    runs: set[tuple[str, ...]] = set()
    last: list[str] = []
    out = 0.0
    for n, p, ws in sentences:
        out += n * _fresh(ws, last, runs) + p
        last = (last + ws)[1 - RUN :]
    return out


def is_prose(share: float, common: float, listed: float, lines: float, paragraphs: float, ngram: float) -> bool:
    """The combined rule: mostly sentences, not dominated by repetition of lines, paragraphs or one n-gram, and no bare list."""
    repeated = lines >= MOST_REPEATED_LINES or paragraphs >= MOST_REPEATED_PARAGRAPHS or ngram >= MOST_NGRAM
    bare_list = listed >= LIST_LINES and common <= LIST_COMMON
    return share >= PROSE_SHARE and not repeated and not bare_list


def statistics(text: str, common: dict[str, frozenset[str]]) -> tuple:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    # each line is cut into words once: (line, body, prefix, what follows it, the words of that in lower case)
    parts, bare = [], []
    for line in lines:
        body = line.strip()
        m = PREFIX.match(body)
        core = body[m.end() :] if m else body
        if m:
            bare += WORD.findall(m.group().lower())
        low = WORD.findall(core.lower())
        bare += low
        parts.append((line, body, m, core, low))
    every = [w for w in bare if w in common.get(None, ())]
    hits = {lang: sum(map(ws.__contains__, every)) for lang, ws in common.items() if lang is not None} if every else {}
    lang = max(sorted(hits), key=hits.__getitem__, default=None) if any(hits.values()) else None
    known = common.get(lang, frozenset()) if lang else frozenset()
    n = len(bare)
    chars = listed = ended = 0
    sentences: list[tuple[int, int, list[str]]] = []  # characters, those of the prefix, words
    before = False
    for line, body, m, core, low in parts:
        marked = LIST_MARK.match(line) is not None
        listed += marked
        ended += body.endswith(TERMINAL)
        if not core:
            chars += len(body)
            before = False
            continue
        if body[0] == "#" and len(body) < 120 and not marked:  # a heading
            before = False
            continue
        chars += len(body)
        good = False
        if core[-1] not in ";{}" and len(low) >= LEAST_WORDS:
            found = [x for x in low if x in known]
            if CAPITALS.search(core) and not core.isupper():  # words in capitals among others are keywords
                found = [x for w in WORD.findall(core) if (x := w.lower()) in known and (len(w) < 2 or not w.isupper())]
            good = len(found) >= COMMON_SHARE * len(low) and len(set(found)) >= LEAST_COMMON and len(CODE.findall(core)) < 2 and not BLOCK_HEAD.match(core) and not any(c in core for c in COMMENTS)
        # the end of a sentence that was wrapped, or a short one among others, goes with the line before
        if not good and before and not marked and m is None and 0 < len(low) < 8 and core[:1].islower() and body.endswith((".", "?", "!")):
            good = True
            before = False
        else:
            before = good and not body.endswith((".", "?", "!"))
        if good:
            sentences.append((len(core) + 1, m.end() if m else 0, low))
    prose = _without_filler(sentences)
    letters = sum(map(len, bare))
    three = list(zip(*(bare[i:] for i in range(NGRAM))))
    top = 0.0
    if len(set(three)) < len(three):
        grams = Counter(three)
        k = max(grams.values())
        top = k * max(sum(map(len, g)) for g, c in grams.items() if c == k) / max(1, letters)
    share = min(1.0, prose / chars) if chars else 0.0
    words = hits[lang] / n if n and lang else 0.0
    list_share = listed / len(lines) if lines else 0.0
    repeated = _repeated(lines), _repeated([p for p in PARAGRAPH.split(text) if p.strip()]), min(top, 1.0)
    return (
        len(text), n, letters / n if n else 0.0, len(SYMBOL.findall(text)) / len(text) if text else 0.0, ended / len(lines) if lines else 0.0,
        words, list_share, *repeated, share, lang, is_prose(share, words, list_share, *repeated) if lines else None,
    )


def word_lists(by_lang: dict[str, set[str]]) -> dict[str | None, frozenset[str]]:
    """The common words of each language, and under None those of all."""
    return {k: frozenset(v) for k, v in by_lang.items()} | {None: frozenset().union(*by_lang.values())}


def text_quality(df: DataFrame, id_col: str, text_col: str, common_words: DataFrame) -> DataFrame:
    """(id, the statistics of FIELDS) of every document.

    common_words (lang, word) is a fixed list of some hundred words; a document's language is the one with the most
    hits. A line is sentence text by its share of common words, whatever stands before it or how it is wrapped; sentences
    and runs of RUN words that occurred before in the document, list entries, table rows, records, code, log lines and random words are not.
    The decision combines the share of sentence text with the repetitions and the list lines (`is_prose`).
    is_prose is null where there is no text (null, empty, white space), whose statistics are 0.
    """
    by_lang: dict[str, set[str]] = {}
    for r in common_words.where("lang is not null and word is not null").select("lang", F.lower("word").alias("word")).collect():  # a fixed list
        by_lang.setdefault(r["lang"], set()).add(r["word"])
    common = word_lists(by_lang)
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t or "", common) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows)) if rows else [[] for _ in FIELDS]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, kinds[k]) for c, (_, k) in zip(cols, FIELDS))], [id_col, *(f for f, _ in FIELDS)])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{f} {k}" for f, k in FIELDS))
