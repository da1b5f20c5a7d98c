"""Text and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths of the snippets and of the documents given to a reranker.
SNIPPET_CHARS, CODE_SNIPPET_LINES, CODE_SNIPPET_CHARS, MEMORY_DOC_CHARS, CODE_DOC_CHARS = 180, 4, 240, 1200, 1500
#: Fixed value: what a line must hold to name a symbol.
SYMBOL = r"\b(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class|interface|type|enum|const|def|struct|impl|fn|func|module)\s+([A-Za-z0-9_$]+)"


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def snippet(content: Column) -> Column:
    return F.substring(F.regexp_replace(content, r"\s+", " "), 1, SNIPPET_CHARS)


def code_snippet(content: Column) -> Column:
    return F.substring(F.array_join(F.slice(F.split(content, "\n"), 1, CODE_SNIPPET_LINES), "\n"), 1, CODE_SNIPPET_CHARS)


def memory_doc(title: Column, summary: Column, content: Column) -> Column:
    return F.substring(F.concat_ws("\n", title, F.nullif(summary, F.lit("")), content), 1, MEMORY_DOC_CHARS)


def code_doc(path: Column, content: Column) -> Column:
    return F.substring(F.concat_ws("\n", path, content), 1, CODE_DOC_CHARS)


def budget_body(content: Column, most: int) -> Column:
    """struct(content, truncated, total_chars) of a body cut to `most` characters; 0 or less is no limit."""
    cut = F.length(content) > most if most > 0 else F.lit(False)
    return F.struct(F.when(cut, F.substring(content, 1, max(most, 0))).otherwise(content).alias("content"), F.coalesce(cut, F.lit(False)).alias("truncated"), F.when(cut, F.length(content)).alias("total_chars"))


def line_range(content: Column, first: int = 1, last: int | None = None, window: int = 400, most: int = 90_000) -> Column:
    """The lines first to last (1-based; by default a window of 400), each with its number, cut to `most` characters."""
    end = last if last is not None else first + window - 1
    lines = F.split(content, "\n")
    part = F.slice(lines, max(first, 1), max(end - max(first, 1) + 1, 0))
    numbered = F.transform(part, lambda x, i: F.concat((i + F.lit(max(first, 1))).cast("string"), F.lit("\t"), x))
    return F.substring(F.array_join(numbered, "\n"), 1, most)


def symbol(text: Column) -> Column:
    """struct(name, kind) of the first line that declares one, or null fields."""
    return F.struct(F.nullif(F.regexp_extract(text, SYMBOL, 2), F.lit("")).alias("name"), F.nullif(F.regexp_extract(text, SYMBOL, 1), F.lit("")).alias("kind"))


def effective_date(event_date: Column, created_at: Column) -> Column:
    return F.coalesce(event_date, created_at)


def json_strings(doc: Column, path: str) -> Column:
    """The array of strings at a JSON path, null where it is missing or no array."""
    return F.from_json(F.get_json_object(doc, path), "array<string>")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null for null or all-zero ones."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)
