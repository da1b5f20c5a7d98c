"""Results as the text that callers read. Each renderer is a column or a function of rows that a limit has bounded."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def public_hits(hits: DataFrame, hidden: tuple[str, ...] = ("score", "final", "rrf", "pool_rank")) -> DataFrame:
    """hits without their scores: what remains is their order."""
    return hits.drop(*hidden)


def graph_line() -> Column:
    """A row of `graph.graph_rows` as a line, indented by its depth."""
    place = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("[d"), F.col("depth").cast("string"), F.lit(" "), F.col("edge_type"), F.lit("] "))
    doubt = F.when(F.col("ambiguous"), F.lit(" (name-matched, may be ambiguous)")).otherwise(F.lit(""))
    return F.concat(place, F.col("name"), F.lit("  "), F.coalesce("file", F.lit("")), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("")), doubt, F.lit("  ["), F.col("id"), F.lit("]"))


def hit_line() -> Column:
    """A hit (rank, id, type, title, snippet, summary, status, at) as its two lines, and a third one for a summary."""
    odd = F.coalesce(F.col("status"), F.lit("active")) != "active"
    note = F.when(odd, F.concat(F.lit(", status: "), F.col("status"))).otherwise(F.lit(""))
    head = F.concat(F.col("rank").cast("string"), F.lit(". ["), F.coalesce("type", F.lit("")), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("  ("), F.coalesce(F.date_format("at", "yyyy-MM-dd"), F.lit("")), note, F.lit(", id: "), F.col("id"), F.lit(")"))
    more = F.when(F.coalesce(F.length("summary"), F.lit(0)) > 0, F.concat(F.lit("\n   summary: "), F.col("summary"))).otherwise(F.lit(""))
    return F.concat(head, F.lit("\n   "), F.coalesce("snippet", F.lit("")), more)


def hit_text(lines: Iterable[str], requested: int, pool: int, truncated: bool = False, dropped: dict | None = None) -> str:
    """The text of a search: what filters were dropped for it, its hits, and how many candidates there were if it shows a part of them."""
    lines = list(lines)
    out = []
    if lines and dropped:
        named = ", ".join(f"{k}: {v}" for k, v in dropped.items())
        out.append(f"Note: no results matched filters {{{named}}}; showing unfiltered results. Filters are optional — retry with different values to narrow.")
    out.append("\n".join(lines) if lines else "No matching memories.")
    if lines and truncated:
        out.append(f"Showing top {requested} of {pool} candidates. Prefer several small targeted searches over one broad one — optionally narrow with type, tags, or after.")
    return "\n".join(out)


def banner(status: Column, superseded_by: Column) -> Column:
    """The line above a memory that is not active: what it was superseded by, or its status; else empty."""
    gone = (status == "superseded") & superseded_by.isNotNull() & (superseded_by != "")
    other = status.isNotNull() & (status != "") & (status != "active")
    return F.when(gone, F.concat(F.lit("superseded — see "), superseded_by, F.lit("\n"))).when(other, F.concat(F.lit("status="), status, F.lit("\n"))).otherwise(F.lit(""))


def status_line() -> Column:
    """A repository of the index status as a line."""
    return F.concat(F.col("repository_id"), F.lit(": "), F.col("n_files").cast("string"), F.lit("/"), F.col("files_total").cast("string"), F.lit(" files, "), F.col("n_chunks").cast("string"), F.lit(" chunks, last indexed "), F.coalesce(F.date_format("last_indexed", "yyyy-MM-dd HH:mm"), F.lit("never")))
