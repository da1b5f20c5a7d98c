"""Predicates that the read paths share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import effective_date, json_strings


def live() -> Column:
    """Not archived, and active or without a status."""
    return F.col("archived_at").isNull() & (F.coalesce("status", F.lit("active")) == "active")


def by_status(status: str | None) -> Column:
    """None: active; 'all': any; else that status."""
    if status == "all":
        return F.lit(True)
    return F.coalesce("status", F.lit("active")) == (status or "active")


def any_tag(tags: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(json_strings(F.col("metadata"), "$.tags"), F.array(*map(F.lit, tags))), F.lit(False))


def has_tag(tag: str) -> Column:
    return F.coalesce(F.array_contains(json_strings(F.col("metadata"), "$.tags"), tag), F.lit(False))


def after(ts: str) -> Column:
    return effective_date(F.col("event_date"), F.col("created_at")) >= F.lit(ts).cast("timestamp")


def in_path(part: str) -> Column:
    """A literal substring of the path: pattern characters have no meaning in it."""
    return F.col("file_path").contains(part)


def with_extension(ext: str) -> Column:
    return F.col("file_path").endswith("." + ext.lstrip("."))


def members(df: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """Rows whose col is among the first column of ids."""
    return df.join(ids.toDF(col).distinct(), col, "left_semi")


def relaxed(df: DataFrame, strict: Column, optional: Column) -> tuple[DataFrame, bool]:
    """(rows that meet both conditions, False), or if there are none (rows that meet the strict one, True)."""
    hit = df.where(strict & optional)
    if hit.isEmpty():
        return df.where(strict), True
    return hit, False
