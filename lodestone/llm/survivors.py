"""One surviving record for each group of duplicates (problem 7)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Trust:
    """Weights of a vote: trust[source] (default for others and null) times 0.5 ** (age in days / half_life_days)."""

    source: str | None
    trust: dict[str, float]
    default: float
    recency: str
    now: str
    half_life_days: float = 180.0

    def weight(self) -> Column:
        base: Column = F.lit(float(self.default))
        if self.source:
            for name, w in self.trust.items():
                base = F.when(F.col(self.source) == name, F.lit(float(w))).otherwise(base)
        age = F.greatest((F.unix_micros(F.lit(self.now).cast("timestamp")) - F.unix_micros(self.recency)) / 86_400e6, F.lit(0.0))
        return base * F.coalesce(F.pow(F.lit(0.5), age / self.half_life_days), F.lit(1e-6))


def _vote_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def _is_time(rows: DataFrame, f: str) -> bool:
    return rows.schema[f].dataType.simpleString().startswith("timestamp")


def _spelled(rows: DataFrame, f: str) -> Column:
    """A value as a string that names it whatever the session's time zone: times by their microseconds."""
    return (F.unix_micros(f) if _is_time(rows, f) else F.col(f)).cast("string")


def field_votes(rows: DataFrame, group: str, voted: list[str], best: list[str], trust: Trust) -> DataFrame:
    """(group, field, key, value, votes): the candidates of each field, one row per group, field and normalised value.

    Fields in `voted` gather weighted votes per value, normalised by case and white space; the value shown is the least
    spelling. Fields in `best` are ordered by the value itself: votes hold it as a number. Null values don't vote. Sums
    of votes are kept to nine places, so that they don't depend on the order of the rows.
    """
    weight = trust.weight()
    parts = [F.struct(F.lit(f).alias("field"), _vote_key(_spelled(rows, f)).alias("key"), _spelled(rows, f).alias("value"), weight.alias("w"), F.lit(False).alias("top")) for f in voted]
    for f in best:
        number = (F.unix_micros(f) if _is_time(rows, f) else F.col(f)).cast("double")
        parts.append(F.struct(F.lit(f).alias("field"), _spelled(rows, f).alias("key"), _spelled(rows, f).alias("value"), number.alias("w"), F.lit(True).alias("top")))
    long = rows.select(group, F.explode(F.array(*parts)).alias("x")).select(group, "x.*").where("value is not null")
    return long.groupBy(group, "field", "key").agg(F.min("value").alias("value"), F.when(F.first("top"), F.max("w")).otherwise(F.round(F.sum("w"), 9)).alias("votes"))


def survivors(rows: DataFrame, group: str, voted: list[str], best: list[str], trust: Trust) -> DataFrame:
    """One built record per group: each field's winner by `field_votes`, of its own type, ties by the least value, and the number of rows.

    A field that is null in all rows of a group stays null. Rows whose group is null are ignored. All steps aggregate
    with partial sums, so a group may hold any share of the rows. Columns not named are left out.
    """
    rows = rows.where(F.col(group).isNotNull())
    won = field_votes(rows, group, voted, best, trust).groupBy(group, "field").agg(F.min_by("value", F.struct(-F.col("votes"), "key")).alias("value"))
    names = [*best, *voted]
    wide = won.groupBy(group).pivot("field", names).agg(F.first("value"))
    back = [(F.timestamp_micros(F.col(f).cast("long")) if _is_time(rows, f) else F.col(f)).cast(rows.schema[f].dataType).alias(f) for f in names]
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows")).join(wide.select(group, *back), group, "left")


def undisputed(rows: DataFrame, group: str, id_col: str, best: list[str], trust: Trust, least_rows: int = 2) -> DataFrame:
    """(id_col): rows that hold the winning value of every field in `best`, of groups of at least `least_rows` rows.

    Null is worse than any value and equal to null: a field that is null in all rows is held by all. Where several rows
    of a group are equal in all these fields, each comes out.
    """
    keep = rows.select(group, id_col, *dict.fromkeys([*best, trust.recency, *([trust.source] if trust.source else [])]))
    won = survivors(keep, group, [], best, trust).where(F.col("n_rows") >= least_rows).select(group, *[F.col(f).alias(f"_won_{f}") for f in best])
    cond = F.lit(True)
    for f in best:
        cond = cond & F.col(f).eqNullSafe(F.col(f"_won_{f}"))
    return keep.join(won, group).where(cond).select(id_col)
