"""Retrieval evaluation: rank metrics, paired tests, comparisons and gates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equality of metrics, fall of recall that a gate allows, bootstrap draws, their seed and level.
TIE, RECALL_FALL, DRAWS, SEED, LEVEL = 1e-12, 0.05, 10_000, 42, 0.95


def norm_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def metrics(ranked: Column, relevant: Column, k: int) -> Column:
    """struct(recall, rr, ndcg, first_rank) of a ranked array against a set of relevant keys; k bounds recall and ndcg.

    recall is 1 if any of the first k is relevant. Each relevant key gains once, at its first place. Without relevant
    keys, or with k of 0 or less, all are 0 and first_rank is null.
    """
    keys = F.array_distinct(F.transform(F.coalesce(relevant, F.array().cast("array<string>")), norm_key))
    hits = F.transform(F.coalesce(ranked, F.array().cast("array<string>")), norm_key)
    at = F.array_sort(F.filter(F.transform(keys, lambda x: F.array_position(hits, x)), lambda p: p > 0))
    first = F.when(F.size(at) > 0, F.element_at(at, 1)).cast("int")
    if k <= 0:
        return F.struct(F.lit(0.0).alias("recall"), F.coalesce(1.0 / first, F.lit(0.0)).alias("rr"), F.lit(0.0).alias("ndcg"), first.alias("first_rank"))
    gain = lambda a: F.aggregate(a, F.lit(0.0), lambda s, p: s + 1.0 / F.log2(p.cast("double") + 1.0))
    ideal = gain(F.sequence(F.lit(1), F.greatest(F.least(F.size(keys), F.lit(k)), F.lit(1))))
    dcg = gain(F.filter(at, lambda p: p <= k))
    return F.struct(
        F.when(F.coalesce(first <= k, F.lit(False)), 1.0).otherwise(0.0).alias("recall"),
        F.coalesce(1.0 / first, F.lit(0.0)).alias("rr"),
        F.when(F.size(keys) > 0, dcg / ideal).otherwise(0.0).alias("ndcg"),
        first.alias("first_rank"),
    )


def canonical(ranked: list[str], chains: list[tuple[str, list[str]]]) -> list[str]:
    """Ranked ids with each id replaced by the first gold key, not credited yet, whose chain holds it."""
    used: set[str] = set()
    out = []
    for x in ranked:
        gold = next((g for g, c in chains if g not in used and x in c), None)
        if gold is not None:
            used.add(gold)
        out.append(x if gold is None else gold)
    return out


def canonicalize(df: DataFrame, id_col: str, ranked_col: str, chains_col: str) -> DataFrame:
    """(id, ranked): `canonical` of each row; chains is an array of struct(gold, members) in gold order."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [canonical(list(r) if r is not None else [], [(c["gold"], list(c["members"])) for c in (cs if cs is not None else [])]) for r, cs in zip(b[ranked_col], b[chains_col])]
            yield pd.DataFrame({id_col: b[id_col], "ranked": got})

    return df.select(id_col, ranked_col, chains_col).mapInPandas(run, f"`{id_col}` {kind}, ranked array<string>")


def mulberry(seed: int) -> Iterator[float]:
    """The 32-bit generator mulberry32, as numbers in [0, 1). Its constants are fixed values."""
    mask, a = 0xFFFFFFFF, seed & 0xFFFFFFFF
    while True:
        a = (a + 0x6D2B79F5) & mask
        t = ((a ^ a >> 15) * (1 | a)) & mask
        t = ((t + ((t ^ t >> 7) * (61 | t) & mask)) & mask) ^ t
        yield ((t ^ t >> 14) & mask) / 4294967296


def _mulberry_array(seed: int, n: int, first: int = 0) -> np.ndarray:
    """The draws first + 1 to first + n of `mulberry`: its state is a counter, so a block needs none before it."""
    with np.errstate(over="ignore"):
        count = (np.arange(first + 1, first + n + 1, dtype=np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        a = (np.uint32(seed & 0xFFFFFFFF) + count * np.uint32(0x6D2B79F5)).astype(np.uint32)
        t = (a ^ a >> np.uint32(15)) * (np.uint32(1) | a)
        t = (t + (t ^ t >> np.uint32(7)) * (np.uint32(61) | t)) ^ t
        return (t ^ t >> np.uint32(14)).astype(np.float64) / 4294967296


def percentile(ordered: np.ndarray, p: float) -> float:
    at = (len(ordered) - 1) * p
    lo, hi = math.floor(at), math.ceil(at)
    return float(ordered[lo] + (ordered[hi] - ordered[lo]) * (at - lo))


def bootstrap(deltas: list[float], draws: int = DRAWS, seed: int = SEED, level: float = LEVEL) -> tuple[float, float, float]:
    """(mean, low, high) of paired differences by resampling; zeros for none. One value per query of an evaluation set, on the driver, in blocks of bounded memory."""
    d = np.asarray(deltas, float)
    if not len(d):
        return 0.0, 0.0, 0.0
    means = np.empty(draws)
    block = max(1, 2_000_000 // len(d))
    for s in range(0, draws, block):
        n = min(block, draws - s)
        u = _mulberry_array(seed, n * len(d), s * len(d))
        means[s : s + n] = d[np.floor(u * len(d)).astype(np.int64)].reshape(n, len(d)).mean(1)
    means.sort()
    return float(d.mean()), percentile(means, (1 - level) / 2), percentile(means, 1 - (1 - level) / 2)


def bootstrap_counts(spark: SparkSession, counts: list[tuple[float, int]], draws: int = DRAWS, seed: int = SEED, level: float = LEVEL) -> tuple[float, float, float]:
    """`bootstrap` of values given with their counts, in order: the same draws at any number of values, the resamples being shared out among tasks."""
    d, c = np.array([x for x, _ in counts], float), np.array([n for _, n in counts], np.int64)
    total, upto = int(c.sum()), np.cumsum(c)
    if not total:
        return 0.0, 0.0, 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            means = []
            for k in b["id"].tolist():
                got = np.zeros(len(d), np.int64)
                for s in range(0, total, 1 << 20):
                    u = _mulberry_array(seed, min(1 << 20, total - s), k * total + s)
                    got += np.bincount(np.searchsorted(upto, np.floor(u * total).astype(np.int64), "right"), minlength=len(d))
                means.append(float(got @ d / total))
            yield pd.DataFrame({"mean": means})

    means = np.sort(spark.range(draws).mapInPandas(run, "mean double").toPandas()["mean"].to_numpy())  # one number a draw
    return float(d @ c / total), percentile(means, (1 - level) / 2), percentile(means, 1 - (1 - level) / 2)


def normal_cdf(z: Column) -> Column:
    """Phi by the approximation 7.1.26 of Abramowitz and Stegun, whose coefficients are fixed values."""
    x = F.abs(z) / math.sqrt(2)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = 1.0 - poly * F.exp(-x * x)
    return 0.5 * (1.0 + F.signum(z) * erf)


def sign_test(deltas: DataFrame, col: str = "delta") -> DataFrame:
    """One row (wins, losses, ties, z, p): normal approximation with continuity correction; no wins or losses give z 0 and p 1."""
    d = F.col(col)
    c = deltas.agg(F.count(F.when(d > TIE, 1)).alias("wins"), F.count(F.when(d < -TIE, 1)).alias("losses"), F.count(F.when(F.abs(d) <= TIE, 1)).alias("ties"))
    n = F.col("wins") + F.col("losses")
    z = F.when(n > 0, F.greatest(F.lit(0.0), F.abs(F.col("wins") - n / 2) - 0.5) / F.sqrt(F.greatest(n, F.lit(1)) / 4.0)).otherwise(0.0)
    c = c.withColumn("z", z)
    return c.withColumn("p", F.when(F.col("z") == 0, 1.0).otherwise(2.0 * (1.0 - normal_cdf(F.col("z")))))


def deltas(base: DataFrame, fresh: DataFrame, id_col: str, col: str) -> DataFrame:
    """(id, delta) of fresh minus base; raises if a query is in one of them only."""
    both = base.select(id_col, F.col(col).alias("_b"), F.lit(1).alias("_in_b")).join(fresh.select(id_col, F.col(col).alias("_f"), F.lit(1).alias("_in_f")), id_col, "full_outer")
    odd = both.where("_in_b is null or _in_f is null")
    if not odd.isEmpty():
        raise ValueError(f"queries in one run only, such as {odd.first()[id_col]}")
    return both.select(id_col, (F.col("_f") - F.col("_b")).alias("delta"))


def gate(values: list[float], recall_base: float, recall_fresh: float) -> bool:
    """Whether a run may pass: its interval is not wholly below 0, and recall has not fallen by more than allowed."""
    return bootstrap(values)[2] >= 0 and recall_fresh >= recall_base - RECALL_FALL


def verdict(control: str, arms: dict[str, list[float]]) -> str:
    """The winning arm by its deltas to the control: interval above 0, more wins than losses, largest mean; else the control."""
    best, most = control, 0.0
    for name, d in sorted(arms.items()):
        mean, low, _ = bootstrap(d)
        wins, losses = sum(x > TIE for x in d), sum(x < -TIE for x in d)
        if low > 0 and wins > losses and mean > most:
            best, most = name, mean
    return best
