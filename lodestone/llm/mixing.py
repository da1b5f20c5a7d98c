"""Mixing sources to target weights (problem 9)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

#: Bits of a text's hash that one step of the search for the end of a partial repetition looks at: windows have at most 2 ** STEP_BITS rows a source.
STEP_BITS = 12
#: Blocks that a shard should be dealt.
SHARD_BLOCKS = 64


def source_key(c: Column) -> Column:
    """One spelling of a source: lower case, with hyphens for spaces and underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_]+", "-")


def shard_quotas(totals: list[int], shards: int, shard: int, seed: int) -> tuple[list[int], list[int]]:
    """(offsets, counts): the blocks of each source that an output shard gets, by walking down a binary tree of shards.

    At each node the blocks left of each source go to the left half by a multivariate hypergeometric draw of its share,
    seeded by the node: each walk sees the same draws, so the shards' blocks are disjoint and together all blocks.
    """
    lo, hi, have, at = 0, shards, list(totals), [0] * len(totals)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        n = sum(have)
        take = round(n * (mid - lo) / (hi - lo))
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left = rng.multivariate_hypergeometric(have, take, method="marginals").tolist() if n else [0] * len(have)
        if shard < mid:
            have, hi = left, mid
        else:
            at = [a + x for a, x in zip(at, left)]
            have, lo = [h - x for h, x in zip(have, left)], mid
    return at, have


@dataclass(frozen=True)
class Quota:
    """What a source gives: its share and repeats as asked for, the texts and tokens it has, its quota, and whole repetitions in it. `limits`: its repeats bound the total."""

    source: str
    share: float
    repeats: int
    rows: int
    tokens: int
    quota: float
    whole: int
    limits: bool


def quotas(sized: DataFrame, size_col: str, source_col: str, targets: DataFrame) -> tuple[list[Quota], DataFrame]:
    """(quotas of the sources with a target, (source, rows, tokens) of all): see `mixture`. Collects a row for each target."""
    goal = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("repeats")).where("share > 0")
    goal = {r["source"]: (r["share"], max(r["repeats"] or 1, 1)) for r in goal.groupBy("source").agg(F.sum("share").alias("share"), F.max("repeats").alias("repeats")).collect()}
    names = sorted(k for k in goal if k is not None)
    used = F.col(size_col) > 0
    held = sized.groupBy(source_key(F.col(source_col)).alias("source")).agg(F.count(F.when(used, 1)).alias("rows"), F.coalesce(F.sum(F.when(used, F.col(size_col).cast("long"))), F.lit(0)).alias("tokens"))
    have = {r["source"]: (r["rows"], r["tokens"]) for r in held.where(F.col("source").isin(names) & (F.col("tokens") > 0)).collect()} if names else {}
    mass = sum(goal[s][0] for s in names if s in have)
    most = {s: have[s][1] * goal[s][1] * mass / goal[s][0] for s in names if s in have}
    total = min(most.values(), default=0)
    out = []
    for s in names:
        n, t = have.get(s, (0, 0))
        quota = total * goal[s][0] / mass if t else 0.0
        out.append(Quota(s, goal[s][0], goal[s][1], n, t, float(quota), min(int(quota // t), goal[s][1]) if t else 0, most.get(s) == total))
    return out, held


def _ends(last: DataFrame) -> dict[str, tuple[int, float]]:
    """Of each source the step of its partial repetition in which its quota ends, and the tokens before it. last: (source, step, rest, tokens)."""
    w = Window.partitionBy("source").orderBy("step")  # at most 2 ** STEP_BITS rows of a source
    sums = last.groupBy("source", "step").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest")).withColumn("upto", F.sum("t").over(w))
    edge = sums.where("upto > rest").groupBy("source").agg(F.min(F.struct("step", (F.col("upto") - F.col("t")).alias("before"))).alias("x"))
    return {r["source"]: (r["x"]["step"], r["x"]["before"]) for r in edge.collect()}  # one row a source


def _by_source(values: dict[str, object], kind: str) -> Column:
    """The value of each source, null for others."""
    out = F.lit(None).cast(kind)
    for s, v in values.items():
        out = F.when(F.col("source") == s, F.lit(v).cast(kind)).otherwise(out)
    return out


def mixture(docs: DataFrame, id_col: str, size_col: str, source_col: str, targets: DataFrame, shard_size: int = 4_000_000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rows, report): the mixture as (id, source, copy, tokens, shard, position) and the shares reached.

    The total is the largest at which every source that has any text can fill its share without a text being used more
    than max_repeats times; shares of sources without text are divided among the others in proportion, and the report
    shows them with 0 and names the source that limits the total. A source is used in whole repetitions and a part of
    one, the texts of which come in the order of a hash up to its quota, so a source misses its quota by less than the
    length of one text. Texts with a null id, no tokens or a source without target are not used; the report has a line
    for each such source. Sources are matched by `source_key`. Blocks follow the tokens: a shard is dealt about
    SHARD_BLOCKS of them, whatever the size of a source.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), source_key(F.col(source_col)).alias("source"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("tokens"))
    known = materialize(known, "sized")
    plan, held = quotas(known, "tokens", "source", targets)
    use = [q for q in plan if q.tokens]
    total = sum(q.quota for q in use)
    present = [q.source for q in use]
    rows = known.where(F.col("source").isin(present) & (F.col("tokens") > 0)) if present else known.where("false")
    whole, repeats = _by_source({q.source: q.whole for q in use}, "int"), _by_source({q.source: q.repeats for q in use}, "int")
    per_block = max(shard_size // SHARD_BLOCKS, 1)
    blocks = {q.source: max(1, math.ceil(q.tokens / per_block)) for q in use}
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(whole + 1, repeats))))
    hashed = copies.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc", "copy", F.lit(seed)), 1))  # 63 bits
    rest = _by_source({q.source: q.quota - q.whole * q.tokens for q in use}, "double")
    last = hashed.where(F.col("copy") > whole).withColumn("rest", rest)
    # the hash up to which the partial repetition goes, by its first bits, then by the next ones, then text by text
    coarse = F.shiftrightunsigned("h", 63 - STEP_BITS)
    fine = F.shiftrightunsigned("h", 63 - 2 * STEP_BITS).bitwiseAND(F.lit((1 << STEP_BITS) - 1))
    one = _ends(last.select("source", coarse.alias("step"), "rest", "tokens"))
    at = _by_source({s: x for s, (x, _) in one.items()}, "long")
    ahead = _by_source({s: b for s, (_, b) in one.items()}, "double")
    two = _ends(last.where(coarse == at).select("source", fine.alias("step"), (F.col("rest") - ahead).alias("rest"), "tokens"))
    at2 = _by_source({s: x for s, (x, _) in two.items()}, "long")
    ahead2 = ahead + _by_source({s: b for s, (_, b) in two.items()}, "double")
    before = at.isNull() | (coarse < at) | ((coarse == at) & (fine < at2))
    w = Window.partitionBy("source").orderBy("h", "doc")  # 2 ** -24 of a source
    edge = last.where((coarse == at) & (fine == at2)).withColumn("upto", ahead2 + F.sum("tokens").over(w)).where("upto <= rest")
    cols = ["doc", "source", "tokens", "copy", "h"]
    used = hashed.where(F.col("copy") <= whole).select(cols).union(last.where(before).select(cols)).union(edge.select(cols))
    number = _by_source(blocks, "long")
    block = F.least(F.floor(F.col("h") / F.lit(2.0**63) * number).cast("long"), number - 1)
    used = materialize(used.withColumn("no", (F.col("copy") - 1) * number + block).drop("h"), "used")
    full = {r["source"]: r["b"] for r in used.groupBy("source").agg(F.max("no").alias("b")).collect()}
    totals = [full.get(s, -1) + 1 for s in present]
    shards = max(1, math.ceil(total / shard_size))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard in b["id"].tolist():
                at, n = shard_quotas(totals, shards, shard, seed)
                for i, s in enumerate(present):
                    yield pd.DataFrame({"source": s, "no": np.arange(at[i], at[i] + n[i]), "shard": shard})

    owners = spark.range(shards).mapInPandas(deal, "source string, no long, shard long")
    # blocks are slices of a hash, so the draw is from permuted blocks
    placed = used.join(owners, ["source", "no"])
    order = Window.partitionBy("shard").orderBy(F.xxhash64("doc", "copy", F.lit(seed + 2)), "doc", "copy")
    out = placed.select(F.col("doc").alias(id_col), "source", "copy", "tokens", "shard", F.row_number().over(order).alias("position"))
    got = used.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows"), F.max("copy").alias("most_repeats"))
    return out, _report(spark, plan, held, got)


REPORT = "source string, target_share double, max_repeats int, quota double, limits_total boolean"


def _report(spark: SparkSession, plan: list[Quota], held: DataFrame, got: DataFrame) -> DataFrame:
    table = F.broadcast(spark.createDataFrame([(q.source, q.share, q.repeats, q.quota, q.limits) for q in plan], REPORT))  # as many rows as targets
    every = held.toDF("_s", "available_rows", "available_tokens").join(table, F.col("_s").eqNullSafe(F.col("source")), "full_outer")
    every = every.select(F.coalesce("source", "_s").alias("source"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("available_rows", "available_tokens", "target_share", "max_repeats")], F.coalesce("limits_total", F.lit(False)).alias("limits_total"))
    all_ = got.agg(F.sum("tokens").alias("all_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(got, "source", "left").crossJoin(F.broadcast(all_)).select("source", "target_share", "max_repeats", zero("tokens"), zero("n_rows"), zero("most_repeats"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"), "available_rows", "available_tokens", "limits_total")
