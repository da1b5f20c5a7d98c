"""Connected components of an undirected edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """Component of every vertex that occurs in `edges`: (node, component), component being its least vertex.

    Edges may repeat, point either way or be loops; rows with a null end are ignored; an empty table gives an empty
    result. Vertices may have any orderable type. Each round shuffles the remaining edges twice, pre-aggregated by
    vertex, and writes them to the shared folder; the number of rounds grows with the logarithm of the diameter.
    """
    raw = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null")
    cur = materialize(raw.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    nodes = raw.where("u = v").select("u").distinct()
    state = None
    for _ in range(max_rounds):
        nxt = materialize(_small_star(_large_star(cur)), "cc")
        discard(cur)
        cur = nxt
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = nodes.select(F.col("u").alias("node"), F.col("u").alias("component"))
    linked = found.union(roots)
    return linked.union(alone.join(linked.select("node"), "node", "left_anti"))
