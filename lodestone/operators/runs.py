"""Evaluation runs: two layers of a search scored against gold, comparisons of runs, and bake-offs of arms over captured pools."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from . import evaluation as ev
from .retrieval import ARM_LIMIT, POOL_LIMIT, RRF_K, Blend, blend_column

#: Cut of the pool's recall, and of the final ranking.
POOL_RECALL_K, FINAL_K = 25, 10


def retrieval_config(cfg: Blend, pool: int = POOL_LIMIT, rrf_k: float = RRF_K) -> dict:
    """What a search was run with, as plain values that JSON can hold."""
    return {"armLimit": ARM_LIMIT, "candidatePool": pool, "rrfK": rrf_k, "blend": {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(cfg).items()}}


def first_of_each(ranked: Column) -> Column:
    """A ranked array without later occurrences of a key, keys being compared as `evaluation.norm_key` writes them: a second chunk of a file is no second document."""
    keys = F.transform(ranked, ev.norm_key)
    return F.filter(F.transform(ranked, lambda x, i: F.when(F.array_position(keys, ev.norm_key(x)) == i + 1, x)), lambda x: x.isNotNull())


def two_layers(rows: DataFrame, config: dict, final_k: int = FINAL_K) -> DataFrame:
    """(id, query, pool_recall, ndcg, mrr, rank) of rows (id, query, pool, final, gold): the pool by its recall at 25, the final ranking by nDCG at `final_k`, reciprocal rank and first rank.

    Raises if the pool of the configuration has another size than 25, since the measure would not be the one it is named.
    Null arrays count as empty.
    """
    if config.get("candidatePool") != POOL_RECALL_K:
        raise ValueError(f"the pool holds {config.get('candidatePool')} candidates, the measure is recall at {POOL_RECALL_K}")
    a, b = ev.metrics(F.col("pool"), F.col("gold"), POOL_RECALL_K), ev.metrics(first_of_each(F.coalesce("final", F.array().cast("array<string>"))), F.col("gold"), final_k)
    got = rows.select("id", "query", a.alias("a"), b.alias("b"))
    return got.select("id", "query", F.col("a.recall").alias("pool_recall"), F.col("b.ndcg").alias("ndcg"), F.col("b.rr").alias("mrr"), F.col("b.first_rank").alias("rank"))


def aggregates(run: DataFrame) -> DataFrame:
    """One row: the number of queries and the means of the three measures, 0 where there are none."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return run.agg(F.count(F.lit(1)).alias("n_queries"), mean("pool_recall").alias("recall_at_25"), mean("ndcg").alias("ndcg_at_10"), mean("mrr").alias("mrr_at_10"))


def compare(spark: SparkSession, arms: dict[str, DataFrame], control: str, col: str = "ndcg") -> DataFrame:
    """(arm, n_queries, mean, delta, low, high, wins, losses, ties, winner) of runs (id, col) against the control, over the same queries.

    The winner is the arm whose interval lies above 0, that wins more often than it loses and has the largest delta; the
    control if there is none. Differences are rounded to nine places, and their distinct values counted.
    """
    rows = []
    for name in sorted(arms):
        d = materialize(ev.deltas(arms[control].select("id", F.col(col).alias("v")), arms[name].select("id", F.col(col).alias("v")), "id", "v"), "deltas")
        sign = ev.sign_test(d).first()
        counts = d.groupBy(F.round("delta", 9).alias("d")).count().orderBy("d").collect()  # values of a measure at a fixed cut
        mean, low, high = ev.bootstrap_counts(spark, [(r["d"], r["count"]) for r in counts])
        total = arms[name].agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(col), F.lit(0.0)).alias("m")).first()
        rows.append((name, total["n"], total["m"], mean, low, high, sign["wins"], sign["losses"], sign["ties"]))
    good = [r for r in rows if r[0] != control and r[4] > 0 and r[6] > r[7]]
    best = max(good, key=lambda r: (r[3], r[0]))[0] if good else control
    return spark.createDataFrame([(*r, r[0] == best) for r in rows], "arm string, n_queries long, mean double, delta double, low double, high double, wins long, losses long, ties long, winner boolean")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    """(id, gold, ranked): the first k rows of each query of (id, gold, m, p, score), best score first, ties in the order of the pool p."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), "p")
    top = scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return top.groupBy("id").agg(F.first("gold").alias("gold"), F.transform(F.array_sort(F.collect_list(F.struct("_r", "m"))), lambda x: x["m"]).alias("ranked"))


def blend_bakeoff(pools: DataFrame, rows: DataFrame, arms: dict[str, Blend], now: str, k: int = FINAL_K) -> dict[str, DataFrame]:
    """A run (id, ndcg) of each arm, all over the same captured pools (id, gold, pool): relevance is the reciprocal rank in the pool over that of its first.

    rows: (id, type, source_kind, event_date, created_at, importance). What the pool holds and rows does not is left out.
    """
    flat = pools.select("id", "gold", F.posexplode("pool").alias("p", "m"))
    held = materialize(flat.join(rows.withColumnRenamed("id", "m"), "m"), "captured")
    rel = F.lit(float(RRF_K + 1)) / (RRF_K + 1 + F.col("p"))
    out = {}
    for name, cfg in arms.items():
        score = blend_column(cfg, now, rel, F.col("type"), F.col("source_kind"), F.col("event_date"), F.col("created_at"), F.coalesce(F.col("importance").cast("double"), F.lit(0.5)))
        best = _ranked(held.select("id", "gold", "m", "p", F.round(score, 9).alias("score")), k)
        out[name] = materialize(best.select("id", ev.metrics(F.col("ranked"), F.col("gold"), k)["ndcg"].alias("ndcg")), "arm")
    return out


def rerank_bakeoff(pools: DataFrame, docs: DataFrame, rankers: dict[str, Callable[[Column, Column], Column] | None], k: int = FINAL_K) -> dict[str, DataFrame]:
    """A run (id, ndcg) of each ranker over the same captured pools (id, query, gold, pool): a ranker gives the score of a query and a document; None keeps the order of the pool. docs: (id, doc)."""
    flat = pools.select("id", "query", "gold", F.posexplode("pool").alias("p", "m")).join(docs.withColumnRenamed("id", "m"), "m")
    held = materialize(flat, "captured")
    out = {}
    for name, score in rankers.items():
        value = F.lit(0.0) if score is None else F.round(score(F.col("query"), F.col("doc")), 9)
        best = _ranked(held.select("id", "gold", "m", "p", value.alias("score")), k)
        out[name] = materialize(best.select("id", ev.metrics(F.col("ranked"), F.col("gold"), k)["ndcg"].alias("ndcg")), "ranker")
    return out
