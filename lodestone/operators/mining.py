"""Mining the search log, sampling a corpus, resolving titles."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .evaluation import norm_key

#: Share of results in the head of the pool below which a query is a candidate, and the head's length.
LOW_OVERLAP, HEAD = 0.5, 10


def harvest(log: DataFrame, now: str, days: int = 30, least: int = 2, gold: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(query, n, n_zero, modal_final, overlap, label) of the queries of a window that recur or found nothing.

    log (query, pool_ids, final_ids, created_at); gold (query): queries known already, compared without case and outer
    white space. modal_final is the most frequent result list, of equals the smallest. label: zero-hit, else low-overlap,
    else frequent. Sorted by n when a limit is given.
    """
    none = F.array().cast("array<string>")
    rows = log.where(F.col("created_at") > F.expr(f"timestamp '{now}' - make_interval(0, 0, 0, {int(days)})")).select("query", F.coalesce("pool_ids", none).alias("pool"), F.coalesce("final_ids", none).alias("final"))
    head = F.slice("pool", 1, HEAD)
    share = F.when(F.size("final") == 0, 0.0).otherwise(F.size(F.filter("final", lambda x: F.array_contains(head, x))) / F.size("final"))
    by_list = rows.withColumn("_s", share).groupBy("query", "final").agg(F.count(F.lit(1)).alias("c"), F.sum("_s").alias("s"))
    per = by_list.groupBy("query").agg(
        F.sum("c").alias("n"), F.sum(F.when(F.size("final") == 0, F.col("c")).otherwise(0)).alias("n_zero"), F.min_by("final", F.struct((-F.col("c")).alias("c"), "final")).alias("modal_final"), F.round(F.sum("s") / F.sum("c"), 6).alias("overlap")
    ).where((F.col("n") >= least) | (F.col("n_zero") > 0))
    if gold is not None:
        per = per.withColumn("_k", norm_key(F.col("query"))).join(gold.select(norm_key(F.col("query")).alias("_k")).distinct(), "_k", "left_anti").drop("_k")
    label = F.when(F.col("n_zero") > 0, "zero-hit").when(F.col("overlap") < LOW_OVERLAP, "low-overlap").otherwise("frequent")
    out = per.withColumn("label", label)
    return out if limit is None else out.orderBy(F.desc("n"), "query").limit(limit)


def stratified_sample(df: DataFrame, id_col: str, strata: list[Column], n: int, seed: str = "") -> DataFrame:
    """Up to n rows of each stratum, in the order of a hash of the id: the same rows at every run. Null strata are strata."""
    names = [f"_s{i}" for i in range(len(strata))]
    marked = df.withColumns(dict(zip(names, strata)))
    w = Window.partitionBy(*names).orderBy(F.sha2(F.concat(F.col(id_col).cast("string"), F.lit(seed)), 256), id_col)
    return marked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r", *names)


def resolve_titles(asked: DataFrame, id_col: str, title_col: str, corpus: DataFrame, corpus_id: str, corpus_title: str) -> DataFrame:
    """(id, n_matches, match_id, state): titles looked up without case and outer white space; state found, ambiguous or missing."""
    keys = corpus.select(norm_key(F.col(corpus_title)).alias("_k"), F.col(corpus_id).alias("m")).groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("match_id"))
    got = asked.select(F.col(id_col), norm_key(F.col(title_col)).alias("_k")).join(keys, "_k", "left")
    n = F.coalesce("n", F.lit(0))
    return got.select(id_col, n.alias("n_matches"), F.when(n == 1, F.col("match_id")).alias("match_id"), F.when(n == 1, "found").when(n > 1, "ambiguous").otherwise("missing").alias("state"))


def parse_candidates(raw: str) -> list[dict]:
    """The candidate rows of a model's answer: an array of objects with a query; anything else is none."""
    at, end = raw.find("["), raw.rfind("]")
    try:
        got = json.loads(raw[at : end + 1]) if 0 <= at < end else []
    except ValueError:
        return []
    return [x for x in got if isinstance(x, dict) and isinstance(x.get("query"), str) and x["query"].strip()]


def dedupe_candidates(df: DataFrame, query_col: str, order: list[Column]) -> DataFrame:
    """The first row, by `order`, of those whose query is the same without case and outer white space."""
    w = Window.partitionBy("_k").orderBy(*order)
    return df.withColumn("_k", norm_key(F.col(query_col))).withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_k", "_r")
