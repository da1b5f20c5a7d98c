"""Queries over the search log and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators.hierarchy import hierarchy
from ..operators import runs
from ..operators.mining import harvest as mine
from ..operators.retrieval import ARMS
from ..functions.text import memory_doc, tokens
from ..session import load, materialize
from .registry import register

NOW = "2026-07-01 00:00:00"
_HEAD = "list_slice(pool, 1, 10)"


@register(f"""with rows as (select distinct id, query, coalesce(pool_ids, []) as pool, coalesce(final_ids, []) as final, created_at from search_log where created_at > timestamptz '{NOW}+00' - interval 30 day),
s as (select query, final, case when len(final) = 0 then 0.0 else len(list_filter(final, lambda x: list_contains({_HEAD}, x)))::double / len(final) end as share from rows),
m as (select query, final, row_number() over (partition by query order by count(*) desc, final) as r from s group by query, final),
p as (select query, count(*) as n, count(*) filter (where len(final) = 0) as n_zero, round(avg(share), 6) as overlap from s group by query having count(*) >= 2 or count(*) filter (where len(final) = 0) > 0)
select p.query, n, n_zero, m.final as modal_final, overlap, case when n_zero > 0 then 'zero-hit' when overlap < 0.5 then 'low-overlap' else 'frequent' end as label from p join m on m.query = p.query and m.r = 1
where lower(trim(p.query)) not in (select lower(trim(query)) from recall_eval where query is not null)""")
def harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of the last 30 days that recur or found nothing, rows delivered twice counted once."""
    log = load(spark, sf_dir, "search_log").select("id", "query", "pool_ids", "final_ids", "created_at").distinct()
    return mine(log, NOW, gold=load(spark, sf_dir, "recall_eval").select("query"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per search with results: its pool, the same pool by importance, and its results as gold."""
    rows = load(spark, sf_dir, "search_log").where("size(final_ids) > 0").groupBy("id").agg(F.min("pool_ids").alias("pool"), F.min("final_ids").alias("gold"))
    imp = load(spark, sf_dir, "memories").select(F.col("id").alias("m"), F.coalesce(F.col("importance").cast("double"), F.lit(0.5)).alias("imp"))
    flat = rows.select("id", F.posexplode("pool").alias("p", "m")).join(imp, "m", "left")
    item = F.struct((-F.coalesce("imp", F.lit(0.0))).alias("o"), F.col("p"), F.col("m"))
    byimp = flat.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["m"]).alias("ranked"))  # a pool has a bounded length
    return rows.join(byimp, "id", "left")


_RUNS = """lg as (select id, min(pool_ids) as pool, min(final_ids) as gold from search_log where len(final_ids) > 0 group by id),
fl as (select id, unnest(pool) as m, unnest(range(len(pool))) as p from lg), im as (select fl.id, fl.m, fl.p, coalesce(case when q.id is null then 0.0 else coalesce(q.importance::double, 0.5) end, 0.0) as imp from fl left join memories q on q.id = fl.m),
rk as (select id, list(m order by imp desc, p) as ranked from im group by id), run as (select lg.id, pool, coalesce(ranked, []) as ranked, list_distinct(gold) as gold from lg left join rk using (id)),
plc as (select id, gold, list_sort(list_filter(list_transform(gold, lambda g: list_position(pool, g)), lambda x: x > 0)) as pa, list_sort(list_filter(list_transform(gold, lambda g: list_position(ranked, g)), lambda x: x > 0)) as pb from run)"""


def _gain(places: str) -> str:
    return f"coalesce(list_sum(list_transform({places}, lambda p: 1.0 / log2(p + 1.0))), 0.0)"


_IDEAL = _gain("range(1, greatest(least(len(gold), 3), 1) + 1)")
_METRIC = {
    "recall": lambda p: f"case when len(list_filter({p}, lambda x: x <= 3)) > 0 then 1.0::double else 0.0::double end",
    "rr": lambda p: f"coalesce(1.0 / {p}[1], 0.0)",
    "ndcg": lambda p: f"{_gain(f'list_filter({p}, lambda x: x <= 3)')} / {_IDEAL}",
}


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir)
    return materialize(rows.select("id", ev.metrics(F.col("pool"), F.col("gold"), 3).alias("a"), ev.metrics(F.col("ranked"), F.col("gold"), 3).alias("b")), "scored")


def _metric(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _scored(spark, sf_dir).select("id", F.round(f"a.{name}", 6).alias("pool"), F.round(f"b.{name}", 6).alias("by_importance"))


def _metric_sql(name: str) -> str:
    return f"with {_RUNS} select id, round({_METRIC[name]('pa')}, 6) as pool, round({_METRIC[name]('pb')}, 6) as by_importance from plc"


@register(_metric_sql("recall"))
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, "recall")


@register(_metric_sql("rr"))
def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, "rr")


@register(_metric_sql("ndcg"))
def ndcg_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric(spark, sf_dir, "ndcg")


@register(f"with {_RUNS} select count(*) as n_queries, " + ", ".join(f"round(avg({m('pa')}), 6) as {n}_pool, round(avg({m('pb')}), 6) as {n}_by_importance" for n, m in _METRIC.items()) + " from plc")
def run_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    return rows.agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(f"{s}.{n}"), 6).alias(f"{n}_{t}") for n in _METRIC for s, t in (("a", "pool"), ("b", "by_importance"))])


_DELTA = f"{_METRIC['ndcg']('pb')} - {_METRIC['ndcg']('pa')}"


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    return ev.deltas(rows.select("id", F.col("a.ndcg").alias("v")), rows.select("id", F.col("b.ndcg").alias("v")), "id", "v")


@register(f"with {_RUNS} select id, round({_DELTA}, 6) as delta from plc")
def query_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir).select("id", F.round("delta", 6).alias("delta"))


@register(f"with {_RUNS}, d as (select {_DELTA} as d from plc) select count(*) filter (where d > 1e-12) as wins, count(*) filter (where d < -1e-12) as losses, count(*) filter (where abs(d) <= 1e-12) as ties from d")
def sign_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sign_test(_deltas(spark, sf_dir)).select("wins", "losses", "ties")


@register(f"""with {_RUNS}, d as (select {_DELTA} as d from plc), c as (select count(*) filter (where d > 1e-12)::double as w, count(*) filter (where d < -1e-12)::double as l from d),
z as (select case when w + l > 0 then greatest(0.0, abs(w - (w + l) / 2) - 0.5) / sqrt((w + l) / 4) else 0.0 end as z from c), t as (select z, z / sqrt(2.0) as x, 1.0 / (1.0 + 0.3275911 * z / sqrt(2.0)) as t from z)
select round(z, 6) as z, round(case when z = 0 then 1.0 else 1.0 - (1.0 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x)) end, 9) as p from t""")
def sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sign_test(_deltas(spark, sf_dir)).select(F.round("z", 6).alias("z"), F.round("p", 9).alias("p"))


@register(f"with {_RUNS}, k as (select id, min(project_id) as project_id from search_log group by id) select coalesce(k.project_id, 'unknown') as project_id, count(*) as n, round(avg({_METRIC['ndcg']('pa')}), 6) as ndcg from plc left join k using (id) group by 1")
def slice_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean nDCG per project."""
    kinds = load(spark, sf_dir, "search_log").groupBy("id").agg(F.min("project_id").alias("project_id"))
    rows = _scored(spark, sf_dir).join(kinds, "id", "left")
    return rows.groupBy(F.coalesce("project_id", F.lit("unknown")).alias("project_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a.ndcg"), 6).alias("ndcg"))


@register()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the mean difference over all searches. Distinct differences are few, so they are collected with their counts."""
    counts = _deltas(spark, sf_dir).groupBy(F.round("delta", 9).alias("d")).count().orderBy("d").collect()  # values of a metric at k = 3
    n = sum(r["count"] for r in counts)
    if not n:
        return spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "n long, mean double, low double, high double")
    got = ev.bootstrap_counts(spark, [(r["d"], r["count"]) for r in counts])
    return spark.createDataFrame([(n, *got)], "n long, mean double, low double, high double")


@register()
def canonical_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools with each memory replaced by the result whose chain of successors it is in."""
    roots = hierarchy(load(spark, sf_dir, "memories").select("id", "superseded_by"), "id", "superseded_by", with_path=True).where("depth >= 0")
    rows = materialize(_log(spark, sf_dir).select("id", "pool", "gold"), "log")
    one = rows.select("id", F.posexplode("gold").alias("p", "g")).join(roots.select(F.col("id").alias("g"), "path"), "g", "left")
    chain = F.struct("p", F.col("g").alias("gold"), F.coalesce("path", F.array("g")).alias("members"))
    chains = one.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(chain)), lambda x: F.struct(x["gold"].alias("gold"), x["members"].alias("members"))).alias("chains"))
    return ev.canonicalize(rows.join(chains, "id", "left"), "id", "pool", "chains")


@register("""select cast(date_trunc('hour', created_at) as timestamp) as start, lower(trim(regexp_replace(query, '\\s+', ' ', 'g'))) as query_key, count(*) as n, count(*) filter (where coalesce(len(final_ids), 0) = 0) as n_zero, round(avg(pool_ms), 6) as mean_pool_ms from search_log group by 1, 2""")
def log_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming statistics as a batch: tumbling hours of each query."""
    key = F.lower(F.trim(F.regexp_replace("query", r"\s+", " ")))
    rows = load(spark, sf_dir, "search_log").groupBy(F.window("created_at", "1 hour").alias("w"), key.alias("query_key")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.coalesce(F.size("final_ids"), F.lit(0)) <= 0, 1)).alias("n_zero"), F.round(F.avg("pool_ms"), 6).alias("mean_pool_ms"))
    return rows.select(F.col("w.start").alias("start"), "query_key", "n", "n_zero", "mean_pool_ms")


_CAPTURED = f"{_RUNS}, lq as (select id, min(query) as query from search_log group by id), cap as (select run.id, lq.query, gold, pool, ranked as final from run join lq using (id))"


def _captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, query, gold, pool, final): the pool of every search with results, its results as gold, and the pool by importance as the final ranking."""
    asked = load(spark, sf_dir, "search_log").groupBy("id").agg(F.min("query").alias("query"))
    return materialize(_log(spark, sf_dir).join(asked, "id").select("id", "query", "gold", "pool", F.col("ranked").alias("final")), "captured")


_LAYERS = f"""with {_CAPTURED}, q as (select id, query, list_distinct(gold) as gold, pool, coalesce(list_filter(final, lambda x, i: list_position(final, x) = i), []) as final from cap),
pl as (select *, list_sort(list_filter(list_transform(gold, lambda g: list_position(pool, g)), lambda x: x > 0)) as pa, list_sort(list_filter(list_transform(gold, lambda g: list_position(final, g)), lambda x: x > 0)) as pb from q),
lay as (select id, query, case when len(list_filter(pa, lambda x: x <= 25)) > 0 then 1.0::double else 0.0::double end as pool_recall, {_gain('list_filter(pb, lambda x: x <= 10)')} / {_gain('range(1, greatest(least(len(gold), 10), 1) + 1)')} as ndcg, coalesce(1.0 / pb[1], 0.0) as mrr, pb[1]::int as rank from pl)"""


@register(f"{_LAYERS} select id, query, pool_recall, round(ndcg, 6) as ndcg, round(mrr, 6) as mrr, rank from lay")
def two_layer_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every search of the log with results: its pool, and the pool by importance, against what it gave."""
    got = runs.two_layers(_captured(spark, sf_dir), runs.retrieval_config(ARMS["A0"]))
    return got.select("id", "query", "pool_recall", F.round("ndcg", 6).alias("ndcg"), F.round("mrr", 6).alias("mrr"), "rank")


@register(f"{_LAYERS} select count(*) as n_queries, round(coalesce(avg(pool_recall), 0), 6) as recall_at_25, round(coalesce(avg(ndcg), 0), 6) as ndcg_at_10, round(coalesce(avg(mrr), 0), 6) as mrr_at_10 from lay")
def two_layer_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = runs.aggregates(runs.two_layers(_captured(spark, sf_dir), runs.retrieval_config(ARMS["A0"])))
    return got.select("n_queries", *[F.round(c, 6).alias(c) for c in ("recall_at_25", "ndcg_at_10", "mrr_at_10")])


@register()
def blend_bakeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five arms over the captured pools against A0, with intervals and the winner."""
    rows = load(spark, sf_dir, "memories").select("id", "type", "source_kind", "event_date", "created_at", "importance")
    return runs.compare(spark, runs.blend_bakeoff(_captured(spark, sf_dir), rows, ARMS, NOW), "A0")


@register(f"""with {_CAPTURED}, fb as (select id, gold, unnest(pool) as m, unnest(range(len(pool))) as p from cap), s as (select fb.id, gold, m, p, round(61.0 / (61 + p), 9) as score from fb join memories q on q.id = fb.m),
k as (select id, gold, m, row_number() over (partition by id order by score desc, p) as r from s), rb as (select id, list_distinct(any_value(gold)) as gold, list(m order by r) as ranked from k where r <= 10 group by id),
pb as (select id, gold, list_sort(list_filter(list_transform(gold, lambda g: list_position(ranked, g)), lambda x: x > 0)) as pb from rb) select id, round({_gain('pb')} / {_gain('range(1, greatest(least(len(gold), 10), 1) + 1)')}, 6) as ndcg from pb""")
def blend_arm_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nDCG of each captured search by the arm of relevance alone."""
    rows = load(spark, sf_dir, "memories").select("id", "type", "source_kind", "event_date", "created_at", "importance")
    return runs.blend_bakeoff(_captured(spark, sf_dir), rows, {"A4": ARMS["A4"]}, NOW)["A4"].select("id", F.round("ndcg", 6).alias("ndcg"))


def _word_share(query, doc):
    q = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(q, tokens(doc))) / F.greatest(F.size(q), F.lit(1))


@register()
def rerank_bakeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of the pools against a reranker by the share of the query's words, over the same captured pools."""
    docs = load(spark, sf_dir, "memories").select("id", memory_doc(F.col("title"), F.col("summary"), F.col("content")).alias("doc"))
    return runs.compare(spark, runs.rerank_bakeoff(_captured(spark, sf_dir), docs, {"pool": None, "overlap": _word_share}), "pool")
