"""Queries over memories: lists, filters, search, hashes, near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stem import STOP_WORDS
from ..functions.text import budget_body, effective_date, json_strings, memory_doc, snippet
from ..operators import dedup, filters, lifecycle, mining, rendering, retrieval
from ..operators.chunking import running_total, snapshot_diff
from ..operators.hits import query_snippets
from ..operators.snapshot import get_secrets, latest, set_secrets
from ..session import load, materialize
from ..sources.models import overlap_reranker
from .registry import register

NOW = "2026-07-01 00:00:00"
PROJECT, TERMS, TAGS = "dwinvacor-cosine", ["ledger", "before"], ["pipeline", "session", "decision"]
QUERY_TEXT = "ledger released before the index was restarted"
_LIVE = "archived_at is null and coalesce(status, 'active') = 'active'"
_TEXT = "lower(coalesce(title, '') || ' ' || coalesce(content, ''))"
_STOP = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))


@register(f"select id, project_id, type, title from memories where {_LIVE}")
def live_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "memories").where(filters.live()).select("id", "project_id", "type", "title")


@register("select project_id, type, count(*) as n_rows, count(*) filter (where archived_at is null and coalesce(status, 'active') = 'active') as n_active, count(*) filter (where status = 'superseded') as n_superseded from memories group by 1, 2")
def list_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda c: F.count(F.when(c, 1))
    return load(spark, sf_dir, "memories").groupBy("project_id", "type").agg(F.count(F.lit(1)).alias("n_rows"), flag(filters.live()).alias("n_active"), flag(F.col("status") == "superseded").alias("n_superseded"))


@register("""select id, title, source_kind, coalesce(event_date, created_at) as at from (
select *, row_number() over (partition by project_id order by coalesce(event_date, created_at) desc, id) as r from memories where coalesce(status, 'active') = 'active' and source_kind = 'session') where r <= 30""")
def list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 newest active session memories of each project."""
    at = effective_date(F.col("event_date"), F.col("created_at"))
    rows = load(spark, sf_dir, "memories").where(filters.by_status(None) & (F.col("source_kind") == "session")).select("id", "project_id", "title", "source_kind", at.alias("at"))
    w = Window.partitionBy("project_id").orderBy(F.desc("at"), "id")
    return rows.withColumn("r", F.row_number().over(w)).where("r <= 30").select("id", "title", "source_kind", "at")


@register(f"select id, title, created_at from memories where {_LIVE} order by created_at desc, id limit 10")
def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "memories").where(filters.live()).select("id", "title", "created_at").orderBy(F.desc("created_at"), "id").limit(10)


@register("select id from memories where list_has_any(cast(json_extract_string(metadata, '$.tags[*]') as varchar[]), ['pipeline', 'session', 'decision'])")
def tag_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "memories").where(filters.any_tag(TAGS)).select("id")


@register("select t as tag, count(*) as n_rows, count(distinct project_id) as n_projects from (select project_id, unnest(json_extract_string(metadata, '$.tags[*]')) as t from memories) group by 1")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = load(spark, sf_dir, "memories").select("project_id", F.explode(json_strings(F.col("metadata"), "$.tags")).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("project_id").alias("n_projects"))


@register("select id from memories where list_contains(json_extract_string(metadata, '$.tags[*]'), 'pipeline')")
def tag_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "memories").where(filters.has_tag("pipeline")).select("id")


@register("select id, coalesce(event_date, created_at) as at from memories where coalesce(event_date, created_at) >= timestamptz '2026-01-01 00:00:00+00'")
def after_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "memories").where(filters.after("2026-01-01")).select("id", effective_date(F.col("event_date"), F.col("created_at")).alias("at"))


@register("select id from memories where source_kind is distinct from 'decision' and type in ('semantic', 'procedural')")
def not_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "memories").where(~F.col("source_kind").eqNullSafe("decision") & F.col("type").isin("semantic", "procedural")).select("id")


@register(f"""with s as (select * from memories where {_LIVE} and type = 'semantic'), h as (select * from s where coalesce(list_contains(json_extract_string(metadata, '$.tags[*]'), 'no such tag'), false))
select id, title, true as retried from s where not exists (select 1 from h) union all select id, title, false from h""")
def relaxed_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag that no row has is dropped, the type stays."""
    rows, retried = filters.relaxed(load(spark, sf_dir, "memories"), filters.live() & (F.col("type") == "semantic"), filters.has_tag("no such tag"))
    return rows.select("id", "title", F.lit(retried).alias("retried"))


@register("select id from memories where id > '7' order by id limit 500")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page after a cursor."""
    return load(spark, sf_dir, "memories").where("id > '7'").select("id").orderBy("id").limit(500)


@register("select project_id, count(*) filter (where summary is null) as no_summary, count(*) filter (where embedding is null) as no_vector from memories group by 1")
def pending_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda c: F.count(F.when(F.col(c).isNull(), 1))
    return load(spark, sf_dir, "memories").groupBy("project_id").agg(flag("summary").alias("no_summary"), flag("embedding").alias("no_vector"))


@register("select doc_id, substr(text, 1, 6000) as content, length(text) > 6000 as truncated, case when length(text) > 6000 then length(text) end as total_chars from documents")
def budget_body_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", budget_body(F.col("text"), 6000).alias("b")).select("doc_id", "b.content", "b.truncated", F.col("b.total_chars").cast("long").alias("total_chars"))


@register("select id, substr(concat_ws(chr(10), title, nullif(summary, ''), content), 1, 1200) as doc, substr(regexp_replace(content, '\\s+', ' ', 'g'), 1, 180) as snippet from memories")
def rerank_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "memories").select("id", memory_doc(F.col("title"), F.col("summary"), F.col("content")).alias("doc"), snippet(F.col("content")).alias("snippet"))


_LEX = f"""w as (select id, regexp_extract_all({_TEXT}, '[a-z0-9]+') as t from memories where {_LIVE}),
tf as (select id, {", ".join(f"len(list_filter(t, lambda x: x = '{t}'))::double as f{i}" for i, t in enumerate(TERMS))} from w),
lexall as (select id, round({" + ".join(f"f{i} / (f{i} + 1.2)" for i in range(len(TERMS)))}, 6) as lex_score from tf where {" and ".join(f"f{i} > 0" for i in range(len(TERMS)))}),
lex as (select *, row_number() over (order by lex_score desc, id)::int as lex_rank from lexall order by lex_score desc, id limit 50)"""
_VEC = f"""u as (select id, embedding::double[] as v from memories where {_LIVE} and embedding is not null and list_sum(list_transform(embedding, lambda x: x::double * x)) > 0),
q as (select v as qv from u order by id limit 1),
vec as (select *, row_number() over (order by cosine desc, id)::int as vec_rank from (select id, round(list_cosine_similarity(v, qv), 6) as cosine from u, q) order by cosine desc, id limit 50)"""


def _fused(k: float, limit: int = 25) -> str:
    return f"""fz as (select coalesce(l.id, v.id) as id, lex_rank, vec_rank, round(coalesce(1.0 / ({k}::double + lex_rank), 0) + coalesce(1.0 / ({k}::double + vec_rank), 0), 9) as rrf from lex l full outer join vec v on l.id = v.id),
pool as (select *, row_number() over (order by rrf desc, id)::int as pool_rank from fz order by rrf desc, id limit {limit})"""


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "memories").where(filters.live())


def _text():
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))


def _query_vector(rows: DataFrame) -> list[float]:
    usable = rows.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))
    first = usable.orderBy("id").select("embedding").first()
    return [float(x) for x in first[0]] if first else []


def _pool(spark: SparkSession, sf_dir: str, k: float = retrieval.RRF_K) -> DataFrame:
    rows = _live(spark, sf_dir)
    return retrieval.fuse(retrieval.lexical_arm(rows, "id", _text(), TERMS), retrieval.vector_arm(rows, "id", "embedding", _query_vector(rows)), k)


@register(f"with {_LEX} select * from lex")
def lexical_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.lexical_arm(_live(spark, sf_dir), "id", _text(), TERMS)


@register()
def lexical_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arm with stemming and cover density."""
    return retrieval.lexical_cover_arm(_live(spark, sf_dir), "id", ["title", "content"], QUERY_TEXT)


@register(f"with {_VEC} select * from vec")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _live(spark, sf_dir)
    return retrieval.vector_arm(rows, "id", "embedding", _query_vector(rows))


@register(f"with {_LEX}, {_VEC}, {_fused(60)} select id, lex_rank, vec_rank, rrf, pool_rank from pool")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir)


@register(f"with {_LEX}, {_VEC}, " + ", ".join(_fused(k).replace("fz", f"fz{k}").replace("pool as", f"pool{k} as") for k in (20, 60, 120)) + " " + " union all ".join(f"select {k} as k, id, rrf, pool_rank from pool{k}" for k in (20, 60, 120)))
def rrf_k_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    rows = _live(spark, sf_dir)
    lex = materialize(retrieval.lexical_arm(rows, "id", _text(), TERMS), "lex")
    vec = materialize(retrieval.vector_arm(rows, "id", "embedding", _query_vector(rows)), "vec")
    for k in (20, 60, 120):
        part = retrieval.fuse(lex, vec, k).select(F.lit(k).alias("k"), "id", "rrf", "pool_rank")
        out = part if out is None else out.union(part)
    return out


_AGE = "(epoch_us(timestamptz '2026-07-01 00:00:00+00') - epoch_us(coalesce(event_date, created_at))) / 86400000000.0"
_TAU = "case when type in ('semantic', 'procedural') then 90.0 else 30.0 end"
_EXEMPT = "(type = 'entity' or coalesce(source_kind, '') = 'decision')"
_RECENCY = {
    "A0": f"exp(-({_AGE}) / 30.0)",
    "A1": f"case when {_EXEMPT} then 1.0 else exp(-({_AGE}) / ({_TAU})) end",
    "A2": f"case when {_EXEMPT} then 1.0 else pow(1 + ({_AGE}) / ({_TAU}), -0.5) end",
    "A3": f"exp(-({_AGE}) / 30.0)",
}
_IMP = "coalesce(importance::double, 0.5)"
_FINAL = {
    "A0": f"0.7 * rel + 0.2 * {_RECENCY['A0']} + 0.1 * {_IMP}",
    "A1": f"0.7 * rel + 0.2 * {_RECENCY['A1']} + 0.1 * {_IMP}",
    "A2": f"0.7 * rel + 0.2 * {_RECENCY['A2']} + 0.1 * {_IMP}",
    "A3": f"rel * (1 + 0.2 * {_RECENCY['A3']} + 0.05 * {_IMP})",
    "A4": "1.0 * rel",
}


def _blend_sql(arm: str, limit: str = "") -> str:
    return f"""with {_LEX}, {_VEC}, {_fused(60)}, r as (select m.*, p.pool_rank, p.rrf / (select max(rrf) from pool) as rel from memories m join pool p on m.id = p.id)
select id, title, type, substr(regexp_replace(content, '\\s+', ' ', 'g'), 1, 180) as snippet, pool_rank, round({_FINAL[arm]}, 6) as final from r order by final desc, pool_rank {limit}"""


def _blended(spark: SparkSession, sf_dir: str, arm: str, limit: int | None = None) -> DataFrame:
    pool = materialize(_pool(spark, sf_dir), "pool")
    return retrieval.rank_pool(pool, load(spark, sf_dir, "memories"), retrieval.ARMS[arm], NOW, None, limit)


@register(_blend_sql("A0"))
def blend_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blended(spark, sf_dir, "A0")


@register(_blend_sql("A3"))
def blend_multiplicative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blended(spark, sf_dir, "A3")


@register(_blend_sql("A2"))
def decay_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blended(spark, sf_dir, "A2")


@register(_blend_sql("A1"))
def decay_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blended(spark, sf_dir, "A1")


@register(_blend_sql("A0", "limit 10"))
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: both arms, fusion, blend, the ten best with their snippets."""
    return _blended(spark, sf_dir, "A0", 10)


@register()
def memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search of the API, with an optional tag that is dropped if nothing has it."""
    rows = load(spark, sf_dir, "memories")
    got = retrieval.memory_search(rows, QUERY_TEXT, _query_vector(rows), NOW, optional=filters.has_tag("no such tag"), limit=10)
    return got.hits.withColumns({"pool_size": F.lit(got.pool_size), "truncated": F.lit(got.truncated), "retried": F.lit(got.retried)})


_RERANK = f"""{_LEX}, {_VEC}, {_fused(60)}, qw as (select list_distinct(regexp_extract_all(lower('{QUERY_TEXT}'), '[^ ]+')) as w),
rr as (select p.id, p.pool_rank, len(list_filter((select w from qw), lambda x: list_contains(regexp_split_to_array(lower(substr(concat_ws(chr(10), m.title, nullif(m.summary, ''), m.content), 1, 1200)), '\\s+'), x))) / len((select w from qw))::double as rel from pool p join memories m on m.id = p.id)"""


@register(f"with {_RERANK} select rr.id, m.title, rr.pool_rank, round(0.7 * rel + 0.2 * {_RECENCY['A0']} + 0.1 * {_IMP}, 6) as final from rr join memories m on m.id = rr.id order by final desc, pool_rank limit 10")
def reranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool scored by a reranker (the share of the query's words), blended, the ten best."""
    rows = load(spark, sf_dir, "memories")
    pool = materialize(retrieval.reranked(_pool(spark, sf_dir), rows, QUERY_TEXT, overlap_reranker, memory_doc(F.col("title"), F.col("summary"), F.col("content"))), "reranked")
    return retrieval.rank_pool(pool, rows, retrieval.ARMS["A0"], NOW, F.col("relevance"), 10).select("id", "title", "pool_rank", "final")


@register()
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship search as callers read it: hits in order without scores, with the snippets of the query, one line block each."""
    best = _blended(spark, sf_dir, "A0", 10)
    ranked = materialize(best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("final"), "pool_rank"))).select("id", "rank"), "hits")  # ten rows
    rows = load(spark, sf_dir, "memories").join(F.broadcast(ranked), "id")
    cut = query_snippets(rows.select("id", "content", F.lit(QUERY_TEXT).alias("query")), "id", "content", "query")
    shown = rows.drop("snippet").join(cut.select("id", "snippet"), "id", "left").withColumn("at", effective_date(F.col("event_date"), F.col("created_at")))
    return rendering.public_hits(shown.select("rank", "id", rendering.hit_line().alias("line")))


@register(f"with {_LEX}, {_VEC}, {_fused(60)}, r as (select m.*, p.pool_rank, p.rrf / (select max(rrf) from pool) as rel from memories m join pool p on m.id = p.id), h as (select id, round({_FINAL['A0']}, 6) as final, pool_rank from r order by final desc, pool_rank limit 10) select 's1' as id, 'p1' as project_id, '{QUERY_TEXT}' as query, (select list(id order by pool_rank) from pool) as pool_ids, (select list(id order by final desc, pool_rank) from h) as final_ids, timestamptz '2026-07-01 00:00:00+00' as created_at")
def search_log_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the flagship search adds to the log."""
    pool = materialize(_pool(spark, sf_dir), "pool")
    best = retrieval.rank_pool(pool, load(spark, sf_dir, "memories"), retrieval.ARMS["A0"], NOW, None, 10)
    hits = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("final"), "pool_rank")))  # ten rows
    return retrieval.search_logged(hits, pool, "s1", "p1", QUERY_TEXT, NOW)


@register("select id, case when status = 'superseded' and coalesce(superseded_by, '') <> '' then 'superseded — see ' || superseded_by || chr(10) when coalesce(status, '') not in ('', 'active') then 'status=' || status || chr(10) else '' end as banner from memories")
def banners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line above each memory that is not active."""
    return load(spark, sf_dir, "memories").select("id", rendering.banner(F.col("status"), F.col("superseded_by")).alias("banner"))


_NEW = "nw as (select 'i' || intake_id as id, project_id, title, content, sha256(content) as h, created_at, case when intake_id % 3 = 0 then 'decision' else source_kind end as kind from memory_intake)"


@register(f"""with {_NEW}, up as (select nw.id as by_id, m.id as old, m.project_id from nw join (select id, project_id, row_number() over (partition by project_id order by id) as r from memories where source_kind = 'decision') m on m.project_id = nw.project_id and m.r = 1 where nw.kind = 'decision'),
live as (select distinct project_id, coalesce(lower(content_sha256), sha256(content)) as h from memories where {_LIVE}),
nd as (select id, row_number() over (partition by project_id, h order by id) as r from nw where kind is distinct from 'decision' and not exists (select 1 from live where live.project_id = nw.project_id and live.h = nw.h)),
fresh as (select id from nw where kind = 'decision' union all select nd.id from nd join nw using (id) where nd.r = 1),
f2 as (select id from fresh where true),
taken as (select old as id, min(by_id) as by_id from up group by 1)
select m.id, case when t.by_id is not null then t.by_id else m.superseded_by end as superseded_by, case when t.by_id is not null then 'superseded' end as decision_status from memories m left join taken t on t.id = m.id
union all select f2.id, null, case when nw.kind = 'decision' then 'active' end from f2 join nw using (id)""")
def stored_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories after all intake rows are stored, every third as a decision that supersedes the first decision of its project."""
    rows = load(spark, sf_dir, "memories").withColumns({"decision_status": F.lit(None).cast("string"), "supersedes_id": F.lit(None).cast("string"), "decided_at": F.lit(None).cast("timestamp")})
    first = rows.where("source_kind = 'decision'").groupBy("project_id").agg(F.min("id").alias("supersedes_id"))
    kind = F.when(F.col("intake_id") % 3 == 0, F.lit("decision")).otherwise(F.col("source_kind"))
    new = load(spark, sf_dir, "memory_intake").select(F.concat(F.lit("i"), F.col("intake_id").cast("string")).alias("id"), "project_id", "title", "content", "created_at", kind.alias("source_kind"), F.lit(None).cast("string").alias("decision_status"))
    new = new.join(first, "project_id", "left").withColumn("supersedes_id", F.when(F.col("source_kind") == "decision", F.col("supersedes_id")))
    return lifecycle.store_decisions(rows, new, NOW).select("id", "superseded_by", "decision_status")


@register(f"select id, case when {_LIVE} and summary is null and length(trim(coalesce(title, ''))) > 0 then trim(title) else summary end as summary from memories")
def summaries_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every live memory without a summary gets one from an offline model that repeats the title."""
    return lifecycle.backfill_summaries(load(spark, sf_dir, "memories"), lambda title, content: title)[0].select("id", "summary")


@register("""with n as (select file_id, count(*) as n from code_chunks group by 1) select file_id as file, part::int as part, true as bounded from (select file_id, unnest(range(case when n > 8000 then ceil(n / 8000.0)::int else 1 end)) as part from n)""")
def context_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of chunks in requests to a contextual embedder, and whether each request keeps to its bounds."""
    chunks = load(spark, sf_dir, "code_chunks")
    got = materialize(lifecycle.contextual_requests(chunks, "file_id", "start_line"), "requests")
    sizes = got.join(chunks.groupBy(F.col("file_id").alias("file")).agg(F.count(F.lit(1)).alias("n")), "file").groupBy("request").agg(F.count(F.lit(1)).alias("f"), F.sum(F.least("n", F.lit(lifecycle.CONTEXT_CHUNKS))).alias("n"))
    ok = (F.col("f") <= lifecycle.CONTEXT_FILES) & (F.col("n") <= lifecycle.CONTEXT_CHUNKS)
    return got.join(sizes.select("request", ok.alias("bounded")), "request").select("file", "part", "bounded")


def _word_judge(batch: list[tuple[str, str]]) -> str:
    """The fixed rule of an offline judge: sides that share nine tenths of their words are the same, and the later one stays."""
    import json

    words = lambda s: set((s or "").lower().split())
    same = [len(words(a) & words(b)) >= 0.9 * max(1, len(words(a) | words(b))) for a, b in batch]
    return json.dumps({str(i): {"verdict": int(s), "keep": "b"} for i, s in enumerate(same, 1)})


@register()
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query-aware snippets of the best hits."""
    best = _blended(spark, sf_dir, "A0", 10).select("id")
    rows = load(spark, sf_dir, "memories").join(F.broadcast(best), "id").select("id", "content", F.lit(QUERY_TEXT).alias("query"))
    return query_snippets(rows, "id", "content", "query")


@register(f"""with stop as (select unnest([{_STOP}]) as w),
q as (select intake_id as k, unnest(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+'))) as w from memory_intake), qq as (select * from q where w not in (select w from stop)),
d as (select id as i, unnest(list_distinct(regexp_extract_all({_TEXT}, '[a-z0-9]+'))) as w from memories), n as (select k, count(*) as n from qq group by k)
select k as query_id, i as id from qq join d using (w) join n using (k) group by k, i, n having count(*) = n""")
def conjunctive_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories that hold all words of the title of an intake row, for every intake row."""
    return retrieval.conjunctive_batch(load(spark, sf_dir, "memory_intake"), "intake_id", F.col("title"), load(spark, sf_dir, "memories"), "id", _text(), STOP_WORDS)


@register("select id, sha256(content) as content_sha256, lower(content_sha256) = sha256(content) as matches from memories")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "memories").select("id", F.sha2("content", 256).alias("h"), "content_sha256").select("id", F.col("h").alias("content_sha256"), (F.lower("content_sha256") == F.col("h")).alias("matches"))


@register("with g as (select project_id, sha256(content) as h, min(id) as keep_id, count(*) as copies from memories where content is not null group by 1, 2) select m.id, g.keep_id, g.copies from memories m join g on g.project_id = m.project_id and g.h = sha256(m.content)")
def exact_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(load(spark, sf_dir, "memories"), "id", [F.col("project_id"), F.sha2("content", 256)])


@register("select sha256(text) as h, count(*) as copies, min(doc_id) as keep_id from documents group by 1 having count(*) > 1")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("keep_id")).where("copies > 1")


@register("""with a as (select id, max(sha256(content)) as h from memories group by id), b as (select id, h from (select m.id, sha256(i.content) as h, row_number() over (partition by m.id order by i.intake_id) as r from memories m join memory_intake i on lower(trim(i.title)) = lower(trim(m.title))) where r = 1)
select coalesce(a.id, b.id) as id, case when a.id is null then 'added' when b.id is null then 'removed' when a.h is not distinct from b.h then 'unchanged' else 'changed' end as change from a full outer join b on a.id = b.id""")
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories against the first intake row of the same title as their new state."""
    rows = load(spark, sf_dir, "memories")
    old = rows.groupBy("id").agg(F.max(F.sha2("content", 256)).alias("h"))
    intake = load(spark, sf_dir, "memory_intake").select(mining.norm_key(F.col("title")).alias("k"), "intake_id", F.sha2("content", 256).alias("h"))
    new = latest(rows.select("id", mining.norm_key(F.col("title")).alias("k")).join(intake, "k"), ["id"], [F.col("intake_id")])
    return snapshot_diff(old, new.select("id", "h"), ["id"], "h")


_NEAR = """u as (select id, embedding::double[] as v from memories where embedding is not null and list_sum(list_transform(embedding, lambda x: x::double * x)) > 0),
n as (select a.id, b.id as near_id, list_cosine_similarity(a.v, b.v) as c from u a join u b on a.id <> b.id),
near as (select id, near_id, c from (select *, row_number() over (partition by id order by c desc, near_id) as r from n where c > 0.9) where r <= 3)"""


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(dedup.near_vectors(load(spark, sf_dir, "memories"), "id", "embedding"), "near")


@register(f"with {_NEAR} select id, near_id, round(c, 6) as cosine from near")
def knn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest memories of each with a cosine over 0.9."""
    return _near(spark, sf_dir).select("id", "near_id", F.round("cosine", 6).alias("cosine"))


@register(f"""with {_NEAR} select id, '[' || string_agg('{{"id":"' || near_id || '","sim":' || round(c, 4)::varchar || '}}', ',' order by c desc, near_id) || ']' as flags from near group by id""")
def dup_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.flags(_near(spark, sf_dir))


_PAIRS = f"""{_NEAR},
kp as (select project_id, sha256(content) as h, min(id) as k from memories where content is not null group by 1, 2),
ex as (select kp.k as x, m.id as y from memories m join kp on kp.project_id = m.project_id and kp.h = sha256(m.content) where m.id <> kp.k),
al as (select id as x, near_id as y, c as sim, 'sweep' as source from near union all select x, y, 1.0, 'flag' from ex),
sl as (select case when ma.created_at < mb.created_at or (ma.created_at = mb.created_at and ma.id < mb.id) then x else y end as a, case when ma.created_at < mb.created_at or (ma.created_at = mb.created_at and ma.id < mb.id) then y else x end as b, sim, source
from al join memories ma on ma.id = x join memories mb on mb.id = y),
pairs as (select a, b, round(max(sim), 4) as sim, case when count(distinct source) > 1 then 'both' else min(source) end as source from sl group by a, b)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "memories")
    sweep = _near(spark, sf_dir).select(F.col("id").alias("a"), F.col("near_id").alias("b"), F.col("cosine").alias("sim"), F.lit("sweep").alias("source"))
    # a copy is paired with the one of its group that is kept, not with every other
    copies = dedup.exact_groups(rows.where("content is not null and project_id is not null"), "id", [F.col("project_id"), F.sha2("content", 256)]).where("copies > 1 and id <> keep_id")
    same = copies.select(F.col("keep_id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("sim"), F.lit("flag").alias("source"))
    return dedup.merge_pairs(sweep.union(same), rows, "id", "created_at")


@register(f"with {_PAIRS} select a, b, sim, source from pairs")
def pair_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs of vectors and of equal texts, once each."""
    return _pairs(spark, sf_dir)


@register(f"with {_PAIRS} select floor(sim / 0.02 + 1e-9)::int as band, count(*) as n_pairs from pairs group by 1")
def pair_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.bands(_pairs(spark, sf_dir))


@register(f"with {_NEAR} select id as a, near_id as b, round(c, 4) as sim, 'flag' as source from near where round(c, 4) > 0.9")
def flagged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs read back from stored flags."""
    flags = dedup.flags(_near(spark, sf_dir))
    rows = load(spark, sf_dir, "memories").select("id").join(flags, "id", "left")
    return dedup.flagged_pairs(rows, "id", "flags")


_SIDE = "list_distinct(list_filter(string_split_regex(lower(substr(concat_ws(': ', title, regexp_replace(coalesce(nullif(summary, ''), content), '\\s+', ' ', 'g')), 1, 700)), '\\s+'), lambda x: x <> ''))"


@register(f"""with {_PAIRS}, sd as (select id, {_SIDE} as w, coalesce(pinned, false) as pin from memories),
jd as (select p.*, len(list_intersect(x.w, y.w)) >= 0.9 * greatest(1, len(list_distinct(list_concat(x.w, y.w)))) as same, x.pin, row_number() over (order by case when source = 'sweep' then 1 else 0 end, sim desc, a, b) as r from pairs p join sd x on x.id = a join sd y on y.id = b),
vd as (select *, case when not same then 0 when pin then -1 else 1 end as verdict from jd)
select a, b, sim, source, verdict::int as verdict, case when verdict = 1 then 'b' end as keep, verdict >= 0 and r <= greatest(1, (select count(*) from pairs) // 2) as carried from vd""")
def consolidation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A consolidation in two runs: the first judges half of the candidates, the second takes its report over and judges the rest."""
    rows = load(spark, sf_dir, "memories")
    pairs = materialize(_pairs(spark, sf_dir), "pairs")
    first = materialize(lifecycle.consolidate(rows, pairs, _word_judge, limit=max(1, pairs.count() // 2)), "report")
    return lifecycle.consolidate(rows, pairs, _word_judge, carried=first).select("a", "b", "sim", "source", "verdict", "keep", "carried")


@register()
def consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs judged by a fixed rule (equal sides are the same) and applied in order."""
    rows = load(spark, sf_dir, "memories")
    side = rows.select("id", dedup.judge_side(F.col("title"), F.col("summary"), F.col("content")).alias("side"), "pinned")
    pairs = _pairs(spark, sf_dir).join(side.toDF("a", "side_a", "pinned_a"), "a").join(side.toDF("b", "side_b", "pinned_b"), "b")

    judged = materialize(dedup.judge_pairs(pairs, _word_judge).withColumn("seq", F.xxhash64("a", "b")), "judged")
    after = dedup.apply_judged(rows.select("id", "status", "superseded_by", "pinned", "source_kind", "archived_at"), judged)
    return after.select("id", "status", "superseded_by")


@register("""with h as (select id, project_id, type, coalesce(source_kind, '') as k, row_number() over (partition by type, coalesce(source_kind, '') order by sha256(id), id) as r from memories)
select id, type, k as source_kind from h where r <= 3""")
def strata_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three memories of each type and kind, by a hash."""
    kind = F.coalesce("source_kind", F.lit(""))
    return mining.stratified_sample(load(spark, sf_dir, "memories"), "id", [F.col("type"), kind], 3).select("id", "type", kind.alias("source_kind"))


@register("""with c as (select lower(trim(title)) as k, count(*) as n, min(id) as m from memories group by 1)
select intake_id, coalesce(n, 0) as n_matches, case when n = 1 then m end as match_id, case when n = 1 then 'found' when n > 1 then 'ambiguous' else 'missing' end as state from memory_intake i left join c on c.k = lower(trim(i.title))""")
def title_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.resolve_titles(load(spark, sf_dir, "memory_intake"), "intake_id", "title", load(spark, sf_dir, "memories"), "id", "title")


@register("select doc_id, (coalesce(sum(ceil(n_chars / 4.0)::bigint) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) // 100000)::bigint as batch_no from documents")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in requests of 100,000 estimated tokens, by the tokens before each."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.ceil(F.col("n_chars") / 4).cast("long").alias("t"))
    return running_total(rows, "doc_id", "t").select("doc_id", F.floor(F.col("before") / 100_000).alias("batch_no"))


@register("select n_nationkey::varchar as name, n_name as value, 'nation' as description from nation")
def secret_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of each nation kept as a secret and read back."""
    rows = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("name"), F.col("n_name").alias("value"), F.lit("nation").alias("description"))
    none = rows.select("name", F.col("value").cast("binary").alias("value_enc"), "description").where("false")
    key = "0123456789abcdef"
    return get_secrets(set_secrets(none, rows, key), key)
