"""Queries over files and chunks: windows, symbols, graphs, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import SYMBOL, code_doc, code_snippet, line_range
from ..operators import filters, graph, retrieval
from ..operators.chunking import cached_values, line_windows
from ..operators.hits import merge_adjacent
from ..operators.rendering import graph_line, status_line
from ..operators.snapshot import latest
from ..operators.symbols import extract_all
from ..session import load, materialize
from .registry import register


@register("select id, file_path from code_chunks where contains(file_path, '-parser')")
def path_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "code_chunks").where(filters.in_path("-parser")).select("id", "file_path")


@register("select id, language from code_chunks where ends_with(file_path, '.py') and language = 'python'")
def ext_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "code_chunks").where(filters.with_extension("..py") & (F.col("language") == "python")).select("id", "language")


@register("select id, substr(array_to_string(string_split(content, chr(10))[1:4], chr(10)), 1, 240) as snippet, substr(concat_ws(chr(10), file_path, content), 1, 1500) as doc from code_chunks")
def code_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "code_chunks").select("id", code_snippet(F.col("content")).alias("snippet"), code_doc(F.col("file_path"), F.col("content")).alias("doc"))


@register("""with l as (select doc_id, string_split(text, chr(10)) as l from documents), e as (select doc_id, list_transform(l[3:6], lambda x, i: (i + 2)::varchar || chr(9) || x) as l from l)
select doc_id, substr(array_to_string(l, chr(10)), 1, 90000) as lines from e""")
def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 3 to 6 of each document, numbered."""
    return load(spark, sf_dir, "documents").select("doc_id", line_range(F.col("text"), 3, 6).alias("lines"))


def _windows_sql(table: str, key: str, text: str, window: int, overlap: int) -> str:
    step = window - overlap
    return f"""with l as (select {key} as k, string_split({text}, chr(10)) as l from {table} where {text} is not null),
s as (select k, l, unnest(range(0, greatest(ceil((len(l) - {window})::double / {step})::int, 0) * {step} + 1, {step}))::int as s from l),
w as (select k, s + 1 as start_line, least(s + {window}, len(l))::int as end_line, array_to_string(l[s + 1:s + {window}], chr(10)) as t from s),
p as (select k, start_line, end_line, substr(t, 1, 4000) as content, regexp_extract(t, '{SYMBOL}', ['kind', 'name']) as y from w where regexp_matches(t, '\\S'))
select k as {key}, start_line, end_line, sha256(content) as content_sha256, nullif(y.name, '') as symbol_name, nullif(y.kind, '') as symbol_kind from p"""


@register(_windows_sql("documents", "doc_id", "text", 60, 12))
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in windows of 60 lines that share 12."""
    return line_windows(load(spark, sf_dir, "documents"), ["doc_id"], F.col("text")).drop("content")


@register(_windows_sql("documents", "doc_id", "text", 6, 2))
def chunk_windows_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_windows(load(spark, sf_dir, "documents"), ["doc_id"], F.col("text"), 6, 2).drop("content")


@register("with h as (select content_sha256, min(id) as m from code_chunks where embedding is not null group by 1) select id, m as cached_from from code_chunks c left join h on h.content_sha256 = c.content_sha256 where c.embedding is null")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without a vector, and the chunk of the same content whose vector they can have."""
    return cached_values(load(spark, sf_dir, "code_chunks").select("id", "content_sha256", "embedding"), "id", "content_sha256", "embedding")


_CODE_TERMS = ["return", "const"]
_CODE_ARMS = """w as (select id, regexp_extract_all(lower(content), '[a-z0-9]+') as t from code_chunks where language = 'typescript'),
tf as (select id, len(list_filter(t, lambda x: x = 'return'))::double as f0, len(list_filter(t, lambda x: x = 'const'))::double as f1 from w),
lex as (select id, row_number() over (order by s desc, id)::int as lex_rank from (select id, round(f0 / (f0 + 1.2) + f1 / (f1 + 1.2), 6) as s from tf where f0 > 0 and f1 > 0) order by s desc, id limit 50),
u as (select id, embedding::double[] as v from code_chunks where language = 'typescript' and embedding is not null and list_sum(list_transform(embedding, lambda x: x::double * x)) > 0),
q as (select v as qv from u order by id limit 1),
vec as (select id, row_number() over (order by c desc, id)::int as vec_rank from (select id, round(list_cosine_similarity(v, qv), 6) as c from u, q) order by c desc, id limit 50),
f as (select coalesce(l.id, v.id) as id, round(coalesce(1.0 / (60::double + lex_rank), 0) + coalesce(1.0 / (60::double + vec_rank), 0), 9) as rrf from lex l full outer join vec v on l.id = v.id),
pool as (select id, rrf, row_number() over (order by rrf desc, id)::int as pool_rank from f order by rrf desc, id limit 25)"""


def _code_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "code_chunks").where("language = 'typescript'")
    usable = rows.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)).orderBy("id").select("embedding").first()
    query = [float(x) for x in usable[0]] if usable else []
    return retrieval.fuse(retrieval.lexical_arm(rows, "id", F.col("content"), _CODE_TERMS), retrieval.vector_arm(rows, "id", "embedding", query))


@register(f"with {_CODE_ARMS} select id, 0.0::double as score, pool_rank from pool order by pool_rank limit 20")
def code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search of TypeScript chunks without a reranker: the pool's order."""
    return retrieval.code_rank(_code_pool(spark, sf_dir), None, 20)


@register()
def code_search_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hits, with adjacent ranges of a file merged."""
    best = retrieval.code_rank(_code_pool(spark, sf_dir), None, 20)
    rows = load(spark, sf_dir, "code_chunks").join(F.broadcast(best), "id")
    return merge_adjacent(rows, ["repository_id", "file_path"], "pool_rank", "start_line", "end_line")


@register()
def merged_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of each file as one result list, merged up to 120 lines."""
    rows = load(spark, sf_dir, "code_chunks")
    return merge_adjacent(rows.withColumn("rank", F.pmod(F.xxhash64("id"), F.lit(1 << 40))), ["repository_id", "file_path"], "rank", "start_line", "end_line")


@register()
def symbol_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols, calls and imports of all TypeScript chunks."""
    rows = load(spark, sf_dir, "code_chunks").where(F.lower("file_path").rlike(r"\.tsx?$"))
    return extract_all(rows, ["id"], "file_path", "content")


_SYM = "sym as (select distinct repository_id as repo, file_path as file, symbol_name as name, repository_id || '|' || file_path || '|' || symbol_name as id from code_chunks where symbol_name is not null)"
_STAGED = "st as (select distinct repository_id as repo, symbol_name as from_name, file_path as from_file, unnest(regexp_extract_all(content, '([A-Za-z_$][A-Za-z0-9_$]*)\\(', 1)) as to_name from code_chunks where symbol_name is not null)"


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "code_chunks").where("symbol_name is not null").select(F.col("repository_id").alias("repo"), F.col("file_path").alias("file"), F.col("symbol_name").alias("name")).distinct()
    return rows.withColumn("id", F.concat_ws("|", "repo", "file", "name"))


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    called = F.regexp_extract_all("content", F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)\("), F.lit(1))
    rows = load(spark, sf_dir, "code_chunks").where("symbol_name is not null")
    return rows.select(F.col("repository_id").alias("repo"), F.col("symbol_name").alias("from_name"), F.col("file_path").alias("from_file"), F.explode(F.array_distinct(called)).alias("to_name")).distinct()


_CALLS = f"{_SYM}, {_STAGED}, calls as (select distinct f.id as from_symbol, t.id as to_symbol from st join sym f on f.repo = st.repo and f.name = st.from_name and f.file = st.from_file join sym t on t.repo = st.repo and t.name = st.to_name)"


@register(f"with {_CALLS} select * from calls")
def edge_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by name, resolved within the repository."""
    return graph.resolve_calls(_staged(spark, sf_dir), _symbols(spark, sf_dir))


@register(f"with {_SYM}, {_STAGED} select distinct f.id as from_symbol, t.id as to_symbol from st join sym t on t.repo = st.repo and t.name = st.to_name and t.file <> st.from_file join sym f on f.repo = st.repo and f.file = st.from_file")
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names used in a file, resolved to other files of the repository."""
    return graph.resolve_imports(_staged(spark, sf_dir), _symbols(spark, sf_dir))


@register(f"with {_CALLS}, named as (select c.from_symbol as src, c.to_symbol as dst, s.name from calls c join sym s on s.id = c.to_symbol), many as (select src, name from named group by 1, 2 having count(distinct dst) > 1) select distinct dst as id from named join many using (src, name)")
def ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = _symbols(spark, sf_dir)
    calls = graph.resolve_calls(_staged(spark, sf_dir), symbols).toDF("src", "dst")
    return graph.ambiguous(calls, symbols.select("id", "name"))


@register("select name, count(*) as n_symbols, count(distinct repo) as n_repos from (select distinct repository_id as repo, file_path, symbol_name as name from code_chunks where symbol_name is not null) group by 1 having count(*) > 1")
def symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that more than one file declares."""
    return _symbols(spark, sf_dir).groupBy("name").agg(F.count(F.lit(1)).alias("n_symbols"), F.count_distinct("repo").alias("n_repos")).where("n_symbols > 1")


_ASOF = """with y as (select file_id, start_line, min(symbol_name) as name from code_chunks where symbol_name is not null group by 1, 2), s as (select id, file_id, end_line from code_chunks),
f as (select file_id, arg_min(name, start_line) as first_name from y group by 1)
select s.id, coalesce((select y.name from y where y.file_id = s.file_id and y.start_line <= s.end_line order by y.start_line desc limit 1), f.first_name) as enclosing from s left join f on f.file_id = s.file_id"""


@register(_ASOF)
def enclosing_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the last line of each chunk the symbol it lies in."""
    rows = load(spark, sf_dir, "code_chunks")
    sites = rows.select("id", "file_id", "end_line")
    symbols = rows.where("symbol_name is not null").select("file_id", "start_line", "symbol_name")
    return graph.enclosing(sites, symbols, ["file_id"], "end_line", "start_line", "symbol_name").select("id", "enclosing")


_EDGES = f"{_CALLS}, ed as (select from_symbol as src, to_symbol as dst from calls)"
_CALLERS = "seed as (select src as id from ed group by src order by count(*) desc, src limit 2)"
_CALLED = "seed as (select dst as id from ed group by dst order by count(*) desc, dst limit 2)"
_OUT = "wout as (select id, 0 as depth from seed union select e.dst, w.depth + 1 from wout w join ed e on e.src = w.id where w.depth < 4)"
_IN = "win as (select id, 0 as depth from seed union select e.src, w.depth + 1 from win w join ed e on e.dst = w.id where w.depth < 4)"


def _call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole call graph of the chunks."""
    return materialize(graph.resolve_calls(_staged(spark, sf_dir), _symbols(spark, sf_dir)).toDF("src", "dst"), "edges")


def _busiest(edges: DataFrame, end: str) -> DataFrame:
    """The two symbols with the most calls out (src) or in (dst)."""
    return edges.groupBy(F.col(end).alias("id")).count().orderBy(F.desc("count"), "id").limit(2).select("id")


def _expanded(spark: SparkSession, sf_dir: str, direction: str) -> DataFrame:
    edges = _call_edges(spark, sf_dir)
    return graph.expand(edges, _busiest(edges, "dst" if direction == "in" else "src"), direction, 4)


@register(f"with recursive {_EDGES}, {_CALLERS}, {_OUT} select id, min(depth)::int as depth, case when min(depth) = 0 then 'def' else 'call→' end as label from wout group by id")
def graph_expand_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir, "out")


@register(f"with recursive {_EDGES}, {_CALLED}, {_IN} select id, min(depth)::int as depth, case when min(depth) = 0 then 'def' else 'call←' end as label from win group by id")
def graph_expand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir, "in")


_BOTH = f"{_EDGES}, {_CALLERS}, {_OUT}, {_IN}, al as (select id, depth, 0 as late from wout union all select id, depth, 1 from win), exp as (select id, min(depth)::int as depth, case when min(depth) = 0 then 'def' when arg_min(late, depth * 2 + late) = 0 then 'call→' else 'call←' end as label from al group by id)"


@register(f"with recursive {_BOTH} select id, depth, label from exp")
def graph_expand_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir, "both")


@register(
    f"""with recursive {_BOTH}, nm as (select c.src, c.dst, s.name from ed c join sym s on s.id = c.dst), amb as (select distinct dst from nm join (select src, name from nm group by 1, 2 having count(distinct dst) > 1) g using (src, name))
select e.id, s.name, s.file, e.depth, e.label as edge_type, (e.depth > 0 and e.id in (select dst from amb)) as ambiguous, repeat('  ', e.depth) || '[d' || e.depth || ' ' || e.label || '] ' || s.name || '  ' || s.file || ':' || case when e.depth > 0 and e.id in (select dst from amb) then ' (name-matched, may be ambiguous)' else '' end || '  [' || e.id || ']' as line
from exp e join sym s on s.id = e.id order by e.depth, s.file, e.id limit 50"""
)
def graph_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expansion as callers read it: ordered, its first 50 rows, ambiguous hops flagged, each as a line."""
    edges = _call_edges(spark, sf_dir)
    symbols = _symbols(spark, sf_dir).withColumn("start_line", F.lit(None).cast("int"))
    got = graph.graph_rows(edges.withColumn("kind", F.lit("call")), symbols, _busiest(edges, "src"), "both", 4, 50)
    return got.select("id", "name", "file", "depth", "edge_type", "ambiguous", graph_line().alias("line"))


_PATHS = f"with recursive {_EDGES}, {_CALLERS}, p as (select id, 0 as depth, [id] as path from seed union all select e.dst, p.depth + 1, list_append(p.path, e.dst) from p join ed e on e.src = p.id where p.depth < 4 and not list_contains(p.path, e.dst))"


@register(_PATHS + " select id, depth::int as depth, array_to_string(path, '>') as path from (select *, row_number() over (partition by id order by depth, path) as r from p) where r = 1")
def trace_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest path from a seed to every symbol within four calls."""
    edges = _call_edges(spark, sf_dir)
    return graph.shortest_paths(edges, _busiest(edges, "src"), 4).select("id", "depth", F.array_join("path", ">").alias("path"))


@register(_PATHS + ", far as (select id from p group by id order by min(depth) desc, id limit 1), t as (select sym.name as n from sym join far on sym.id = far.id), hit as (select path from p join sym on sym.id = p.id where sym.name in (select n from t) order by depth, path limit 1) select unnest(path) as id, unnest(range(len(path)))::int as depth from hit")
def trace_to_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path to the name of the farthest symbol."""
    edges = _call_edges(spark, sf_dir)
    seeds = _busiest(edges, "src")
    names = _symbols(spark, sf_dir).select("id", "name")
    far = graph.shortest_paths(edges, seeds, 4).orderBy(F.desc("depth"), "id").select("id").limit(1)
    target = names.join(far, "id").first()
    return graph.trace(edges, seeds, names, target["name"] if target else "", 4)[0]


def _extracted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges of all TypeScript chunks, by the scanner, with lines of the file."""
    rows = load(spark, sf_dir, "code_chunks").where(F.lower("file_path").rlike(r"\.tsx?$")).select(F.col("repository_id").alias("repo"), F.col("file_path").alias("file"), "start_line", "content")
    got = extract_all(rows, ["repo", "file", "start_line"], "file", "content").withColumn("line", F.col("line") + F.col("start_line") - 1)
    return graph.code_graph(got)


@register()
def code_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code graph as one plan: symbols, calls and imports found by the scanner, resolved by name, as edges with their kind."""
    return _extracted(spark, sf_dir)[1]


@register()
def code_graph_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that a caller of the scanned graph reaches by a name it shares with others."""
    symbols, edges = _extracted(spark, sf_dir)
    return graph.ambiguous(edges.where("kind = 'call'").select("src", "dst"), symbols.select("id", "name"))


@register()
def code_graph_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanned graph around its two busiest callers, ordered and flagged, at depth 6."""
    symbols, edges = _extracted(spark, sf_dir)
    edges = materialize(edges, "edges")
    return graph.graph_rows(edges, symbols, _busiest(edges.where("kind = 'call'"), "src"), "both", 6, 200)


@register("select repository_id as repo, file_path as file, symbol_name as name, min(start_line) as line from code_chunks where symbol_name = (select symbol_name from code_chunks where symbol_name is not null group by 1 order by count(*) desc, 1 limit 1) group by 1, 2, 3 order by file, line, repo limit 50")
def symbol_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the name that most chunks declare is declared, in the order of file and line."""
    rows = load(spark, sf_dir, "code_chunks").where("symbol_name is not null")
    name = rows.groupBy("symbol_name").count().orderBy(F.desc("count"), "symbol_name").limit(1).select("symbol_name")
    hit = rows.join(F.broadcast(name), "symbol_name").groupBy(F.col("repository_id").alias("repo"), F.col("file_path").alias("file"), F.col("symbol_name").alias("name")).agg(F.min("start_line").alias("line"))
    return hit.orderBy("file", "line", "repo").limit(50)


@register("select n.n_nationkey, n.n_name, r.r_name from nation n join region r on r.r_regionkey = n.n_regionkey where n.n_name ilike '%a%' or n.n_nationkey::varchar = '3'")
def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by a pattern of their name or by id, with what they point to."""
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    hit = n.where(F.col("n_name").ilike("%a%") | (F.col("n_nationkey").cast("string") == "3"))
    return hit.join(r, hit.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")


@register("select repository_id, id, indexed_at from (select *, row_number() over (partition by repository_id order by indexed_at desc, id) as r from files) where r = 1")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of each repository that was indexed last."""
    return latest(load(spark, sf_dir, "files"), ["repository_id"], [F.desc("indexed_at"), F.col("id")]).select("repository_id", "id", "indexed_at")


@register("""with c as (select repository_id, count(*) as n_chunks, count(distinct file_id) as n_files, count(distinct language) as n_languages from code_chunks group by 1), f as (select repository_id, count(*) as files_total, max(indexed_at) as last_indexed from files group by 1)
select coalesce(c.repository_id, f.repository_id) as repository_id, coalesce(n_chunks, 0) as n_chunks, coalesce(n_files, 0) as n_files, coalesce(n_languages, 0) as n_languages, coalesce(files_total, 0) as files_total, last_indexed from c full outer join f on c.repository_id = f.repository_id""")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = load(spark, sf_dir, "code_chunks").groupBy("repository_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("file_id").alias("n_files"), F.count_distinct("language").alias("n_languages"))
    files = load(spark, sf_dir, "files").groupBy("repository_id").agg(F.count(F.lit(1)).alias("files_total"), F.max("indexed_at").alias("last_indexed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return chunks.join(files, "repository_id", "full_outer").select("repository_id", zero("n_chunks"), zero("n_files"), zero("n_languages"), zero("files_total"), "last_indexed")


@register("""with c as (select repository_id, count(*) as n_chunks, count(distinct file_id) as n_files from code_chunks group by 1), f as (select repository_id, count(*) as files_total, max(indexed_at) as t from files group by 1)
select coalesce(c.repository_id, f.repository_id) as repository_id, coalesce(c.repository_id, f.repository_id) || ': ' || coalesce(n_files, 0) || '/' || coalesce(files_total, 0) || ' files, ' || coalesce(n_chunks, 0) || ' chunks, last indexed ' || coalesce(strftime(t, '%Y-%m-%d %H:%M'), 'never') as line from c full outer join f on c.repository_id = f.repository_id""")
def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index status as lines."""
    return index_status(spark, sf_dir).select("repository_id", status_line().alias("line"))


@register("""with s as (select id, coalesce(language, '') as l, split_part(path, '/', 1) as d, row_number() over (partition by coalesce(language, ''), split_part(path, '/', 1) order by sha256(id), id) as r from files)
select id, l as language, d as top_dir from s where r <= 2""")
def file_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of each language and top directory, by a hash."""
    from ..operators.mining import stratified_sample

    lang, top = F.coalesce("language", F.lit("")), F.split_part("path", F.lit("/"), F.lit(1))
    return stratified_sample(load(spark, sf_dir, "files"), "id", [lang, top], 2).select("id", lang.alias("language"), top.alias("top_dir"))


@register("select id, file_id, lag(id) over (partition by file_id order by start_line, id) as previous_id, start_line - lag(end_line) over (partition by file_id order by start_line, id) as gap from code_chunks")
def chunk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk before each in its file, and the lines between them."""
    w = Window.partitionBy("file_id").orderBy("start_line", "id")
    return load(spark, sf_dir, "code_chunks").select("id", "file_id", F.lag("id").over(w).alias("previous_id"), (F.col("start_line") - F.lag("end_line").over(w)).alias("gap"))
