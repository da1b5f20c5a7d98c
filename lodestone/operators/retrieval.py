"""Hybrid retrieval: lexical and vector arms, reciprocal-rank fusion, blending, batch forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stem import analyze
from ..functions.text import effective_date, snippet, tokens
from ..session import materialize

#: Kinds of memories.
TYPES = ("episodic", "semantic", "procedural", "entity")
#: Rows each arm recalls, rows of the fused pool, the constant of reciprocal ranks.
ARM_LIMIT, POOL_LIMIT, RRF_K = 50, 25, 60


@dataclass(frozen=True)
class Blend:
    """Weights and decay of a blend. shape 'exp': e**(-age/tau); 'power': (1 + age/tau)**-power. Exempt rows don't decay."""

    relevance: float = 0.7
    recency: float = 0.2
    importance: float = 0.1
    form: str = "additive"
    shape: str = "exp"
    tau: float = 30.0
    power: float = 0.5
    tau_by_type: dict[str, float] = field(default_factory=dict)
    exempt_types: tuple[str, ...] = ()
    exempt_kinds: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        numbers = [self.relevance, self.recency, self.importance, self.tau, self.power, *self.tau_by_type.values()]
        if self.form not in ("additive", "multiplicative") or self.shape not in ("exp", "power"):
            raise ValueError("unknown form or shape")
        if not all(np.isfinite(numbers)) or min(self.relevance, self.recency, self.importance) < 0 or min([self.tau, self.power, *self.tau_by_type.values()]) <= 0:
            raise ValueError("weights must be finite and not negative, tau and power positive")


def parse_blend(given: dict[str, str | None]) -> Blend:
    """A blend from settings as text, by the names of its fields; unset and empty ones keep their defaults. Raises ValueError, naming the setting, for any that can't be read.

    tau_by_type is a JSON object of types and days; `exempt` lists types and kinds, as in 'type:entity,source_kind:decision'.
    """
    import json

    out: dict = {}
    for name, raw in given.items():
        if raw is None or raw.strip() == "":
            continue
        try:
            if name in ("form", "shape"):
                out[name] = raw
            elif name in ("relevance", "recency", "importance", "tau", "power"):
                out[name] = float(raw)
            elif name == "tau_by_type":
                got = json.loads(raw)
                if not isinstance(got, dict) or any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in got.values()):
                    raise ValueError("not an object of numbers")
                out[name] = {k: float(v) for k, v in got.items()}
            elif name == "exempt":
                parts = [x.strip().partition(":") for x in raw.split(",") if x.strip()]
                if any(k not in ("type", "source_kind") or not v for k, _, v in parts) or any(k == "type" and v not in TYPES for k, _, v in parts):
                    raise ValueError("not a list of types and kinds")
                out["exempt_types"] = tuple(v for k, _, v in parts if k == "type")
                out["exempt_kinds"] = tuple(v for k, _, v in parts if k == "source_kind")
            else:
                raise ValueError("no such setting")
        except ValueError as e:
            raise ValueError(f"{name}={raw!r}: {e}") from None
    return Blend(**out)


#: The arms that are compared with each other.
ARMS = {
    "A0": Blend(),
    "A1": Blend(tau_by_type={"semantic": 90.0, "procedural": 90.0}, exempt_types=("entity",), exempt_kinds=("decision",)),
    "A2": Blend(tau_by_type={"semantic": 90.0, "procedural": 90.0}, exempt_types=("entity",), exempt_kinds=("decision",), shape="power"),
    "A3": Blend(1.0, 0.2, 0.05, "multiplicative"),
    "A4": Blend(1.0, 0.0, 0.0),
}


def blend_column(cfg: Blend, now: str, relevance: Column, kind: Column, source_kind: Column, event_date: Column, created_at: Column, importance: Column) -> Column:
    """The blended score. A future date gives an age below 0, which is not clamped."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(effective_date(event_date, created_at))) / F.lit(86_400e6)
    tau: Column = F.lit(float(cfg.tau))
    for t, v in cfg.tau_by_type.items():
        tau = F.when(kind == t, F.lit(float(v))).otherwise(tau)
    decay = F.exp(-age / tau) if cfg.shape == "exp" else F.pow(1.0 + age / tau, F.lit(-float(cfg.power)))
    exempt = F.coalesce(kind.isin(*cfg.exempt_types), F.lit(False)) | F.coalesce(source_kind.isin(*cfg.exempt_kinds), F.lit(False))
    decay = F.when(exempt, F.lit(1.0)).otherwise(decay)
    if cfg.form == "additive":
        return cfg.relevance * relevance + cfg.recency * decay + cfg.importance * importance
    return relevance * (1.0 + cfg.recency * decay + cfg.importance * importance)


def _is(term: str) -> Callable[[Column], Column]:
    return lambda x: x == F.lit(term)


def lexical_arm(df: DataFrame, id_col: str, text: Column, terms: list[str], limit: int = ARM_LIMIT) -> DataFrame:
    """(id, lex_score, lex_rank): rows that hold all terms, by summed saturated term frequency tf / (tf + 1.2).

    A plain substring test goes first, so that only rows which may match are cut into words.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    maybe = df.select(F.col(id_col).alias("id"), low.alias("_t"))
    for t in terms:
        maybe = maybe.where(F.col("_t").contains(t))
    words = maybe.select("id", tokens(F.col("_t")).alias("_w"))
    tf = [F.size(F.filter("_w", _is(t))).cast("double") for t in terms]
    score, found = F.lit(0.0), F.lit(True)
    for c in tf:
        score, found = score + c / (c + 1.2), found & (c > 0)
    top = words.where(found).select("id", F.round(score, 6).alias("lex_score")).orderBy(F.desc("lex_score"), "id").limit(limit)
    return top.withColumn("lex_rank", F.row_number().over(Window.orderBy(F.desc("lex_score"), "id")))  # at most `limit` rows


def cover_density(positions: list[list[int]]) -> float:
    """Sum over minimal covers of 1 / (1 + width - terms): each cover holds every term once at least and no smaller cover."""
    if not positions or any(not p for p in positions):
        return 0.0
    places = sorted((p, i) for i, ps in enumerate(positions) for p in ps)
    last, total, before = {}, 0.0, -1
    for p, i in places:
        last[i] = p
        if len(last) == len(positions):
            start = min(last.values())
            if start > before:
                total += 1.0 / (1.0 + (p - start + 1) - len(positions))
                before = start
    return total


def lexical_cover_arm(df: DataFrame, id_col: str, text_cols: list[str], query: str, limit: int = ARM_LIMIT) -> DataFrame:
    """The lexical arm with stop words, stemming and cover density: (id, lex_score, lex_rank). A query of stop words finds nothing."""
    terms = sorted({t for t, _ in analyze(query)})
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, text in zip(b["id"], b["t"]):
                at: dict[str, list[int]] = {t: [] for t in terms}
                for w, p in analyze(text):
                    if w in at:
                        at[w].append(p)
                if terms and all(at.values()):
                    out.append((key, round(cover_density(list(at.values())), 6)))
            yield pd.DataFrame(out, columns=["id", "lex_score"])

    rows = df.select(F.col(id_col).alias("id"), F.concat_ws(" ", *text_cols).alias("t"))
    for t in terms:  # stemming rewrites at most the last three letters of a stem, so what is before is in the word itself
        rows = rows.where(F.lower("t").contains(t[: max(1, len(t) - 3)]))
    top = rows.mapInPandas(run, f"id {kind}, lex_score double").orderBy(F.desc("lex_score"), "id").limit(limit)
    return top.withColumn("lex_rank", F.row_number().over(Window.orderBy(F.desc("lex_score"), "id")))


def _best_of(score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The k rows of the largest scores, of equal ones those of the least place."""
    at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k]) if k < len(score) else np.arange(len(score))
    return at[np.lexsort((place[at], -score[at]))[:k]]


def vector_scores(df: DataFrame, id_col: str, vec_col: str, queries: dict[str, np.ndarray], limit: int) -> DataFrame:
    """(query_id, id, cosine): per query and batch of rows the nearest `limit`, by the cosine to six places and then by id, as the ranks that follow go. `queries` is a stated set, held by each task."""
    names = list(queries)
    q = np.stack([np.asarray(queries[n], float) for n in names]) if names else np.zeros((0, 1))
    norm = np.sqrt((q * q).sum(1))
    kind = df.schema[id_col].dataType.simpleString()
    dim = q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not names:
                continue
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
            n = np.sqrt((x * x).sum(1))
            ok = np.flatnonzero(np.isfinite(n) & (n > 0))
            sims = (x[ok] @ q.T) / (n[ok, None] * norm[None, :])
            k = min(limit, len(ok))
            if not k:
                continue
            sims = np.round(sims, 6)
            own = b.column("id").take(pa.array(ok))
            place = np.empty(len(ok), np.int64)
            place[pc.sort_indices(own).to_numpy()] = np.arange(len(ok))
            at = np.stack([_best_of(sims[:, j], place, k) for j in range(len(names))])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, k).tolist()), own.take(pa.array(at.ravel())), pa.array(np.take_along_axis(sims.T, at, 1).ravel())], ["query_id", "id", "cosine"])

    rows = df.where(F.col(vec_col).isNotNull() & (F.size(vec_col) == dim)).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(~F.exists("v", lambda x: x.isNull()))
    return rows.mapInArrow(run, f"query_id string, id {kind}, cosine double").where(~F.isnan("cosine"))


def vector_arm(df: DataFrame, id_col: str, vec_col: str, query: list[float], limit: int = ARM_LIMIT) -> DataFrame:
    """(id, cosine, vec_rank): the rows nearest to one query vector; rows without a usable vector don't take part."""
    near = vector_scores(df, id_col, vec_col, {"q": np.asarray(query, float)}, limit).select("id", F.round("cosine", 6).alias("cosine")).orderBy(F.desc("cosine"), "id").limit(limit)
    return near.withColumn("vec_rank", F.row_number().over(Window.orderBy(F.desc("cosine"), "id")))


def fuse(lexical: DataFrame, vector: DataFrame, k: float = RRF_K, limit: int = POOL_LIMIT) -> DataFrame:
    """(id, lex_rank, vec_rank, rrf, pool_rank) of the rows in either arm, an absent arm counting 0."""
    if not (np.isfinite(k) and k > 0):
        raise ValueError("k must be finite and positive")
    part = lambda r: F.coalesce(F.lit(1.0) / (F.lit(float(k)) + F.col(r)), F.lit(0.0))
    both = lexical.select("id", "lex_rank").join(vector.select("id", "vec_rank"), "id", "full_outer")
    pool = both.withColumn("rrf", F.round(part("lex_rank") + part("vec_rank"), 9)).orderBy(F.desc("rrf"), "id").limit(limit)
    return pool.withColumn("pool_rank", F.row_number().over(Window.orderBy(F.desc("rrf"), "id")))


def rank_pool(pool: DataFrame, rows: DataFrame, cfg: Blend, now: str, relevance: Column | None = None, limit: int | None = None) -> DataFrame:
    """Pool rows with title, type, snippet and final score, best first; relevance is by default rrf over its largest value.

    rows: (id, title, type, content, importance, source_kind, event_date, created_at). Missing relevance counts 0,
    missing importance 0.5. Ties keep the order of the pool.
    """
    held = rows.join(F.broadcast(pool), "id")  # the pool has at most its limit
    best = pool.agg(F.max("rrf").alias("best"))
    held = held.join(F.broadcast(best))
    rel = F.coalesce(relevance if relevance is not None else F.col("rrf") / F.col("best"), F.lit(0.0))
    final = blend_column(cfg, now, rel, F.col("type"), F.col("source_kind"), F.col("event_date"), F.col("created_at"), F.coalesce(F.col("importance").cast("double"), F.lit(0.5)))
    out = held.select("id", "title", "type", snippet(F.col("content")).alias("snippet"), "pool_rank", F.round(final, 6).alias("final")).orderBy(F.desc("final"), "pool_rank")
    return out if limit is None else out.limit(limit)


def code_rank(pool: DataFrame, scores: DataFrame | None, limit: int) -> DataFrame:
    """(id, score, pool_rank): by the reranker's scores (id, score); if it gave none, the pool's order with score 0."""
    if scores is None or scores.isEmpty():
        return pool.select("id", F.lit(0.0).alias("score"), "pool_rank").orderBy("pool_rank").limit(limit)
    return pool.join(scores, "id").select("id", "score", "pool_rank").orderBy(F.desc("score"), "pool_rank").limit(limit)


@dataclass
class SearchResult:
    hits: DataFrame
    pool_size: int
    requested: int
    truncated: bool
    retried: bool


def memory_search(df: DataFrame, query: str, vector: list[float], now: str, strict: Column | None = None, optional: Column | None = None, cfg: Blend | None = None, limit: int = 5, scorer: Callable[[DataFrame], Column] | None = None) -> SearchResult:
    """The whole search: both arms over live rows that meet the filters, fusion, blend; without any result the optional filters are dropped once."""
    from .filters import live

    base = df.where(live() & (strict if strict is not None else F.lit(True)))
    retried = False
    for cond in [optional, None] if optional is not None else [None]:
        rows = base if cond is None else base.where(cond)
        pool = fuse(lexical_cover_arm(rows, "id", ["title", "content"], query), vector_arm(rows, "id", "embedding", vector))
        size = pool.count()
        if size:
            break
        retried = optional is not None and cond is not None
    hits = rank_pool(pool, base, cfg or Blend(), now, scorer(pool) if scorer else None, limit)
    n = min(limit, size)
    return SearchResult(hits, size, limit, n == limit and size > limit, retried)


def reranked(pool: DataFrame, rows: DataFrame, query: str, rerank: Callable[[str, list[str]], list[float]], doc: Column) -> DataFrame:
    """pool with `relevance`, by a reranker that scores the documents of one query; null for all if it fails or gives another number of scores. A pool has at most its limit of rows."""
    held = pool.join(rows.select("id", doc.alias("_doc")), "id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pool.schema.fields) + ", relevance double"
    names = pool.columns

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("pool_rank")
        try:
            got = [float(x) for x in rerank(query, b["_doc"].fillna("").tolist())]
        except Exception:
            got = []
        scores = got if len(got) == len(b) else [None] * len(b)
        return b.assign(relevance=pd.Series(scores, index=b.index, dtype=float))[[*names, "relevance"]]

    return held.withColumn("_g", F.lit(1)).groupBy("_g").applyInPandas(run, schema)


def search_logged(hits: DataFrame, pool: DataFrame, search_id: str, project: str, query: str, at: str) -> DataFrame:
    """The row of the search log: what was asked, the ids of the pool and of the hits, each in order."""
    ids = lambda df, by: df.agg(F.coalesce(F.transform(F.array_sort(F.collect_list(F.struct(by, "id"))), lambda x: x["id"]), F.array().cast("array<string>")).alias("ids"))
    both = ids(pool, "pool_rank").toDF("pool_ids").crossJoin(ids(hits, "rank").toDF("final_ids"))  # one row each
    return both.select(F.lit(search_id).alias("id"), F.lit(project).alias("project_id"), F.lit(query).alias("query"), "pool_ids", "final_ids", F.lit(at).cast("timestamp").alias("created_at"))


def conjunctive_batch(queries: DataFrame, query_id: str, query_text: Column, docs: DataFrame, doc_id: str, doc_text: Column, stop: frozenset[str]) -> DataFrame:
    """(query_id, id): the documents that hold every word of a query, for a table of queries; queries of stop words only find nothing.

    Each query meets the postings of its two rarest words alone, so a query of common words doesn't meet the whole list of
    one; its other words are then looked up in the document, of which only the words that some query asks for are kept.
    """
    stops = F.array(*[F.lit(w) for w in sorted(stop)]) if stop else F.array().cast("array<string>")
    q = queries.select(F.col(query_id).alias("query_id"), F.array_except(F.array_distinct(tokens(query_text)), stops).alias("terms")).where(F.size("terms") > 0)
    d = docs.select(F.col(doc_id).alias("id"), F.array_except(F.array_distinct(tokens(doc_text)), stops).alias("held"))
    asked = q.select(F.explode("terms").alias("term")).distinct()
    posted = materialize(d.select("id", F.explode("held").alias("term")).join(asked, "term", "left_semi"), "postings")
    freq = posted.groupBy("term").count()
    rare = q.select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("term")).join(freq, "term", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("c"), "term")))  # the words of one query
    least = rare.groupBy("query_id").agg(F.first("n").alias("n"), order.alias("t")).select("query_id", "n", F.col("t")[0]["term"].alias("first"), F.try_element_at("t", F.lit(2))["term"].alias("second"), F.transform("t", lambda x: x["term"]).alias("terms"))
    one = least.where("second is null").select("query_id", F.col("first").alias("term")).join(posted, "term").select("query_id", "id")
    # pairs of words that some query has as its rarest two, and the documents that hold both
    pairs = least.where("second is not null").select("first", "second").distinct()
    both = pairs.join(posted.withColumnRenamed("term", "first"), "first").join(posted.withColumnRenamed("term", "second"), ["second", "id"]).select("first", "second", "id")
    some = least.where("second is not null").join(both, ["first", "second"]).select("query_id", "id", "n", "terms")
    kept = posted.groupBy("id").agg(F.collect_list("term").alias("held"))  # asked words of one document
    more = some.where("n > 2").join(kept, "id").where(F.size(F.array_except("terms", "held")) == 0).select("query_id", "id")
    return one.union(some.where("n = 2").select("query_id", "id")).union(more)
