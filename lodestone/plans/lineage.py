"""Supersession chains: problem 6 and the chains of gold rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import chains, descendants, hierarchy
from ..session import load, materialize
from .registry import register

_WALK = """with recursive walk as (
  select id, id as here, superseded_by as nxt, 0 as d, [id] as seen, cast(null as varchar) as loop_id from memories where superseded_by is not null
  union all
  select w.id, m.id, m.superseded_by, w.d + 1, list_append(w.seen, m.id),
    case when list_contains(w.seen, m.id) then list_min(w.seen[list_position(w.seen, m.id):]) end
  from walk w join memories m on m.id = w.nxt where w.loop_id is null),
ended as (select id, coalesce(loop_id, here) as root_id, case when loop_id is null then d else -1 end as depth, seen from (
  select *, row_number() over (partition by id order by d desc) as r from walk) where r = 1)"""

#: Every memory, with what its pointers reach, each once.
_CHAINS = """with recursive walk as (
  select id, id as here, superseded_by as nxt, [id] as seen, cast(null as varchar) as back from memories where id is not null
  union all
  select w.id, m.id, m.superseded_by, case when list_contains(w.seen, m.id) then w.seen else list_append(w.seen, m.id) end, case when list_contains(w.seen, m.id) then m.id end
  from walk w join memories m on m.id = w.nxt where w.back is null),
chains as (select id, case when back is null then here else list_min(seen[list_position(seen, back):]) end as root_id, case when back is null then len(seen) - 1 else -1 end::int as depth, seen,
  case when back = id then 'on loop' when back is not null then 'leads to loop' when nxt is null then 'sound' when here = id then 'dangling' else 'leads to dangling' end as status
  from walk w where back is not null or nxt is null or nxt not in (select id from memories where id is not null))"""


@register(_WALK + " select id, root_id, depth::int as depth from ended")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(load(spark, sf_dir, "memories").select("id", "superseded_by"), "id", "superseded_by").select("id", "root_id", "depth")


@register(_WALK + " select id, root_id, depth::int as depth, array_to_string(seen, '>') as path from ended where depth >= 0")
def p6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path of every memory whose chain is sound, from itself to its root."""
    got = hierarchy(load(spark, sf_dir, "memories").select("id", "superseded_by"), "id", "superseded_by", with_path=True)
    return got.where("depth >= 0").select("id", "root_id", "depth", F.array_join("path", ">").alias("path"))


@register(_WALK + ", steps as (select id, unnest(seen) as ancestor_id, unnest(range(len(seen))) as distance from ended where depth >= 0) select ancestor_id, id, distance::int as distance from steps where distance > 0")
def p6_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All memories that a memory replaced, directly or not."""
    got = hierarchy(load(spark, sf_dir, "memories").select("id", "superseded_by"), "id", "superseded_by", with_path=True)
    return descendants(materialize(got, "paths"), "id")


@register(_CHAINS + " select id, root_id, depth, status, array_to_string(seen, '>') as path from chains")
def p6_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every memory with its path, depth and root, and whether its chain is sound, ends at a pointer to nowhere, or is or leads to a loop, around which the path goes once."""
    got = chains(load(spark, sf_dir, "memories").select("id", "superseded_by"), "id", "superseded_by")
    return got.select("id", "root_id", "depth", "status", F.array_join("path", ">").alias("path"))


@register(_CHAINS + ", steps as (select id, unnest(seen) as ancestor_id, unnest(range(len(seen))) as distance from chains) select ancestor_id, id, distance::int as distance from steps where distance > 0")
def p6_all_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All memories that a memory replaced, directly or not, also where the chain runs into a loop; distance is the least number of steps."""
    got = chains(load(spark, sf_dir, "memories").select("id", "superseded_by"), "id", "superseded_by")
    return descendants(materialize(got, "paths"), "id")


@register(
    _WALK
    + """, gold as (select id, unnest(relevant_ids) as relevant_id from recall_eval where id is not null)
select g.id, g.relevant_id, coalesce(case when e.depth >= 0 then e.root_id end, g.relevant_id) as live_id from gold g left join ended e on e.id = g.relevant_id"""
)
def gold_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each relevant id of the evaluation rows with the memory that stands for it now."""
    chains = hierarchy(load(spark, sf_dir, "memories").select("id", "superseded_by"), "id", "superseded_by").where("depth >= 0")
    gold = load(spark, sf_dir, "recall_eval").select("id", F.explode("relevant_ids").alias("relevant_id"))
    return gold.join(chains.select(F.col("id").alias("relevant_id"), "root_id"), "relevant_id", "left").select("id", "relevant_id", F.coalesce("root_id", "relevant_id").alias("live_id"))


@register(
    _WALK
    + """, steps as (select id, unnest(seen) as ancestor_id, unnest(range(len(seen))) as distance from ended where depth >= 0)
select s.ancestor_id as decision_id, s.id, s.distance::int as distance from steps s join memories m on m.id = s.ancestor_id where m.source_kind = 'decision' and distance > 0"""
)
def decision_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each decision took the place of, directly or not."""
    rows = load(spark, sf_dir, "memories")
    paths = materialize(hierarchy(rows.select("id", "superseded_by"), "id", "superseded_by", with_path=True), "paths")
    heads = rows.where("source_kind = 'decision'").select(F.col("id").alias("ancestor_id"))
    return descendants(paths, "id").join(heads, "ancestor_id", "left_semi").select(F.col("ancestor_id").alias("decision_id"), "id", "distance")
