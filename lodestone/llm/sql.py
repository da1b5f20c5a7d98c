"""DuckDB SQL that gives the same rows, over whole tables, where SQL can express the operator."""

from __future__ import annotations


def _words(table: str, key: str, text: str, where: str = "true") -> str:
    return f"select {key} as k, unnest(list_distinct(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+'))) as w from {table} where {where}"


_SIZES = "select k, count(*) as n from {0} group by k"
_MEMORY_LINKS = f"""
w as ({_words("memories", "id", "coalesce(title, '') || ' ' || coalesce(content, '')")}),
s as ({_SIZES.format("w")}),
c as (select a.k as x, b.k as y, count(*) as o from w a join w b on a.w = b.w and a.k < b.k group by 1, 2),
links as (select x, y from c join s sx on sx.k = x join s sy on sy.k = y where o / (sx.n + sy.n - o)::double >= 0.7 - 1e-12),
ends as (select x, y from links union all select y, x from links),
reach as (select x as k, x as g from ends union select r.k, e.y from reach r join ends e on e.x = r.g),
groups as (select k, min(g) as g from reach group by k)"""

_QUERY_PAIRS = f"""w as ({_words("recall_eval", "id", "query")}), s as ({_SIZES.format("w")}),
sp as (select id, split = 'train' as t from recall_eval where split is not null),
c as (select a.k as x, b.k as y, count(*) as o, sum(length(a.w)) as l from w a join w b on a.w = b.w join sp p on p.id = a.k and p.t join sp q on q.id = b.k and not q.t group by 1, 2),
pairs as (select x, y, l from c join s sx on sx.k = x join s sy on sy.k = y where o / (sx.n + sy.n - o)::double >= 0.6 - 1e-12)"""
_INTAKE = f"""a as ({_words("memory_intake", "intake_id", "content")}), b as ({_words("memories", "id", "content")}),
sa as ({_SIZES.format("a")}), sb as ({_SIZES.format("b")}),
h as (select a.k as x, b.k as y, count(*) as o from a join b on a.w = b.w group by 1, 2),
i as (select a.k as x, b.k as y, count(*) as o from a join a b on a.w = b.w and b.k < a.k group by 1, 2),
old as (select distinct x from h join sa on sa.k = x join sb on sb.k = y where o / (sa.n + sb.n - o)::double >= 0.7 - 1e-12),
new as (select distinct x from i join sa on sa.k = x join sa s2 on s2.k = y where o / (sa.n + s2.n - o)::double >= 0.7 - 1e-12)"""


def _nearest(kind: str) -> str:
    return f"""select distinct '{kind}' as record_kind, least(x, y) as id_a, greatest(x, y) as id_b from (
select *, row_number() over (partition by x order by c desc, y) as r from (
select a.id as x, b.id as y, list_cosine_similarity(a.v, b.v) as c from u_{kind} a join u_{kind} b on a.id <> b.id)) where r <= 5 and c >= 0.85"""


def _usable(kind: str, table: str) -> str:
    return f"u_{kind} as (select id, embedding::double[] as v from {table} where embedding is not null and list_sum(list_transform(embedding, lambda x: x::double * x)) > 0)"


SQL = {
    "p1_found": "select id from code_chunks where length(content) > 4000",
    "p2_found": f"with {_QUERY_PAIRS} select least(x, y) as id_a, greatest(x, y) as id_b from pairs",
    "p2_report": f"""with {_QUERY_PAIRS}, z as (select k, sum(length(w)) as l from w group by k), e as (select y, count(*) as n, max(pairs.l / z.l) as m from pairs join z on z.k = y group by y)
select split, provenance, count(*) as n_rows, count(n) as n_overlapping, coalesce(sum(n), 0)::bigint as n_pairs, round(avg(m), 6) as mean_overlap from recall_eval r left join e on e.y = r.id where split <> 'train' group by 1, 2""",
    "p4_found": f"with {_usable('memory', 'memories')}, {_usable('chunk', 'code_chunks')} {_nearest('memory')} union all {_nearest('chunk')}",
    "p3_found": f"with recursive {_MEMORY_LINKS} select a.k as id_a, b.k as id_b from groups a join groups b on a.g = b.g and a.k < b.k",
    "p3_groups": f"""with recursive {_MEMORY_LINKS}, deg as (select x as k, count(*) as n from ends group by 1)
select m.id, coalesce(g.g, m.id) as group_id, coalesce(d.n, 0) as links from memories m left join groups g on g.k = m.id left join deg d on d.k = m.id""",
    "p5_found": f"with {_INTAKE} select x as intake_id from old union select x from new",
    "p5_batches": f"""with {_INTAKE} select batch_no, count(*) as n_rows, count(old.x) as held_by_memories, count(*) filter (where old.x is null and new.x is not null) as held_by_intake, count(*) filter (where old.x is null and new.x is null) as n_new
from memory_intake m left join old on old.x = m.intake_id left join new on new.x = m.intake_id group by 1""",
    "p7_found": f"""with recursive {_MEMORY_LINKS},
f as (select m.id, g.g, coalesce(pinned::int, -1) as p, coalesce(importance, '-infinity'::float) as i, coalesce(access_count, -2147483648) as c, coalesce(created_at, '1000-01-01'::timestamp) as t from memories m join groups g on g.k = m.id),
best as (select g, max(p) as p, max(i) as i, max(c) as c, max(t) as t from f group by g)
select id from f join best using (g, p, i, c, t)""",
}


_VOTED = ["type", "title", "content", "source_kind", "status", "source_uri", "summary"]
_WEIGHT = "(case source_kind when 'decision' then 2.0 when 'agent-memory' then 1.5 else 1.0 end) * coalesce(pow(0.5::double, greatest((epoch_us(timestamptz '2026-07-01 00:00:00+00') - epoch_us(created_at)) / 86400e6, 0) / 180.0), 1e-6)"
_WON = ", ".join(
    f"w_{f} as (select g, v as {f} from (select g, v, row_number() over (partition by g order by votes desc, key) as r from (select g, regexp_replace(lower(trim({f})), '\\s+', ' ', 'g') as key, min({f}) as v, round(sum(w), 9) as votes from f where {f} is not null group by 1, 2)) where r = 1)"
    for f in _VOTED
)
SQL["p7_survivors"] = f"""with recursive {_MEMORY_LINKS},
f as (select m.*, g.g, {_WEIGHT} as w from memories m join groups g on g.k = m.id), {_WON},
top as (select g, count(*) as n_rows, max(pinned::int)::boolean as pinned, max(importance) as importance, max(access_count) as access_count, max(created_at) as created_at from f group by g)
select top.g as group_id, n_rows, pinned, importance, access_count, created_at, {", ".join(_VOTED)} from top {" ".join(f"left join w_{f} on w_{f}.g = top.g" for f in _VOTED)}"""


SQL["p1_rejoined"] = "select id, sha256(content) as content_sha256, true as within from code_chunks where content is not null"
SQL["p8_sizes"] = "select doc_id, greatest(ceil(n_chars / 8192.0), 1)::bigint as pieces, greatest(ceil(n_chars / 8192.0), 1)::bigint as n_rows, n_chars as chars, true as sound from documents"
_KEY = "regexp_replace(lower(trim({0})), '[\\s_]+', '-', 'g')"
SQL["p9_quotas"] = f"""with g as (select {_KEY.format("source")} as source, sum(target_share) as share, greatest(coalesce(max(max_repeats), 1), 1) as r from mix_targets where target_share > 0 group by 1),
h as (select {_KEY.format("source")} as source, count(*) as n, sum(n_chars) as t from documents where n_chars > 0 group by 1),
j as (select g.source, share, r, coalesce(n, 0) as n, coalesce(t, 0) as t from g left join h using (source)),
m as (select sum(share) as mass from j where t > 0), b as (select *, case when t > 0 then t * r * mass / share end as most from j, m), z as (select min(most) as total from b)
select source, share as target_share, r as max_repeats, n::bigint as n_rows, t::bigint as tokens, case when t > 0 then round(total * share / mass, 3) else 0 end as quota,
case when t > 0 then least(floor((total * share / mass) / t)::int, r) else 0 end as whole, coalesce(most = total, false) as limits_total from b, z"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
