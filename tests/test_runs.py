import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluation as ev
from lodestone.operators import graph, lifecycle, rendering, runs
from lodestone.operators.retrieval import ARMS, reranked, search_logged
from lodestone.operators.symbols import extract, extract_all
from lodestone.sources.files import read_transcripts, read_tree

TREE = {
    "route.ts": 'import { handleGetUser } from "./handler";\n\nexport function route(id: string) {\n  return handleGetUser(id);\n}\n',
    "handler.ts": 'import { getUser, UserRow } from "./service";\n\nexport function handleGetUser(id: string) {\n  return getUser(id);\n}\n',
    "service.ts": 'import { findUser, UserRow } from "./repo";\n\nexport function getUser(id: string) {\n  return findUser(id);\n}\n',
    "repo.ts": "export interface UserRow {\n  id: string;\n}\n\nexport function findUser(id: string) {\n  return { id };\n}\n",
    "ambiguous.ts": "export function format(n: number) {\n  return n.toFixed(2).trim();\n}\nexport function useFormat(n: number) {\n  return format(n);\n}\n",
    "format-alt.ts": "export function format(n: number) {\n  return String(n);\n}\n",
    "cycle-a.ts": 'import { beta } from "./cycle-b";\nexport function alpha() {\n  beta();\n}\n',
    "cycle-b.ts": 'import { alpha } from "./cycle-a";\nexport function beta() {\n  alpha();\n}\n',
}


@pytest.fixture(scope="module")
def code(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (root / name).write_text(text)
    files = read_tree(spark, str(root), "r").withColumnsRenamed({"repository_id": "repo", "path": "file"})
    symbols, edges = graph.code_graph(extract_all(files, ["repo", "file"], "file", "content"))
    return symbols, edges


def seeds(symbols, *names):
    return symbols.where(F.col("name").isin(*names)).select("id")


def test_tree_to_graph(code):
    symbols, edges = code
    assert {(r.name, r.kind, r.file, r.start_line) for r in symbols.collect()} >= {("route", "function", "route.ts", 3), ("UserRow", "interface", "repo.ts", 1), ("format", "function", "ambiguous.ts", 1), ("format", "function", "format-alt.ts", 1)}
    name = {r.id: r.name for r in symbols.collect()}
    calls = sorted((name[r.src], name[r.dst]) for r in edges.where("kind = 'call'").collect())
    assert calls == sorted([("route", "handleGetUser"), ("handleGetUser", "getUser"), ("getUser", "findUser"), ("useFormat", "format"), ("useFormat", "format"), ("alpha", "beta"), ("beta", "alpha")])
    imports = {(name[r.src], name[r.dst]) for r in edges.where("kind = 'import'").collect()}
    assert imports == {("route", "handleGetUser"), ("handleGetUser", "getUser"), ("handleGetUser", "UserRow"), ("getUser", "findUser"), ("getUser", "UserRow"), ("alpha", "beta"), ("beta", "alpha")}


def test_rows_are_ordered_flagged_and_limited(code):
    symbols, edges = code
    for depth, n in ((1, 2), (2, 3), (3, 4), (5, 4), (10, 4)):
        assert graph.graph_rows(edges, symbols, seeds(symbols, "route"), "out", depth).count() == n
    got = graph.graph_rows(edges, symbols, seeds(symbols, "useFormat"), "out", 4).collect()
    assert [(r.name, r.file, r.depth, r.edge_type, r.ambiguous) for r in got] == [("useFormat", "ambiguous.ts", 0, "def", False), ("format", "ambiguous.ts", 1, "call→", True), ("format", "format-alt.ts", 1, "call→", True)]
    assert [r.name for r in graph.graph_rows(edges, symbols, seeds(symbols, "alpha"), "out").collect()] == ["alpha", "beta"]
    assert graph.graph_rows(edges, symbols, seeds(symbols, "route"), "out", 4, 2).count() == 2
    lines = [r.line for r in graph.graph_rows(edges, symbols, seeds(symbols, "useFormat"), "out").select(rendering.graph_line().alias("line")).collect()]
    assert lines[0].startswith("[d0 def] useFormat  ambiguous.ts:4  [") and lines[1].startswith("  [d1 call→] format  ambiguous.ts:1 (name-matched, may be ambiguous)  [")


def test_trace_over_the_tree(code):
    symbols, edges = code
    rows, reached = graph.trace(edges.where("kind = 'call'").select("src", "dst"), seeds(symbols, "route"), symbols.select("id", "name"), "findUser")
    name = {r.id: r.name for r in symbols.collect()}
    assert reached and [name[r.id] for r in rows.orderBy("depth").collect()] == ["route", "handleGetUser", "getUser", "findUser"]


def test_seed_by_chunk_and_lookup(spark):
    s = spark.createDataFrame([("1", "p", "r", "f", "go", "function", 2), ("2", "p", "r", "f", "stop", "function", 9), ("3", "p", "q", "a", "go", "class", 5)], "id string, project string, repo string, file string, name string, kind string, start_line int")
    chunks = spark.createDataFrame([("c", "p", "f", 10), ("d", "x", "f", 10)], "id string, project string, file string, start_line int")
    found = lambda **k: [r.id for r in graph.resolve_seed(s, "p", chunks=chunks, **k).collect()]
    assert found(chunk_id="c") == ["2"] and found(chunk_id="d") == [] and found(chunk_id="none") == [] and found(chunk_id="c", symbol_id="1") == ["1"]
    assert [(r.file, r.line) for r in graph.lookup_symbol(s, "p", "go").collect()] == [("a", 5), ("f", 2)] and graph.lookup_symbol(s, "p", "go", "r", 1).count() == 1


def test_a_scan_that_fails_keeps_what_it_found(spark, monkeypatch):
    from lodestone.operators import symbols as sy

    def broken(ts, out):
        out.symbols.append(("found", "function", 1))
        raise IndexError

    monkeypatch.setattr(sy, "_scan", broken)
    got = extract("x", "a.ts")
    assert got.failed and got.symbols == [("found", "function", 1)]


def test_rendering(spark):
    rows = [("superseded", "b"), ("superseded", None), ("active", None), (None, None), ("deferred", "x")]
    got = [r.b for r in spark.createDataFrame(rows, "s string, o string").select(rendering.banner(F.col("s"), F.col("o")).alias("b")).collect()]
    assert got == ["superseded — see b\n", "status=superseded\n", "", "", "status=deferred\n"]
    hits = spark.createDataFrame([(1, "i", "semantic", "T", "snip", None, "active", "2026-01-02 00:00:00", 0.5), (2, "j", "entity", None, None, "sum", "superseded", None, 0.1)], "rank int, id string, type string, title string, snippet string, summary string, status string, at string, score double").withColumn("at", F.to_timestamp("at"))
    assert "score" not in rendering.public_hits(hits).columns
    lines = [r.l for r in hits.select(rendering.hit_line().alias("l")).collect()]
    assert lines == ["1. [semantic] T  (2026-01-02, id: i)\n   snip", "2. [entity]   (, status: superseded, id: j)\n   \n   summary: sum"]
    assert rendering.hit_text([], 5, 0) == "No matching memories."
    text = rendering.hit_text(["a"], 1, 9, True, {"type": "x"})
    assert text.startswith("Note: no results matched filters {type: x}") and "Showing top 1 of 9" in text


def test_store_with_decisions(spark):
    schema = "id string, project_id string, source_kind string, content string, content_sha256 string, status string, archived_at timestamp, superseded_by string, decision_status string, supersedes_id string, decided_at timestamp"
    old = spark.createDataFrame([("d1", "p", "decision", "a", None, None, None, None, "active", None, None), ("m1", "p", "session", "b", None, None, None, None, None, None, None)], schema)
    new = lambda *r: spark.createDataFrame(r, "id string, project_id string, source_kind string, content string, decision_status string, supersedes_id string")
    got = {r.id: r for r in lifecycle.store_decisions(old, new(("d2", "p", "decision", "a", None, "d1"), ("d3", "q", "decision", "c", "deferred", "d1"), ("d4", "p", "decision", "d", None, "m1"), ("m2", "p", "session", "b", None, None)), "2026-07-01").collect()}
    assert set(got) == {"d1", "m1", "d2", "d3", "d4"}  # m2 is held already
    assert (got["d1"].decision_status, got["d1"].superseded_by) == ("superseded", "d2") and got["m1"].superseded_by is None
    assert (got["d2"].decision_status, got["d3"].decision_status) == ("active", "deferred") and got["d2"].decided_at is not None
    for bad in (("x", "p", "session", "z", "active", None), ("x", "p", "decision", "z", "maybe", None), ("x", "p", None, "z", None, "d1")):
        with pytest.raises(ValueError):
            lifecycle.store_decisions(old, new(bad), "2026-07-01")


def test_neighbour_flags(spark):
    v = lambda c: [c, (1 - c * c) ** 0.5, 0.0]
    rows = spark.createDataFrame([("a", "p", [1.0, 0.0, 0.0], None, None), ("b", "q", [1.0, 0.0, 0.0], None, None), ("c", "p", v(0.95), None, "superseded")], "id string, project_id string, embedding array<double>, archived_at timestamp, status string")
    new = spark.createDataFrame([("n", "p", v(0.98)), ("o", "p", [0.0, 0.0, 1.0])], "id string, project_id string, embedding array<double>")
    assert [(r.id, r.flags) for r in lifecycle.neighbour_flags(rows, new).collect()] == [("n", '[{"id":"a","sim":0.98}]')]


def test_summaries(spark):
    rows = spark.createDataFrame([("a", "t", "c", None, None, None), ("b", "boom", "c", None, None, None), ("c", "t", "c", "has", None, None), ("d", "t", "c", None, "superseded", None), ("e", None, None, None, None, None)], "id string, title string, content string, summary string, status string, archived_at timestamp")

    def model(title, content):
        if title == "boom":
            raise RuntimeError
        return f" {title}:{content} " if title else "  "

    after, report = lifecycle.backfill_summaries(rows, model)
    assert {r.id: r.summary for r in after.collect()} == {"a": "t:c", "b": None, "c": "has", "d": None, "e": None}
    assert tuple(report.first()) == (1, 2)
    assert lifecycle.summarized(rows, "id", "title", "content", model, enabled=False).where("summary is not null").count() == 0


def test_contextual_vectors(spark, monkeypatch):
    monkeypatch.setattr(lifecycle, "CONTEXT_CHUNKS", 5)
    rows = [(f"{f}{i}", f, i, f"text {f} {i}") for f, n in (("a", 3), ("b", 2), ("c", 12), ("d", 1)) for i in range(n)] + [("z", None, 1, "t")]
    chunks = spark.createDataFrame(rows, "id string, file string, line int, text string")
    req = lifecycle.contextual_requests(chunks, "file", "line", 2, 5).collect()
    parts = {r.file: sorted(x.part for x in req if x.file == r.file) for r in req}
    assert parts == {"a": [0], "b": [0], "c": [0, 1, 2], "d": [0]} and len({r.request for r in req if r.file in "abd"}) >= 2
    embed = lambda docs: [[[float(len(d)), float(len(t))] for t in d] for d in docs]
    got = {r.id: r.embedding for r in lifecycle.contextual_vectors(chunks, "id", "file", "line", "text", embed).collect()}
    assert set(got) == {r[0] for r in rows if r[1]} and got["a0"][0] == 3.0 and got["c11"][0] == 2.0


def test_consolidation_resumes(spark, tmp_path):
    import json

    rows = spark.createDataFrame([(f"m{i}", None, None, f"text {i}", False, None, "session", None, None, f"2026-01-0{i + 1}") for i in range(6)], "id string, title string, summary string, content string, pinned boolean, status string, source_kind string, archived_at timestamp, superseded_by string, created string")
    pairs = spark.createDataFrame([("m0", "m1", 0.99, "flag"), ("m2", "m3", 0.95, "sweep"), ("m4", "m5", 0.97, "sweep")], "a string, b string, sim double, source string")
    judge = lambda batch: json.dumps({str(i): {"verdict": 1, "keep": "b"} for i in range(1, len(batch) + 1)})
    first = lifecycle.consolidate(rows, pairs, judge, limit=2)
    assert {(r.a, r.verdict) for r in first.collect()} == {("m0", 1), ("m4", 1), ("m2", -1)}
    lifecycle.write_report(first, f"file://{tmp_path}/report", "p")
    stored = spark.read.json(f"file://{tmp_path}/report")
    asked = spark.sparkContext.accumulator(0)

    def counting(batch):
        asked.add(len(batch))
        return judge(batch)

    second = lifecycle.consolidate(rows, pairs.where("a <> 'm4'"), counting, carried=stored)
    assert {(r.a, r.verdict, r.carried) for r in second.collect()} == {("m0", 1, True), ("m4", 1, True), ("m2", 1, False)} and asked.value == 1
    after, warnings = lifecycle.apply_report(rows, stored, "q")
    assert warnings and {r.id: r.superseded_by for r in after.collect() if r.status} == {"m0": "m1", "m4": "m5"}
    again, _ = lifecycle.apply_report(after, stored)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, after.collect()))
    assert [lifecycle.cli_action(*x) for x in ((False, False, False), (True, False, False), (True, True, False), (True, False, True))] == ["dry-run", "apply", "apply-report", "resume"]
    with pytest.raises(ValueError):
        lifecycle.cli_action(True, True, True)
    assert lifecycle.write_candidates(pairs, f"file://{tmp_path}/c", "harvest") == 3 and spark.read.json(f"file://{tmp_path}/c").where("provenance = 'harvest'").count() == 3


def test_two_layers_and_bakeoffs(spark):
    rows = spark.createDataFrame([("q1", "x", ["a", "b"], ["b", "B ", "a"], ["a"]), ("q2", "y", None, None, ["a"]), ("q3", "z", ["c"], ["c"], [])], "id string, query string, pool array<string>, final array<string>, gold array<string>")
    got = {r.id: r for r in runs.two_layers(rows, runs.retrieval_config(ARMS["A0"])).collect()}
    assert got["q1"].pool_recall == 1.0 and got["q1"].rank == 2 and abs(got["q1"].mrr - 0.5) < 1e-12 and got["q2"].pool_recall == 0.0 and got["q2"].rank is None and got["q3"].ndcg == 0.0
    with pytest.raises(ValueError):
        runs.two_layers(rows, runs.retrieval_config(ARMS["A0"], 30))
    assert runs.aggregates(runs.two_layers(rows, runs.retrieval_config(ARMS["A0"]))).first().n_queries == 3
    mem = spark.createDataFrame([("g", "entity", None, None, "2026-04-02", 0.5), ("d", "semantic", None, None, "2026-06-01", 0.5)], "id string, type string, source_kind string, event_date timestamp, created string, importance float").withColumn("created_at", F.to_timestamp("created"))
    pools = spark.createDataFrame([(f"q{i}", ["g"], ["d", "g"]) for i in range(12)], "id string, gold array<string>, pool array<string>")
    arms = runs.blend_bakeoff(pools, mem, ARMS, "2026-07-01")
    table = {r.arm: r for r in runs.compare(spark, arms, "A0").collect()}
    assert table["A1"].wins == 12 and table["A1"].delta > 0 and [a for a in table if table[a].winner] in (["A1"], ["A2"])
    assert table["A0"].ties == 12 and table["A0"].delta == 0
    docs = spark.createDataFrame([("g", "right words"), ("d", "other")], "id string, doc string")
    ranked = runs.rerank_bakeoff(pools.withColumn("query", F.lit("right words")), docs, {"pool": None, "has": lambda q, d: F.when(d == q, 1.0).otherwise(0.0)})
    best = {r.arm: r for r in runs.compare(spark, ranked, "pool").collect()}
    assert best["has"].winner and best["has"].mean == 1.0 and best["pool"].mean < 1.0


def test_bootstrap_of_counts_is_the_bootstrap(spark):
    values = sorted([0.5] * 7 + [0.0] * 20 + [-0.25] * 5)
    counts = [(v, values.count(v)) for v in sorted(set(values))]
    a, b = ev.bootstrap(values), ev.bootstrap_counts(spark, counts)
    assert all(abs(x - y) < 1e-12 for x, y in zip(a, b)) and ev.bootstrap_counts(spark, []) == (0.0, 0.0, 0.0)


def test_reranker_and_log(spark):
    pool = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2)], "id string, rrf double, pool_rank int")
    rows = spark.createDataFrame([("a", "x"), ("b", None)], "id string, t string")
    got = {r.id: r.relevance for r in reranked(pool, rows, "q", lambda q, ds: [float(len(d)) for d in ds], F.col("t")).collect()}
    assert got == {"a": 1.0, "b": 0.0}
    broken = reranked(pool, rows, "q", lambda q, ds: [1.0], F.col("t")).collect()
    assert all(r.relevance is None or r.relevance != r.relevance for r in broken)
    row = search_logged(pool.select("id", F.col("pool_rank").alias("rank")).limit(0), pool, "s", "p", "q", "2026-07-01").first()
    assert row.pool_ids == ["a", "b"] and row.final_ids == []


def test_transcript_blocks(spark, tmp_path):
    import json

    lines = [{"message": {"role": "user", "content": "hello " * 30}}, {"role": "assistant", "content": [{"type": "text", "text": "one " * 20}, {"type": "tool_use", "id": "t"}, {"type": "text", "text": "two"}]}, {"role": "user", "content": "[not blocks"}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, lines)))
    text = read_transcripts(spark, f"file://{tmp_path}/t.jsonl").first().transcript
    assert "assistant: one one" in text and "two" in text and "tool_use" not in text and text.endswith("user: [not blocks")


def test_settings_of_a_blend():
    from lodestone.operators.retrieval import Blend, parse_blend

    assert parse_blend({"relevance": "", "tau": None}) == Blend()
    got = parse_blend({"tau": "45", "shape": "power", "tau_by_type": '{"semantic": 90}', "exempt": "type:entity, source_kind:decision"})
    assert (got.tau, got.shape, got.tau_by_type, got.exempt_types, got.exempt_kinds) == (45.0, "power", {"semantic": 90.0}, ("entity",), ("decision",))
    for bad in ({"tau": "x"}, {"tau": "-1"}, {"tau": "nan"}, {"shape": "log"}, {"tau_by_type": "[1]"}, {"tau_by_type": '{"a": "b"}'}, {"exempt": "type:other"}, {"exempt": "source_kind:"}, {"nothing": "1"}):
        with pytest.raises(ValueError):
            parse_blend(bad)
