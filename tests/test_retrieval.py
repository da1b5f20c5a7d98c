import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from lodestone.operators import filters, retrieval
from lodestone.operators.hits import fragments, merge_adjacent, merge_ranges, query_snippets

NOW = "2026-07-01 12:00:00"
SCHEMA = "id string, project_id string, title string, type string, content string, importance double, source_kind string, event_date timestamp, created_at timestamp, status string, archived_at timestamp, metadata string, embedding array<float>"


def days(n):
    return dt.datetime(2026, 7, 1, 12, tzinfo=dt.timezone.utc) - dt.timedelta(days=n)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        ("1", "p", "postgres pool", "semantic", "the connection pool of postgres restarts", 0.9, None, None, days(3), "active", None, '{"tags":["a","b"]}', [1.0, 0.0]),
        ("2", "p", "rollback", "procedural", "rollback of deployments", 0.7, "decision", days(1), days(9), None, None, "{}", [0.8, 0.6]),
        ("3", "p", "old", "semantic", "pool connection", None, None, None, days(90), "superseded", None, None, [0.0, 1.0]),
        ("4", "q", None, "entity", None, 0.5, "docs", None, days(5), "active", None, "not json", None),
        ("5", "q", "zero", "entity", "connections pooling", 0.5, "docs", None, days(5), "active", days(0), '{"tags":"a"}', [0.0, 0.0]),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return [r.id for r in df.collect()]


def test_filters(corpus):
    assert ids(corpus.where(filters.live())) == ["1", "2", "4"]
    assert ids(corpus.where(filters.by_status("all"))) == ["1", "2", "3", "4", "5"]
    assert ids(corpus.where(filters.by_status("superseded"))) == ["3"]
    assert ids(corpus.where(filters.any_tag(["b", "z"]))) == ["1"] and ids(corpus.where(filters.has_tag("a"))) == ["1"]
    assert ids(corpus.where(filters.after("2026-06-29 12:00:00"))) == ["2"]
    got, retried = filters.relaxed(corpus, filters.live(), filters.has_tag("nope"))
    assert retried and got.count() == 3


def test_arms_and_fusion(corpus):
    lex = retrieval.lexical_arm(corpus, "id", F.col("content"), ["pool", "connection"])
    assert [(r.id, r.lex_rank) for r in lex.collect()] == [("1", 1), ("3", 2)]
    vec = retrieval.vector_arm(corpus, "id", "embedding", [1.0, 0.0])
    assert [(r.id, r.vec_rank, round(r.cosine, 3)) for r in vec.collect()] == [("1", 1, 1.0), ("2", 2, 0.8), ("3", 3, 0.0)]
    pool = {r.id: (r.pool_rank, r.rrf) for r in retrieval.fuse(lex, vec).collect()}
    assert pool["1"] == (1, round(2 / 61, 9)) and pool["3"][1] == round(1 / 62 + 1 / 63, 9) and pool["2"][0] == 3
    with pytest.raises(ValueError):
        retrieval.fuse(lex, vec, 0)


def test_stemmed_arm_is_conjunctive(corpus):
    got = retrieval.lexical_cover_arm(corpus, "id", ["title", "content"], "the pooled connections")
    assert sorted(ids(got)) == ["1", "3", "5"]
    assert ids(retrieval.lexical_cover_arm(corpus, "id", ["content"], "the of and")) == []
    assert retrieval.cover_density([[1], [2]]) == 1.0 and retrieval.cover_density([[1], [4]]) == pytest.approx(1 / 3) and retrieval.cover_density([[1], []]) == 0.0
    assert retrieval.cover_density([[1, 5], [2]]) == pytest.approx(1 + 1 / 3)


@pytest.mark.parametrize(("rel", "imp", "age", "want"), [(0.6, 0.8, 30, 0.42 + 0.2 * math.exp(-1) + 0.08), (0.0, 0.4, 60, 0.2 * math.exp(-2) + 0.04), (0.5, 0.5, 0, 0.6)])
def test_blend_points(spark, rel, imp, age, want):
    df = spark.createDataFrame([("semantic", None, None, days(age), rel, imp)], "type string, source_kind string, event_date timestamp, created_at timestamp, rel double, imp double")
    col = retrieval.blend_column(retrieval.Blend(), NOW, F.col("rel"), F.col("type"), F.col("source_kind"), F.col("event_date"), F.col("created_at"), F.col("imp"))
    assert df.select(col.alias("x")).first().x == pytest.approx(want)


def test_blend_shapes(spark):
    df = spark.createDataFrame([("entity", "x", None, days(90), 0.5, 0.4), ("semantic", "decision", None, days(90), 0.5, 0.4), ("semantic", None, days(-30), days(90), 0.5, 0.4)], "type string, source_kind string, event_date timestamp, created_at timestamp, rel double, imp double")
    args = [F.col(c) for c in ("rel", "type", "source_kind", "event_date", "created_at", "imp")]
    at = lambda arm: [r.x for r in df.select(retrieval.blend_column(retrieval.ARMS[arm], NOW, *args).alias("x")).collect()]
    assert at("A1")[:2] == pytest.approx([0.59, 0.59]) and at("A2")[2] == pytest.approx(0.35 + 0.2 * (1 - 30 / 90) ** -0.5 + 0.04)
    assert at("A3")[0] == pytest.approx(0.5 * (1 + 0.2 * math.exp(-3) + 0.02)) and at("A4") == [0.5] * 3
    for bad in ({"form": "x"}, {"tau": 0.0}, {"relevance": math.nan}, {"recency": -1.0}):
        with pytest.raises(ValueError):
            retrieval.Blend(**bad)


def test_search_drops_optional_filters(corpus):
    got = retrieval.memory_search(corpus, "connection pool", [1.0, 0.0], NOW, strict=F.col("project_id") == "p", optional=filters.has_tag("nope"), limit=1)
    assert got.retried and got.truncated and got.pool_size == 2 and ids(got.hits) == ["1"]
    assert retrieval.memory_search(corpus, "zzz", [1.0, 0.0], NOW, strict=F.col("project_id") == "none").pool_size == 0


def test_code_rank(spark):
    pool = spark.createDataFrame([("a", 1), ("b", 2)], "id string, pool_rank int")
    assert [(r.id, r.score) for r in retrieval.code_rank(pool, None, 5).collect()] == [("a", 0.0), ("b", 0.0)]
    assert ids(retrieval.code_rank(pool, spark.createDataFrame([("b", 0.9)], "id string, score double"), 5)) == ["b"]


def test_conjunctive_batch(spark):
    q = spark.createDataFrame([(1, "Old pool"), (2, "the"), (3, None), (4, "missing pool")], "q long, t string")
    d = spark.createDataFrame([("a", "an old pool"), ("b", "pool"), ("c", None)], "id string, t string")
    assert [tuple(r) for r in retrieval.conjunctive_batch(q, "q", F.col("t"), d, "id", F.col("t"), frozenset(["the"])).collect()] == [(1, "a")]


def test_merge_ranges():
    assert merge_ranges([(1, 60), (49, 108), (97, 156)], 120) == [(0, 1, 108, 2), (2, 97, 156, 1)]
    assert merge_ranges([(1, 10), (30, 40), (11, 29)], 120) == [(0, 1, 40, 3)]
    assert merge_ranges([(1, 10), (12, 20)], 120) == [(0, 1, 10, 1), (1, 12, 20, 1)] and merge_ranges([], 5) == []


@pytest.mark.parametrize("seed", range(100))
def test_merged_ranges_never_overlap(seed):
    import random

    r = random.Random(seed)
    got = merge_ranges([(s := r.randrange(1, 300), s + r.randrange(1, 60)) for _ in range(12)], 10_000)
    spans = sorted((s, e) for _, s, e, _ in got)
    assert all(a[1] + 1 < b[0] for a, b in zip(spans, spans[1:])) and sum(n for *_, n in got) == 12


def test_merge_adjacent(spark):
    df = spark.createDataFrame([("r", "f", 2, 1, 60), ("r", "f", 1, 49, 108), ("r", "g", 3, 1, 5), ("r", "g", None, 1, 5)], "repo string, file string, rank int, s int, e int")
    assert sorted(tuple(r) for r in merge_adjacent(df, ["repo", "file"], "rank", "s", "e").collect()) == [("r", "f", 1, 1, 108, 2), ("r", "g", 3, 1, 5, 1)]


def test_snippets(spark):
    text = " ".join(f"w{i}" for i in range(40)) + " the restarted index " + " ".join(f"v{i}" for i in range(40))
    got = fragments("index restarting", text)
    assert "**restarted** **index**" in got and len(got.split()) <= 20 and fragments("zzz", text) is None
    df = spark.createDataFrame([("a", "no  match\nhere", "zzz"), ("b", None, "x"), ("c", "an index", None)], "id string, t string, q string")
    assert {r.id: r.snippet for r in query_snippets(df, "id", "t", "q").collect()} == {"a": "no match here", "b": "", "c": "an index"}
