import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import snapshot
from lodestone.sources import files, models
from lodestone.streaming.log import first_arrivals, query_windows, run_available

ROW = "id string, project_id string, content string, content_sha256 string, source_kind string, status string, archived_at timestamp, summary string, metadata string, access_count int, last_accessed_at timestamp"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("a", "p", "x", sha("x").upper(), None, "active", None, "s", '{"dupCandidates":"1","k":"v"}', 1, None), ("b", "p", "y", None, "decision", None, dt.datetime(2026, 1, 1), None, None, None, None)], ROW)


def test_upsert_and_children(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2, "n"), ("c", 3, "n")], "k string, v int, extra string")
    assert sorted(tuple(r) for r in snapshot.upsert(old, new, ["k"]).collect()) == [("a", 1, None), ("b", 2, "n"), ("c", 3, "n")]
    kids = snapshot.replace_children(spark.createDataFrame([("f", "s1"), ("g", "s2")], "file string, s string"), spark.createDataFrame([("f", "s3"), ("f", "s3")], "file string, s string"), ["file"], ["file", "s"])
    assert sorted(tuple(r) for r in kids.collect()) == [("f", "s3"), ("g", "s2")]


def test_partition_overwrite(spark, tmp_path):
    p = str(tmp_path / "t")
    snapshot.overwrite_partitions(spark.createDataFrame([("a", 1), ("b", 1)], "r string, v int"), p, "r")
    snapshot.overwrite_partitions(spark.createDataFrame([("b", 2)], "r string, v int"), p, "r")
    assert sorted((r.r, r.v) for r in spark.read.parquet(p).collect()) == [("a", 1), ("b", 2)]


def test_store_update_archive(spark, rows):
    new = spark.createDataFrame([("n1", "p", "x", None), ("n2", "q", "x", None), ("n3", "p", "x", "decision"), ("n4", "p", "y", None), ("n5", "p", "y", None)], "id string, project_id string, content string, source_kind string")
    assert sorted(r.id for r in snapshot.store(rows, new).collect()) == ["a", "b", "n2", "n3", "n4"]
    after = {r.id: r for r in snapshot.update(rows, spark.createDataFrame([("a", "z", None), ("zz", "q", None)], "id string, content string, status string"), ["content", "status"]).collect()}
    assert (after["a"].content, after["a"].content_sha256, after["a"].summary, json.loads(after["a"].metadata), after["a"].status) == ("z", sha("z"), None, {"k": "v"}, "active") and after["b"].content == "y"
    got = {r.id: r.archived_at for r in snapshot.archive(rows, spark.createDataFrame([("a",), ("b",)], "id string"), "2026-07-01 00:00:00").collect()}
    assert got["a"].year == 2026 and got["a"].month == 7 and got["b"].month == 1
    ev = spark.createDataFrame([("a", dt.datetime(2026, 7, 1)), ("a", dt.datetime(2026, 7, 2))], "id string, at timestamp")
    assert {r.id: r.access_count for r in snapshot.access_counts(rows, ev).collect()} == {"a": 3, "b": 0}


def test_runs_and_secrets(spark):
    ev = spark.createDataFrame([("r", 1, "running", 0, 9), ("r", 2, "running", 4, None), ("r", 3, "done", None, None)], "run_id string, at int, status string, files_done int, files_total int")
    assert tuple(snapshot.run_states(ev).first()) == ("r", 1, "done", 4, 9)
    none = spark.createDataFrame([], "name string, value_enc binary, description string")
    kept = snapshot.set_secrets(none, spark.createDataFrame([("k", "v", None)], "name string, value string, description string"), "k" * 16)
    kept = snapshot.set_secrets(kept, spark.createDataFrame([("k", "w", "d")], "name string, value string, description string"), "k" * 16)
    assert kept.first().value_enc != b"w" and tuple(snapshot.get_secrets(kept, "k" * 16).first()) == ("k", "w", "d")


def test_read_tree(spark, tmp_path):
    for name, text in {"a.ts": "x", "sub/b.PY": "y", "node_modules/c.ts": "z", "secrets/d.md": "q", "e.bin": "x", "empty.go": "", "big.sql": "x" * 400_001, "gen/f.ts": "g", "keep/gen.ts": "k", "log/x.md": "l", "y.min.js": "m"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / ".gitignore").write_text("# c\n/gen/\n*.md\n!log/x.md\n")
    got = {r.path: r.language for r in files.read_tree(spark, str(tmp_path), "repo").collect()}
    assert got == {"a.ts": "typescript", "sub/b.PY": "python", "keep/gen.ts": "typescript", "log/x.md": "markdown"}


def test_gold_and_artifacts(tmp_path):
    def put(doc):
        (tmp_path / "g.json").write_text(json.dumps(doc))
        return str(tmp_path / "g.json")

    good = {"version": 2, "rows": [{"id": "1", "split": "dev"}, {"id": "2", "split": "test"}]}
    assert [r["id"] for r in files.read_gold(put(good), "test")] == ["2"]
    assert files.read_gold(put([{"query": "q"}])) == [] and files.read_gold(put([{"query": "q"}]), legacy=True)[0]["split"] == "dev"
    for bad in ({"version": 3}, {"version": 2, "rows": [{"id": "1", "split": "x"}]}, {"version": 2, "rows": [{"id": "1", "split": "dev"}] * 2}):
        with pytest.raises(ValueError):
            files.read_gold(put(bad))
    p = files.write_artifact(str(tmp_path), "a b/c", {"perQuery": [], "aggregates": {}}, dt.date(2026, 7, 1))
    assert p.endswith("2026-07-01-a-b-c.json") and files.read_artifact(p)["perQuery"] == []
    with pytest.raises(ValueError):
        files.read_artifact(put({"x": 1}))


def test_transcripts_and_lines(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text("\n".join([json.dumps({"role": "user", "content": "hi " * 100}), json.dumps({"message": {"role": "bot", "content": "yo"}}), "broken"]))
    t = files.read_transcripts(spark, str(tmp_path / "t.jsonl")).first().transcript
    assert t.startswith("user: hi") and t.endswith("bot: yo")
    (tmp_path / "f.txt").write_text("a\nb\nc")
    assert files.read_lines(str(tmp_path), "f.txt", 2) == "2\tb\n3\tc"
    with pytest.raises(ValueError):
        files.read_lines(str(tmp_path), "../x")


def test_models(spark):
    df = spark.createDataFrame([("a b",), (None,), ("a b",)], "t string")
    got = [r.v for r in models.with_embeddings(df.coalesce(1), "t", "v", models.hash_embedder(8), 1).collect()]
    assert got[0] == got[2] and got[1] is None and sum(x * x for x in got[0]) == pytest.approx(1)
    assert models.overlap_reranker("a b", ["a", "c", ""]) == [0.5, 0.0, 0.0]
    assert models.budget_batches([5, 5, 20, 1, 1, 1], 10, 2) == [[0, 1], [2], [3, 4], [5]]
    tries, waits = [], []

    class Busy(Exception):
        status = 503

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise Busy
        return "ok"

    assert models.retried(call, sleep=waits.append)() == "ok" and waits == [0.5, 1.0]


def test_streams(spark, sf, tmp_path):
    src = tmp_path / "src"
    batch = spark.read.parquet(f"{sf}/search_log.parquet").orderBy("created_at")
    batch.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(batch.schema).parquet(str(src))
    run_available(first_arrivals(stream, ["id"], "created_at"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == batch.select("id").distinct().count()
    run_available(query_windows(spark.readStream.schema(batch.schema).parquet(str(src))), str(tmp_path / "w"), str(tmp_path / "d"))
    got = spark.read.parquet(str(tmp_path / "w"))
    # windows the watermark has passed are out; they agree with the batch
    key = F.lower(F.trim(F.regexp_replace("query", r"\s+", " ")))
    want = {(r.w.start, r.k): r.n for r in batch.groupBy(F.window("created_at", "1 hour").alias("w"), key.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = got.collect()
    assert rows and all(want[r.start, r.query_key] == r.n for r in rows)
