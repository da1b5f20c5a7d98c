import json
import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import dedup
from lodestone.operators.chunking import cached_values, line_windows, running_total, snapshot_diff


def test_exact_groups(spark):
    df = spark.createDataFrame([("a", "p", "x"), ("b", "p", "x"), ("c", "q", "x"), ("d", "p", None)], "id string, p string, t string")
    got = {r.id: (r.keep_id, r.copies) for r in dedup.exact_groups(df, "id", [F.col("p"), F.sha2("t", 256)]).collect()}
    assert got == {"a": ("a", 2), "b": ("a", 2), "c": ("c", 1)}


def test_near_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:20] + 0.15 * rng.standard_normal((20, 16)), base[:3], np.zeros((1, 16))])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [math.nan] * 16)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {(r.id, r.near_id) for r in dedup.near_vectors(df, "id", "v", 0.9, 2).collect()}
    u = x[:-1].astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -1)
    want = {(i, j) for i in range(len(u)) for j in sorted(range(len(u)), key=lambda j: (-s[i, j], j))[:2] if s[i, j] > 0.9}
    assert got == want
    assert dedup.near_vectors(spark.createDataFrame([], "id long, v array<float>"), "id", "v").count() == 0


def test_flags_round_trip(spark):
    near = spark.createDataFrame([("a", "b", 0.98004), ("a", "c", 0.95), ("b", "a", 0.98004)], "id string, near_id string, cosine double")
    flags = dedup.flags(near)
    assert json.loads({r.id: r.flags for r in flags.collect()}["a"]) == [{"id": "b", "sim": 0.98}, {"id": "c", "sim": 0.95}]
    rows = spark.createDataFrame([("a", '[{"id":"b","sim":"0.95"},{"id":"zz","sim":0.99},{"id":"c","sim":"x"},{"id":"c","sim":0.5}]'), ("b", "{}"), ("c", None)], "id string, f string")
    assert [tuple(r) for r in dedup.flagged_pairs(rows, "id", "f").collect()] == [("a", "b", 0.95, "flag")]


def test_merge_pairs(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 1), ("c", 1)], "id string, t int")
    pairs = spark.createDataFrame([("a", "b", 0.91, "sweep"), ("b", "a", 0.95, "flag"), ("c", "b", 0.92, "sweep"), ("a", "a", 1.0, "flag")], "a string, b string, sim double, source string")
    got = dedup.merge_pairs(pairs, rows, "id", "t").orderBy(*dedup.priority()).collect()
    assert [tuple(r) for r in got] == [("b", "a", 0.95, "both"), ("b", "c", 0.92, "sweep")]
    assert dedup.merge_pairs(pairs, rows, "id", "t", spark.createDataFrame([("b", "a")], "a string, b string")).count() == 1


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('ok {"1":{"verdict":1,"keep":"a"},"2":{"verdict":0}} done', [(1, "a"), (0, None)]),
        ('{"1":{"verdict":1,"keep":"b"}}', [(1, "b"), (-1, None)]),
        ('{"1":{"verdict":1},"2":{"verdict":2}}', [(-1, None), (-1, None)]),
        ('{"1":{"verdict":"1","keep":"a"},"2":{"verdict":1,"keep":"a"}}', [(-1, None), (-1, None)]),
        ('{"1":{"verdict":true,"keep":"a"},"2":[]}', [(-1, None), (-1, None)]),
        ("{broken", [(-1, None), (-1, None)]),
        ("[1]", [(-1, None), (-1, None)]),
    ],
)
def test_verdicts(raw, want):
    assert dedup.parse_verdicts(raw, [(False, False), (False, True)]) == want


def test_apply_judged_in_order(spark):
    rows = spark.createDataFrame([(x, "active" if x != "f" else None, None, x == "e", "decision" if x == "d" else None, None, 7) for x in "abcdef"], "id string, status string, superseded_by string, pinned boolean, source_kind string, archived_at timestamp, n int")
    judged = spark.createDataFrame([(1, "a", "b", 1, "a"), (2, "b", "c", 1, "a"), (3, "c", "f", 1, "a"), (4, "a", "d", 1, "a"), (5, "a", "e", 1, "a"), (6, "a", "c", 0, None), (7, "a", "f", -1, None)], "seq long, a string, b string, verdict int, keep string")
    got = {r.id: r.superseded_by for r in dedup.apply_judged(rows, judged).collect()}
    # b lost to a, so it can't win over c; c is still live and wins over f; d is a decision and e pinned
    assert got == {"a": None, "b": "a", "c": None, "d": None, "e": None, "f": "c"}
    assert dedup.apply_judged(rows, judged.where("verdict = 0")).columns == rows.columns


@pytest.mark.parametrize(("limit", "rounds"), [(dedup.SETTLE_ROWS, 50), (20, 50), (0, 1)])
def test_apply_judged_of_many_copies(spark, monkeypatch, limit, rounds):
    # in one task, in rounds, and by components after them: the same as one verdict after another
    monkeypatch.setattr(dedup, "SETTLE_ROWS", limit)
    r = random.Random(4)
    ids = [f"m{i:02}" for i in range(75)]
    groups = [ids[:60], ids[60:]]
    pairs = [(a, b) for g in groups for i, a in enumerate(g) for b in g[i + 1 :]]
    verdicts = [(s, a, b, 1, r.choice("ab") if a > "m50" else "b") for s, (a, b) in zip(r.sample(range(10_000), len(pairs)), pairs)]
    held = {x: r.choice(["pinned", "archived", "decision", "superseded"]) for x in r.sample(ids, 12)}
    rows = [(x, "superseded" if held.get(x) == "superseded" else None, None, held.get(x) == "pinned", held.get(x) if held.get(x) == "decision" else None, datetime(2026, 1, 1) if held.get(x) == "archived" else None) for x in ids]
    gone = {}
    for _, a, b, _, keep in sorted(verdicts):
        w, lo = (a, b) if keep == "a" else (b, a)
        if w not in gone and lo not in gone and held.get(w) not in ("archived", "superseded") and held.get(lo) not in ("pinned", "decision", "superseded"):
            gone[lo] = w
    df = spark.createDataFrame(rows, "id string, status string, superseded_by string, pinned boolean, source_kind string, archived_at timestamp")
    judged = spark.createDataFrame(verdicts, "seq long, a string, b string, verdict int, keep string")
    got = {x.id: x.superseded_by for x in dedup.apply_judged(df, judged, rounds).collect()}
    assert got == {x: gone.get(x) for x in ids} and len(gone) > 50


def test_judge_failure_leaves_batch(spark):
    pairs = spark.createDataFrame([(str(i), "x" if i == 9 else "y", "y", False, None) for i in range(10)], "k string, side_a string, side_b string, pinned_a boolean, pinned_b boolean")

    def judge(batch):
        if any(a == "x" for a, _ in batch):
            raise RuntimeError
        return json.dumps({str(i): {"verdict": 0} for i in range(1, len(batch) + 1)})

    got = [r.verdict for r in dedup.judge_pairs(pairs.coalesce(1), judge).orderBy("k").collect()]
    assert got == [0] * 8 + [-1] * 2


def test_line_windows(spark):
    text = "\n".join(["def f():"] + [f"l{i}" for i in range(2, 12)])
    df = spark.createDataFrame([("a", text), ("b", ""), ("c", None), ("d", "   \n ")], "id string, t string")
    got = [(r.id, r.start_line, r.end_line, r.symbol_name) for r in line_windows(df, ["id"], F.col("t"), 5, 2).orderBy("start_line").collect()]
    assert got == [("a", 1, 5, "f"), ("a", 4, 8, None), ("a", 7, 11, None)]
    assert line_windows(df, ["id"], F.col("t"), 5, 2, 3).first().content == "def"


def test_diff_cache_running(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "k string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("c", None)], "k string, h string")
    assert {r.k: r.change for r in snapshot_diff(old, new, ["k"], "h").collect()} == {"a": "unchanged", "b": "changed", "c": "unchanged", "d": "added"}
    rows = spark.createDataFrame([("a", "h", 1), ("b", "h", None), ("c", "g", None)], "id string, h string, v int")
    assert {r.id: r.cached_from for r in cached_values(rows, "id", "h", "v").collect()} == {"b": "a", "c": None}
    df = spark.createDataFrame([(i, i * 3 % 7) for i in range(50)], "i long, v long")
    got = {r.i: r.before for r in running_total(df, "i", "v").collect()}
    assert got == {i: sum(j * 3 % 7 for j in range(i)) for i in range(50)}
