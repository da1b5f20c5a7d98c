import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluation as ev
from lodestone.operators import mining


def score(spark, ranked, gold, k):
    df = spark.createDataFrame([(ranked, gold)], "r array<string>, g array<string>")
    return df.select(ev.metrics(F.col("r"), F.col("g"), k).alias("m")).first().m


def test_metrics(spark):
    m = score(spark, ["x", " A ", "b", "a"], ["a", "B"], 3)
    assert (m.recall, m.rr, m.first_rank) == (1.0, 0.5, 2)
    assert m.ndcg == pytest.approx((1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3)))
    assert score(spark, ["a", "a"], ["a"], 5).ndcg == 1.0 and score(spark, ["x", "a"], ["a"], 1).recall == 0.0
    for ranked, gold, k in ((["a"], [], 3), ([], ["a"], 3), (None, ["a"], 3), (["a"], None, 3)):
        assert tuple(score(spark, ranked, gold, k))[:3] == (0.0, 0.0, 0.0)
    assert score(spark, ["a"], ["a"], 0).recall == 0.0


def test_canonical(spark):
    chains = [("A", ["A", "B"]), ("C", ["C", "B"])]
    assert ev.canonical(["B", "B", "B", "z"], chains) == ["A", "C", "B", "z"]
    df = spark.createDataFrame([("1", ["B"], [("A", ["A", "B"])]), ("2", None, None)], "id string, r array<string>, c array<struct<gold:string,members:array<string>>>")
    assert {x.id: x.ranked for x in ev.canonicalize(df, "id", "r", "c").collect()} == {"1": ["A"], "2": []}


def test_generator_and_bootstrap():
    first = list(itertools.islice(ev.mulberry(42), 3))
    assert first == pytest.approx([0.6011037519201636, 0.44829055899754167, 0.8524657934904099])
    assert ev._mulberry_array(42, 3).tolist() == first
    d = [0.1, -0.2, 0.3, 0.4]
    rnd = ev.mulberry(7)
    means = sorted(sum(d[int(next(rnd) * 4)] for _ in range(4)) / 4 for _ in range(200))
    at = lambda p: means[math.floor(199 * p)] + (means[math.ceil(199 * p)] - means[math.floor(199 * p)]) * (199 * p - math.floor(199 * p))
    assert ev.bootstrap(d, 200, 7) == pytest.approx((0.15, at(0.025), at(0.975)))
    assert ev.bootstrap([]) == (0.0, 0.0, 0.0) and ev.bootstrap([0.5])[1:] == (0.5, 0.5)


def test_sign_test(spark):
    df = spark.createDataFrame([(x,) for x in [0.1] * 9 + [-0.1] * 1 + [0.0] * 3], "delta double")
    r = ev.sign_test(df).first()
    z = (abs(9 - 5) - 0.5) / math.sqrt(2.5)
    assert (r.wins, r.losses, r.ties) == (9, 1, 3) and r.z == pytest.approx(z) and r.p == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-6)
    r = ev.sign_test(df.where("delta = 0")).first()
    assert (r.z, r.p) == (0.0, 1.0)


def test_deltas_gate_verdict(spark):
    a = spark.createDataFrame([("1", 0.5), ("2", 0.25)], "id string, v double")
    b = spark.createDataFrame([("1", 0.75), ("2", 0.25)], "id string, v double")
    assert {r.id: r.delta for r in ev.deltas(a, b, "id", "v").collect()} == {"1": 0.25, "2": 0.0}
    with pytest.raises(ValueError):
        ev.deltas(a, b.limit(1), "id", "v")
    assert ev.gate([0.1] * 20, 0.9, 0.86) and not ev.gate([-0.1] * 20, 0.9, 0.9) and not ev.gate([0.1] * 20, 0.9, 0.84)
    assert ev.verdict("A0", {"A1": [0.1] * 20, "A2": [0.2] * 20, "A3": [0.0] * 20}) == "A2" and ev.verdict("A0", {"A1": [0.1, -0.1] * 10}) == "A0"


def test_harvest(spark):
    t = "2026-06-20 00:00:00"
    rows = [("rotate api keys", ["1", "2", "3"], ["1", "2"], t)] * 3 + [("ghost", ["4"], [], t)] * 2 + [("deep", [str(i) for i in range(10, 21)], ["20"], t)] * 2
    rows += [("Already In Gold ", ["5"], ["5"], t)] * 5 + [("once", ["6"], ["6"], t), ("old", ["6"], ["6"], "2026-01-01 00:00:00"), ("lost", None, None, t)]
    log = spark.createDataFrame(rows, "query string, pool_ids array<string>, final_ids array<string>, t string").withColumn("created_at", F.to_timestamp("t"))
    gold = spark.createDataFrame([("already in gold",), (None,)], "query string")
    got = {r.query: (r.n, r.n_zero, r.modal_final, r.label) for r in mining.harvest(log, "2026-07-01 00:00:00", gold=gold).collect()}
    assert got == {"rotate api keys": (3, 0, ["1", "2"], "frequent"), "ghost": (2, 2, [], "zero-hit"), "deep": (2, 0, ["20"], "low-overlap"), "lost": (1, 1, [], "zero-hit")}
    assert [r.query for r in mining.harvest(log, "2026-07-01 00:00:00", limit=1).collect()] == ["Already In Gold "]


def test_sample_titles_candidates(spark):
    r = random.Random(0)
    df = spark.createDataFrame([(str(i), r.choice(["a", "b", None])) for i in range(60)], "id string, k string")
    got = mining.stratified_sample(df, "id", [F.col("k")], 3)
    assert sorted(x["count"] for x in got.groupBy("k").count().collect()) == [3, 3, 3]
    assert sorted(x.id for x in got.collect()) == sorted(x.id for x in mining.stratified_sample(df.repartition(7), "id", [F.col("k")], 3).collect())
    asked = spark.createDataFrame([(1, " A"), (2, "b"), (3, None), (4, "c")], "q long, t string")
    corpus = spark.createDataFrame([("x", "a"), ("y", "B"), ("z", "b "), ("n", None)], "id string, t string")
    assert {x.q: (x.state, x.match_id) for x in mining.resolve_titles(asked, "q", "t", corpus, "id", "t").collect()} == {1: ("found", "x"), 2: ("ambiguous", None), 3: ("missing", None), 4: ("missing", None)}
    assert mining.parse_candidates('x [{"query":"a"},{"query":" "},3] y') == [{"query": "a"}] and mining.parse_candidates("[") == [] and mining.parse_candidates(json.dumps({"a": 1})) == []
    c = spark.createDataFrame([("A ", 2), ("a", 1), ("b", 1)], "query string, n int")
    assert sorted(tuple(x) for x in mining.dedupe_candidates(c, "query", [F.col("n")]).collect()) == [("a", 1), ("b", 1)]
