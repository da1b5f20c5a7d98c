import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import setjoin
from lodestone.llm.cross_split import cross_split_overlaps, cut, rolling
from lodestone.llm.history import HistoryTable, held_intake, loads
from lodestone.llm.near_dups import group_pairs, near_duplicate_groups


def words(s):
    return frozenset(re.findall("[a-z0-9]+", (s or "").lower()))


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def corpus(seed, n=160, vocabulary=400, common=6):
    """Texts with edits, copies, common words and empty ones."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)]
    out = []
    for _ in range(n):
        if out and r.random() < 0.5:
            ws = r.choice(out).split()
            for _ in range(r.randrange(0, max(1, len(ws) // 4) + 1)):
                k = r.randrange(3)
                if k == 0 and ws:
                    ws.pop(r.randrange(len(ws)))
                elif k == 1:
                    ws.insert(r.randrange(len(ws) + 1), r.choice(vocab))
                else:
                    r.shuffle(ws)
        else:
            ws = r.sample(vocab, r.randrange(1, 25)) + r.sample([f"c{i}" for i in range(common)], r.randrange(common))
        out.append(" ".join(ws))
    return out + ["", " .. ", "w1", "w1", "W1!"]


def groups_of(texts, theta):
    parent = {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if share(texts[a], texts[b]) >= theta - 1e-12:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}


@pytest.mark.parametrize(("theta", "cap"), [(0.7, 500), (0.7, 2), (0.6, 2), (0.8, 1), (0.5, 2), (0.3, 2), (1.0, 1)])
def test_similar_texts_is_exact(spark, theta, cap):
    texts = corpus(int(theta * 10) + cap)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    members, reps = setjoin.collapse(setjoin.word_sets(df, "id", F.col("t")))
    of = {}
    for m in members.collect():
        of.setdefault(m.rid, words(texts[m.doc]))
    got = {(min(r.a, r.b), max(r.a, r.b)): r.share for r in setjoin.similar_texts(reps, theta, cap=cap).collect()}
    ids = sorted(of)
    want = {(a, b): share(of[a], of[b]) for a in ids for b in ids if a < b and share(of[a], of[b]) >= theta - 1e-12}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups(spark, seed):
    texts = {f"d{i:03}": t for i, t in enumerate(corpus(seed))}
    rows = [(k, t, 1, "x") for k, t in texts.items()] + [("nul", None, None, None), (None, "w1", 0, "")]
    # columns with names that the operator itself uses
    df = spark.createDataFrame(rows, "id string, t string, rid int, words string")
    got = {r.doc: (r.group_id, r.links) for r in near_duplicate_groups(df, "id", F.col("t"), 0.7, count_links=True).collect()}
    sets = {k: words(t) for k, t in texts.items()} | {"nul": words(None)}
    want = groups_of(sets, 0.7)
    assert {k: v[0] for k, v in got.items()} == want
    assert {k: v[1] for k, v in got.items()} == {k: sum(share(sets[k], sets[j]) >= 0.7 - 1e-12 for j in sets if j != k) for k in sets}


@pytest.mark.parametrize(("seed", "theta", "crowded"), [(11, 0.7, 3), (12, 0.6, 5), (13, 0.8, 2)])
def test_crowded_regions_are_compared_in_blocks(spark, monkeypatch, seed, theta, crowded):
    r = random.Random(seed)
    base = [[f"b{k}x{i}" for i in range(20)] for k in range(3)]
    rows = []
    for i in range(120):  # many variants of a few texts, some of them far from each other
        ws = list(base[i % 3])
        for _ in range(r.randrange(0, 9)):
            ws[r.randrange(len(ws))] = r.choice(base[i % 3] + [f"z{r.randrange(40)}"])
        rows.append((f"d{i:03}", " ".join(ws)))
    df = spark.createDataFrame(rows, "id string, t string")
    _, reps = setjoin.collapse(setjoin.word_sets(df, "id", F.col("t")))
    full = {(min(x.a, x.b), max(x.a, x.b)) for x in setjoin.similar_texts(reps, theta, cap=2).collect()}
    monkeypatch.setattr(setjoin, "BLOCK_ROWS", 8)
    some = {(min(x.a, x.b), max(x.a, x.b)) for x in setjoin.connecting_texts(reps, theta, cap=2, crowded=crowded).collect()}
    assert some <= full and len(some) < len(full)  # true links only, and fewer

    def joined(pairs):
        of = {x: x for p in full for x in p}
        for a, b in sorted(pairs) * len(of):
            of[a] = of[b] = min(of[a], of[b])
        return of

    assert joined(some) == joined(full)


def test_group_pairs_and_empty(spark):
    df = spark.createDataFrame([("b", "x y z"), ("a", "x y z"), ("c", "q")], "id string, t string")
    g = near_duplicate_groups(df, "id", F.col("t"))
    assert [tuple(r) for r in group_pairs(g).collect()] == [("a", "b")]
    assert near_duplicate_groups(df.limit(0), "id", F.col("t")).count() == 0
    assert near_duplicate_groups(df.select("id", F.lit(None).cast("string").alias("t")), "id", F.col("t")).count() == 3


def test_pairs_of_a_large_group(spark):
    from itertools import combinations

    rows = [(f"d{i:03}", "g" if i < 60 else f"s{i // 2}") for i in range(70)]
    got = sorted(tuple(r) for r in group_pairs(spark.createDataFrame(rows, "doc string, group_id string"), 7).collect())
    assert got == sorted((a, b) for (a, x), (b, y) in combinations(rows, 2) if x == y)


def test_a_third_are_copies_and_long_text(spark):
    rows = [(i, "same text for all of these rows") for i in range(300)] + [(1000 + i, f"a{i} b{i} c{i} same text") for i in range(100)] + [(5000, " ".join(f"v{i}" for i in range(20_000))), (5001, " ".join(f"v{i}" for i in range(19_000)))]
    got = {r.doc: (r.group_id, r.links) for r in near_duplicate_groups(spark.createDataFrame(rows, "id long, t string"), "id", F.col("t"), count_links=True).collect()}
    assert all(got[i] == (0, 299) for i in range(300)) and got[1005] == (1005, 0) and got[5001] == (5000, 1)


def intake_truth(hist, intake, theta):
    h = [words(t) for t in hist]
    out, seen = {}, []
    for k, t in intake:
        w = words(t)
        old = any(share(w, x) >= theta - 1e-12 for x in h)
        out[k] = (old or any(share(w, x) >= theta - 1e-12 for x in seen), old)
        seen.append(w)
    return out


def test_held_intake(spark):
    hist, new = corpus(5), corpus(6) + corpus(5)[:30]
    rows = [(10 * i, t, i // 40, "x") for i, t in enumerate(new)] + [(99_999, None, 9, None)]
    h, n = spark.createDataFrame([(t,) for t in [*hist, None]], "t string"), spark.createDataFrame([*rows, (None, "w1", 1, None), (100_000, "w1", None, None)], "id long, t string, b long, rid string")
    want = intake_truth(hist, [(k, t) for k, t, *_ in rows] + [(100_000, "w1")], 0.7)
    for load_rows in (1, 60, 10_000):
        got = {r.id: (r.held, r.by_history) for r in held_intake(h, F.col("t"), n, "id", "b", F.col("t"), 0.7, load_rows).collect()}
        assert got == want
    assert {r.held for r in held_intake(h.limit(0), F.col("t"), n.where("id = 0"), "id", "b", F.col("t"), 0.7).collect()} == {False}
    assert held_intake(h, F.col("t"), n.limit(0), "id", "b", F.col("t")).count() == 0


def test_loads(spark):
    df = spark.createDataFrame([(b,) for b, n in ((1, 3), (2, 9), (4, 1), (5, 2), (6, 20), (7, 1), (None, 2)) for _ in range(n)], "b long")
    sizes = [df.where(c).count() for c in loads(df, "b", 10)]
    assert sizes == [12, 23, 1, 2] and [df.where(c).count() for c in loads(df, "b", 1)] == [3, 9, 1, 2, 20, 1, 2] and loads(df.limit(0), "b", 10) == []


def test_history_table_batches_and_sessions(spark, tmp_path):
    hist, new = corpus(7, 80), corpus(8, 60) + corpus(7, 80)[:20]
    path = f"file://{tmp_path}/table"
    HistoryTable.build(spark.createDataFrame([(t,) for t in hist], "t string"), F.col("t"), 0.7, path, range_rows=50)
    accepted = [words(t) for t in hist]
    for k, at in enumerate(range(0, len(new), 30)):
        table = HistoryTable(spark.newSession() if k % 2 else spark, path)  # opened again from what is stored
        assert table.parts() == k + 1 and table.ranges > 4
        rows = [(f"k{at + i}", t) for i, t in enumerate(new[at : at + 30])] + [(f"n{at}", None)]
        batch = table.spark.createDataFrame(rows, "k string, t string")
        got = {r.k: r.held for r in table.probe(batch, "k", F.col("t")).collect()}
        assert got == {k: any(share(words(t), x) >= 0.7 - 1e-12 for x in accepted) for k, t in rows}
        fresh = [(k, t) for k, t in rows if not got[k]]
        table.append(table.spark.createDataFrame(fresh, "k string, t string"), F.col("t"))
        accepted += [words(t) for _, t in fresh]


def test_a_part_cut_short_leaves_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/table"
    table = HistoryTable.build(spark.createDataFrame([("a b c",)], "t string"), F.col("t"), 0.7, path)
    real = HistoryTable.parts
    lost = spark.createDataFrame([("x y z",)], "t string")
    table.append(lost, F.col("t"))
    monkeypatch.setattr(HistoryTable, "parts", lambda self: real(self) - 1)  # as if the log had not been reached
    held = lambda t: table.probe(spark.createDataFrame([(1, t)], "k int, t string"), "k", F.col("t")).first().held
    assert not held("x y z") and held("a b c")
    table.append(spark.createDataFrame([("p q r",)], "t string"), F.col("t"))
    monkeypatch.setattr(HistoryTable, "parts", lambda self: 2)
    assert held("p q r") and not held("x y z")


def test_a_batch_reads_a_bounded_share_of_history(spark, tmp_path):
    r = random.Random(4)
    hist = [" ".join(f"v{r.randrange(50_000)}" for _ in range(12)) for _ in range(3000)]
    table = HistoryTable.build(spark.createDataFrame([(t,) for t in hist], "t string"), F.col("t"), 0.7, f"file://{tmp_path}/t", range_rows=100)
    assert table.ranges >= 64
    _, texts = setjoin.collapse(setjoin.word_sets(spark.createDataFrame([(1, hist[7])], "k int, t string"), "k", F.col("t")))
    ranges = [x["range"] for x in table._distances(texts).select("range").distinct().collect()]
    read, whole = (table._read("distances", 1, x).select(F.input_file_name().alias("f")) for x in (ranges, list(range(table.ranges))))
    assert 0 < read.distinct().count() <= len(ranges) <= 13 and read.distinct().count() < whole.distinct().count() / 4 and read.count() < whole.count() / 4


def test_history_table_copies_of_frequent_words(spark, monkeypatch):
    # more texts than REGION_TEXTS hold the words, so that their regions ask for words that short texts don't have
    hist = [f"done now w{i} v{i} u{i} t{i}" for i in range(600)] + ["done", "now done"]
    monkeypatch.setattr(setjoin, "REGION_TEXTS", 500)
    table = HistoryTable.build(spark.createDataFrame([(t,) for t in hist], "t string"), F.col("t"), 0.7)
    rows = [("one", "Done."), ("two", "done, now"), ("other", "now"), ("new", "done w1"), ("long", hist[5] + "!")]
    got = {r.k: r.held for r in table.probe(spark.createDataFrame(rows, "k string, t string"), "k", F.col("t")).collect()}
    assert got == {"one": True, "two": True, "other": False, "new": False, "long": True}


def test_chunks():
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    assert cut(text, 0) == text.split() and cut("", 3) == []
    for bits in (1, 2, 3):
        assert " ".join(cut(text, bits)) == text
    # an edit in front leaves the cuts behind it where they were
    long = " ".join(f"w{i * 7919 % 1000}" for i in range(400))
    assert len(set(cut(long, 3)) & set(cut("new words " + long, 3))) >= len(cut(long, 3)) - 2
    a = rolling(b"xxxxhello world, again")
    assert a[-1] == rolling(b"yyhello world, again")[-1]


def test_cross_split(spark):
    texts = corpus(9, 120)
    r = random.Random(3)
    rows = [(f"r{i:03}", t, r.choice(["train", "dev", "test"]), "x") for i, t in enumerate(texts)] + [("z1", None, "train", None), ("z2", "w1", None, None), (None, "w1", "dev", None)]
    df = spark.createDataFrame(rows, "id string, query string, split string, tag string")
    got = {(x.train_id, x.other_id): x for x in cross_split_overlaps(df, "id", "query", "split", "train", 0.6).collect()}
    train = [(k, words(t)) for k, t, s, _ in rows if k and s == "train"]
    other = [(k, words(t)) for k, t, s, _ in rows if k and s in ("dev", "test")]
    assert got.keys() == {(a, b) for a, x in train for b, y in other if share(x, y) >= 0.6 - 1e-12}
    by = {k: words(t) for k, t, *_ in rows if k}
    for (a, b), x in got.items():
        common = sum(map(len, by[a] & by[b]))
        assert abs(x.share - share(by[a], by[b])) < 1e-12 and abs(x.train_overlap - common / sum(map(len, by[a]))) < 1e-12 and abs(x.other_overlap - common / sum(map(len, by[b]))) < 1e-12
    assert cross_split_overlaps(df.limit(0), "id", "query", "split").count() == 0


def test_longer_chunks_find_long_overlaps(spark):
    base = " ".join(f"q{i * 31 % 977}" for i in range(300))
    df = spark.createDataFrame([("a", base, "train"), ("b", "some other start " + base, "dev"), ("c", " ".join(f"u{i}" for i in range(300)), "test")], "id string, q string, s string")
    got = cross_split_overlaps(df, "id", "q", "s", theta=0.5, mask_bits=2).collect()
    assert [(x.train_id, x.other_id) for x in got] == [("a", "b")] and got[0].train_overlap > 0.9 and got[0].by_chunks


def test_variants_of_one_text_meet_their_leaders(spark):
    r = random.Random(2)
    base = [f"b{i}" for i in range(24)]
    rows = [(i, " ".join(base[:22] + [f"y{i}", r.choice(base)])) for i in range(300)]
    _, reps = setjoin.collapse(setjoin.word_sets(spark.createDataFrame(rows, "id long, t string"), "id", F.col("t")))
    ties = setjoin.leaders(reps, 0.7).collect()
    assert len({t.a for t in ties}) > 250 and all(t.a > t.b for t in ties)
    got = near_duplicate_groups(spark.createDataFrame(rows, "id long, t string"), "id", F.col("t"), 0.7, crowded=20)
    assert {x.group_id for x in got.collect()} == {0}
