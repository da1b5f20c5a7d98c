import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing, packing, quality
from lodestone.llm.split_items import cuts, pieces, split_oversized
from lodestone.llm.survivors import Trust, survivors, undisputed
from lodestone.llm.tokens import encoder, with_tokens

LINES = "".join(f"def f{i}(a):\n    b = a + {i}\n    return b\n\n" for i in range(300))


@pytest.mark.parametrize("text", [LINES, LINES.replace("\n", "\r\n"), LINES.replace("\n", "\r"), "x" * 10_000, "wort " * 3000, "é" * 4001, "日本語。" * 2500, "a" * 3999 + "\n" + "b" * 3999, ("line\n" * 10 + "\n") * 300, "\r\n" * 5000, "é" * 5000, "👩‍👩‍👧" * 2000])
@pytest.mark.parametrize(("limit", "overlap"), [(4000, 200), (1000, 0), (100, 99)])
def test_pieces_join_and_fit(text, limit, overlap):
    if overlap == 99:
        text = text[:1500]
    got = pieces(text, limit, overlap)
    assert all(e - s <= limit and e > s for s, e, *_ in got)
    assert all(min(overlap, got[i - 1][1]) - 64 <= o <= overlap for i, (_, _, o, _, _) in enumerate(got) if i)
    assert not any(text[s - 1 : s + 1] == "\r\n" for s, *_ in got if s)
    if text == LINES:
        assert all(o == overlap for _, _, o, _, _ in got[1:])
    assert "".join(text[s + o : e] for s, e, o, _, _ in got) == text
    for s, e, _, a, z in got:
        lines = text[:s].replace("\r\n", "\n").replace("\r", "\n").count("\n")
        assert abs(a - lines) <= 1 and z >= a


def test_overlap_starts_at_a_whole_letter():
    import unicodedata

    text = "e\u0301" * 5000
    got = pieces(text, 4000, 201)
    assert len(got) > 2 and all(not unicodedata.combining(text[s]) and o in (200, 201) for s, _, o, _, _ in got[1:])
    assert all(o in (200, 201) and text[s] != "\n" for s, _, o, _, _ in pieces("ab\r\n" * 3000, 4000, 201)[1:])


def test_pieces_are_few_balanced_and_at_declarations():
    got = pieces(LINES, 4000, 200)
    assert len(got) <= math.ceil((len(LINES) - 200) / 3800) + 1
    assert all(LINES[e:].startswith("def ") for _, e, *_ in got[:-1])
    sizes = [e - s for s, e, *_ in got]
    assert max(sizes) - min(sizes) < 800 and cuts("x" * 4000, 4000, 200) == [] and len(cuts("x" * 4001, 4000, 200)) == 1


def test_split_frame(spark):
    rows = [("a", "1\n2\n3\n", 10, 1), ("b", LINES, 5, 1), ("c", "", None, 1), ("d", None, 1, 1), ("e", "y" * 9000, None, 1)]
    df = spark.createDataFrame(rows, "id string, content string, start_line int, piece int")
    got = {}
    for r in split_oversized(df, "id", "content", "start_line").orderBy("id", "piece").collect():
        got.setdefault(r.id, []).append(r)
    assert set(got) == {"a", "b", "c", "e"} and (got["a"][0].start_line, got["a"][0].end_line, got["a"][0].content) == (10, 12, "1\n2\n3\n")
    assert "".join(r.content[r.overlap_chars :] for r in got["b"]) == LINES and got["b"][0].start_line == 5 and got["b"][-1].end_line == 5 + LINES.count("\n") - 1
    assert (got["c"][0].start_line, got["c"][0].end_line) == (0, 0) and len(got["e"]) == 3
    assert split_oversized(df.limit(0), "id", "content", "start_line").count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "id", "content", "start_line", 100, 100)


def test_tokens(spark):
    enc = encoder()
    rows = [(1, "Hello world, it's 3 o'clock", 5), (2, "", 5), (3, None, 5), (4, "<|endoftext|>", 5)]
    got = {r.id: r.tokens for r in with_tokens(spark.createDataFrame(rows, "id long, text string, tokens int"), "text").collect()}
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t, _ in rows} and enc.decode(enc.encode_ordinary(rows[0][1])) == rows[0][1]


def check_packing(rows, capacity, got):
    size = {}
    for r in got:
        size.setdefault(r.container, []).append(r)
    for rs in size.values():
        assert sum(r["size"] for r in rs) == rs[0].fill <= capacity and len({r.fill for r in rs}) == 1
    back = {}
    for r in got:
        back.setdefault(r.id, []).append(r)
    assert set(back) == {k for k, _ in rows if k is not None}
    for k, n in rows:
        if k is None:
            continue
        n = n or 0
        assert sum(r["size"] for r in back[k]) == n and len(back[k]) == max(1, math.ceil(n / capacity)) == back[k][0].pieces
    return size


@pytest.mark.parametrize("seed", range(3))
def test_packing(spark, seed):
    r = random.Random(seed)
    rows = [(i, int(r.lognormvariate(5.5, 1))) for i in range(600)] + [(9000, 2048), (9001, 5000), (9002, 0), (9003, None), (None, 5)]
    got = packing.pack(spark.createDataFrame(rows, "id long, n long"), "id", "n", 2048, shard_items=200).collect()
    size = check_packing(rows, 2048, got)
    total = sum(n or 0 for k, n in rows if k is not None)
    assert len(size) <= math.ceil(total / 2048) * 1.02 + 1


def test_packing_corners(spark):
    schema = "id long, n long"
    assert packing.pack(spark.createDataFrame([], schema), "id", "n").count() == 0
    for rows in ([(1, 0)], [(1, 2048)], [(1, 1025), (2, 1025)], [(i, 1024) for i in range(7)], [(i, 700) for i in range(9)]):
        size = check_packing(rows, 2048, packing.pack(spark.createDataFrame(rows, schema), "id", "n").collect())
        assert len(size) == {1: 1, 2: 2, 7: 4, 9: 5}[len(rows)]


@pytest.mark.parametrize("seed", range(20))
def test_local_search_raises_squared_fill(seed):
    r = random.Random(seed)
    sizes = [r.randrange(1, 60) for _ in range(80)]
    bins, fill = [[]], 0
    for i in r.sample(range(80), 80):  # next fit
        if fill + sizes[i] > 100:
            bins.append([])
            fill = 0
        bins[-1].append(i)
        fill += sizes[i]
    square = lambda bs: sum(sum(sizes[i] for i in b) ** 2 for b in bs)
    better = packing.improve([list(b) for b in bins], sizes, 100, 1.0)
    again = packing.improve([list(b) for b in better], sizes, 100, 1.0)
    assert sorted(map(sorted, again)) == sorted(map(sorted, better))  # nothing is left to gain
    assert sorted(i for b in better for i in b) == list(range(80)) and all(sum(sizes[i] for i in b) <= 100 for b in better)
    assert square(better) > square(bins) and len(better) <= len(bins) and len(better) <= sum(sizes) / 100 * 1.05 + 1


def test_quotas_partition_the_blocks():
    totals = [37, 5, 0, 100]
    for shards in (1, 2, 7):
        taken = [set() for _ in totals]
        for s in range(shards):
            at, n = mixing.shard_quotas(totals, shards, s, 3)
            for i, (a, k) in enumerate(zip(at, n)):
                new = set(range(a, a + k))
                assert not new & taken[i]
                taken[i] |= new
        assert [len(t) for t in taken] == totals


def test_mixture(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["Big_Source"] * 6 + ["mid"] * 3 + ["small"]), r.randrange(1, 400), "x") for i in range(3000)] + [(9999, None, 5, ""), (9998, "mid", None, ""), (None, "mid", 5, ""), (9997, "unasked", 10**6, "")]
    docs = spark.createDataFrame(rows, "id long, source string, tokens long, copy string")
    targets = spark.createDataFrame([("big source", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 3), ("gone", 0.05, 2)], "source string, target_share double, max_repeats int")
    got, report = mixing.mixture(docs, "id", "tokens", "source", targets, shard_size=20_000)
    out = got.collect()
    have = {i: n for i, _, n, _ in rows}
    assert len({(x.id, x.copy) for x in out}) == len(out) and all(x.tokens == have[x.id] for x in out)
    assert {s: max(x.copy for x in out if x.source == s) <= m for s, m in (("big-source", 1), ("mid", 2), ("small", 3))} == {"big-source": True, "mid": True, "small": True}
    rep = {x.source: x for x in report.collect()}
    for s, t in (("big-source", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert abs(rep[s].share - t / 0.95) < 0.01 and rep[s].tokens == sum(x.tokens for x in out if x.source == s)
    assert rep["gone"].share == 0 and rep["gone"].tokens == 0
    assert [x for x in rep if rep[x].limits_total] in (["big-source"], ["mid"], ["small"])
    assert rep["unasked"].available_tokens == 10**6 and rep["unasked"].target_share == 0 and rep["unasked"].share == 0 and rep[None].available_rows == 1 and set(rep) == {"big-source", "mid", "small", "gone", "unasked", None}
    per = {}
    for x in out:
        per.setdefault(x.shard, []).append(x.position)
    assert len(per) > 3 and all(sorted(p) == list(range(1, len(p) + 1)) for p in per.values())
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mixture(docs.repartition(5), "id", "tokens", "source", targets, shard_size=20_000)[0].collect()))
    empty, rep = mixing.mixture(docs.limit(0), "id", "tokens", "source", targets)
    small, _ = mixing.mixture(docs, "id", "tokens", "source", targets, shard_size=50)  # more shards than texts
    assert sorted((x.id, x.copy) for x in small.collect()) == sorted((x.id, x.copy) for x in out)
    assert empty.count() == 0 and {x.share for x in rep.collect()} == {0.0}
    assert mixing.mixture(docs, "id", "tokens", "source", targets.limit(0))[0].count() == 0


COMMON = quality.word_lists({"en": frozenset("the a of and to in is was that it by with for which not are be as on had its when".split()), "de": frozenset("der die das und ist nicht ein von mit den wurde".split())})
PROSE = "The cache was moved to the lower level when it had failed. It is not clear which of the nodes had written the last block, and that is a risk for all of them."


@pytest.mark.parametrize("text", [PROSE, PROSE.lower().replace(".", "").replace(",", ""), "\n".join(PROSE[i : i + 60] for i in range(0, len(PROSE), 60)), "- " + PROSE.replace(". ", ".\n- "), "[12:30] " + PROSE, "> " + PROSE, "user: " + PROSE, "2026-05-22T18:14:00Z INFO " + PROSE, PROSE.upper(), "# Title\n\n" + PROSE, "Der Plan ist nicht von der Gruppe und wurde mit den Daten verworfen, die das Team hat."])
def test_prose(text):
    assert quality.statistics(text, COMMON)[-1] is True


@pytest.mark.parametrize("text", ["- a cached ticket;\n- empty;\n- slow alias", "a,b,c\n1,2,3\n4,5,6", "key=1 v=2\nkey=3 v=4", "2026-05-22T18:14:00Z ERROR [x] suffix=6\n" * 4, "TODO\n" * 30, PROSE.split(". ")[0] + ".\n" + "x,1,2\n" * 60, (PROSE.split(". ")[0] + ".\n") * 20, "zq xv ñ" * 50, "Envida fazi zelselfa yage pelmimund xenbe beta!", "for x in y; do\n  run it\ndone", "type A struct {\n\tB string\n\tC bool // " + PROSE + "\n}\n", "for it in that.was():\n    if it.is_on and not it.was(to):\n        return it.on()\n", "SELECT a FROM t WHERE b IS NOT NULL AND c IN (1);", "    at f (a.go:5:6)\n" * 5, "🙂" * 100])
def test_not_prose(text):
    assert quality.statistics(text, COMMON)[-1] is False


FILLER = "the team of the plan will be in a review and " * 60


def wrapped(text, seed=5):
    r, ws, lines = random.Random(seed), text.split(), []
    while ws:
        n = r.randrange(8, 30)
        lines.append(" ".join(ws[:n]))
        ws = ws[n:]
    return "\n".join(lines)


@pytest.mark.parametrize("text", [FILLER, wrapped(FILLER), "".join(f"the team of the plan {i} will be in a review and the " for i in range(60)), "\n\n".join(wrapped(FILLER[:600], i) for i in range(6))])
def test_filler_without_end_marks(text):
    common = quality.word_lists({"en": set("the of will be in a and".split())})
    assert quality.statistics(text, common)[-1] is False
    assert quality.statistics(FILLER[:45], common)[-1] is True


def test_prose_with_a_recurring_phrase():
    common = quality.word_lists({"en": set("the of will be in a and".split())})
    text = "\n".join(f"In the review of the plan the {w}1 and the {w}2 of {w}3 will be in {w}4 and a {w}5 of the {w}6." for w in "abcdefgh")
    assert quality.statistics(text, common)[-1] is True


def test_quality_frame(spark):
    words = spark.createDataFrame([("en", w) for w in COMMON["en"]] + [("en", None), (None, "x")], "lang string, word string")
    rows = [(1, PROSE), (2, None), (3, ""), (4, " \n "), (5, "a a a a a a"), (6, "x" * 1_000_000), (7, "same line\nsame line\n\nsame line\nsame line")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "id long, text string, is_prose string")
    got = {r.id: r for r in quality.text_quality(df, "id", "text", words).collect()}
    assert got[1].is_prose and got[1].language == "en" and got[1].terminal_line_share == 1.0 and 0.4 < got[1].common_word_share < 0.8
    assert all(got[i].is_prose is None and got[i].n_words == 0 for i in (2, 3, 4)) and got[5].ngram_coverage == 1.0 and got[6].mean_word_length == 1_000_000
    assert got[7].duplicate_line_share == 0.75 and got[7].duplicate_paragraph_share == 0.5
    assert quality.text_quality(df.limit(0), "id", "text", words).count() == 0


def test_survivors(spark):
    t = lambda d: f"2026-0{d}-01 00:00:00"
    rows = [
        ("g", "1", "Title", "x", True, 0.5, 3, t(1), "decision"),
        ("g", "2", "title ", "y", True, 0.9, 5, t(3), None),
        ("g", "3", None, "y", None, None, None, t(2), "session"),
        ("h", "4", "a", "x", True, 0.5, None, t(1), None),
        ("h", "5", "b", "x", False, 0.5, 7, t(2), None),
        ("k", "6", None, None, None, None, None, None, None),
        ("k", "7", None, None, None, None, None, None, None),
        ("s", "8", "z", "z", True, 1.0, 1, t(1), None),
        (None, "9", "z", "z", True, 1.0, 1, t(1), None),
    ]
    df = spark.createDataFrame(rows, "g string, id string, title string, content string, pinned boolean, importance float, access_count int, at string, kind string").withColumn("created_at", F.to_timestamp("at")).withColumn("value", F.lit(1)).withColumn("votes", F.lit(2))
    best = ["pinned", "importance", "access_count", "created_at"]
    trust = Trust("kind", {"decision": 3.0}, 1.0, "created_at", "2026-07-01", 3650.0)
    got = {r.g: r for r in survivors(df, "g", ["title", "content"], best, trust).collect()}
    assert set(got) == {"g", "h", "k", "s"} and got["g"].n_rows == 3 and got["k"].title is None and got["k"].pinned is None
    assert (got["g"].title, got["g"].content, got["g"].pinned, got["g"].access_count) == ("Title", "x", True, 5)
    trusting = Trust(None, {}, 1.0, "created_at", "2026-07-01", 3650.0)
    assert {r.g: r.content for r in survivors(df, "g", ["content"], best, trusting).collect()}["g"] == "y"
    assert sorted(r.id for r in undisputed(df, "g", "id", best, Trust(None, {}, 1.0, "created_at", "2026-07-01")).collect()) == ["2", "6", "7"]
    assert survivors(df.limit(0), "g", ["title"], best, trust).count() == 0 and undisputed(df.limit(0), "g", "id", best, trust).count() == 0
