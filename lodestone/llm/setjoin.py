"""Exact similarity join of word sets under the Jaccard distance: a prefix filter on rare words, split by further words.

Words are ordered from the rarest. If two texts share at least t words, their first common word stands among the first
n - t + 1 of either; the sizes bound t from both sides, so the larger text of a pair takes part in the regions of
n - theta * n + 1 of its words, the smaller one in those of n - 2 * theta / (1 + theta) * n + 1. Seen as a metric join,
single words are pivots at distance 1 - 1/n from the texts that contain them, ties going to the rarer word, and a text is
replicated to the pivots that may be the nearest common one. A word that too many texts contain is split again by the
second and third common word until the expected region is small. All of it is exact: no text, region or pair is dropped.

Region rows carry a sketch of the text, 128 parities of its distance to the empty set on slices of the vocabulary. Each
slice obeys the triangle inequality, so pairs too far apart leave within the join of the regions, before any words move.

Where only the groups that links make are asked for, each text is first tied to a leader, a text within 1 - theta of it
that shares a least hash with it. Pairs of texts tied to the same leader are passed over, since the ties connect them
already, and words are counted in texts without a leader, so thousands of variants of one text neither make pairs nor
make their words frequent. Regions that hold many texts all the same are compared in blocks (`crowded_pairs`).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize

#: Bound on the frequent words whose counts every task gets: 16 bytes each, whatever the size of the input.
FREQUENT_WORDS = 200_000
#: Texts that a region may be expected to hold before it is split by a further word.
REGION_TEXTS = 10_000
EPS = 1e-9


def words(text: Column) -> Column:
    """Distinct words: maximal runs of a-z and 0-9 after lower-casing. Null counts as empty."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")), "")


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x.view(np.int64)


def digest(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little", signed=True)


def _offsets(n: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(n)].astype(np.int32)


def set_columns(row: np.ndarray, h: np.ndarray, rows: int) -> list[pa.Array]:
    """words, n, k1, k2, s1 and s2 of `rows` sets, from the row and hash of each element: the sorted distinct hashes, their number, two hashes of the whole set, and the sketch."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    row, h = row[new], h[new]
    n = np.bincount(row, minlength=rows)
    k1, k2, s1, s2 = (np.zeros(rows, np.int64) for _ in range(4))
    if len(h):
        full = np.flatnonzero(n)
        at = (np.cumsum(n) - n)[full]
        with np.errstate(over="ignore"):
            k1[full] = np.add.reduceat(_mix(h, np.full(len(h), 11, np.int64)), at)
            k2[full] = np.add.reduceat(_mix(h, np.full(len(h), 13, np.int64)), at)
        bit = np.left_shift(np.uint64(1), h.view(np.uint64) & np.uint64(63))
        upper = (h & 64) != 0
        s1[full] = np.bitwise_xor.reduceat(np.where(upper, np.uint64(0), bit), at).view(np.int64)
        s2[full] = np.bitwise_xor.reduceat(np.where(upper, bit, np.uint64(0)), at).view(np.int64)
    return [pa.ListArray.from_arrays(pa.array(_offsets(n)), pa.array(h)), pa.array(n.astype(np.int32)), pa.array(k1), pa.array(k2), pa.array(s1), pa.array(s2)]


def _hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 8192):
            part = b.slice(at, 8192)
            text = pc.utf8_lower(pc.replace_substring(pc.fill_null(part.column("text"), ""), "\u0130", "i\u0307"))
            lists = pc.split_pattern_regex(text, "[^a-z0-9]+")
            n = np.diff(np.asarray(lists.offsets))
            coded = lists.flatten().dictionary_encode()
            table = np.array([digest(w) for w in coded.dictionary.to_pylist()] or [0], np.int64)
            empty = np.array([w == "" for w in coded.dictionary.to_pylist()] or [True])
            code = coded.indices.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)
            keep = ~empty[code]
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("tag"), *set_columns(row[keep], table[code[keep]], len(n))], ["doc", "tag", "words", "n", "k1", "k2", "s1", "s2"])


SET_COLUMNS = "tag int, words array<long>, n int, k1 long, k2 long, s1 long, s2 long"


def word_sets(docs: DataFrame, id_col: str, text: Column, tag: Column | None = None) -> DataFrame:
    """(doc, tag, words, n, k1, k2, s1, s2): the words of each text as sorted 64-bit hashes, their number, hashes of the whole set, and its sketch.

    Cutting and hashing run on Arrow batches; each distinct word of a batch is hashed once.
    """
    rows = docs.select(F.col(id_col).alias("doc"), (tag if tag is not None else F.lit(0)).cast("int").alias("tag"), text.cast("string").alias("text"))
    return rows.mapInArrow(_hash_words, f"doc {docs.schema[id_col].dataType.simpleString()}, {SET_COLUMNS}")


def collapse(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, texts): the class `rid` of every document, and one row per distinct non-empty word set.

    Copies meet in a pre-aggregation, so a class may hold any share of the rows. `tag` of a text is the union of the
    bits of its copies. Documents without words belong to no class and are not members.
    """
    sets = materialize(sets.where("n > 0"), "sets")
    texts = materialize(
        sets.groupBy("k1", "k2").agg(F.first("words").alias("words"), F.bit_or("tag").alias("tag"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("s1").alias("s1"), F.first("s2").alias("s2")).select(F.monotonically_increasing_id().alias("rid"), "k1", "k2", "tag", "copies", "n", "s1", "s2", "words"),
        "texts",
    )
    members = materialize(sets.select("doc", "tag", "k1", "k2").join(texts.select("k1", "k2", "rid"), ["k1", "k2"]).select("doc", "tag", "rid"), "members")
    discard(sets)
    return members, texts


def frequent_words(texts: DataFrame, limit: int = FREQUENT_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts, over all texts, of the words that make up at least 1 / limit of all: there can't be more than `limit` of them."""
    total = texts.agg(F.sum("n")).first()[0] or 0
    least = max(3, -(-total // limit))
    top = texts.select(F.explode("words").alias("w")).groupBy("w").count().where(F.col("count") >= least).collect()
    top.sort(key=lambda r: r["w"])
    return np.array([r["w"] for r in top], np.int64), np.array([r["count"] for r in top], np.int64)


def _regions(theta: float, keys: np.ndarray, counts: np.ndarray, total: int, cap: int, hot: np.ndarray | None):
    """A mapInArrow function: texts to the regions (key, rid, m, s1, s2, label) each takes part in as the larger text of a pair.

    m packs the number of words, that of words from the first pivot on (the most that it can share with a text it first
    meets there), the tag, whether it takes part as the smaller text, too, and whether the region is of several words.
    With `hot`, sorted hashes, only regions all words of which are among them come out.
    """
    narrow = 2 * theta / (1 + theta)
    depth = max(1, min(3, math.ceil(theta / (1 - theta) - EPS))) if theta < 1 else 3  # words that different texts share at least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            flat, off = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets)
            n = np.diff(off)
            if not len(flat):
                continue
            row = np.repeat(np.arange(len(n)), n)
            count = np.zeros(len(flat), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
                count = np.where(keys[at] == flat, counts[at], 0)
            order = np.lexsort((flat, count, row))
            flat, count = flat[order], count[order]
            start = np.repeat(np.cumsum(n) - n, n)
            pos, size = np.arange(len(flat)) - start, n[row]
            last = size - np.ceil(theta * size - EPS).astype(np.int64)  # the first common word stands here at the latest
            last_short = size - np.ceil(narrow * size - EPS).astype(np.int64)
            is_hot = np.isin(flat, hot) if hot is not None else np.ones(len(flat), bool)
            live = np.flatnonzero((pos <= last) & is_hot)
            key, first, tip, expect, short = flat[live], live, live, count[live].astype(float), pos[live] <= last_short[live]
            out = []
            for level in range(1, depth + 1):
                done = (expect <= cap) | (level == depth)
                out.append((key[done], first[done], short[done], np.full(int(done.sum()), level > 1)))
                key, first, tip, expect, short = (z[~done] for z in (key, first, tip, expect, short))
                if not len(key):
                    break
                room = last[first] + level - pos[tip]  # the next common word stands at most this much further on
                room = np.maximum(np.minimum(room, size[first] - 1 - pos[tip]), 0)
                rep = np.repeat(np.arange(len(key)), room)
                tip = tip[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(room) - room, room) + 1
                rep, tip = rep[is_hot[tip]], tip[is_hot[tip]]
                key, first = _mix(key[rep], flat[tip]), first[rep]
                short = short[rep] & (pos[tip] <= last_short[first] + level)
                expect = expect[rep] * count[tip] / max(total, 1)
            key, first, short, multi = (np.concatenate(z) for z in zip(*out))
            r = row[first]
            tag = batch.column("tag").to_numpy(zero_copy_only=False).astype(np.int64)[r]
            m = (n[r].astype(np.int64) << 34) | ((size[first] - pos[first]).astype(np.int64) << 4) | (tag << 2) | (short.astype(np.int64) << 1) | multi
            kept = [pa.array(batch.column(c).to_numpy(zero_copy_only=False)[r]) for c in ("rid", "s1", "s2", "label")]
            yield pa.RecordBatch.from_arrays([pa.array(key), kept[0], pa.array(m), *kept[1:]], ["key", "rid", "m", "s1", "s2", "label"])

    return run


def region_rows(texts: DataFrame, theta: float, keys: np.ndarray, counts: np.ndarray, total: int, cap: int | None = None, hot: np.ndarray | None = None) -> DataFrame:
    """(key, rid, m, s1, s2, label): the regions each text takes part in. Texts of up to 2**29 distinct words; label is the rid where texts have none.

    All rows that are to meet must be made with the same keys, counts and total: they fix the order of the words.
    """
    label = F.col("label") if "label" in texts.columns else F.col("rid").alias("label")
    return texts.select("rid", "tag", "n", "s1", "s2", label, "words").mapInArrow(_regions(theta, keys, counts, total, cap or REGION_TEXTS, hot), "key long not null, rid long not null, m long not null, s1 long not null, s2 long not null, label long not null")


def size_of(x: str) -> str:
    return f"({x}.m >> 34)"


def _left(x: str) -> str:
    return f"(({x}.m >> 4) & 536870911)"


def tag_of(x: str) -> str:
    return f"(({x}.m >> 2) & 3)"


def is_short(x: str) -> str:
    return f"({x}.m & 2) <> 0"


def may_be_near(theta: float, ordered: bool = True) -> str:
    """SQL: neither size, position nor sketch keeps apart a, the larger text (with `ordered`), and b."""
    both = f"({size_of('a')} + {size_of('b')})"
    t = f"({theta / (1 + theta)!r} * {both} - {EPS!r})"
    sketch = f"bit_count(a.s1 ^ b.s1) + bit_count(a.s2 ^ b.s2) <= {(1 - theta) / (1 + theta)!r} * {both} + {EPS!r}"
    if ordered:
        sizes = f"{size_of('b')} <= {size_of('a')} and {size_of('b')} >= {theta!r} * {size_of('a')} - {EPS!r}"
    else:
        lo, hi = f"least({size_of('a')}, {size_of('b')})", f"greatest({size_of('a')}, {size_of('b')})"
        short = f"if({size_of('a')} < {size_of('b')}, {is_short('a')}, {is_short('b')})"
        sizes = f"{lo} >= {theta!r} * {hi} - {EPS!r} and {short}"
    return f"{sizes} and {_left('a')} >= {t} and {_left('b')} >= {t} and {sketch}"


def join_regions(regions: DataFrame, theta: float, allow: str = "a.label <> b.label") -> DataFrame:
    """Candidate pairs (a, b), a being the larger text: they share a region, and nothing in its rows keeps them apart. Each comes once.

    The rows are shuffled once for both sides: the condition that b takes part as the smaller text, with its rarest words
    alone, is put so that it can't be moved below the shuffle.
    """
    regions = regions.repartition("key")
    smaller = regions.where("if(spark_partition_id() >= 0, m & 2 <> 0, false)")
    cond = f"a.key = b.key and ({allow}) and {may_be_near(theta)} and ({size_of('b')} < {size_of('a')} or b.rid < a.rid)"
    return regions.alias("a").join(smaller.alias("b"), F.expr(cond)).select(F.col("a.rid").alias("a"), F.col("b.rid").alias("b")).distinct()


#: Bits of the filter that spares texts without candidates a shuffle: so many per candidate, and at most; beyond it lets more through.
FILTER_SHARE, FILTER_BITS = 16, 1 << 27


def thin(df: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """df (rid, words) without most rows whose rid is not in ids (rid), of which there are `count`: a bitmap, made from partial sums, which never drops one that is."""
    bits = 1 << min(max(16, math.ceil(math.log2(max(count, 1) * FILTER_SHARE))), FILTER_BITS.bit_length() - 1)
    place = F.pmod(F.xxhash64("rid"), F.lit(bits))
    held = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("x")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[held["w"].to_numpy()] = held["x"].to_numpy()
    shared = df.sparkSession.sparkContext.broadcast(table)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            p = batch.column("p").to_numpy(zero_copy_only=False)
            yield batch.select(["rid", "words"]).filter(pa.array((held[p >> 6] >> (p & 63)) & 1 == 1))

    return df.select("rid", "words", place.alias("p")).mapInArrow(keep, "rid long, words array<long>")


def verify(pairs: DataFrame, texts: DataFrame, theta: float) -> DataFrame:
    """(a, b, share) of the candidate pairs (a written table) whose true word share is at least theta."""
    ids = pairs.select(F.col("a").alias("rid")).union(pairs.select(F.col("b").alias("rid")))
    used = thin(texts, ids, 2 * pairs.count())
    both = pairs.join(used.select(F.col("rid").alias("a"), F.col("words").alias("wa")), "a").join(used.select(F.col("rid").alias("b"), F.col("words").alias("wb")), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    return both.select("a", "b", (common / (F.size("wa") + F.size("wb") - common)).alias("share")).where(F.col("share") >= theta - 1e-12)


def similar_texts(texts: DataFrame, theta: float, allow: str = "true", cap: int = REGION_TEXTS, frequent: int = FREQUENT_WORDS, order: tuple[np.ndarray, np.ndarray, int] | None = None) -> DataFrame:
    """All pairs (a, b, share) of distinct texts (as made by `collapse`) whose word share is at least theta.

    `allow` is a SQL condition over the tags of a and b (see `tag_of`) that a pair must meet; a is the larger text, or that
    of the higher rid. Works for 0 < theta <= 1; no texts give no pairs. `order`: keys, counts and total of a fixed order
    of words, by default that of these texts.
    """
    if not 0 < theta <= 1:
        raise ValueError("theta must be in (0, 1]")
    keys, counts, total = order or (*frequent_words(texts, frequent), texts.count())
    pairs = materialize(join_regions(region_rows(texts, theta, keys, counts, total, cap), theta, allow), "candidates")
    return verify(pairs, texts, theta)


#: Texts that a region may hold before it is compared in blocks, rows of a block, and least hashes that leaders are drawn by.
CROWDED, BLOCK_ROWS, LEADER_HASHES = 8192, 4096, 4


def leaders(texts: DataFrame, theta: float, hashes: int = LEADER_HASHES) -> DataFrame:
    """(a, b): texts a and their leaders b, of word share >= theta: of the texts that have one of `hashes` least hashes in common with a, the one of the least rid."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            flat, off = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets)
            if not len(flat):
                continue
            got = np.stack([np.minimum.reduceat(_mix(flat, np.full(len(flat), 101 + i, np.int64)), off[:-1] - off[0]) ^ i for i in range(hashes)], 1)
            rep = pa.array(np.repeat(np.arange(batch.num_rows), hashes))
            yield pa.RecordBatch.from_arrays([pa.array(got.ravel()), *(batch.column(c).take(rep) for c in ("rid", "n", "s1", "s2"))], ["key", "rid", "n", "s1", "s2"])

    rows = texts.select("rid", "n", "s1", "s2", "words").mapInArrow(least, "key long, rid long, n int, s1 long, s2 long")
    first = rows.groupBy("key").agg(F.min(F.struct("rid", "n", "s1", "s2")).alias("l"))
    near = f"l.rid <> rid and least(l.n, n) >= {theta!r} * greatest(l.n, n) - {EPS!r} and bit_count(s1 ^ l.s1) + bit_count(s2 ^ l.s2) <= {(1 - theta) / (1 + theta)!r} * (n + l.n) + {EPS!r}"
    pairs = rows.join(first, "key").where(near).select(F.col("rid").alias("a"), F.col("l.rid").alias("b")).distinct()
    return verify(materialize(pairs, "leaders"), texts, theta).select("a", "b")


def _block_pairs(theta: float):
    """Candidate pairs of two blocks of one region, but for those of texts with the same leader."""
    ratio = (1 - theta) / (1 + theta)

    def run(group: pa.Table) -> pa.Table:
        rid, m, s1, s2, label, block, one, two = (group.column(c).to_numpy() for c in ("rid", "m", "s1", "s2", "label", "block", "one", "two"))
        s1, s2, n, room, short = s1.view(np.uint64), s2.view(np.uint64), m >> 34, (m >> 4) & ((1 << 29) - 1), (m & 2) != 0
        names, count = np.unique(label, return_counts=True)
        big = label == names[np.argmax(count)]  # most have one leader where a region is crowded with variants
        inside = one[0] == two[0]
        left, right = block == one, block == two
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows, cols in ((left & ~big, right),) if inside else ((left & ~big, right), (left & big, right & ~big)):
            rows, cols = np.flatnonzero(rows), np.flatnonzero(cols)
            for at in range(0, len(rows) if len(cols) else 0, 256):
                i, j = rows[at : at + 256, None], cols[None, :]
                both = n[i] + n[j]
                ok = np.bitwise_count(s1[i] ^ s1[j]).astype(np.int16) + np.bitwise_count(s2[i] ^ s2[j]) <= ratio * both + EPS
                x, y = np.nonzero(ok & (label[i] != label[j]))
                i, j = i[x, 0], cols[y]
                both = n[i] + n[j]
                need = theta / (1 + theta) * both - EPS
                ok = (room[i] >= need) & (room[j] >= need) & (np.minimum(n[i], n[j]) >= theta * np.maximum(n[i], n[j]) - EPS) & np.where(n[i] < n[j], short[i], np.where(n[i] > n[j], short[j], short[i] & short[j]))
                if inside:
                    ok &= big[j] | (rid[i] < rid[j])
                out_a.append(rid[i[ok]])
                out_b.append(rid[j[ok]])
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return run


def crowded_pairs(regions: DataFrame, sizes: DataFrame, theta: float, block_rows: int | None = None) -> DataFrame:
    """(a, b): candidates of the regions, of different labels. sizes: (key, count). Rows are dealt to blocks by hash, and each pair of blocks is one group."""
    dealt = regions.join(sizes, "key").withColumn("blocks", F.ceil(F.col("count") / (block_rows or BLOCK_ROWS)).cast("int")).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("key", "rid", "m", "s1", "s2", "label", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    return spread.groupBy("key", "one", "two").applyInArrow(_block_pairs(theta), "a long, b long").distinct()


def connecting_texts(texts: DataFrame, theta: float, cap: int = REGION_TEXTS, frequent: int = FREQUENT_WORDS, crowded: int = CROWDED) -> DataFrame:
    """(a, b): pairs of texts of word share >= theta, enough of them to connect all that the pairs of `similar_texts` connect."""
    if not 0 < theta <= 1:
        raise ValueError("theta must be in (0, 1]")
    ties = materialize(leaders(texts, theta), "ties")
    own = texts.join(ties.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "rid"), "rid", "left")
    own = materialize(own.select("rid", "tag", "n", "s1", "s2", "words", F.coalesce("label", "rid").alias("label")), "labelled")
    alone = own.where("label = rid")
    keys, counts = frequent_words(alone, frequent)
    order = (keys, counts, alone.count())
    regions = region_rows(own, theta, *order, cap)
    all_keys, all_counts = frequent_words(own, frequent)
    hot = all_keys[all_counts > crowded]
    if not len(hot):  # no region can hold more texts than contain its words
        pairs = join_regions(regions, theta)
    else:
        dense = region_rows(own, theta, *order, cap, hot)
        busy = materialize(dense.groupBy("key").count().where(F.col("count") > crowded), "busy")
        names = busy.select("key")
        pairs = join_regions(regions.join(names, "key", "left_anti"), theta).union(crowded_pairs(dense.join(names, "key", "left_semi"), busy, theta)).distinct()
    got = verify(materialize(pairs, "candidates"), own, theta).select("a", "b")
    return got.union(ties)
