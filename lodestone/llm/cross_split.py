"""Same or near-same records across splits (problem 2).

Records are normalised (lower case, distinct words) and cut where a rolling hash of their bytes meets a mask at the end
of a word. Records that share enough of their chunk digests across splits are candidates, with the summed lengths of the
shared chunks over those of all as overlap; the true word share decides. Short records may share no chunk though most of
their words are common: the pairs that the chunks did not bring are found with words as chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from .setjoin import SET_COLUMNS, collapse, digest, frequent_words, join_regions, region_rows, set_columns, similar_texts, tag_of, verify, word_sets, words

TRAIN, OTHER = 1, 2
WINDOW, BASE = 12, 257


def rolling(data: bytes, window: int = WINDOW) -> np.ndarray:
    """Polynomial hash, modulo 2**64, of the `window` bytes that end at each position (fewer at the start)."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    out, power = np.zeros(len(b), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(min(window, len(b))):
            out[k:] += b[: len(b) - k] * power
            power *= np.uint64(BASE)
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x9E3779B97F4A7C15)
    return out >> np.uint64(40)


def cut(record: str, mask_bits: int) -> list[str]:
    """The chunks of a normalised record: they end at word ends where the rolling hash has mask_bits zero bits."""
    if not record:
        return []
    data = record.encode()
    ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 32), len(data))
    if mask_bits:
        hit = (rolling(data)[ends - 1] & np.uint64((1 << mask_bits) - 1)) == 0
        hit[-1] = True
        ends = ends[hit]
    out, at = [], 0
    for e in ends.tolist():
        out.append(data[at:e].decode())
        at = e + 1
    return out


def _chunker(mask_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunks = [list(dict.fromkeys(cut(r or "", mask_bits))) for r in b.column("record").to_pylist()]
            flat = [c for cs in chunks for c in cs]
            n = np.array([len(cs) for cs in chunks], np.int64)
            h = np.array([digest(c) for c in flat] or [0], np.int64)[: len(flat)]
            row = np.repeat(np.arange(len(n)), n)
            size = np.array([len(c) for c in flat] or [0], np.int32)[: len(flat)]
            order = np.lexsort((h, row))  # the order of the digests in `words`
            lengths = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(size[order]))
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("tag"), *set_columns(row, h, len(n)), lengths], ["doc", "tag", "words", "n", "k1", "k2", "s1", "s2", "lengths"])

    return run


#: Zero bits that end a chunk (of two words on average), and the share of common chunks from which a pair is a candidate: much less would bring together all records that share one frequent chunk.
MASK_BITS, CHUNK_SHARE = 1, 0.4


def _across(a: str = "a", b: str = "b") -> str:
    """SQL: one of the two classes has a train row and the other one of another split."""
    return f"({tag_of(a)} | {tag_of(b)}) = 3 and ({tag_of(a)} <> {tag_of(b)} or {tag_of(a)} = 3)"


def cross_split_overlaps(df: DataFrame, id_col: str, text_col: str, split_col: str, train: str = "train", theta: float = 0.8, mask_bits: int = MASK_BITS, chunk_share: float = CHUNK_SHARE) -> DataFrame:
    """(train_id, other_id, share, train_overlap, other_overlap, by_chunks) of each train row and row of another split whose word share is at least theta.

    The overlaps are the summed lengths of the common words over those of all words of the record, in characters.
    by_chunks tells the pairs that the content-defined chunks brought from those that only words as chunks did. Rows whose
    id, split or words are missing take part in nothing. Copies of a text are joined as one; pairs are expanded at the end.
    """
    rows = df.where(F.col(id_col).isNotNull() & F.col(split_col).isNotNull())
    norm = rows.select(F.col(id_col).alias("doc"), F.when(F.col(split_col) == train, TRAIN).otherwise(OTHER).alias("tag"), F.array_join(words(F.col(text_col)), " ").alias("record")).where("record <> ''")
    norm = materialize(norm, "records")
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, {SET_COLUMNS}, lengths array<int>"
    members, texts = collapse(word_sets(norm, "doc", F.col("record"), F.col("tag")))
    chunked, cuts = collapse(norm.mapInArrow(_chunker(mask_bits), schema).drop("lengths"))
    # the classes of equal chunks to those of equal words, which are coarser
    of = materialize(chunked.select("doc", F.col("rid").alias("c")).join(members.select("doc", "rid"), "doc").select("c", "rid").distinct(), "classes")
    alike = similar_texts(cuts, chunk_share, _across()).select("a", "b")
    found = alike.join(of.toDF("a", "ra"), "a").join(of.toDF("b", "rb"), "b").where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct()
    brought = materialize(verify(materialize(found, "candidates"), texts, theta).withColumn("by_chunks", F.lit(True)), "brought")
    keys, counts = frequent_words(texts)
    others = join_regions(region_rows(texts, theta, keys, counts, texts.count()), theta, _across()).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    left = materialize(others.join(brought.select("a", "b"), ["a", "b"], "left_anti"), "candidates")
    links = brought.union(verify(left, texts, theta).withColumn("by_chunks", F.lit(False)))
    same = texts.where("tag = 3").select(F.col("rid").alias("a"), F.col("rid").alias("b"), F.lit(1.0).alias("share"), F.lit(True).alias("by_chunks"))
    links = materialize(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "share", "by_chunks")).union(same), "links")
    size = materialize(norm.mapInArrow(_chunker(0), schema).select("doc", "words", "lengths"), "lengths")
    discard(texts, cuts, of, brought, left)
    one = members.where(F.col("tag") == TRAIN).select(F.col("doc").alias("train_id"), F.col("rid").alias("a"))
    two = members.where(F.col("tag") == OTHER).select(F.col("doc").alias("other_id"), F.col("rid").alias("b"))
    pairs = one.join(links, "a").join(two, "b").select("train_id", "other_id", "share", "by_chunks")
    pairs = pairs.join(size.toDF("train_id", "wa", "la"), "train_id").join(size.toDF("other_id", "wb", "lb"), "other_id")
    shared = F.expr("aggregate(filter(arrays_zip(wa, la), x -> array_contains(wb, x.wa)), 0, (s, x) -> s + x.la)")
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    return pairs.select("train_id", "other_id", "share", (shared / total("la")).alias("train_overlap"), (shared / total("lb")).alias("other_overlap"), "by_chunks")
