"""Deduplicating new batches against all history (problem 5).

The pivot-distance table stores, for each accepted text, its distances to fixed pivots: the empty set (the number of its
words, and the parities of that on 128 slices of the vocabulary) and the pivots at which it can meet a similar text, rare
words and pairs and triples of frequent ones (with what it has left from there on). The table is partitioned by ranges of
the pivots and sorted by them within each. A probe reads the ranges its batch has pivots in, prunes by the triangle
inequality within the join, verifies the true word share of what is left, and rows are appended as a new part. The order
of the pivots is fixed when the table is made and stored with it, so that a later session goes on where one ended.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialize, shared_dir
from .setjoin import collapse, frequent_words, may_be_near, region_rows, similar_texts, size_of, word_sets

#: Rows of distances that a range should hold at first, and the most ranges of a table.
RANGE_ROWS, MOST_RANGES = 500_000, 4096
#: Rows of distances of a batch that are broadcast at a time, 32 bytes each; a larger batch takes several turns.
TURN_ROWS = 500_000
#: Intake rows that make a load: smaller batches that follow each other are taken together.
LOAD_ROWS = 10_000


class HistoryTable:
    """A stored pivot-distance table to probe batches against and append rows to.

    Below `path`: order (word, count) and facts (theta, total, ranges), written once; distances and texts, by part and
    range; log, one row per part. A part counts once it stands in the log, and writing it again replaces it, so a write
    that was cut short leaves nothing behind.
    """

    def __init__(self, spark: SparkSession, path: str):
        """Open a table that `build` has made."""
        self.spark, self.path = spark, path
        facts = spark.read.parquet(f"{path}/facts").first()
        self.theta, self.ranges = facts["theta"], facts["ranges"]
        order = spark.read.parquet(f"{path}/order").toPandas().sort_values("word")  # bounded, see frequent_words
        self.order = (order["word"].to_numpy(np.int64), order["count"].to_numpy(np.int64), facts["total"])

    @classmethod
    def build(cls, history: DataFrame, text: Column, theta: float = 0.8, path: str | None = None, range_rows: int = RANGE_ROWS) -> HistoryTable:
        """Make the table of history, which may be empty, and open it. Texts without words are left out: nothing resembles them."""
        if not 0 < theta <= 1:
            raise ValueError("theta must be in (0, 1]")
        spark = history.sparkSession
        path = path or f"{shared_dir(spark)}/lodestone/history-{uuid.uuid4().hex}"
        members, texts = collapse(word_sets(history.select(F.lit(0).alias("doc"), text.alias("text")), "doc", F.col("text")))
        keys, counts = frequent_words(texts)
        total = texts.count()
        rows = region_rows(texts, theta, keys, counts, max(total, 1)).count() if total else 0
        ranges = 1 << min(max(0, math.ceil(math.log2(max(rows, 1) / range_rows))), MOST_RANGES.bit_length() - 1)
        spark.createDataFrame(list(zip(keys.tolist(), counts.tolist())), "word long, count long").write.mode("overwrite").parquet(f"{path}/order")
        spark.createDataFrame([(theta, max(total, 1), ranges)], "theta double, total long, ranges int").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")
        spark.createDataFrame([], "part int, texts long").write.mode("overwrite").parquet(f"{path}/log")
        table = cls(spark, path)
        table._append(texts)
        discard(members, texts)
        return table

    def parts(self) -> int:
        return self.spark.read.parquet(f"{self.path}/log").count()

    def _distances(self, texts: DataFrame) -> DataFrame:
        """(range, key, rid, m, s1, s2): the pivots of each text, and the hash of its whole set as one more, where equal texts meet however few words they have."""
        near = region_rows(texts, self.theta, *self.order).drop("label")
        same = texts.select(F.col("k1").bitwiseXOR(F.col("k2")).alias("key"), "rid", F.expr("(cast(n as long) << 34) | (cast(n as long) << 4) | 2").alias("m"), "s1", "s2")
        return near.union(same).withColumn("range", F.shiftrightunsigned("key", 64 - self.ranges.bit_length() + 1).cast("int") if self.ranges > 1 else F.lit(0))

    def _append(self, texts: DataFrame) -> None:
        part = self.parts()
        by_range = self._distances(texts.withColumn("tag", F.lit(0))).repartition(self.ranges, "range").sortWithinPartitions("range", "key")
        by_range.write.mode("overwrite").partitionBy("range").parquet(f"{self.path}/distances/part={part}")
        held = texts.select(F.pmod("rid", F.lit(self.ranges)).cast("int").alias("range"), "rid", "words").repartition(self.ranges, "range").sortWithinPartitions("range", "rid")
        held.write.mode("overwrite").partitionBy("range").parquet(f"{self.path}/texts/part={part}")
        self.spark.createDataFrame([(part, texts.count())], "part int, texts long").coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _read(self, name: str, parts: int, ranges: list[int]) -> DataFrame:
        """The rows of the logged parts in these ranges; other ranges are not read."""
        kinds = {"distances": "key long, rid long, m long, s1 long, s2 long", "texts": "rid long, words array<long>"}
        return self.spark.read.schema(f"{kinds[name]}, part int, range int").parquet(f"{self.path}/{name}").where((F.col("part") < parts) & F.col("range").isin(ranges))

    def _near(self, texts: DataFrame, parts: int) -> DataFrame:
        """(rid, part) of each text of the batch and part of the table that holds a text of word share >= theta with it."""
        asked = materialize(self._distances(texts), "asked")
        per_range = {r["range"]: r["count"] for r in asked.groupBy("range").count().collect()}  # at most MOST_RANGES
        rows = sum(per_range.values())
        turns, found = max(1, math.ceil(rows / TURN_ROWS)), None
        for t in range(turns):
            mine = asked.where(F.pmod(F.xxhash64("rid"), F.lit(turns)) == t)
            theirs, short = self._read("distances", parts, sorted(per_range)), F.expr("m & 2 <> 0")
            near, longer = may_be_near(self.theta, False), f"{size_of('b')} > {size_of('a')}"
            # whichever text is the smaller one takes part with its rarest words alone; equal pivots lie in the same range
            for held, asking, cond in ((theirs, mine.where(short), f"not {longer}"), (theirs.where(short), mine, longer)):
                got = held.alias("a").join(F.broadcast(asking).alias("b"), F.expr(f"a.key = b.key and {cond} and {near}"))
                got = got.select(F.col("b.rid").alias("x"), "part", F.col("a.rid").alias("y"))
                found = got if found is None else found.union(got)
        pairs = materialize(found.distinct().withColumn("range", F.pmod("y", F.lit(self.ranges)).cast("int")), "candidates")
        at = sorted(r["range"] for r in pairs.select("range").distinct().collect())  # at most MOST_RANGES
        theirs = self._read("texts", parts, at).select("range", "part", F.col("rid").alias("y"), F.col("words").alias("wy"))
        both = pairs.join(theirs, ["range", "part", "y"]).join(texts.select(F.col("rid").alias("x"), F.col("words").alias("wx")), "x")
        common = F.size(F.array_intersect("wx", "wy"))
        share = common / (F.size("wx") + F.size("wy") - common)
        near = materialize(both.where(share >= self.theta - 1e-12).select(F.col("x").alias("rid"), "part").distinct(), "near")
        discard(asked, pairs)
        return near

    def probe(self, batch: DataFrame, id_col: str, text: Column) -> DataFrame:
        """(id_col, held): whether a row's word share with any row of the table is at least theta. Rows without words are not held."""
        members, texts = collapse(word_sets(batch.select(F.col(id_col).alias("doc"), text.alias("text")), "doc", F.col("text")))
        hit = self._near(texts, self.parts()).select("rid").distinct().withColumn("held", F.lit(True))
        got = members.join(hit, "rid", "left").select(F.col("doc").alias(id_col), F.coalesce("held", F.lit(False)).alias("held"))
        return batch.select(id_col).join(got, id_col, "left").select(id_col, F.coalesce("held", F.lit(False)).alias("held"))

    def append(self, accepted: DataFrame, text: Column) -> None:
        members, texts = collapse(word_sets(accepted.select(F.lit(0).alias("doc"), text.alias("text")), "doc", F.col("text")))
        self._append(texts)
        discard(members, texts)

    def take(self, load: DataFrame, order_col: str, text: Column) -> DataFrame:
        """(order_col, held, by_history) of the rows of a load, which are appended, held or not.

        held: a word share of at least theta with a row of the table or with a row of the load of a smaller order_col, a
        unique long. by_history: with a row of the part that `build` made. Null order_col: ignored. Copies are one class.
        """
        rows = load.where(F.col(order_col).isNotNull()).select(F.col(order_col).cast("long").alias("doc"), text.alias("text"))
        members, texts = collapse(word_sets(rows, "doc", F.col("text")))
        near = self._near(texts, self.parts()).groupBy("rid").agg(F.bool_or(F.col("part") == 0).alias("old"))
        first = members.groupBy("rid").agg(F.min("doc").alias("first"))
        links = similar_texts(texts, self.theta, order=self.order).select("a", "b")
        ends = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ahead = ends.join(first.withColumnRenamed("rid", "b"), "b").groupBy(F.col("a").alias("rid")).agg(F.min("first").alias("near_first"))
        state = first.join(ahead, "rid", "left").join(near, "rid", "left")
        got = members.join(state, "rid").select("doc", F.col("old").isNotNull().alias("by_table"), F.coalesce("old", F.lit(False)).alias("old"), F.coalesce(F.least("first", "near_first") < F.col("doc"), F.lit(False)).alias("by_load"))
        out = rows.select("doc").join(got, "doc", "left").select(F.col("doc").alias(order_col), F.coalesce(F.col("by_table") | F.col("by_load"), F.lit(False)).alias("held"), F.coalesce("old", F.lit(False)).alias("by_history"))
        out = materialize(out, "taken")
        self._append(texts)
        discard(members, texts)
        return out


def loads(intake: DataFrame, batch_col: str, least_rows: int = LOAD_ROWS) -> list[Column]:
    """A condition for each load: batches in order, so many that a load has at least `least_rows` rows; null last. Collects one count per batch."""
    counts = {r[0]: r[1] for r in intake.groupBy(batch_col).count().collect()}
    runs, rows = [], 0
    for k in sorted(k for k in counts if k is not None):
        if rows:
            runs[-1][1] = k
        else:
            runs.append([k, k])
        rows = 0 if rows + counts[k] >= least_rows else rows + counts[k]
    return [F.col(batch_col).between(a, z) for a, z in runs] + ([F.col(batch_col).isNull()] if None in counts else [])


def held_intake(history: DataFrame, history_text: Column, intake: DataFrame, order_col: str, batch_col: str, intake_text: Column, theta: float = 0.8, load_rows: int = LOAD_ROWS) -> DataFrame:
    """(order_col, held, by_history) of every intake row: held if its word share with any history row, or with an intake row that came before, is at least theta.

    The history is made a `HistoryTable` once, and the batches are taken in order, each load being probed against the
    table and then appended. Batches must not overlap in order_col. Rows where order_col is null are ignored, those where
    batch_col is null come last. Texts without words are never held. Either table may be empty.
    """
    table = HistoryTable.build(history.select(history_text.alias("text")), F.col("text"), theta)
    out = None
    for part in loads(intake, batch_col, load_rows):
        got = table.take(intake.where(part).select(order_col, intake_text.alias("text")), order_col, F.col("text"))
        out = got if out is None else out.union(got)
    if out is None:
        return intake.sparkSession.createDataFrame([], f"{order_col} long, held boolean, by_history boolean")
    return out
