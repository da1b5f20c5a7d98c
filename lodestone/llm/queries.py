"""The queries of this subpackage, by the names of TESTDATA.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, materialize, ship
from .cross_split import cross_split_overlaps
from .history import held_intake
from .mixing import mixture, quotas
from .near_dups import group_pairs, near_duplicate_groups
from .packing import pack
from .neighbours import graph_search, neighbour_graph
from .quality import text_quality
from .split_items import split_oversized
from .survivors import Trust, survivors, undisputed
from .tokens import with_tokens

#: Thresholds that TESTDATA.md fixes.
MEMORY_SHARE, QUERY_SHARE = 0.70, 0.60
CHUNK_LIMIT, CHUNK_OVERLAP, CONTAINER = 4000, 200, 2048
BEST = ["pinned", "importance", "access_count", "created_at"]
TRUST = Trust("source_kind", {"decision": 2.0, "agent-memory": 1.5}, 1.0, "created_at", "2026-07-01")


def _memory_groups(spark: SparkSession, sf_dir: str, count_links: bool = False) -> DataFrame:
    rows = load(spark, sf_dir, "memories")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))
    return near_duplicate_groups(rows, "id", text, MEMORY_SHARE, count_links)


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk in pieces of at most 4,000 characters."""
    return split_oversized(load(spark, sf_dir, "code_chunks"), "id", "content", "start_line", CHUNK_LIMIT, CHUNK_OVERLAP)


def p1_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk put together again from its pieces without what they repeat: the hash of that, and whether all are within the limit. Gathers the pieces of one chunk at a time."""
    part = F.struct("piece", F.expr("substring(content, overlap_chars + 1)").alias("own"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["own"]), "")
    return p1_pieces(spark, sf_dir).groupBy("id").agg(F.sha2(whole, 256).alias("content_sha256"), (F.max(F.length("content")) <= CHUNK_LIMIT).alias("within"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pieces(spark, sf_dir).where("piece = 2").select("id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cross_split_overlaps(load(spark, sf_dir, "recall_eval"), "id", "query", "split", "train", QUERY_SHARE)
    return got.select(F.least("train_id", "other_id").alias("id_a"), F.greatest("train_id", "other_id").alias("id_b"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping rows and pairs per split and provenance of the evaluation row."""
    rows = load(spark, sf_dir, "recall_eval")
    got = cross_split_overlaps(rows, "id", "query", "split", "train", QUERY_SHARE)
    ends = got.groupBy(F.col("other_id").alias("id")).agg(F.count(F.lit(1)).alias("pairs"), F.max("other_overlap").alias("most"))
    other = rows.where("split <> 'train'").join(ends, "id", "left")
    return other.groupBy("split", "provenance").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("pairs").alias("n_overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"), F.round(F.avg("most"), 6).alias("mean_overlap")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_pairs(materialize(_memory_groups(spark, sf_dir), "groups"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per memory: its group and the number of memories it is linked to."""
    return _memory_groups(spark, sf_dir, True).select(F.col("doc").alias("id"), "group_id", "links")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = held_intake(load(spark, sf_dir, "memories"), F.col("content"), load(spark, sf_dir, "memory_intake"), "intake_id", "batch_no", F.col("content"), MEMORY_SHARE)
    return got.where("held").select("intake_id")


def p5_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per batch: rows, rows held by memories, rows held by earlier intake only, and new rows."""
    intake = load(spark, sf_dir, "memory_intake")
    got = held_intake(load(spark, sf_dir, "memories"), F.col("content"), intake, "intake_id", "batch_no", F.col("content"), MEMORY_SHARE)
    flag = lambda c: F.count(F.when(c, 1))
    return intake.select("intake_id", "batch_no").join(got, "intake_id").groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("n_rows"), flag(F.col("by_history")).alias("held_by_memories"), flag(F.col("held") & ~F.col("by_history")).alias("held_by_intake"), flag(~F.col("held")).alias("n_new")
    )


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = materialize(_memory_groups(spark, sf_dir), "groups")
    sizes = groups.groupBy("group_id").count().where("count > 1").select("group_id")
    multi = groups.join(sizes, "group_id", "left_semi").select(F.col("doc").alias("id"), "group_id")
    return load(spark, sf_dir, "memories").join(multi, "id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _grouped(spark, sf_dir).select("id", "group_id", "source_kind", *BEST)
    return undisputed(rows, "group_id", "id", BEST, TRUST)


def p7_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One built record per group of restated memories."""
    return survivors(_grouped(spark, sf_dir), "group_id", ["type", "title", "content", "source_kind", "status", "source_uri", "summary"], BEST, TRUST)


def _containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialize(with_tokens(load(spark, sf_dir, "documents").select("doc_id", "text"), "text"), "tokens")
    return pack(sized, "doc_id", "tokens", CONTAINER)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _containers(spark, sf_dir).where("piece = 2").select("doc_id")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document or piece of one."""
    return _containers(spark, sf_dir)


def p8_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed by its characters into containers of 8,192: its pieces, what they add up to, and whether each container's fill is the sum of its items and within the capacity."""
    packed = materialize(pack(load(spark, sf_dir, "documents"), "doc_id", "n_chars", 4 * CONTAINER), "packed")
    sums = packed.groupBy("container").agg(F.sum("size").alias("total"))
    sound = packed.join(sums, "container").withColumn("sound", (F.col("total") == F.col("fill")) & (F.col("fill") <= 4 * CONTAINER))
    return sound.groupBy("doc_id").agg(F.max("pieces").cast("long").alias("pieces"), F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("chars"), F.bool_and("sound").alias("sound"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = materialize(with_tokens(load(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text"), "tokens")
    return mixture(sized, "doc_id", "tokens", "source", load(spark, sf_dir, "mix_targets"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the mixture, in output shards."""
    return _mixed(spark, sf_dir)[0]


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the tokens that each source reached, and what it had."""
    return _mixed(spark, sf_dir)[1]


def p9_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source of the mixture is to give, with characters for tokens: its quota, whole repetitions, and whether it limits the total."""
    plan, _ = quotas(load(spark, sf_dir, "documents"), "n_chars", "source", load(spark, sf_dir, "mix_targets"))
    rows = [(q.source, q.share, q.repeats, q.rows, q.tokens, round(q.quota, 3), q.whole, q.limits) for q in plan]
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int, n_rows long, tokens long, quota double, whole int, limits_total boolean")


def p10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document."""
    return text_quality(load(spark, sf_dir, "documents"), "doc_id", "text", load(spark, sf_dir, "common_words"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_quality(spark, sf_dir).where("not is_prose").select("doc_id")


#: Nearest rows asked for, and the least cosine of a pair.
NEAREST, COSINE = 5, 0.85


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind, table in (("memory", "memories"), ("chunk", "code_chunks")):
        near = neighbour_graph(load(spark, sf_dir, table), "id", "embedding", NEAREST, least=COSINE)
        pairs = near.select(F.lit(kind).alias("record_kind"), F.least("id", "neighbour_id").alias("id_a"), F.greatest("id", "neighbour_id").alias("id_b")).distinct()
        out = pairs if out is None else out.union(pairs)
    return out


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar rows of every memory and chunk, whatever their cosine: far neighbours need larger cells than near ones."""
    out = None
    for kind, table in (("memory", "memories"), ("chunk", "code_chunks")):
        near = neighbour_graph(load(spark, sf_dir, table), "id", "embedding", NEAREST, spread=5, cell_rows=32_768).select(F.lit(kind).alias("record_kind"), "id", "neighbour_id", "rank", "cosine")
        out = near if out is None else out.union(near)
    return out


def p4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy search of the neighbour graph of the table embeddings, for every row whose id is divisible by 50."""
    rows = load(spark, sf_dir, "embeddings")
    return graph_search(rows, "vec_id", "embedding", rows.where("vec_id % 50 = 0"), NEAREST)


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_rejoined, p2_found, p2_report, p3_found, p3_groups, p4_found, p4_neighbours, p4_search, p5_found, p5_batches, p7_found, p7_survivors, p8_found, p8_containers, p8_sizes, p9_mixture, p9_report, p9_quotas, p10_found, p10_quality)}


def queries() -> dict:
    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {name: shipped(f) for name, f in QUERIES.items()}
