"""Line-window chunks, content hashes and incremental diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import symbol

#: Lines of a window, lines shared by consecutive ones, most characters kept.
WINDOW_LINES, OVERLAP_LINES, MAX_CHARS = 60, 12, 4000


def line_windows(df: DataFrame, key_cols: list[str], text: Column, window: int = WINDOW_LINES, overlap: int = OVERLAP_LINES, most: int = MAX_CHARS) -> DataFrame:
    """(keys, start_line, end_line, content, content_sha256, symbol_name, symbol_kind): windows of lines, 1-based and inclusive.

    Windows start every max(1, window - overlap) lines until one reaches the last line; blank ones are left out. The
    symbol is looked for in the whole window, the hash is that of the kept text. Null text has no windows.
    """
    step = max(1, window - overlap)
    lines = df.where(text.isNotNull()).select(*key_cols, F.split(text, "\n").alias("_l")).withColumn("_n", F.size("_l"))
    last = F.greatest(F.ceil((F.col("_n") - window) / step), F.lit(0)).cast("int")
    # each window is cut before the rows multiply: the array of all lines is never copied into them
    cut = F.transform(F.sequence(F.lit(0), last), lambda x: F.struct((x * step).alias("s"), F.array_join(F.slice("_l", x * step + 1, F.lit(window)), "\n").alias("t")))
    starts = lines.select(*key_cols, "_n", F.explode(cut).alias("_w"))
    whole = starts.select(*key_cols, F.col("_w.s") + 1, F.least(F.col("_w.s") + window, F.col("_n")), "_w.t").toDF(*key_cols, "start_line", "end_line", "_t")
    kept = whole.where(F.col("_t").rlike(r"\S")).withColumn("content", F.substring("_t", 1, most)).withColumn("_y", symbol(F.col("_t")))
    return kept.select(*key_cols, "start_line", "end_line", "content", F.sha2("content", 256).alias("content_sha256"), F.col("_y.name").alias("symbol_name"), F.col("_y.kind").alias("symbol_kind"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], hash_col: str) -> DataFrame:
    """(keys, change): added, changed, unchanged or removed, by comparing a hash. Keys must be unique in either."""
    a = old.select(*keys, F.col(hash_col).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(*keys, F.col(hash_col).alias("_new"), F.lit(True).alias("_in_new"))
    both = a.join(b, keys, "full_outer")
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return both.select(*keys, change.alias("change"))


def cached_values(rows: DataFrame, id_col: str, hash_col: str, value_col: str) -> DataFrame:
    """(id, cached_from): for each row without a value the least id with the same hash that has one, or null."""
    have = rows.where(F.col(value_col).isNotNull()).groupBy(hash_col).agg(F.min(id_col).alias("cached_from"))
    return rows.where(F.col(value_col).isNull()).select(id_col, hash_col).join(have, hash_col, "left").select(id_col, "cached_from")


def running_total(df: DataFrame, order_col: str, value_col: str) -> DataFrame:
    """df with `before`, the sum of value_col over all rows of a smaller order_col (unique), without gathering rows.

    Rows are range-partitioned by order_col; each partition adds up its own, and the sums of the partitions, a row for
    each, are added on the driver.
    """
    from pyspark.sql.window import Window

    ranged = df.repartitionByRange(order_col).withColumn("_p", F.spark_partition_id())
    from ..session import materialize

    ranged = materialize(ranged, "ranged")
    sums = sorted((r["_p"], r["s"]) for r in ranged.groupBy("_p").agg(F.sum(value_col).alias("s")).collect())
    offset, rows = 0, []
    for p, s in sums:
        rows.append((p, offset))
        offset += s or 0
    offsets = df.sparkSession.createDataFrame(rows or [(0, 0)], "_p int, _o long")
    w = Window.partitionBy("_p").orderBy(order_col)
    return ranged.join(F.broadcast(offsets), "_p").withColumn("before", F.col("_o") + F.sum(value_col).over(w) - F.col(value_col)).drop("_p", "_o")
