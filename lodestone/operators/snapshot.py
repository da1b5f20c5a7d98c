"""Writes as transforms of snapshots: upserts, updates, lifecycle flips, run logs, secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys; columns that only one has are null in the other."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_children(old: DataFrame, new: DataFrame, parent_cols: list[str], identity: list[str]) -> DataFrame:
    """old without the rows of the parents in new, and new's rows, one per identity."""
    return old.join(new.select(*parent_cols).distinct(), parent_cols, "left_anti").unionByName(new.dropDuplicates(identity), allowMissingColumns=True)


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace the partitions that df has rows for, and no others."""
    df.write.mode("overwrite").partitionBy(by).option("partitionOverwriteMode", "dynamic").parquet(path)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def store(rows: DataFrame, new: DataFrame) -> DataFrame:
    """rows and those of new whose text is not live in the project yet; decisions always come in. The hash is that of the content."""
    from .filters import live

    have = rows.where(live()).select("project_id", F.coalesce(F.lower("content_sha256"), F.sha2("content", 256)).alias("_h")).distinct()
    hashed = new.withColumn("content_sha256", F.sha2("content", 256)).withColumn("_h", F.col("content_sha256"))
    fresh = hashed.join(have.withColumn("_held", F.lit(True)), ["project_id", "_h"], "left")
    keep = fresh.where(F.col("_held").isNull() | F.col("source_kind").eqNullSafe("decision"))
    # of equal texts that arrive together the one of least id comes in
    w = Window.partitionBy("project_id", "_h").orderBy("id")
    one = keep.withColumn("_r", F.row_number().over(w)).where((F.col("_r") == 1) | F.col("source_kind").eqNullSafe("decision"))
    return rows.unionByName(one.drop("_held", "_h", "_r"), allowMissingColumns=True)


def update(rows: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """rows after changes (id, fields): a null field keeps the old value; a new content renews its hash and clears summary and duplicate flags."""
    c = changes.select("id", F.lit(True).alias("_hit"), *[F.col(f).alias(f"_new_{f}") for f in fields])
    both = rows.join(c, "id", "left")
    out = {f: F.coalesce(F.col(f"_new_{f}"), F.col(f)) for f in fields}
    if "content" in fields:
        edited = F.col("_new_content").isNotNull() & ~F.col("_new_content").eqNullSafe(F.col("content"))
        out["content_sha256"] = F.when(edited, F.sha2("_new_content", 256)).otherwise(F.col("content_sha256"))
        if "summary" in rows.columns and "summary" not in fields:
            out["summary"] = F.when(~edited, F.col("summary"))
        if "metadata" in rows.columns and "metadata" not in fields:
            kept = F.map_filter(F.from_json("metadata", "map<string,string>"), lambda k, v: k != "dupCandidates")
            out["metadata"] = F.when(edited & F.col("metadata").contains("dupCandidates"), F.to_json(kept)).otherwise(F.col("metadata"))
    return both.select(*[out.get(x, F.col(x)).alias(x) for x in rows.columns])


def archive(rows: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """rows with archived_at set for ids (id) that are not archived yet."""
    hit = rows.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    at = F.when(F.col("_hit") & F.col("archived_at").isNull(), F.lit(now).cast("timestamp")).otherwise(F.col("archived_at"))
    return hit.select(*[at.alias(c) if c == "archived_at" else F.col(c) for c in rows.columns])


def access_counts(rows: DataFrame, events: DataFrame) -> DataFrame:
    """rows with access_count raised, and last_accessed_at moved, by the append-only access events (id, at)."""
    e = events.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.max("at").alias("_at"))
    both = rows.join(e, "id", "left")
    new = {"access_count": (F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("int"), "last_accessed_at": F.greatest("last_accessed_at", "_at")}
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns])


def run_states(events: DataFrame) -> DataFrame:
    """The present state of each run from its event log (run_id, at, status, files_done, files_total): the latest value of each field."""
    w = F.struct("at", "status")
    return events.groupBy("run_id").agg(F.min("at").alias("started_at"), F.max_by("status", w).alias("status"), *[F.max_by(c, F.when(F.col(c).isNotNull(), w)).alias(c) for c in ("files_done", "files_total")])


def set_secrets(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old (name, value_enc, description) with new (name, value, description) encrypted by AES-GCM under a key of 16, 24 or 32 bytes."""
    enc = new.select("name", F.aes_encrypt(F.col("value"), F.lit(key)).alias("value_enc"), "description")
    return upsert(old, enc, ["name"])


def get_secrets(secrets: DataFrame, key: str) -> DataFrame:
    return secrets.select("name", F.aes_decrypt(F.col("value_enc"), F.lit(key)).cast("string").alias("value"), "description")
