"""Groups of near-duplicate records (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import discard, materialize
from .setjoin import CROWDED, collapse, connecting_texts, similar_texts, word_sets


def near_duplicate_groups(docs: DataFrame, id_col: str, text: Column, theta: float = 0.8, count_links: bool = False, crowded: int = CROWDED) -> DataFrame:
    """(doc, group_id[, links]): the group of every document, groups being connected by links of word share >= theta.

    group_id is the least id of the group. With count_links, links counts the documents that one is linked to, copies
    among them; this makes all pairs of linked texts, which the groups alone do not need. A document without words (null
    or empty text) is linked to nothing and forms its own group, as does any document that resembles no other. Rows with
    a null id are ignored; ids are expected to be unique. Other columns are not touched. Exact copies are one class
    throughout and are never expanded into pairs.
    """
    docs = docs.where(F.col(id_col).isNotNull())
    members, texts = collapse(word_sets(docs, id_col, text))
    links = similar_texts(texts, theta).select("a", "b") if count_links else connecting_texts(texts, theta, crowded=crowded)
    links = materialize(links, "links")
    comp = components(links, "a", "b")
    classes = texts.select("rid", "copies").join(comp.withColumnsRenamed({"node": "rid"}), "rid", "left").select("rid", "copies", F.coalesce("component", "rid").alias("component"))
    if count_links:
        ends = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = ends.join(texts.select(F.col("rid").alias("b"), "copies"), "b").groupBy(F.col("a").alias("rid")).agg(F.sum("copies").alias("near"))
        classes = classes.join(degree, "rid", "left").withColumn("links", F.coalesce("near", F.lit(0)) + F.col("copies") - 1)
    else:
        classes = classes.withColumn("links", F.lit(None).cast("long"))
    classes = materialize(classes.select("rid", "component", "links"), "classes")
    discard(texts)
    placed = members.join(classes, "rid").select("doc", "component", "links")
    least = placed.groupBy("component").agg(F.min("doc").alias("group_id"))
    grouped = placed.join(least, "component").select("doc", "group_id", "links")
    ids = docs.select(F.col(id_col).alias("doc"))
    alone = ids.join(members.select("doc"), "doc", "left_anti").select("doc", F.col("doc").alias("group_id"), F.lit(0).cast("long").alias("links"))
    out = grouped.union(alone)
    return out if count_links else out.drop("links")


#: Members of a group that one task pairs with each other group's part: larger groups are dealt to so many parts.
PART_ROWS = 4096


def group_pairs(groups: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(id_a, id_b): all pairs of documents in the same group, the smaller id first.

    Each row is one of the pairs asked for. A large group is dealt to parts by hash, and each pair of parts is a join of
    its own, so that no task holds a group whatever its size.
    """
    sizes = groups.groupBy("group_id").count().where("count > 1").withColumn("parts", F.ceil(F.col("count") / part_rows).cast("int")).drop("count")
    g = groups.join(sizes, "group_id").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    spread = g.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select("group_id", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "doc")
    keys = ["group_id", "lo", "hi"]
    a, b = spread.toDF(*keys, "pa", "id_a"), spread.toDF(*keys, "pb", "id_b")
    # two parts meet once; within a part only the rows of its own pair of parts do
    return a.join(b, keys).where("id_a < id_b and (lo = hi or pa <> pb)").select("id_a", "id_b")
