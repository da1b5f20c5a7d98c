"""Parent-child links to full hierarchies (problem 6), by tree contraction.

Rounds alternate raking (all leaves are removed, each remembering its parent and distance) and compression (of the nodes
with exactly one child and a parent, those whose hash exceeds that of such neighbours are spliced out of their chain).
Each round removes a constant share of every tree, however deep. What is left in the end are loops that have shrunk to a
node pointing at itself, which goes when nothing hangs from it any more. The rounds are then undone in reverse order, and each removed node takes its root, depth and
path from the node it was removed to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize


RAKED, SPLICED, LOOPED = 0, 1, 2
#: What the parent of a link is: a node with a link of its own, the sound end of a chain, or one with a pointer to nowhere.
OPEN, END, CUT = 0, 1, 2


def _contract(links: DataFrame, with_path: bool, max_rounds: int) -> list[DataFrame]:
    """The records of each round. links: (v, p, fin, w, low, via), v being w steps below p, over the nodes via, the least of which or v is low; fin tells whether p ends the chain."""
    active, records = materialize(links, "tree"), []
    kind = links.schema["v"].dataType
    for r in range(max_rounds):
        kids = active.where("v <> p").groupBy("p").agg(F.count(F.lit(1)).alias("kids"), F.min("v").alias("kid"))
        seen = active.join(kids.select(F.col("p").alias("v"), "kids", "kid"), "v", "left")
        node = materialize(seen.select("*", F.xxhash64("v", F.lit(r)).alias("h")), "round")
        # a node on a chain has one child and a parent; its hash, anew each round, decides against its neighbours'
        inner = node.where("v <> p and kids is not null").select("v", F.when(F.col("kids") == 1, F.col("h")).alias("h"))
        chain = node.where("v <> p and kids = 1").join(inner.toDF("p", "hp"), "p", "left").join(inner.toDF("kid", "hk"), "kid")
        spliced = chain.where("(hp is null or h > hp) and (hk is null or h > hk)").select("v", "p", "fin", "w", "low", "via", F.lit(SPLICED).alias("kind"), "kid")
        gone = node.where("kids is null").select("v", "p", "fin", "w", "low", "via", F.when(F.expr("v = p"), LOOPED).otherwise(RAKED).alias("kind"), F.lit(None).cast(kind).alias("kid"))
        record = materialize(gone.union(spliced), "record")
        if record.isEmpty():
            discard(record, node, active)
            break
        records.append(record)
        rest = node.join(record.select("v"), "v", "left_anti").select("v", "p", "fin", "w", "low", "via")
        over = record.where(F.col("kind") == SPLICED).select(F.col("kid").alias("v"), F.col("v").alias("_m"), F.col("p").alias("_p"), F.col("fin").alias("_fin"), F.col("w").alias("_w"), F.col("low").alias("_low"), F.col("via").alias("_via"))
        hop = F.col("_p").isNotNull()
        joined = F.concat("via", F.array("_m"), "_via") if with_path else F.col("via")
        left = rest.join(over, "v", "left").select(
            "v",
            F.coalesce("_p", "p").alias("p"),
            F.coalesce("_fin", "fin").alias("fin"),
            (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"),
            F.when(hop, F.least("low", "_low")).otherwise(F.col("low")).alias("low"),
            F.when(hop, joined).otherwise(F.col("via")).alias("via"),
        )
        nxt = materialize(left, "tree")
        discard(node, active)
        active = nxt
    else:
        raise RuntimeError(f"contraction did not end in {max_rounds} rounds")
    return records


def _walks(rows: DataFrame, id_col: str, parent_col: str, with_path: bool, max_rounds: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, walks): (v, p) of every id, and (v, root, d, on, cut, path) of those that have a pointer or are pointed at.

    cut tells chains that end at a pointer to nowhere. The path of a node whose chain never ends goes once around the loop.
    """
    base = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("v")).agg(F.min(parent_col).alias("p"))
    kind = base.schema["v"].dataType
    base = materialize(base, "nodes")
    known = base.select(F.col("v").alias("p"))
    held = base.where("p is not null")
    good = held.join(known, "p", "left_semi")
    broken = held.join(known, "p", "left_anti").select("v", F.lit(True).alias("cut"))
    empty = F.array().cast(f"array<{kind.simpleString()}>")
    # of a link to a row that ends a chain all is known: such rows are never looked up again
    over = base.where("p is null").select(F.col("v").alias("p"), F.lit(END).alias("_fin")).union(broken.select(F.col("v").alias("p"), F.lit(CUT).alias("_fin")))
    links = good.join(over, "p", "left").select("v", "p", F.coalesce("_fin", F.lit(OPEN)).alias("fin"), F.lit(1).cast("int").alias("w"), F.col("v").alias("low"), empty.alias("via"))
    records = _contract(links, with_path, max_rounds)
    around = F.concat(F.array("v"), "via") if with_path else empty
    parts = [broken.select("v", F.col("v").alias("root"), F.lit(0).alias("d"), F.lit(False).alias("on"), "cut", (F.array("v") if with_path else empty).alias("path"))]
    later: list[DataFrame] = []  # what was removed in later rounds, a shrinking share of all rows
    for record in reversed(records):
        loops = record.where(F.col("kind") == LOOPED).select("v", F.col("low").alias("root"), F.lit(-1).alias("d"), F.lit(True).alias("on"), F.lit(False).alias("cut"), around.alias("path"))
        gone = record.where(F.col("kind") != LOOPED)
        path = F.concat(F.array("v"), "via", F.array("p")) if with_path else empty
        ended = gone.where(F.col("fin") != OPEN).select("v", F.col("p").alias("root"), F.col("w").cast("int").alias("d"), F.lit(False).alias("on"), (F.col("fin") == CUT).alias("cut"), path.alias("path"))
        got = loops.union(ended)
        if later:
            lookup = later[0]
            for more in later[1:]:
                lookup = lookup.union(more)
            up = lookup.select(F.col("v").alias("p"), "root", "d", "cut", F.col("path").alias("up_path"))
            kid = lookup.where("on").select(F.col("v").alias("kid"), "on")
            # a node spliced out of a chain lies on a loop if its only child does
            rows = gone.where(F.col("fin") == OPEN).join(up, "p").join(kid, "kid", "left")
            on = F.coalesce("on", F.lit(False))
            # the way around the loop from p ends with v and the nodes between them
            rest = F.when(on, F.slice("up_path", F.lit(1), F.size("up_path") - 1 - F.size("via"))).otherwise(F.col("up_path"))
            path = F.concat(F.array("v"), "via", rest) if with_path else F.col("up_path")
            depth = F.when(F.col("d") < 0, F.lit(-1)).otherwise(F.col("d") + F.col("w"))
            got = got.union(rows.select("v", "root", depth.cast("int").alias("d"), on.alias("on"), "cut", path.alias("path")))
        later.append(materialize(got, "solved"))
    parts += later
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    discard(*records)
    return base, out


def hierarchy(rows: DataFrame, id_col: str, parent_col: str, with_path: bool = False, max_rounds: int = 400) -> DataFrame:
    """(id, root_id, depth, in_loop[, path]) of every row with a parent pointer.

    root_id is the last node reached by following the pointers, depth the steps to it, path the nodes from the row to
    it, both included. A pointer to an id that is not in the table ends the chain at the row that holds it: depth 0, and
    the row is its own root. If the chain never ends, depth is -1, root_id is the smallest id on the loop it runs into
    and path is null; in_loop tells the rows on the loop from those that lead to it. Rows with a null id are ignored; if
    an id occurs more than once, the row with the smallest pointer counts. An empty table gives an empty result.
    `chains` gives every row, and paths through loops.
    """
    base, out = _walks(rows, id_col, parent_col, with_path, max_rounds)
    out = out.join(base.where("p is not null").select("v"), "v", "left_semi")
    cols = [F.col("v").alias(id_col), F.col("root").alias("root_id"), F.col("d").alias("depth"), F.col("on").alias("in_loop")]
    return out.select(*cols, *([F.when(F.col("d") >= 0, F.col("path")).alias("path")] if with_path else []))


SOUND, DANGLING, TO_DANGLING, ON_LOOP, TO_LOOP = "sound", "dangling", "leads to dangling", "on loop", "leads to loop"


def chains(rows: DataFrame, id_col: str, parent_col: str, max_rounds: int = 400) -> DataFrame:
    """(id, root_id, depth, status, path) of every row, with a pointer or without.

    As `hierarchy`, but a row without a pointer is its own root at depth 0, and the path of a row whose chain never ends
    holds each node that its pointers reach once, in their order. status is 'sound'; 'dangling' for a row whose pointer
    names no row and 'leads to dangling' for those whose chain ends there; 'on loop' and 'leads to loop'.
    """
    base, out = _walks(rows, id_col, parent_col, True, max_rounds)
    out = out.join(base.where("p is not null").select("v"), "v", "left_semi")
    status = F.when(F.col("on"), ON_LOOP).when(F.col("d") < 0, TO_LOOP).when(F.col("cut") & (F.col("d") == 0), DANGLING).when(F.col("cut"), TO_DANGLING).otherwise(SOUND)
    top = base.where("p is null").select("v", F.col("v").alias("root"), F.lit(0).alias("d"), F.lit(SOUND).alias("status"), F.array("v").alias("path"))
    every = out.select("v", "root", "d", status.alias("status"), "path").union(top)
    return every.select(F.col("v").alias(id_col), F.col("root").alias("root_id"), F.col("d").alias("depth"), "status", "path")


def descendants(paths: DataFrame, id_col: str) -> DataFrame:
    """(ancestor_id, id, distance): each node below each node, from the paths of `hierarchy`, or of `chains`, which has those through loops too; one row per pair, so nothing is gathered."""
    steps = paths.where("path is not null").select(id_col, F.posexplode("path").alias("distance", "ancestor_id"))
    return steps.where("distance > 0").select("ancestor_id", id_col, "distance")
