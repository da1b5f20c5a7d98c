"""Exact and near duplicates by hash and vector, candidate pairs, judged consolidation."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cosine
from ..session import discard, materialize
from .components import components

#: Cosine above which rows are candidates, neighbours looked at per row, pairs of a judge's batch, characters per side.
DUP_COSINE, TOP_S, JUDGE_BATCH, JUDGE_CHARS = 0.9, 3, 8, 700


def exact_groups(df: DataFrame, id_col: str, keys: list[Column]) -> DataFrame:
    """(id, keep_id, copies): the least id of the rows with equal keys. Rows with a null key are copies of nothing."""
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(F.col(id_col).alias("id"), *[k.alias(n) for k, n in zip(keys, names)])
    groups = rows.groupBy(*names).agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    return rows.join(groups, names).select("id", "keep_id", "copies")


#: Rows of a bucket.
BUCKET_ROWS = 512


def plan_bits(rows: int, threshold: float, miss: float = 1e-6) -> tuple[int, int]:
    """(tables, bits) of sign hashing, so that a pair at the threshold is missed with a probability of `miss` at most.

    Buckets hold BUCKET_ROWS rows on average: comparing these costs less than the tables that smaller ones would need.
    """
    bits = max(4, math.ceil(math.log2(max(rows, 2) / BUCKET_ROWS)))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log(1 - agree)), bits


def near_vectors(df: DataFrame, id_col: str, vec_col: str, threshold: float = DUP_COSINE, top: int | None = TOP_S, seed: int = 7) -> DataFrame:
    """(id, near_id, cosine): per row its `top` nearest others with a cosine over the threshold (all of them for None).

    Signs of random projections put each row in one bucket of each table; rows that share a bucket are compared exactly.
    A pair at the threshold is missed with a probability of a millionth, closer ones with less. Null, all-zero and
    odd-sized vectors don't take part. Vectors travel to the buckets at 8 bits a component; a bucket is compared in
    blocks and gives each row its nearest few, and all that the rounding, which is bounded by the length of a code, may have
    put behind them; their cosines are then computed exactly.
    """
    rows = df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    kind = df.schema[id_col].dataType.simpleString()
    head = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not head or not head["d"]:
        return df.sparkSession.createDataFrame([], f"id {kind}, near_id {kind}, cosine double")
    dim, n = head["d"], head["count"]
    tables, bits = plan_bits(n, threshold)
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
    weights = 1 << np.arange(bits, dtype=np.int64)
    usable = rows.where((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull()))
    usable = materialize(usable.select(F.monotonically_increasing_id().alias("rid"), "id", "v", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")), "usable")
    # equal vectors are one row: what would be all pairs of copies is never made
    firsts = usable.groupBy("h1", "h2").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("copies"))
    many = materialize(firsts.where("copies > 1").drop("copies"), "many")
    named = materialize(usable.select("rid", "id", "h1", "h2").join(many, ["h1", "h2"], "left").select("rid", "id", F.coalesce("first", "rid").alias("first")), "named")
    usable = usable.join(named.where("first <> rid").select("rid"), "rid", "left_anti").select("rid", "id", "v")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if b.num_rows else np.zeros((0, dim))
            norm = np.sqrt((x * x).sum(1))
            ok = np.flatnonzero(np.isfinite(norm) & (norm > 0))
            code = ((x[ok] @ planes) > 0).reshape(len(ok), tables, bits) @ weights + (np.arange(tables, dtype=np.int64) << 32)
            at = np.repeat(ok, tables)
            q = np.rint(x[ok] * (127 / np.abs(x[ok]).max(1, initial=1e-300))[:, None]).astype(np.int8)
            data = pa.array([r.tobytes() for r in q], pa.binary()).take(pa.array(np.repeat(np.arange(len(ok)), tables)))
            yield pa.RecordBatch.from_arrays([pa.array(code.ravel()), b.column("rid").take(pa.array(at)), data], ["bucket", "rid", "q"])

    def compare(group: pa.Table) -> pa.Table:
        ids = group.column("rid").to_numpy()
        x = np.frombuffer(b"".join(group.column("q").to_pylist()), np.int8).reshape(-1, dim).astype(np.float32)
        length = np.sqrt(np.einsum("ij,ij->i", x, x))
        off = (1.001 * math.sqrt(dim) / length + 1e-5).astype(np.float32)  # twice the most that rounding turns a vector by
        x /= length[:, None]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(x), 1024):
            sims = x[at : at + 1024] @ x.T
            sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -2
            slack = off[at : at + 1024, None] + off[None, :]
            i, j = np.nonzero(sims > threshold - slack)
            if top is not None and len(i):
                low, high = sims[i, j] - slack[i, j], sims[i, j] + slack[i, j]
                order = np.lexsort((-low, i))
                i, j, low, high = i[order], j[order], low[order], high[order]
                # as many as are asked for are surely at least this near
                last = low[np.minimum(np.searchsorted(i, i) + top - 1, np.searchsorted(i, i, "right") - 1)]
                full = np.searchsorted(i, i, "right") - np.searchsorted(i, i) > top
                keep = ~full | (high >= last)
                i, j = i[keep], j[keep]
            left.append(ids[at + i])
            right.append(ids[j])
        return pa.table({"a": np.concatenate(left), "b": np.concatenate(right)})

    found = usable.select("rid", "v").mapInArrow(hashed, "bucket long, rid long, q binary").groupBy("bucket").applyInArrow(compare, "a long, b long").distinct()
    found = materialize(found, "pairs")
    v = usable.select("rid", "v")
    both = found.join(v.toDF("a", "va"), "a").join(v.toDF("b", "vb"), "b").select("a", "b", cosine(F.col("va"), F.col("vb")).alias("cosine"))
    own = v.join(many.select(F.col("first").alias("rid")), "rid").select(F.col("rid").alias("a"), F.col("rid").alias("b"), cosine(F.col("v"), F.col("v")).alias("cosine"))
    near = both.union(own).where((F.col("cosine") > threshold) & ~F.isnan("cosine"))
    members = named.select(F.col("first").alias("b"), F.col("id").alias("near_id"))
    if top is not None:  # no more than the top + 1 least ids of a class can be among the nearest of a row
        members = members.withColumn("_r", F.row_number().over(Window.partitionBy("b").orderBy("near_id"))).where(F.col("_r") <= top + 1).drop("_r")
    pairs = near.join(members, "b").select("a", "near_id", "cosine")
    if top is not None:
        pairs = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "near_id"))).where(F.col("_r") <= top + 1).drop("_r")
    out = named.select(F.col("first").alias("a"), "id").join(pairs, "a").where("id <> near_id").select("id", "near_id", "cosine")
    if top is None:
        return out
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "near_id")
    return out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")


def flags(near: DataFrame) -> DataFrame:
    """(id, flags): per row a JSON array of {id, sim} of its near rows, nearest first, sim to four places; `top` bounds each."""
    item = F.struct((-F.col("cosine")).alias("o"), F.col("near_id").alias("n"), F.round("cosine", 4).alias("s"))
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["n"].alias("id"), x["s"].alias("sim")))
    return near.groupBy("id").agg(F.to_json(ordered).alias("flags"))


def flagged_pairs(df: DataFrame, id_col: str, flags_col: str, threshold: float = DUP_COSINE) -> DataFrame:
    """(a, b, sim, source) from stored flags whose partner exists; entries that are no array, or whose sim is no number, are passed over."""
    one = F.explode(F.from_json(flags_col, "array<struct<id:string,sim:string>>"))
    raw = df.select(F.col(id_col).alias("a"), one.alias("x")).select("a", F.col("x.id").alias("b"), F.expr("try_cast(x.sim as double)").alias("sim"))
    return raw.where(F.col("sim") > threshold).join(df.select(F.col(id_col).alias("b")), "b", "left_semi").select("a", "b", "sim", F.lit("flag").alias("source"))


def merge_pairs(pairs: DataFrame, rows: DataFrame, id_col: str, created_col: str, judged: DataFrame | None = None) -> DataFrame:
    """(a, b, sim, source): one row per unordered pair, the older row first (ties by id), the largest sim to four places; source 'both' if they differ.

    judged (a, b): pairs already decided, which are left out. Most pressing first when sorted by `priority`.
    """
    age = rows.select(F.col(id_col).alias("id"), F.col(created_col).alias("t"))
    aged = pairs.join(age.toDF("a", "ta"), "a").join(age.toDF("b", "tb"), "b").where("a <> b")
    keep = (F.col("ta") < F.col("tb")) | ((F.col("ta") == F.col("tb")) & (F.col("a") < F.col("b")))
    slots = aged.select(F.when(keep, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(keep, F.col("b")).otherwise(F.col("a")).alias("b"), "sim", "source")
    one = slots.groupBy("a", "b").agg(F.round(F.max("sim"), 4).alias("sim"), F.when(F.count_distinct("source") > 1, F.lit("both")).otherwise(F.min("source")).alias("source"))
    return one if judged is None else one.join(judged.select("a", "b"), ["a", "b"], "left_anti")


def priority() -> list[Column]:
    """Sort order of candidate pairs: flagged first, then by sim."""
    return [F.when(F.col("source") == "sweep", 1).otherwise(0), F.desc("sim"), F.col("a"), F.col("b")]


def bands(pairs: DataFrame, width: float = 0.02) -> DataFrame:
    return pairs.groupBy(F.floor(F.col("sim") / width + 1e-9).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("n_pairs"))


def judge_side(title: Column, summary: Column, content: Column) -> Column:
    return F.substring(F.concat_ws(": ", title, F.regexp_replace(F.coalesce(F.nullif(summary, F.lit("")), content), r"\s+", " ")), 1, JUDGE_CHARS)


def parse_verdicts(raw: str, pairs: list[tuple[bool, bool]]) -> list[tuple[int, str | None]]:
    """(verdict, keep) per pair of a batch; pairs give (a is pinned, b is pinned).

    0: different. 1: the same, keep 'a' or 'b', whose other side must not be pinned. -1: not judged, for any entry that
    is missing or not of that form, and for the whole batch if there is no JSON object.
    """
    at, end = raw.find("{"), raw.rfind("}")
    try:
        entries = json.loads(raw[at : end + 1]) if 0 <= at < end else None
    except ValueError:
        entries = None
    if not isinstance(entries, dict):
        return [(-1, None)] * len(pairs)
    out: list[tuple[int, str | None]] = []
    for i, pinned in enumerate(pairs, 1):
        e = entries.get(str(i))
        v = e.get("verdict") if isinstance(e, dict) else None
        if isinstance(v, float) and v.is_integer():
            v = int(v)
        keep = e.get("keep") if isinstance(e, dict) else None
        if isinstance(v, bool) or v not in (0, 1):
            out.append((-1, None))
        elif v == 0:
            out.append((0, None))
        elif keep not in ("a", "b") or pinned[keep == "a"]:
            out.append((-1, None))
        else:
            out.append((1, keep))
    return out


def judge_pairs(pairs: DataFrame, judge: Callable[[list[tuple[str, str]]], str], batch: int = JUDGE_BATCH) -> DataFrame:
    """pairs (a, b, side_a, side_b, pinned_a, pinned_b, ...) with verdict and keep, by a judge that answers a batch in JSON; a failing one leaves its batch unjudged."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields) + ", verdict int, keep string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got: list[tuple[int, str | None]] = []
            for s in range(0, len(b), batch):
                part = b.iloc[s : s + batch]
                pinned = [(a is True, b is True) for a, b in zip(part["pinned_a"].tolist(), part["pinned_b"].tolist())]
                try:
                    got += parse_verdicts(judge(list(zip(part["side_a"], part["side_b"]))), pinned)
                except Exception:
                    got += [(-1, None)] * len(part)
            yield b.assign(verdict=pd.Series([v for v, _ in got], index=b.index, dtype="int32"), keep=pd.Series([k for _, k in got], index=b.index, dtype=object))

    return pairs.mapInPandas(run, schema)


#: Verdicts that one task settles in order; more are first brought down in rounds.
SETTLE_ROWS = 200_000


def _settle(part: pd.DataFrame) -> pd.DataFrame:
    """The verdicts (seq, winner, loser) of `part` that take effect, one after another."""
    gone: set = set()
    hit = []
    for t in part.sort_values(["seq", "winner", "loser"]).itertuples(index=False):
        if t.winner not in gone and t.loser not in gone:
            gone.add(t.loser)
            hit.append((t.loser, t.winner))
    return pd.DataFrame(hit, columns=["loser", "winner"])


def apply_judged(rows: DataFrame, judged: DataFrame, max_rounds: int = 50) -> DataFrame:
    """rows (id, status, superseded_by, pinned, source_kind, archived_at, ...) after the verdicts of judged (seq, a, b, verdict, keep).

    Verdicts take effect in the order of seq, then winner and loser: a loser flips only while it is active, not pinned
    and no decision, and its winner live. Those that the rows alone rule out are dropped at once. In each round every
    verdict takes effect whose ends no earlier one left can flip, and all later ones that name its loser are dropped with
    it; so in an order unrelated to the ids the rounds needed grow as the logarithm of the verdicts. What is at most
    SETTLE_ROWS, or left after max_rounds, is settled in order, one task for each connected part; nothing is gathered on
    the driver.
    """
    todo = judged.where("verdict = 1 and keep in ('a', 'b')").select("seq", F.expr("if(keep = 'a', a, b)").alias("winner"), F.expr("if(keep = 'a', b, a)").alias("loser")).where("winner <> loser")
    active = F.coalesce("status", F.lit("active")) == "active"
    up = rows.where(F.col("archived_at").isNull() & active).select(F.col("id").alias("winner"))
    may = rows.where(active & (F.coalesce("pinned", F.lit(False)) == F.lit(False)) & ~F.col("source_kind").eqNullSafe("decision")).select(F.col("id").alias("loser"))
    todo = materialize(todo.join(up, "winner", "left_semi").join(may, "loser", "left_semi").select("seq", "winner", "loser").distinct(), "todo")
    flipped, left, rounds = None, todo.count(), 0
    if not left:
        return rows
    while left > SETTLE_ROWS and rounds < max_rounds:
        o = F.struct("seq", "winner", "loser")
        first = materialize(todo.groupBy("loser").agg(F.min(o).alias("first")), "first")
        mine = todo.join(first, "loser").where(o == F.col("first")).drop("first")
        over = first.toDF("winner", "first")
        ready = materialize(mine.join(over, "winner", "left").where(F.col("first").isNull() | (F.col("first") > o)).select("seq", "winner", "loser"), "ready")
        out = ready.select(F.col("loser").alias("id"), o.alias("at"))
        # a flipped row loses no more, and wins nothing after its flip
        rest = todo.join(out.toDF("loser", "at"), "loser", "left_anti").join(out.toDF("winner", "at"), "winner", "left").where(F.col("at").isNull() | (o < F.col("at"))).select("seq", "winner", "loser")
        nxt = materialize(rest, "todo")
        hit = ready.select("loser", "winner")
        flipped = hit if flipped is None else flipped.union(hit)
        discard(todo, first)
        todo, left, rounds = nxt, nxt.count(), rounds + 1
    kind = todo.schema["loser"].dataType.simpleString()
    if left:
        part = todo.withColumn("part", F.lit(0))
        if left > SETTLE_ROWS:
            named = components(todo.select(F.col("winner").alias("u"), F.col("loser").alias("v")))
            part = todo.join(named.toDF("loser", "part"), "loser")
        hit = part.groupBy("part").applyInPandas(lambda x: _settle(x), f"loser {kind}, winner {kind}")
        flipped = hit if flipped is None else flipped.union(hit)
    won = rows.join(materialize(flipped, "flipped").withColumnRenamed("loser", "id"), "id", "left")
    new = {"status": F.when(F.col("winner").isNotNull(), F.lit("superseded")).otherwise(F.col("status")), "superseded_by": F.coalesce("winner", "superseded_by")}
    return won.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns])
