"""Filling fixed-capacity containers with items (problem 8)."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize

#: Items that are packed in one task; what their shards leave underfull is packed again together.
SHARD_ITEMS = 4000
#: Containers filled less than this share count as underfull.
FULL = 0.995
#: Share of its items that a round must settle for another one to follow.
LEAST_GAIN = 0.05


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, the largest first, goes to the fullest bin that has room for it."""
    bins: list[list[int]] = []
    open_: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(open_, (sizes[i], -1))
        if at < len(open_):
            room, b = open_.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > sizes[i]:
            bisect.insort(open_, (room - sizes[i], b))
    return bins


class _Bins:
    """Underfull bins, their distinct sizes and the sums of two of their items: what exchanges are looked up in."""

    def __init__(self, bins: list[list[int]], sizes: list[int]):
        self.bins, self.sizes = bins, sizes
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def offers(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(sums, pairs) of bin b, sorted: each distinct size alone (as (item, -1)) and each distinct sum of two items. A bin has few distinct sizes, as they add up to its fill."""
        if b not in self.tables:
            by: dict[int, list[int]] = {}
            for i in self.bins[b]:
                by.setdefault(self.sizes[i], []).append(i)
            names = sorted(by)
            found: dict[int, tuple[int, int]] = {}
            for x, s in enumerate(names):
                for t in names[x:]:
                    if t != s or len(by[s]) > 1:
                        found.setdefault(s + t, (by[s][0], by[t][-1]))
            found |= {s: (by[s][0], -1) for s in names}  # one item goes before two of the same sum
            sums = np.array(sorted(found), np.int64)
            self.tables[b] = sums, np.array([found[int(k)] for k in sums], np.int64).reshape(-1, 2)
        return self.tables[b]


def improve(bins: list[list[int]], sizes: list[int], capacity: int, full: float = FULL) -> list[list[int]]:
    """Local search over the underfull bins: moves one or two items of a bin to another one, or exchanges them for one of its items, while that raises the sum of squared fills.

    Bins are taken from the fullest on, each being filled from the others by the exchange that leaves it the least
    room, until none gains; then all are taken again, as long as a pass changes anything. Every step raises an integer
    that is bounded, so the search ends at a packing that no such exchange improves. Emptied bins go.
    """
    fill = [sum(sizes[i] for i in b) for b in bins]
    state = _Bins(bins, sizes)
    changed = True
    while changed:
        changed = False
        under = sorted((b for b in range(len(bins)) if bins[b] and fill[b] < full * capacity), key=lambda b: (-fill[b], b))
        tables = {b: state.offers(b) for b in under}
        sums = np.concatenate([tables[b][0] for b in under] or [np.zeros(0, np.int64)])
        owner = np.repeat(np.array(under, np.int64), [len(tables[b][0]) for b in under]) if under else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(tables[b][0])) for b in under]) if under else np.zeros(0, np.int64)
        order = np.argsort(sums, kind="stable")
        sums, owner, place = sums[order], owner[order], place[order]
        stale: set[int] = set()  # bins whose rows in the arrays no longer hold; they come in again with the next pass
        for target in under:
            if target in stale:
                continue
            while bins[target] and fill[target] < full * capacity:
                gap = capacity - fill[target]
                mine: dict[int, int] = {0: -1}
                for i in bins[target]:
                    mine.setdefault(sizes[i], i)
                best = None  # (gain, donor, items that come, item that goes)
                for s, i in mine.items():
                    at = int(np.searchsorted(sums, s + gap, "right")) - 1
                    while at >= 0 and sums[at] > s and (best is None or sums[at] - s > best[0]):
                        d = int(owner[at])
                        if d != target and d not in stale and fill[target] + sums[at] - s > fill[d]:  # the sum of squares rises
                            come = [int(x) for x in tables[d][1][place[at]] if x >= 0]
                            best = (int(sums[at]) - s, d, come, i)
                            break
                        at -= 1
                if best is None:
                    break
                gain, donor, come, go = best
                bins[target] = [x for x in bins[target] if x != go] + come
                bins[donor] = [x for x in bins[donor] if x not in come] + ([go] if go >= 0 else [])
                fill[target] += gain
                fill[donor] -= gain
                for b in (target, donor):
                    state.tables.pop(b, None)
                    stale.add(b)
                changed = True
    return [b for b in bins if b]


def _packer(capacity: int, full: float):
    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["doc", "piece"]).reset_index(drop=True)
        sizes = b["size"].tolist()
        bins = improve(best_fit(sizes, capacity), sizes, capacity, full)
        at = pd.Series(0, index=b.index)
        fill = pd.Series(0, index=b.index)
        for k, items in enumerate(bins):
            at.loc[items] = k
            fill.loc[items] = sum(sizes[i] for i in items)
        return b.assign(slot=at.astype("int32"), fill=fill.astype("int64"))

    return run


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int = 2048, shard_items: int = SHARD_ITEMS, full: float = FULL, least_gain: float = LEAST_GAIN) -> DataFrame:
    """(id, piece, size, pieces, container, fill): the container of every item.

    An item over the capacity, and no other, is cut into pieces of exactly the capacity and a rest, numbered from 1; full
    pieces have containers of their own. Items of size 0 or null go into a container like others, with size 0. Ids are
    expected to be unique; rows with a null id are ignored. Shards are drawn by hash, so no key can make one large, and
    each is packed in a task of its own. What all of them leave in underfull containers is drawn anew and packed again,
    until it fits one shard or a round settles less than the share `least_gain` of its items.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    size = F.greatest(F.coalesce(F.col(size_col), F.lit(0)).cast("long"), F.lit(0))
    base = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), size.alias("all"))
    n = F.greatest(F.ceil(F.col("all") / capacity), F.lit(1)).cast("int")
    cut = base.withColumn("pieces", n).select("doc", "pieces", "all", F.explode(F.sequence(F.lit(1), "pieces")).alias("piece"))
    cut = materialize(cut.select("doc", "piece", "pieces", F.least(F.col("all") - (F.col("piece") - 1) * F.lit(capacity).cast("long"), F.lit(capacity).cast("long")).alias("size")), "items")
    whole = cut.where(F.col("size") == capacity).select("doc", "piece", "size", "pieces", F.concat(F.lit("w-"), F.col("doc").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container"), F.col("size").alias("fill"))
    kind = cut.schema["doc"].dataType.simpleString()
    left, done, before, r = cut.where(F.col("size") < capacity), [whole], None, 0
    count = left.count()
    while count:
        shards = math.ceil(count / shard_items)
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("doc", "piece", F.lit(r)), F.lit(shards)).cast("int")).repartition(shards, "shard")
        packed = dealt.groupBy("shard").applyInPandas(_packer(capacity, full), f"doc {kind}, piece int, pieces int, size long, shard int, slot int, fill long")
        packed = materialize(packed, "packed")
        name = F.concat_ws("-", F.lit(f"r{r}"), "shard", "slot")
        under = packed.where(F.col("fill") < full * capacity)
        before, count = count, under.count() if shards > 1 else 0
        last = count > (1 - least_gain) * before or not count
        ready = packed if last else packed.where(F.col("fill") >= full * capacity)
        done.append(ready.select("doc", "piece", "size", "pieces", name.alias("container"), "fill"))
        if last:
            break
        left, r = under.select("doc", "piece", "pieces", "size"), r + 1
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.withColumnRenamed("doc", id_col)
