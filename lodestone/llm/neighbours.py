"""Most similar vectors for every vector (problem 4).

Equal vectors form one class from the start. A first graph comes from cells: each class joins the cells of its nearest
centres, drawn from a bounded sample, and finds its nearest ones there by matrix products. NN-descent then improves it in
rounds: the neighbours of a row, and the rows that have it as one, are offered to each other by Spark joins, as long as
one of the two links is new, and each row keeps its best. Within the graph vectors travel as 8 bits a component, which
changes a cosine by about 0.001; those of the links that are reported are computed anew. Searches walk the graph greedily.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import discard, materialize

SCALE = 32767.0
#: Rows of the sample that centres are drawn from, at most, and the number of centres: what the driver and all tasks hold.
SAMPLE_ROWS, MOST_CENTRES = 16_384, 4096
#: Rows a cell should have; one that is expected to have over twice as many is divided by centres of its own.
CELL_ROWS = 8192
#: Centres that a row is sent to within each of its cells, where cells are divided.
SECOND_SPREAD = 2
#: Links kept beyond those asked for while the graph is built.
SPARE = 1


def unit_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int | None = None) -> tuple[DataFrame, int]:
    """(rid, id, q, h1, h2) of the rows with a usable vector, as a written table, and the dimension (by default that of most rows).

    q is the vector at unit length as 16-bit integers, h1 and h2 are hashes of it. Null ids, null, all-zero or non-finite
    vectors, null components and other dimensions do not take part.
    """
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    if dim is None:
        sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = sizes["d"] if sizes else 0
    rows = rows.where((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))).select(F.monotonically_increasing_id().alias("rid"), "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not dim:
                continue
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            norm = np.sqrt((x * x).sum(1))
            ok = np.isfinite(norm) & (norm > 0)
            q = np.rint(x[ok] / norm[ok, None] * SCALE).astype(np.int16)
            keep = b.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([keep.column("rid"), keep.column("id"), _binary(q)], ["rid", "id", "q"])

    kind = df.schema[id_col].dataType.simpleString()
    return materialize(rows.mapInArrow(run, f"rid long, id {kind}, q binary").withColumns({"h1": F.xxhash64("q"), "h2": F.hash("q")}), "vectors"), dim


def _binary(q: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    q = np.ascontiguousarray(q)
    width = q.shape[1] * q.itemsize
    offsets = pa.py_buffer((np.arange(len(q) + 1, dtype=np.int32) * width).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(q), [None, offsets, pa.py_buffer(q.tobytes())])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-30)[:, None]


def _matrix(column, dim: int, kind=np.int16) -> np.ndarray:
    """Unit vectors of a binary column, chunked or not."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    got = []
    for c in chunks:
        if len(c):
            offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            got.append(np.frombuffer(c.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind))
    return _unit(np.concatenate(got).reshape(-1, dim)) if got else np.zeros((0, dim), np.float32)


def _codes(x: np.ndarray) -> np.ndarray:
    """Unit vectors as 8-bit integers, each by its largest component."""
    return np.rint(x * (127 / np.maximum(np.abs(x).max(1), 1e-30))[:, None]).astype(np.int8)


class Cells:
    """Which cells a vector belongs to: its nearest centres, each with its nearest second centres where all cells would be too large, and centres of their own for cells that the sample shows to be crowded."""

    def __init__(self, centres: np.ndarray, second: np.ndarray, spread: int):
        self.centres, self.second, self.spread, self.own = centres, second, spread, {}

    def coarse(self, x: np.ndarray) -> np.ndarray:
        m = min(self.spread, len(self.centres))
        first = _nearest(x, self.centres, m)
        if len(self.second) == 1:
            return first << 32
        fine = _nearest(x, self.second, min(SECOND_SPREAD, len(self.second)))
        return ((first[:, :, None] << 32) | (fine[:, None, :] << 16)).reshape(len(x), -1)

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell), the first of each row being the one it is at home in."""
        cells = self.coarse(x)
        row = np.repeat(np.arange(len(x)), cells.shape[1])
        cell, rank = cells.ravel(), np.tile(np.arange(cells.shape[1]), len(x))
        if self.own:
            keep, more = np.ones(len(cell), bool), []
            for name, sub in self.own.items():
                at = np.flatnonzero(cell == name)
                if len(at):
                    keep[at] = False
                    fine = _nearest(x[row[at]], sub, min(SECOND_SPREAD, len(sub)))
                    w = fine.shape[1]
                    more.append((np.repeat(row[at], w), np.repeat(cell[at], w) + 1 + fine.ravel(), np.repeat(rank[at] * SECOND_SPREAD, w) + np.tile(np.arange(w), len(at))))
            row, cell, rank = (np.concatenate(z) for z in zip((row[keep], cell[keep], rank[keep] * SECOND_SPREAD), *more))
            order = np.lexsort((rank, row))
            row, cell = row[order], cell[order]
        return row, cell


def _nearest(x: np.ndarray, centres: np.ndarray, m: int) -> np.ndarray:
    """The m nearest centres of each row, the nearest first."""
    sims = x @ centres.T
    at = np.argpartition(-sims, m - 1, axis=1)[:, :m] if m < len(centres) else np.tile(np.arange(len(centres)), (len(x), 1))
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(sims, at, 1), axis=1, kind="stable"), 1).astype(np.int64)


def _sample(rows: DataFrame, total: int, seed: int) -> tuple[np.ndarray, list[bytes]]:
    got = rows.select("rid", "q").sample(False, min(1.0, 1.2 * SAMPLE_ROWS / max(total, 1)), seed).limit(SAMPLE_ROWS).collect()
    got = got or rows.select("rid", "q").limit(SAMPLE_ROWS).collect()
    got.sort(key=lambda r: r["rid"])
    return np.array([r["rid"] for r in got]), [bytes(r["q"]) for r in got]


def _plan_cells(rows: DataFrame, dim: int, total: int, spread: int, seed: int, cell_rows: int) -> tuple[np.ndarray, Cells]:
    """(rids of the centres, cells), from a sample of at most SAMPLE_ROWS rows; crowded cells get centres from their own sampled rows."""
    rids, data = _sample(rows, total, seed)
    x = _unit(np.frombuffer(b"".join(data), np.int16).reshape(-1, dim))
    rng = np.random.default_rng(seed)
    wanted = max(1, math.ceil(total * spread / cell_rows))
    n = min(wanted, MOST_CENTRES, len(x))
    pick = np.sort(rng.choice(len(x), n, replace=False))
    m = min(math.ceil(SECOND_SPREAD * wanted / n), MOST_CENTRES, len(x)) if wanted > MOST_CENTRES else 1
    cells = Cells(x[pick], x[rng.choice(len(x), m, replace=False)], spread)
    coarse = cells.coarse(x)
    row = np.repeat(np.arange(len(x)), coarse.shape[1])
    names, at, rows_in = np.unique(coarse.ravel(), return_inverse=True, return_counts=True)
    for k in np.flatnonzero(rows_in * (total / len(x)) > 2 * cell_rows):
        mine = row[at == k]
        parts = min(math.ceil(SECOND_SPREAD * rows_in[k] * (total / len(x)) / cell_rows), len(mine), 65_000)
        if parts > 1:
            cells.own[int(names[k])] = x[rng.choice(mine, parts, replace=False)]
    return rids[pick], cells


def _assigner(cells: Cells, dim: int):
    """Vectors (rid, q) to their cells: (cell, rid, home, code, at_home)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                x = _matrix(part.column("q"), dim)
                row, cell = cells.of(x)
                first = np.searchsorted(row, np.arange(len(x)))
                at_home = np.zeros(len(row), bool)
                at_home[first] = True
                home = ((cell[first] * 0x9E3779B1) >> 16).astype(np.int32)  # cells that fall together only make a larger home
                codes = _binary(_codes(x)).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(cell), part.column("rid").take(pa.array(row)), pa.array(home[row]), codes, pa.array(at_home)], ["cell", "rid", "home", "code", "at_home"])

    return run


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row: they stand in the k groups of 32 with the largest maxima."""
    rows, width = sims.shape
    if width <= 64 * max(k, 1):
        return np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < width else np.tile(np.arange(width), (rows, 1))
    groups = -(-width // 32)
    if width % 32:
        sims = np.concatenate([sims, np.full((rows, groups * 32 - width), -9, np.float32)], 1)
    cubes = sims.reshape(rows, groups, 32)
    g = np.argpartition(-cubes.max(2), k - 1, axis=1)[:, :k]
    near = np.take_along_axis(cubes, g[:, :, None], 1).reshape(rows, -1)
    at = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return np.take_along_axis(g, at // 32, 1) * 32 + at % 32


LINKS = "a long, ha int, b long, hb int, s float"


def _links(a, ha, b, hb, s) -> pa.Table:
    return pa.table({"a": a.astype(np.int64), "ha": ha.astype(np.int32), "b": b.astype(np.int64), "hb": hb.astype(np.int32), "s": s.astype(np.float32)})


def _best_in_cell(dim: int, k: int):
    """Links to the k nearest rows of each row of a cell, by blocks of the matrix of cosines."""

    def run(group: pa.Table) -> pa.Table:
        rid, home = group.column("rid").to_numpy(), group.column("home").to_numpy()
        x = _matrix(group.column("code"), dim, np.int8)
        w, out = min(k, len(x) - 1), [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.float32),)]
        for s in range(0, len(x) if w else 0, 512):
            sims = x[s : s + 512] @ x.T
            sims[np.arange(len(sims)), np.arange(s, s + len(sims))] = -2
            j = _best(sims, w)
            out.append((np.repeat(np.arange(s, s + len(sims)), w), j.ravel(), np.take_along_axis(sims, j, 1).ravel()))
        i, j, v = (np.concatenate(z) for z in zip(*out))
        return _links(rid[i], home[i], rid[j], home[j], v)

    return run


def _top(links: DataFrame, k: int) -> DataFrame:
    """The k best links of each row, each once; of copies an older one makes a link old. One shuffle, by row."""
    w = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    once = links.repartition("a").groupBy("a", "ha", "b", "hb").agg(F.max("s").alias("s"), F.min("new").alias("new"))
    return once.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _turned(links: DataFrame) -> DataFrame:
    return links.select(F.col("b").alias("a"), F.col("hb").alias("ha"), F.col("a").alias("b"), F.col("ha").alias("hb"), *[c for c in links.columns if c not in ("a", "ha", "b", "hb")])


def _offers(dim: int):
    """Of the links of one home and the vectors these need: pairs of neighbours of a row, one of them newly so, whose cosine raises the least that one of them has."""

    def run(links: pa.Table, held: pa.Table) -> pa.Table:
        x = _matrix(held.column("code"), dim, np.int8)
        ids, home, least = (held.column(c).to_numpy() for c in ("x", "hx", "least"))
        order = np.argsort(ids)
        v, name, new = (links.column(c).to_numpy(zero_copy_only=False) for c in ("v", "x", "new"))
        at = order[np.searchsorted(ids, name, sorter=order)]
        by = np.lexsort((at, v))
        v, at, new = v[by], at[by], new[by].astype(bool)
        out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.float32),)]
        if len(v):
            once = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (at[1:] != at[:-1])])  # a neighbour either way comes once
            new, v, at = np.logical_or.reduceat(new, once), v[once], at[once]
            start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            n = np.diff(np.r_[start, len(v)])
            fresh = np.logical_or.reduceat(new, start)
            for size in np.unique(n[(n > 1) & fresh]):  # rows with as many neighbours at a time, in blocks
                first = start[(n == size) & fresh]
                i, j = np.triu_indices(size, 1)
                for s in range(0, len(first), 2048):
                    m = first[s : s + 2048, None] + np.arange(size)
                    q = x[at[m]]
                    sims = (q @ q.transpose(0, 2, 1))[:, i, j]
                    lo, young = least[at[m]], new[m]
                    g, p = np.nonzero((young[:, i] | young[:, j]) & ((sims > lo[:, i]) | (sims > lo[:, j])))
                    out.append((at[m[g, i[p]]], at[m[g, j[p]]], sims[g, p]))
        a, b, s = (np.concatenate(z) for z in zip(*out))
        swap = ids[a] > ids[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        _, where = np.unique(a * len(ids) + b, return_index=True)
        a, b, s = a[where], b[where], s[where]
        return _links(ids[a], home[a], ids[b], home[b], s)

    return run


def _descend(links: DataFrame, codes: DataFrame, dim: int, k: int, first: bool) -> DataFrame:
    """One round of NN-descent: the k neighbours of each row, and the k nearest of those that have it as one, are offered to each other.

    The links of all rows of one home meet the vectors they need there, each of which comes once, however many of these
    rows have it as a neighbour. Only offers that one of the two can use leave. Rows none of whose links is new have none.
    """
    back = _turned(links).withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))).where(F.col("_r") <= k)
    local = links.select("a", "ha", "b", "new").union(back.select("a", "ha", "b", "new")).toDF("v", "home", "x", "new")
    if not first:  # in the first round all are new
        fresh = links.where("new").select(F.col("a").alias("v")).union(links.where("new").select(F.col("b").alias("v"))).distinct()
        local = local.join(fresh, "v", "left_semi").select("v", "home", "x", "new")
    local = materialize(local, "local")
    least = links.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("m"))
    state = codes.select(F.col("rid").alias("x"), F.col("home").alias("hx"), "code").join(least.withColumnRenamed("a", "x"), "x", "left").select("x", "hx", "code", F.when(F.col("n") >= k, F.col("m")).otherwise(-2.0).cast("float").alias("least"))
    held = local.select("home", "x").distinct().join(state, "x").select("home", "x", "hx", "code", "least").toDF("at", "x", "hx", "code", "least")
    got = materialize(local.groupBy("home").cogroup(held.groupBy("at")).applyInArrow(_offers(dim), LINKS).withColumn("new", F.lit(True)), "offered")
    out = materialize(_top(links.withColumn("new", F.lit(False)).union(got).union(_turned(got)), k), "links")
    discard(local, got)
    return out


def _graph(vectors: DataFrame, dim: int, k: int, spare: int, spread: int, rounds: int, seed: int, least_change: float, cell_rows: int | None = None) -> DataFrame:
    """Links (a, b, s), by 8-bit vectors, of the k + spare nearest rows of each of vectors (rid, q)."""
    total = vectors.count() if dim else 0
    if not total:
        return vectors.sparkSession.createDataFrame([], "a long, b long, s float")
    _, cells = _plan_cells(vectors, dim, total, spread, seed, cell_rows or CELL_ROWS)
    placed = materialize(vectors.select("rid", "q").mapInArrow(_assigner(cells, dim), "cell long, rid long, home int, code binary, at_home boolean"), "placed")
    codes = placed.where("at_home").select("rid", "home", "code")
    found = placed.select("cell", "rid", "home", "code").groupBy("cell").applyInArrow(_best_in_cell(dim, k + min(spare, SPARE)), LINKS).withColumn("new", F.lit(True))
    k += spare
    links = materialize(_top(found, k), "links")
    for r in range(rounds):
        better = _descend(links, codes, dim, k, r == 0)
        discard(links)
        links = better
        if links.where("new").count() <= least_change * total * k:
            break
    return links.select("a", "b", "s")


def _cosines(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.einsum("ij,ij->i", _matrix(b.column("qa"), dim), _matrix(b.column("qb"), dim)) if b.num_rows else np.zeros(0, np.float32)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(s.astype(np.float32))], ["a", "b", "s"])

    return run


def _exact(pairs: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(a, b, s) of links (a, b) with their cosines by the 16-bit vectors, each unordered pair being computed once."""
    one = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    q = vectors.select("rid", "q")
    both = one.join(q.toDF("a", "qa"), "a").join(q.toDF("b", "qb"), "b")
    return both.select("a", "b", "qa", "qb").mapInArrow(_cosines(dim), "a long, b long, s float")


def neighbour_graph(df: DataFrame, id_col: str, vec_col: str, k: int = 5, spread: int = 4, rounds: int = 3, seed: int = 42, least_change: float = 0.02, least: float = -1.0, spare: int = SPARE, cell_rows: int | None = None) -> DataFrame:
    """(id, neighbour_id, rank, cosine): the k rows most similar to each row by cosine, found approximately.

    While the graph is built each row keeps k + `spare` links; more of them let NN-descent find far neighbours, and so do
    cells of more rows (`cell_rows`), each of which a row is compared with. A wider spread of each row over cells, or more rounds of NN-descent, which end once a round changes fewer than
    `least_change` of the links, raise the recall. Equal vectors are one row of the graph, and are nearest to each other.
    Ties in cosine are broken by id. `least`: only neighbours of at least this cosine are reported; the graph itself
    leaves none out. Rows without a usable vector (see unit_vectors) do not come out.
    """
    vectors, dim = unit_vectors(df, id_col, vec_col)
    w = Window.partitionBy("h1", "h2").orderBy("id", "rid")
    firsts = vectors.groupBy("h1", "h2").agg(F.min("rid").alias("class"), F.count(F.lit(1)).alias("copies"))
    many = materialize(firsts.where("copies > 1"), "many")
    named = materialize(vectors.select("rid", "id", "h1", "h2").join(many, ["h1", "h2"], "left").select("rid", "id", F.coalesce("class", "rid").alias("class"), F.coalesce("copies", F.lit(1)).alias("copies"), "h1", "h2"), "named")
    single = vectors.join(named.where("class <> rid").select("rid"), "rid", "left_anti").select("rid", "q")
    single = materialize(single, "classes")
    links = _graph(single, dim, k, spare, spread, rounds, seed, least_change, cell_rows)
    near = materialize(_exact(links.where(F.col("s") >= least - 0.01), single, dim).where(F.col("s") >= least), "near")
    near = near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    # each class meets the k + 1 least ids of another or of itself: no more can be among the k nearest
    few = named.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1).select(F.col("class").alias("b"), F.col("id").alias("neighbour_id"))
    own = many.select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).cast("float").alias("s"))
    order = Window.partitionBy("a").orderBy(F.desc("s"), "neighbour_id")
    best = materialize(near.union(own).join(few, "b").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).select("a", "neighbour_id", "s"), "best")
    all_ = named.select(F.col("class").alias("a"), "id").join(best, "a").where("id <> neighbour_id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "neighbour_id"))
    return all_.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "neighbour_id", "rank", F.col("s").cast("double").alias("cosine"))


def graph_search(df: DataFrame, id_col: str, vec_col: str, queries: DataFrame, k: int = 5, beam: int = 64, hops: int = 16, seed: int = 42, spread: int = 5, cell_rows: int = 32_768) -> DataFrame:
    """(query_id, id, rank, cosine): for each row of `queries` (same columns) the k rows of df nearest to it, by greedy walks.

    Each walk starts at the `beam` / 2 nearest of at most MOST_CENTRES sampled rows; in every hop the unvisited neighbours of its best rows join the
    beam. A query finds its own row if df has it. Queries without a usable vector do not come out.
    """
    vectors, dim = unit_vectors(df, id_col, vec_col)
    asked, _ = unit_vectors(queries, id_col, vec_col, dim)
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    if not dim:
        return spark.createDataFrame([], f"query_id {kind}, id {kind}, rank int, cosine double")
    edges = _graph(vectors, dim, k, k, spread, 3, seed, 0.02, cell_rows)
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "walks")
    rids, data = _sample(vectors, vectors.count(), seed)
    some = np.random.default_rng(seed).choice(len(rids), min(len(rids), MOST_CENTRES), replace=False)
    rids, c = rids[some], _unit(np.frombuffer(b"".join(data), np.int16).reshape(-1, dim)[some])
    m = min(max(beam // 2, 1), len(c))

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                sims = _unit(np.frombuffer(b"".join(b["q"]), np.int16).reshape(-1, dim)) @ c.T
                near = np.argpartition(-sims, m - 1, axis=1)[:, :m]
                yield pd.DataFrame({"query": np.repeat(b["rid"].to_numpy(), m), "node": rids[near.ravel()], "s": np.take_along_axis(sims, near, 1).ravel()})

    state = materialize(asked.select("rid", "q").mapInPandas(start, "query long, node long, s float").withColumn("done", F.lit(False)), "beam")
    w = Window.partitionBy("query").orderBy(F.desc("s"), "node")
    for _ in range(hops):
        fresh = state.where("not done").join(both.withColumnRenamed("a", "node"), "node").select("query", F.col("b").alias("node")).distinct().join(state.select("query", "node"), ["query", "node"], "left_anti")
        pairs = fresh.join(asked.select(F.col("rid").alias("query"), F.col("q").alias("qa")), "query").join(vectors.select(F.col("rid").alias("node"), F.col("q").alias("qb")), "node")
        found = pairs.select(F.col("query").alias("a"), F.col("node").alias("b"), "qa", "qb").mapInArrow(_cosines(dim), "a long, b long, s float").toDF("query", "node", "s")
        merged = state.withColumn("done", F.lit(True)).union(found.withColumn("done", F.lit(False)))
        nxt = materialize(merged.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= beam).drop("_r"), "beam")
        discard(state)
        state = nxt
        if state.where("not done").isEmpty():
            break
    best = state.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    named = best.join(asked.select(F.col("rid").alias("query"), F.col("id").alias("query_id")), "query").join(vectors.select(F.col("rid").alias("node"), "id"), "node")
    return named.select("query_id", "id", "rank", F.col("s").cast("double").alias("cosine"))
