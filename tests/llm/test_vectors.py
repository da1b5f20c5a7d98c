import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm.neighbours import graph_search, neighbour_graph, unit_vectors


def clusters(seed, n=1500, dim=32):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 3, dim))
    pick = rng.integers(0, len(base), n - len(base))
    return np.concatenate([base, base[pick] + rng.uniform(0.05, 0.5, len(pick))[:, None] * rng.standard_normal((len(pick), dim))]).astype(np.float32)


def frame(spark, x, extra=()):
    return spark.createDataFrame([(f"v{i:05}", [float(c) for c in v], "x") for i, v in enumerate(x)] + list(extra), "id string, v array<float>, rid string")


ODD = [("n1", None, None), ("n2", [0.0] * 32, None), ("n3", [1.0], None), ("n4", [float("nan")] * 32, None), ("n5", [None] * 32, None), (None, [1.0] * 32, None)]


def exact(x, k):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return s, np.argsort(-s, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize(("cell", "most"), [(128, 4096), (96, 16)])
def test_recall_of_the_graph(spark, monkeypatch, cell, most):
    from lodestone.llm import neighbours

    monkeypatch.setattr(neighbours, "CELL_ROWS", cell)  # as many cells as a large table has, or more than there may be centres
    monkeypatch.setattr(neighbours, "MOST_CENTRES", most)
    x = clusters(1)
    got = {}
    for r in neighbour_graph(frame(spark, x, ODD), "id", "v", 5).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour_id, r.cosine))
    s, top = exact(x, 5)
    assert set(got) == {f"v{i:05}" for i in range(len(x))} and all(sorted(r for r, *_ in v) == [1, 2, 3, 4, 5] for v in got.values())
    names = {k: {n for _, n, _ in v} for k, v in got.items()}
    recall = np.mean([len(names[f"v{i:05}"] & {f"v{j:05}" for j in top[i]}) / 5 for i in range(len(x))])
    near = [(i, j) for i in range(len(x)) for j in top[i] if s[i, j] >= 0.85]
    close = np.mean([f"v{j:05}" in names[f"v{i:05}"] for i, j in near])
    assert recall >= 0.9 and close >= 0.98
    assert all(abs(c - s[int(k[1:]), int(n[1:])]) < 1e-4 for k, v in got.items() for _, n, c in v)


def test_descent_improves(spark, monkeypatch):
    from lodestone.llm import neighbours

    monkeypatch.setattr(neighbours, "CELL_ROWS", 64)
    x = clusters(2)
    _, top = exact(x, 5)

    def recall(rounds):
        got = {}
        for r in neighbour_graph(frame(spark, x), "id", "v", 5, spread=2, rounds=rounds, spare=11).collect():
            got.setdefault(r.id, set()).add(r.neighbour_id)
        return np.mean([len(got.get(f"v{i:05}", set()) & {f"v{j:05}" for j in top[i]}) / 5 for i in range(len(x))])

    before, after = recall(0), recall(3)
    assert after > before + 0.1


def test_copies_least_and_tiny(spark):
    rows = frame(spark, np.concatenate([np.ones((400, 32)), -np.ones((1, 32))]).astype(np.float32))
    got = neighbour_graph(rows, "id", "v", 3, least=0.5)
    assert got.count() == 1200 and got.agg(F.min("cosine")).first()[0] > 0.9999
    # equal vectors are nearest to each other, those of the least ids first
    assert {r.neighbour_id for r in got.where("id = 'v00002'").collect()} == {"v00000", "v00001", "v00003"}
    assert {r.neighbour_id for r in neighbour_graph(rows, "id", "v", 3).where("id = 'v00400'").collect()} == {"v00000", "v00001", "v00002"}
    assert neighbour_graph(rows.limit(0), "id", "v").count() == 0
    assert neighbour_graph(rows.limit(1), "id", "v").count() == 0
    assert neighbour_graph(spark.createDataFrame(ODD, "id string, v array<float>, rid string"), "id", "v").where("id like 'n1'").count() == 0
    table, dim = unit_vectors(frame(spark, np.ones((2, 32), np.float32), ODD), "id", "v")
    assert dim == 32 and table.count() == 2


def test_crowded_cells_are_divided(spark, monkeypatch):
    from lodestone.llm import neighbours

    monkeypatch.setattr(neighbours, "CELL_ROWS", 64)
    rng = np.random.default_rng(5)
    crowd = np.ones((700, 32)) + 0.15 * rng.standard_normal((700, 32))  # most rows point the same way, and differ
    x = np.concatenate([crowd, rng.standard_normal((300, 32))]).astype(np.float32)
    table, dim = unit_vectors(frame(spark, x), "id", "v")
    _, cells = neighbours._plan_cells(table, dim, 1000, 4, 1, 64)
    q = neighbours._matrix(table.toArrow().column("q").combine_chunks(), dim)
    row, cell = cells.of(q)
    assert cells.own and set(row.tolist()) == set(range(1000)) and np.unique(cell, return_counts=True)[1].max() < 450
    got = {}
    for r in neighbour_graph(frame(spark, x), "id", "v", 5).collect():
        got.setdefault(r.id, set()).add(r.neighbour_id)
    _, top = exact(x, 5)
    assert np.mean([len(got[f"v{i:05}"] & {f"v{j:05}" for j in top[i]}) / 5 for i in range(1000)]) >= 0.85


def test_search(spark):
    x = clusters(3, 900)
    rows = frame(spark, x)
    asked = rows.where("cast(substring(id, 2, 5) as int) % 50 = 0")
    got = {}
    for r in graph_search(rows, "id", "v", asked, 5).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = {f"v{i:05}": {f"v{j:05}" for j in np.argsort(-(u @ u[i]))[:5]} for i in range(0, 900, 50)}
    assert got.keys() == want.keys() and np.mean([len(got[k] & want[k]) / 5 for k in want]) >= 0.9
    assert graph_search(rows.limit(0), "id", "v", asked, 5).count() == 0 and graph_search(rows, "id", "v", asked.limit(0), 5).count() == 0
