import random

import pytest

from lodestone.operators.components import components
from lodestone.operators.hierarchy import chains, descendants, hierarchy


def walk(parents):
    out = {}
    for v, p in parents.items():
        if p is None:
            continue
        seen, x = [], v
        while True:
            if x in seen:
                loop = seen[seen.index(x) :]
                out[v] = (min(loop), -1, v in loop)
                break
            seen.append(x)
            p = parents[x]
            if p is None or p not in parents:
                out[v] = (x, len(seen) - 1, False)
                break
            x = p
    return out


def run(spark, parents):
    df = spark.createDataFrame(list(parents.items()), "id string, p string")
    return {r.id: (r.root_id, r.depth, r.in_loop) for r in hierarchy(df, "id", "p").collect()}


def test_shapes(spark):
    n = 40
    tree = {f"a{i:02}": (f"a{i + 1:02}" if i < n - 1 else None) for i in range(n)}
    tree |= {f"b{i}": f"b{(i + 1) % 7}" for i in range(7)} | {"s": "s", "t": "s", "u": "t", "m": "nowhere", "n": "m", "z": None}
    assert run(spark, tree) == walk(tree)


def test_random_forest(spark):
    r = random.Random(1)
    parents = {f"n{i:03}": r.choice([None, "missing", *[f"n{j:03}" for j in range(max(0, i - 4), min(150, i + 3))]]) for i in range(150)}
    assert run(spark, parents) == walk(parents)


def test_paths_nulls_and_repeats(spark):
    rows = [("a", "b"), ("b", "c"), ("c", None), (None, "a"), ("a", "b"), ("x", "y"), ("y", "x")]
    df = spark.createDataFrame(rows, "id string, p string")
    got = hierarchy(df, "id", "p", with_path=True)
    assert {r.id: r.path for r in got.collect()} == {"a": ["a", "b", "c"], "b": ["b", "c"], "x": None, "y": None}
    assert {(r.ancestor_id, r.id, r.distance) for r in descendants(got, "id").collect()} == {("b", "a", 1), ("c", "a", 2), ("c", "b", 1)}


def test_chains_of_every_row(spark):
    r = random.Random(3)
    parents = {f"n{i:03}": r.choice([None, "missing", *[f"n{j:03}" for j in range(max(0, i - 3), min(200, i + 3))]]) for i in range(200)}
    parents |= {f"b{i}": f"b{(i + 1) % 9}" for i in range(9)} | {f"t{i:02}": f"t{i + 1:02}" if i < 19 else "b4" for i in range(20)} | {"s": "s", "u": "s", "alone": None}
    want = {}
    for v in parents:
        path = [v]
        while (p := parents[path[-1]]) in parents and p not in path:
            path.append(p)
        if p in path:
            loop = path[path.index(p) :]
            want[v] = (min(loop), -1, "on loop" if v in loop else "leads to loop", path)
        else:
            want[v] = (path[-1], len(path) - 1, "sound" if p is None else "dangling" if len(path) == 1 else "leads to dangling", path)
    df = chains(spark.createDataFrame(list(parents.items()), "id string, p string"), "id", "p").cache()
    assert {x.id: (x.root_id, x.depth, x.status, x.path) for x in df.collect()} == want and df.count() == len(parents)
    assert {w[2] for w in want.values()} == {"sound", "dangling", "leads to dangling", "on loop", "leads to loop"}
    links = {(x.ancestor_id, x.id, x.distance) for x in descendants(df, "id").collect()}
    assert links == {(a, v, i) for v, w in want.items() for i, a in enumerate(w[3]) if i} and ("t19", "t00", 19) in links


def test_empty_and_long_ids(spark):
    assert hierarchy(spark.createDataFrame([], "id string, p string"), "id", "p").count() == 0
    df = spark.createDataFrame([(1, 2), (2, 3), (3, None)], "id long, p long")
    assert {(r.id, r.root_id, r.depth) for r in hierarchy(df, "id", "p").collect()} == {(1, 3, 2), (2, 3, 1)}


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, None), (500, 500)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("n", [1, 33])
def test_star(spark, n):
    got = components(spark.createDataFrame([(0, i + 1) for i in range(n)], "u long, v long")).collect()
    assert {x.component for x in got} == {0} and len(got) == n + 1
