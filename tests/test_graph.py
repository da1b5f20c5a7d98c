import random

import pytest

from lodestone.operators import graph
from lodestone.operators.symbols import extract, extract_all


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


CHAIN = [("route", "handle"), ("handle", "get"), ("get", "find"), ("use", "format1"), ("use", "format2"), ("alpha", "beta"), ("beta", "alpha")]


@pytest.mark.parametrize(("depth", "rows"), [(1, 2), (2, 3), (3, 4), (9, 4)])
def test_expand_depth(spark, depth, rows):
    assert graph.expand(edges_of(spark, CHAIN), seed(spark, "route"), "out", depth).count() == rows


def test_expand_cycle_and_labels(spark):
    e = edges_of(spark, CHAIN)
    assert sorted((r.id, r.depth, r.label) for r in graph.expand(e, seed(spark, "alpha"), "out").collect()) == [("alpha", 0, "def"), ("beta", 1, "call→")]
    assert sorted((r.id, r.depth, r.label) for r in graph.expand(e, seed(spark, "alpha"), "both").collect()) == [("alpha", 0, "def"), ("beta", 1, "call→")]
    assert sorted((r.id, r.label) for r in graph.expand(e, seed(spark, "find"), "in", 2).collect()) == [("find", "def"), ("get", "call←"), ("handle", "call←")]
    assert graph.expand(e, seed(spark), "both").count() == 0
    with pytest.raises(ValueError):
        graph.expand(e, seed(spark, "alpha"), "sideways")


def test_wide_star(spark):
    e = edges_of(spark, [("root", f"l{i}") for i in range(6000)])
    assert graph.expand(e, seed(spark, "root"), "out", 5).count() == 6001
    assert graph.expand(e, seed(spark, "root"), "out", 5, cap=5000).count() == 5001


def test_shortest_paths_against_search(spark):
    r = random.Random(4)
    pairs = sorted({(f"n{r.randrange(25):02}", f"n{r.randrange(25):02}") for _ in range(60)})
    got = {x.id: tuple(x.path) for x in graph.shortest_paths(edges_of(spark, pairs), seed(spark, "n00"), 5).collect()}
    best, level = {"n00": ("n00",)}, {"n00": ("n00",)}
    for _ in range(5):
        nxt = {}
        for v, p in level.items():
            for a, b in pairs:
                if a == v and b not in best and (b not in nxt or p + (b,) < nxt[b]):
                    nxt[b] = p + (b,)
        best |= nxt
        level = nxt
    assert got == best


def test_trace(spark):
    e = edges_of(spark, [("root", "aSibling"), ("root", "mid"), ("mid", "target")])
    names = spark.createDataFrame([(x, x) for x in ("root", "aSibling", "mid", "target")], "id string, name string")
    rows, reached = graph.trace(e, seed(spark, "root"), names, "target")
    assert reached and [r.id for r in rows.orderBy("depth").collect()] == ["root", "mid", "target"]
    assert graph.trace(e, seed(spark, "root"), names, "root")[0].count() == 1
    rows, reached = graph.trace(e, seed(spark, "root"), names, "nowhere")
    assert not reached and rows.count() == 4


def test_resolution(spark):
    symbols = spark.createDataFrame([("1", "r", "a", "foo"), ("2", "r", "b", "foo"), ("3", "r", "c", "bar"), ("4", "q", "a", "bar")], "id string, repo string, file string, name string")
    staged = spark.createDataFrame([("r", "foo", "a", "bar"), ("r", "foo", "a", "bar"), ("r", "bar", "c", "foo"), ("r", "foo", "a", "trim")], "repo string, from_name string, from_file string, to_name string")
    calls = graph.resolve_calls(staged, symbols)
    assert sorted(tuple(r) for r in calls.collect()) == [("1", "3"), ("3", "1"), ("3", "2")]
    assert sorted(tuple(r) for r in graph.resolve_imports(staged, symbols).collect()) == [("1", "3"), ("3", "1"), ("3", "2")]
    assert sorted(r.id for r in graph.ambiguous(calls.toDF("src", "dst"), symbols.select("id", "name")).collect()) == ["1", "2"]


def test_enclosing(spark):
    sites = spark.createDataFrame([("f", 5), ("f", 1), ("f", 10), ("g", 3)], "file string, line int")
    symbols = spark.createDataFrame([("f", 4, "b"), ("f", 2, "a"), ("f", 10, "c")], "file string, start int, name string")
    got = {(r.file, r.line): r.enclosing for r in graph.enclosing(sites, symbols, ["file"], "line", "start", "name").collect()}
    assert got == {("f", 5): "b", ("f", 1): "a", ("f", 10): "c", ("g", 3): None}


def test_seed(spark):
    s = spark.createDataFrame([("1", "p", "f", "go", 2), ("2", "p", "f", "stop", 9), ("3", "q", "f", "go", 2)], "id string, project string, file string, name string, start_line int")
    found = lambda **k: sorted(r.id for r in graph.resolve_seed(s, "p", **k).collect())
    assert found(symbol_id="1", name="stop") == ["1"] and found(symbol_id="3") == [] and found(name="go") == ["1"]
    assert found(file="f") == ["1", "2"] and found(file="f", line=8) == ["1"] and found(file="f", line=1) == ["1"] and found() == []


SOURCE = """import Default, { a as b, type T, c } from "./m";
import * as ns from './n'; import "side";
export interface Row { id: string }
type Id = string | number;
enum Kind { A, B }
export async function getUser(id: Id): Promise<Row> {
  // call(nothing)
  const text = `x ${format(id)} y(z)`;
  if (check(id)) { return this.repo.findUser(id); }
  return new Row();
}
const arrow = async (x: number): Promise<void> => { await run(x) };
const short = x => twice(x);
const value = outside();
abstract class Service<T> extends Base {
  private field = make();
  constructor(private a: string) { super(); init(); }
  method<K>(k: K): void { this.other?.(k); helper(k) }
}
"""


def test_extract():
    got = extract(SOURCE, "src/a.ts")
    assert [(n, k) for n, k, _ in got.symbols] == [("Row", "interface"), ("Id", "type"), ("Kind", "enum"), ("getUser", "function"), ("arrow", "function"), ("short", "function"), ("Service", "class"), ("constructor", "method"), ("method", "method")]
    calls = {(a, b) for a, b, _ in got.calls}
    assert {("getUser", "format"), ("getUser", "check"), ("getUser", "findUser"), ("arrow", "run"), ("short", "twice"), ("Service", "make"), ("constructor", "init"), ("method", "helper")} <= calls
    assert not any(b in ("nothing", "z", "outside", "Row") for _, b in calls)
    assert [(a, e, m) for a, e, m, _ in got.imports] == [("Default", "Default", "./m"), ("b", "a", "./m"), ("T", "T", "./m"), ("c", "c", "./m"), ("ns", "ns", "./n")]
    assert extract(SOURCE, "a.py").symbols == [] and extract("function (", "a.ts").symbols == [] and extract("", "a.tsx").calls == []


def test_extract_all(spark):
    df = spark.createDataFrame([("1", "a.ts", SOURCE), ("2", None, None), ("3", "b.go", "func x() {}")], "id string, p string, t string")
    got = extract_all(df, ["id"], "p", "t")
    assert got.where("record = 'symbol'").count() == 9 and got.select("id").distinct().count() == 1
