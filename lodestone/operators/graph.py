"""Code-graph operators: edge resolution, ambiguity, bounded expansion, shortest paths, seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import discard, materialize

#: Bounds of depth and rows a caller may ask for.
MAX_DEPTH, DEFAULT_DEPTH, MAX_ROWS, DEFAULT_ROWS = 10, 4, 1000, 50


def clamp(value: int | None, default: int, most: int) -> int:
    return default if value is None else min(max(int(value), 1), most)


def resolve_calls(staged: DataFrame, symbols: DataFrame) -> DataFrame:
    """(from_symbol, to_symbol) of staged (repo, from_name, from_file, to_name): the caller by repository, name and file, the callee by repository and name.

    symbols: (id, repo, file, name). Names that resolve to nothing give no edge, ambiguous ones an edge each.
    """
    src = symbols.select(F.col("repo"), F.col("name").alias("from_name"), F.col("file").alias("from_file"), F.col("id").alias("from_symbol"))
    dst = symbols.select(F.col("repo"), F.col("name").alias("to_name"), F.col("id").alias("to_symbol"))
    return staged.distinct().join(src, ["repo", "from_name", "from_file"]).join(dst, ["repo", "to_name"]).select("from_symbol", "to_symbol").distinct()


def resolve_imports(staged: DataFrame, symbols: DataFrame) -> DataFrame:
    """(from_symbol, to_symbol) of staged (repo, from_file, to_name): every symbol of the importing file to those of that name elsewhere."""
    src = symbols.select("repo", F.col("file").alias("from_file"), F.col("id").alias("from_symbol"))
    dst = symbols.select("repo", F.col("name").alias("to_name"), F.col("file").alias("to_file"), F.col("id").alias("to_symbol"))
    named = staged.select("repo", "from_file", "to_name").distinct().join(dst, ["repo", "to_name"]).where("to_file <> from_file")
    return named.join(src, ["repo", "from_file"]).select("from_symbol", "to_symbol").distinct()


def ambiguous(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(id): targets of a (source, target name) that leads to several targets. edges (src, dst), names (id, name)."""
    named = edges.distinct().join(names.toDF("dst", "name"), "dst")
    many = named.groupBy("src", "name").agg(F.count_distinct("dst").alias("n")).where("n > 1").select("src", "name")
    return named.join(many, ["src", "name"], "left_semi").select(F.col("dst").alias("id")).distinct()


def _reach(edges: DataFrame, seeds: DataFrame, depth: int, label: str, cap: int | None) -> DataFrame:
    seen = materialize(seeds.select("id", F.lit(0).alias("depth")), "seen")
    frontier = seen
    for d in range(1, depth + 1):
        nxt = frontier.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        if cap is not None:
            nxt = nxt.orderBy("id").limit(cap)
        frontier = materialize(nxt.select("id", F.lit(d).alias("depth")), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen.withColumn("label", F.when(F.col("depth") == 0, "def").otherwise(label))


def expand(edges: DataFrame, seeds: DataFrame, direction: str = "both", depth: int | None = None, cap: int | None = None) -> DataFrame:
    """(id, depth, label): nodes within `depth` steps of the seeds (id), breadth first: 'out' along edges (src, dst), 'in' against them, 'both' independently.

    Of a node that both walks reach the smaller depth counts, at equal depth that of 'out'. Seeds have depth 0 and
    label def. `cap` bounds the nodes of a level and is off by default.
    """
    depth = clamp(depth, DEFAULT_DEPTH, MAX_DEPTH)
    if direction not in ("out", "in", "both"):
        raise ValueError("direction must be out, in or both")
    seeds = seeds.select("id").distinct()
    walks = []
    if direction != "in":
        walks.append(_reach(edges, seeds, depth, "call→", cap))
    if direction != "out":
        walks.append(_reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds, depth, "call←", cap))
    all_ = walks[0] if len(walks) == 1 else walks[0].unionByName(walks[1])
    return all_.groupBy("id").agg(F.min("depth").alias("depth"), F.min_by("label", F.struct("depth", (F.col("label") == "call←").alias("late"))).alias("label"))


def shortest_paths(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, depth, path): for each node within `depth` steps the shortest path from a seed, of equals the smallest by its ids."""
    depth = clamp(depth, DEFAULT_DEPTH, MAX_DEPTH)
    seen = materialize(seeds.select("id").distinct().select("id", F.lit(0).alias("depth"), F.array("id").alias("path")), "paths")
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        best = step.groupBy("id").agg(F.min("path").alias("path")).join(seen.select("id"), "id", "left_anti")
        frontier = materialize(best.select("id", F.lit(d).alias("depth"), "path"), "paths")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def trace(edges: DataFrame, seeds: DataFrame, names: DataFrame, target: str, depth: int | None = None) -> tuple[DataFrame, bool]:
    """(rows, reached): the nodes (id, depth) of the shortest path to a node of that name; if there is none, what the seeds reach, and False."""
    paths = shortest_paths(edges, seeds, depth)
    hit = paths.join(names.where(F.col("name") == target).select("id"), "id").orderBy("depth", "path").limit(1)
    if hit.isEmpty():
        return expand(edges, seeds, "out", depth).select("id", "depth"), False
    return hit.select(F.posexplode("path").alias("depth", "id")).select("id", "depth"), True


def enclosing(sites: DataFrame, symbols: DataFrame, keys: list[str], line_col: str, start_col: str, value_col: str) -> DataFrame:
    """sites with `enclosing`: the value of the symbol with the greatest start at or above the line, else of the file's first, else null.

    One sort of sites and symbols together by file and line (an as-of join): no pair of them is made.
    """
    s = sites.select(*sites.columns, F.col(line_col).alias("_at"), F.lit(1).alias("_site"), F.lit(None).cast(symbols.schema[value_col].dataType).alias("_v"))
    y = symbols.groupBy(*keys, F.col(start_col).alias("_at")).agg(F.min(value_col).alias("_v")).select(*keys, "_at", F.lit(0).alias("_site"), "_v")
    both = s.unionByName(y, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_at", "_site").rowsBetween(Window.unboundedPreceding, 0)
    first = symbols.groupBy(*keys).agg(F.min_by(value_col, F.struct(start_col, value_col)).alias("_first"))
    got = both.withColumn("_e", F.last("_v", ignorenulls=True).over(w)).where("_site = 1").join(first, keys, "left")
    return got.select(*sites.columns, F.coalesce("_e", "_first").alias("enclosing"))


def code_graph(extracted: DataFrame, repo: str = "repo", file: str = "file") -> tuple[DataFrame, DataFrame]:
    """(symbols (id, repo, file, name, kind, start_line), edges (src, dst, kind)) of what `symbols.extract_all` found, with the keys `repo` and `file` and lines of the file.

    A symbol that overlapping windows found twice comes once. Calls lead from the caller in its file to every symbol of
    the called name in the repository, imports from every symbol of a file to those of the exported name elsewhere.
    """
    got = extracted.select(F.col(repo).alias("repo"), F.col(file).alias("file"), "record", "name", "kind", "other", "line")
    symbols = got.where("record = 'symbol'").select("repo", "file", "name", "kind", F.col("line").alias("start_line")).distinct()
    symbols = materialize(symbols.withColumn("id", F.concat_ws("|", "repo", "file", "name", "kind", F.col("start_line").cast("string"))), "symbols")
    calls = got.where("record = 'call'").select("repo", F.col("name").alias("from_name"), F.col("file").alias("from_file"), F.col("other").alias("to_name"))
    imports = got.where("record = 'import'").select("repo", F.col("file").alias("from_file"), F.col("other").alias("to_name"))
    edges = resolve_calls(calls, symbols).withColumn("kind", F.lit("call")).union(resolve_imports(imports, symbols).withColumn("kind", F.lit("import")))
    return symbols, edges.toDF("src", "dst", "kind")


def graph_rows(edges: DataFrame, symbols: DataFrame, seeds: DataFrame, direction: str = "both", depth: int | None = None, limit: int | None = None) -> DataFrame:
    """(id, name, file, line, depth, edge_type, ambiguous): `expand` over the call edges (src, dst, kind), in the order of depth, file, line and id, the first `limit` rows.

    ambiguous tells targets that a caller reaches by a name it shares with others; seeds are never flagged.
    """
    calls = materialize(edges.where("kind = 'call'").select("src", "dst").distinct(), "calls")
    got = expand(calls, seeds, direction, depth).join(symbols.select("id", "name", "file", F.col("start_line").alias("line")), "id")
    many = ambiguous(calls, symbols.select("id", "name")).withColumn("_many", F.lit(True))
    flagged = got.join(many, "id", "left").select("id", "name", "file", "line", "depth", F.col("label").alias("edge_type"), ((F.col("depth") > 0) & F.coalesce("_many", F.lit(False))).alias("ambiguous"))
    return flagged.orderBy("depth", "file", "line", "id").limit(clamp(limit, DEFAULT_ROWS, MAX_ROWS))


def lookup_symbol(symbols: DataFrame, project: str, name: str, repo: str | None = None, limit: int | None = None) -> DataFrame:
    """(name, kind, file, line): the symbols of exactly that name in a project, in the order of file and line."""
    own = symbols.where((F.col("project") == project) & (F.col("name") == name))
    own = own if repo is None else own.where(F.col("repo") == repo)
    return own.select("name", "kind", "file", F.col("start_line").alias("line")).orderBy("file", "line", "kind").limit(clamp(limit, DEFAULT_ROWS, MAX_ROWS))


def resolve_seed(symbols: DataFrame, project: str, symbol_id: str | None = None, name: str | None = None, file: str | None = None, line: int | None = None, chunk_id: str | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """Seed symbols (id, project, file, name, start_line) by id, else by name, else by chunk, else by file and line; all within the project.

    A chunk (id, project, file, start_line) stands for its file and first line.
    """
    if symbol_id is None and name is None and chunk_id is not None and chunks is not None:
        at = chunks.where((F.col("id") == chunk_id) & (F.col("project") == project)).select("file", "start_line").first()
        if at is None:
            return symbols.where(F.lit(False))
        file, line = at["file"], at["start_line"]
    own = symbols.where(F.col("project") == project)
    if symbol_id is not None:
        return own.where(F.col("id") == symbol_id)
    if name is not None:
        return own.where(F.col("name") == name)
    if file is None:
        return own.where(F.lit(False))
    here = own.where(F.col("file") == file)
    if line is None:
        return here
    above = here.where(F.col("start_line") <= line).orderBy(F.desc("start_line"), "id").limit(1)
    return above if not above.isEmpty() else here.orderBy("start_line", "id").limit(1)
