"""Source trees, evaluation files, transcripts and run artefacts."""

from __future__ import annotations

import datetime as dt
import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Languages by extension, directories that are passed over, patterns ignored besides those of the tree, bytes of the largest file.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java",
    "rb": "ruby", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "sql": "sql", "sh": "bash", "md": "markdown",
    "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "css": "css", "scss": "scss", "html": "html", "vue": "vue", "svelte": "svelte", "astro": "astro",
}
SKIPPED_DIRS = ["node_modules", ".git", "dist", "build", ".next", ".turbo", ".cache", "coverage", "vendor", ".venv", "__pycache__", ".idea", ".vscode", ".nx", "out", ".svelte-kit"]
IGNORED = ["secrets/", "*.pem", "*.key", "*.min.js", "*.lock", "pnpm-lock.yaml", "package-lock.json"]
MAX_FILE_BYTES = 400_000
TRANSCRIPT_CHARS, LEAST_TRANSCRIPT = 24_000, 200


def language(path: Column) -> Column:
    """The language of a path by its extension, or null."""
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, ext)


def ignore_regex(patterns: list[str]) -> list[tuple[bool, str]]:
    """(negated, regex over the relative path) of ignore-file lines, in order; the last that matches decides."""
    out = []
    for line in patterns:
        p = line.rstrip("\n").rstrip()
        if not p or p.startswith("#"):
            continue
        negated = p.startswith("!")
        p = p[1:] if negated else p
        p = p[1:] if p.startswith("\\") else p
        only_dir = p.endswith("/")
        p = p.rstrip("/")
        rooted = "/" in p
        p = p.lstrip("/")
        body, i = "", 0
        while i < len(p):
            if p.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
            elif p.startswith("/**", i) and i + 3 == len(p):
                body, i = body + "/.+", i + 3
            elif p[i] == "*":
                body, i = body + "[^/]*", i + 1
            elif p[i] == "?":
                body, i = body + "[^/]", i + 1
            elif p[i] == "[" and "]" in p[i + 1 :]:
                j = p.index("]", i + 1)
                body, i = body + "[" + p[i + 1 : j].replace("!", "^", 1) + "]", j + 1
            else:
                body, i = body + re.escape(p[i]), i + 1
        out.append((negated, ("^" if rooted else "(?:^|/)") + body + ("/" if only_dir else "(?:/|$)")))
    return out


def ignored(path: Column, patterns: list[str]) -> Column:
    got: Column = F.lit(False)
    for negated, regex in ignore_regex(patterns):
        got = F.when(path.rlike(regex), F.lit(not negated)).otherwise(got)
    return got


def read_tree(spark: SparkSession, root: str, repository: str) -> DataFrame:
    """(repository_id, path, language, content, content_sha256, size) of the source files below a folder.

    Passed over are skipped directories, what .gitignore and .indexignore at the root and the fixed patterns name, files
    of no known language, empty ones and those over 400,000 bytes. Sizes and paths are tested before contents are read.
    """
    own = [p for name in (".gitignore", ".indexignore") if (f := Path(root) / name).is_file() for p in f.read_text(encoding="utf8", errors="replace").split("\n")]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = Path(root).resolve().as_uri().removeprefix("file://").rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(base) + "/", "")
    skip = "(?:^|/)(?:" + "|".join(map(re.escape, SKIPPED_DIRS)) + ")/"
    kept = raw.where((F.col("length") > 0) & (F.col("length") <= MAX_FILE_BYTES)).withColumn("path", rel).where(~F.col("path").rlike(skip)).withColumn("language", language(F.col("path"))).where(F.col("language").isNotNull() & ~ignored(F.col("path"), own + IGNORED))
    text = kept.withColumn("content", F.decode("content", "UTF-8"))
    return text.select(F.lit(repository).alias("repository_id"), "path", "language", "content", F.sha2("content", 256).alias("content_sha256"), F.col("length").alias("size"))


def read_gold(path: str, split: str | None = None, legacy: bool = False) -> list[dict]:
    """Rows of an evaluation file of version 2, checked: unique ids, a split of dev or test. Version 1 gives rows of dev if `legacy`, else none; others raise."""
    doc = json.loads(Path(path).read_text(encoding="utf8"))
    version = doc.get("version", 1) if isinstance(doc, dict) else 1
    rows = doc.get("rows", []) if isinstance(doc, dict) else doc
    if version == 1:
        rows = [{"split": "dev"} | r for r in rows] if legacy else []
    elif version != 2:
        raise ValueError(f"unknown version {version}")
    seen: set[str] = set()
    for r in rows:
        if version == 2 and (not isinstance(r.get("id"), str) or r["id"] in seen or r.get("split") not in ("dev", "test")):
            raise ValueError(f"bad row {r.get('id')!r}")
        seen.add(r.get("id"))
    return [r for r in rows if split is None or r["split"] == split]


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(file, transcript): messages of a JSONL file as 'role: text' lines, the last 24,000 characters; files whose whole text is shorter than 200 are left out.

    The content of a message is a string, or an array of blocks, of which those of type text count, one a line.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"), "value", F.from_json("value", "role string, content string, message struct<role:string,content:string>").alias("m"))
    said = raw.select("file", "n", F.coalesce("m.role", "m.message.role").alias("role"), F.coalesce("m.content", "m.message.content").alias("c"))
    blocks = F.filter(F.from_json("c", "array<struct<type:string,text:string>>"), lambda b: (b["type"] == "text") & b["text"].isNotNull())
    text = F.when(F.col("c").startswith("[{") & blocks.isNotNull(), F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")).otherwise(F.col("c"))
    said = said.select("file", "n", "role", text.alias("text")).where("role is not null and text <> ''")
    per = said.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("t"))
    return per.where(F.length("t") >= LEAST_TRANSCRIPT).select("file", F.expr(f"right(t, {TRANSCRIPT_CHARS})").alias("transcript"))


def write_artifact(folder: str, label: str, payload: dict, today: dt.date | None = None) -> str:
    """Write a run's JSON under a dated name; returns the path."""
    safe = re.sub(r"[^\w.-]+", "-", label)
    target = Path(folder) / f"{(today or dt.date.today()).isoformat()}-{safe}.json"
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(payload, indent=2, sort_keys=True), encoding="utf8")
    return str(target)


def read_artifact(path: str) -> dict:
    """A run's JSON, checked to hold its queries and aggregates."""
    doc = json.loads(Path(path).read_text(encoding="utf8"))
    if not isinstance(doc, dict) or not isinstance(doc.get("perQuery"), list) or not isinstance(doc.get("aggregates"), dict):
        raise ValueError(f"{path} is no run artefact")
    return doc


def append_log(rows: DataFrame, path: str) -> bool:
    """Append to a log; a failure is told by the result and never raised."""
    try:
        rows.write.mode("append").parquet(path)
        return True
    except Exception:
        return False


def read_lines(root: str, path: str, first: int = 1, last: int | None = None, window: int = 400, most: int = 90_000) -> str:
    """Numbered lines of a file below root; a path that leads out of it raises."""
    base = Path(root).resolve()
    full = (base / path).resolve()
    if not full.is_relative_to(base):
        raise ValueError("path leads out of the tree")
    lines = full.read_text(encoding="utf8", errors="replace").split("\n")
    first = max(first, 1)
    end = min(last if last is not None else first + window - 1, len(lines))
    return "\n".join(f"{n}\t{lines[n - 1]}" for n in range(first, end + 1))[:most]
