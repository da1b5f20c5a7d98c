"""Writes that take several steps: stores with decisions and neighbour flags, summaries, contextual vectors, resumable consolidation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from . import dedup
from .filters import live
from .snapshot import store

#: States of a decision, characters of a text that is summarised, files and chunks of a contextual request.
DECISION_STATES = ("active", "superseded", "deferred")
SUMMARY_INPUT_CHARS, CONTEXT_FILES, CONTEXT_CHUNKS = 8000, 100, 8000


def check_decisions(new: DataFrame, states: tuple[str, ...] = DECISION_STATES) -> DataFrame:
    """Rows of new that may not be stored, with a reason: decision fields on rows of another kind, or a state that there is none of."""
    decision = F.col("source_kind").eqNullSafe("decision")
    odd = ~decision & (F.col("decision_status").isNotNull() | F.col("supersedes_id").isNotNull())
    bad = decision & F.col("decision_status").isNotNull() & ~F.col("decision_status").isin(*states)
    return new.select("id", F.when(odd, F.lit("decision fields on another kind")).when(bad, F.lit("unknown decision status")).alias("reason")).where("reason is not null")


def store_decisions(rows: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """The snapshot after `new` (id, project_id, source_kind, content, decision_status, supersedes_id, ...) is stored.

    As `snapshot.store`; besides, a decision without a state is active and decided now, and what it supersedes gets the
    state superseded and a pointer to it: only a decision of the same project does, others are left as they are. Of
    several that supersede one the least id counts. Raises ValueError if a row may not be stored.
    """
    wrong = check_decisions(new).orderBy("id").first()
    if wrong:
        raise ValueError(f"{wrong['id']}: {wrong['reason']}")
    decision = F.col("source_kind").eqNullSafe("decision")
    full = new.withColumns({"decision_status": F.when(decision, F.coalesce("decision_status", F.lit("active"))), "decided_at": F.when(decision, F.lit(now).cast("timestamp")), "supersedes_id": F.when(decision, F.col("supersedes_id"))})
    after = store(rows, full)
    took = full.where(F.col("supersedes_id").isNotNull()).groupBy(F.col("supersedes_id").alias("id"), "project_id").agg(F.min("id").alias("_by"))
    both = after.join(took, ["id", "project_id"], "left")
    hit = F.col("_by").isNotNull() & decision
    put = {"decision_status": F.when(hit, F.lit("superseded")).otherwise(F.col("decision_status")), "superseded_by": F.when(hit, F.col("_by")).otherwise(F.col("superseded_by"))}
    return both.select(*[put.get(c, F.col(c)).alias(c) for c in after.columns])


def neighbour_flags(rows: DataFrame, new: DataFrame, threshold: float = dedup.DUP_COSINE, top: int = dedup.TOP_S) -> DataFrame:
    """(id, flags): for each row of new its nearest live rows of the same project over the threshold, as `dedup.flags` writes them. Both have (id, project_id, embedding)."""
    old = rows.where(live()).select("id", "project_id", "embedding")
    both = old.withColumn("_new", F.lit(False)).union(new.select("id", "project_id", "embedding").withColumn("_new", F.lit(True)))
    near = dedup.near_vectors(both, "id", "embedding", threshold, None)
    side = both.select("id", "project_id", "_new")
    pairs = near.join(side.where("_new").select("id", "project_id"), "id").join(side.where("not _new").select(F.col("id").alias("near_id"), "project_id"), ["near_id", "project_id"])
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "near_id")
    return dedup.flags(pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).select("id", "near_id", "cosine"))


def summarized(df: DataFrame, id_col: str, title_col: str, content_col: str, summarize: Callable[[str, str], str | None], enabled: bool = True) -> DataFrame:
    """(id, summary) by a model: null where it is not enabled, fails or gives nothing but white space; a failure never fails the rest."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[str | None] = []
            for title, content in zip(b[title_col], b[content_col]):
                try:
                    got = summarize(title or "", (content or "")[:SUMMARY_INPUT_CHARS]) if enabled else None
                    out.append((got or "").strip() or None)
                except Exception:
                    out.append(None)
            yield pd.DataFrame({id_col: b[id_col], "summary": pd.Series(out, dtype=object)})

    return df.select(id_col, title_col, content_col).mapInPandas(run, f"`{id_col}` {kind}, summary string")


def backfill_summaries(rows: DataFrame, summarize: Callable[[str, str], str | None]) -> tuple[DataFrame, DataFrame]:
    """(rows after, report (processed, skipped)): live rows without a summary get one; those the model fails on stay as they are."""
    pending = rows.where(live() & F.col("summary").isNull())
    got = materialize(summarized(pending, "id", "title", "content", summarize), "summaries")
    both = rows.join(got.withColumnRenamed("summary", "_new"), "id", "left")
    after = both.select(*[F.coalesce("_new", "summary").alias("summary") if c == "summary" else F.col(c) for c in rows.columns])
    return after, got.agg(F.count("summary").alias("processed"), F.count(F.when(F.col("summary").isNull(), 1)).alias("skipped"))


def contextual_requests(chunks: DataFrame, file_col: str, order_col: str, files: int | None = None, most: int | None = None) -> DataFrame:
    """(file, part, request): files gathered into requests of at most `files` files and `most` chunks; a file of more chunks goes in parts, each a request of its own.

    Files are dealt to groups by hash, so that a group, which one task reads, holds about ten requests; within a group
    they follow each other in order.
    """
    files, most = files or CONTEXT_FILES, most or CONTEXT_CHUNKS
    sizes = chunks.where(F.col(file_col).isNotNull()).groupBy(F.col(file_col).alias("file")).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.count(F.lit(1)).alias("f"), F.sum("n").alias("n")).first()
    groups = max(1, (total["f"] or 0) // (10 * files), (total["n"] or 0) // (10 * most))
    kind = sizes.schema["file"].dataType.simpleString()

    def gather(b: pd.DataFrame) -> pd.DataFrame:
        out, held, count, no = [], 0, 0, 0
        group = int(b["grp"].iloc[0])
        for t in b.sort_values("file").itertuples(index=False):
            if t.n > most:
                out += [(t.file, p, f"{group}-{t.file}-{p}") for p in range(-(-t.n // most))]
                continue
            if held == files or count + t.n > most:
                no, held, count = no + 1, 0, 0
            held, count = held + 1, count + t.n
            out.append((t.file, 0, f"{group}-{no}"))
        return pd.DataFrame(out, columns=["file", "part", "request"])

    dealt = sizes.withColumn("grp", F.pmod(F.xxhash64("file"), F.lit(groups)).cast("long"))
    return dealt.groupBy("grp").applyInPandas(gather, f"file {kind}, part int, request string")


def contextual_vectors(chunks: DataFrame, id_col: str, file_col: str, order_col: str, text_col: str, embed: Callable[[list[list[str]]], list[list[list[float]]]]) -> DataFrame:
    """(id, embedding): each chunk embedded among the others of its file, by requests of whole files: embed takes the texts of each file of a request, and gives as many vectors."""
    requests = materialize(contextual_requests(chunks, file_col, order_col), "requests")
    w = Window.partitionBy(file_col).orderBy(order_col, id_col)
    own = chunks.where(F.col(file_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(file_col).alias("file"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.row_number().over(w) - 1).alias("place"))
    own = own.withColumn("part", F.floor(F.col("place") / CONTEXT_CHUNKS).cast("int")).join(requests, ["file", "part"])
    kind = own.schema["id"].dataType.simpleString()

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["file", "place"])
        docs = [g for _, g in b.groupby("file", sort=False)]
        got = embed([g["text"].tolist() for g in docs])
        return pd.DataFrame({"id": [i for g in docs for i in g["id"]], "embedding": [v for vs in got for v in vs]})

    return own.groupBy("request").applyInPandas(run, f"id {kind}, embedding array<float>")


def _sequence() -> Column:
    """The order of `dedup.priority` as a string."""
    apart = F.lpad(F.round((2 - F.col("sim")) * 1_000_000).cast("long").cast("string"), 9, "0")
    return F.concat_ws("-", F.when(F.col("source") == "sweep", F.lit("1")).otherwise(F.lit("0")), apart, "a", "b")


def consolidate(rows: DataFrame, pairs: DataFrame, judge: Callable[[list[tuple[str, str]]], str], carried: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """The report of a run: (seq, a, b, sim, source, verdict, keep, carried) for pairs (a, b, sim, source) of rows, most pressing first.

    carried: the report of an earlier run. What it has judged is taken over and not judged again, what it left unjudged
    enters anew, once. `limit` bounds the pairs judged in this run; the others stay unjudged (verdict -1) for the next.
    """
    side = rows.select("id", dedup.judge_side(F.col("title"), F.col("summary"), F.col("content")).alias("side"), F.coalesce("pinned", F.lit(False)).alias("pinned"))
    want = pairs.select("a", "b", "sim", "source")
    done = None
    if carried is not None:
        done = carried.where("verdict >= 0").select("a", "b", "sim", "source", "verdict", "keep")
        again = carried.where("verdict < 0").select("a", "b", "sim", "source").join(want.select("a", "b"), ["a", "b"], "left_anti")
        want = want.unionByName(again).join(done.select("a", "b"), ["a", "b"], "left_anti")
    both = want.join(side.toDF("a", "side_a", "pinned_a"), "a").join(side.toDF("b", "side_b", "pinned_b"), "b")
    if limit is not None:
        now = materialize(both.orderBy(*dedup.priority()).limit(limit), "now")
        left = both.join(now.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "sim", "source", F.lit(-1).alias("verdict"), F.lit(None).cast("string").alias("keep"))
    else:
        now, left = both, None
    judged = materialize(dedup.judge_pairs(now, judge), "judged").select("a", "b", "sim", "source", "verdict", "keep")
    report = judged if left is None else judged.unionByName(left)
    report = report.withColumn("carried", F.lit(False))
    if done is not None:
        report = report.unionByName(done.withColumn("carried", F.lit(True)))
    return report.select(_sequence().alias("seq"), "a", "b", "sim", "source", "verdict", "keep", "carried")


def write_report(report: DataFrame, path: str, project: str) -> None:
    """A report as a checkpoint: pairs as JSON lines, with what made them; writing replaces an older one."""
    report.select("a", "b", "sim", "source", "verdict", "keep", F.lit(project).alias("project")).write.mode("overwrite").json(path)


def apply_report(rows: DataFrame, report: DataFrame, project: str | None = None) -> tuple[DataFrame, list[str]]:
    """(rows after, warnings): a report that was read again takes effect without being judged anew; the guards of `dedup.apply_judged` hold, so a stale one changes nothing it may not."""
    warnings = []
    if project is not None and "project" in report.columns:
        other = report.where(F.col("project") != project).select("project").first()
        if other:
            warnings.append(f"the report is of project {other['project']}, not {project}")
    return dedup.apply_judged(rows, report.select(_sequence().alias("seq"), "a", "b", "verdict", "keep")), warnings


def cli_action(apply: bool, report: bool, resume: bool) -> str:
    """What a run does by its switches: 'apply' (judge and apply), 'apply-report', 'resume' or 'dry-run'. A report can't be resumed and applied at once."""
    if report and resume:
        raise ValueError("a report is applied or resumed, not both")
    return "apply-report" if apply and report else "resume" if resume else "apply" if apply else "dry-run"


def write_candidates(rows: DataFrame, path: str, label: str) -> int:
    """Rows proposed for an evaluation set, as JSON lines with a label and unapproved; returns their number. For a set that people review."""
    out = rows.withColumns({"provenance": F.lit(label), "approved_by": F.lit(None).cast("string")})
    out.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return out.count()

