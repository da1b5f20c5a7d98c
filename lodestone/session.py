"""Session helpers: shipping the package, shared work tables, table loading."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_LOCAL_DIRS: dict[str, str] = {}
_SCOPES: list[list[DataFrame]] = []
_ENDING: set[str] = set()


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of a cluster (once per application)."""
    sc = spark.sparkContext
    if _is_local(spark) or sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: spark.checkpoint.dir. Only a local session (tests) may leave it unset and gets a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return _LOCAL_DIRS[sc.applicationId]


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def work_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one; Hadoop removes it when the application ends."""
    path = f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}"
    if path not in _ENDING:
        fs, p = _hadoop(spark, path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _ENDING.add(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and losing an executor costs nothing."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path  # type: ignore[attr-defined]
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete work tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_work_path", None)
        if path:
            fs, p = _hadoop(df.sparkSession, path)
            fs.delete(p, True)


@contextmanager
def workspace() -> Iterator[None]:
    """Work tables made within are deleted at its end: results must have been written or collected by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        discard(*_SCOPES.pop())


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release_shuffles(spark: SparkSession) -> None:
    """Nothing to do: Spark drops shuffle files that no plan refers to any more."""
