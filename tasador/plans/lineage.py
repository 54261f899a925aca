"""Materialise intermediate tables where every executor can read them again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_owned: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own: on a cluster a
    machine-local folder is lost with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tasador-"))
    return spark.sparkContext.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has used before."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _owned:
        _owned[-1].append(path)
    return path


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def path_exists(spark: SparkSession, path: str) -> bool:
    files, found = _files(spark, path)
    return files.exists(found)


def stored_bytes(spark: SparkSession, path: str) -> int:
    files, found = _files(spark, path)
    return files.getContentSummary(found).getLength()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Own the intermediate tables written inside, and remove them at the end.

    Results must be written out inside: a lazy result would find its inputs gone.
    """
    own: list[str] = []
    _owned.append(own)
    try:
        yield
    finally:
        _owned.remove(own)
        for path in own:
            files, found = _files(spark, path)
            files.delete(found, True)


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result survives lost executors, is computed once however often it is
    used, and gives the planner true sizes to choose joins by.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_measured(df: DataFrame, label: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``cut_lineage`` that also returns aggregates of the rows, taken while they are written.

    The size of the written table is added as ``bytes``.
    """
    seen = Observation()
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.observe(seen, *[m.alias(name) for name, m in measures.items()]).write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    return written, {**seen.get, "bytes": stored_bytes(spark, path)}
