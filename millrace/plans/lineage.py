"""Cutting lineage with tables that every executor can read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a temporary one, but only in local mode:
    on a cluster the executors and the driver would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Paths of the tables that each open ``temporary`` block has made, the innermost block last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def stash(df: DataFrame, label: str = "step", file_rows: int = 0) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The result survives the loss of any executor, and its plan starts at a scan. Tables stay until the folder is cleared,
    ``release`` is called or the ``temporary`` block around this ends: a later plan may read them as long as its result is not written.
    file_rows: rows of a file at most, if not 0. For rows of megabytes, as a task holds up to 4,096 rows of a file at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    for made in _OPEN.get()[-1:]:
        made.append(path)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A block whose tables are deleted when it ends, also by an error. It gives a form of ``stash`` whose table stays: for the
    block's result, which has to be written by it, as nothing may read the others any more."""
    made: list[str] = []
    kept: list[str] = []
    before = _OPEN.get()
    token = _OPEN.set((*before, made))

    def keep(df: DataFrame, label: str = "result") -> DataFrame:
        out = stash(df, label)
        kept.append(made[-1])
        return out

    try:
        yield keep
    finally:
        _OPEN.reset(token)
        for outer in before[-1:]:
            outer.extend(kept)
        for path in made:
            if path not in kept:
                _delete(spark, path)


def release(df: DataFrame) -> None:
    """Delete a table made by ``stash`` that no plan reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
        if path.getParent() == folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder):
            _delete(spark, path.toString())
