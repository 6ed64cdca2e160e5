"""Intermediate tables in the shared folder, and reading of the given tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`, which driver and executors share. Where it is
    unset a temporary one is made, in local mode only; elsewhere that is an error."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="termweave-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder, remembered for `drop_written`."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(frame: DataFrame) -> DataFrame:
    """The rows, computed once and read back from the shared folder: lineage ends here, and a
    lost executor costs a re-read only."""
    path = new_path(frame.sparkSession, "table")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def drop_written(spark: SparkSession, keep: int = 0) -> int:
    """Delete the tables written so far in this session but for the first `keep`; for callers
    that have written out what they computed from them."""
    gone = _WRITTEN.get(spark.sparkContext.applicationId, [])[keep:]
    for path in gone:
        drop_path(spark, path)
    return len(gone)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what lies at a path made by `new_path`."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    if path in paths:
        paths.remove(path)


def written_count(spark: SparkSession) -> int:
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that gives memory back to the system when a task ends: Python workers
    stay for later tasks, and beside those of another step they would hold it for nothing."""
    def through(batches: Iterator) -> Iterator:
        yield from run(batches)
        import ctypes

        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return through


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: list[str], *stems: str) -> list[str]:
    """Column names that a table does not have, one for each stem."""
    out = []
    for stem in stems:
        while stem in columns:
            stem += "_"
        out.append(stem)
    return out


def boxed(docs: DataFrame, *names: str) -> DataFrame:
    """All columns of a row as one struct, `row_`, beside the columns an operator reads: its own
    columns then clash with none that the table happens to have."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), *[F.col(f"`{n}`") for n in names])


def unboxed(frame: DataFrame, columns: list[str]) -> DataFrame:
    return frame.select(*[F.col("row_").getField(c).alias(c) for c in columns])
