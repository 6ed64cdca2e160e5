"""Cutting lineage in loops, on storage that outlives an executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


_CUTS: dict[str, list[str]] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one in local mode only."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="termweave-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut(frame: DataFrame) -> DataFrame:
    """Write the rows once as a table in the shared folder and go on from there.

    Three gains over the lazy frame: it is computed once; its size is known, so the planner
    broadcasts it only while it is small; and a join with it shuffles plain rows on both
    sides, which is the shape adaptive execution can split when a key is hot.
    """
    spark = frame.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    _CUTS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(frame.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables `cut` wrote in this session, once results that read them are written."""
    paths = _CUTS.pop(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    return len(paths)


_STORED: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The frame as a table in the shared folder, written once per session and key.

    Readers get a plain scan: short plans, column pruning, pushed filters, known size.
    """
    slot = (spark.sparkContext.applicationId, key)
    if slot not in _STORED:
        path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
        build().write.parquet(path)
        _STORED[slot] = path
    return spark.read.parquet(_STORED[slot])

