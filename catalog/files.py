"""Files derived from the driver's tables, written once per session to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from termweave.plans.cut import ensure_checkpoint_dir

_WRITTEN: dict[tuple[str, str], str] = {}


def written(spark, key: str, write) -> str:
    """Folder that `write(folder)` filled, once per session and key."""
    slot = (spark.sparkContext.applicationId, key)
    if slot not in _WRITTEN:
        folder = f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
        write(folder)
        _WRITTEN[slot] = folder
    return _WRITTEN[slot]


def text_files(spark, key: str, lines: DataFrame) -> str:
    """`lines` has (doc, ord, text): one folder `doc=…` per document, lines in order."""
    def write(folder: str) -> None:
        (lines.repartition("doc").sortWithinPartitions("doc", "ord").select("doc", "text")
         .write.partitionBy("doc").text(folder))
    return written(spark, key, write)
