"""Ordered text files: written by many tasks, read back with their line numbers.

Rows are dealt by ranges of their line number, each task writes its range as one file, and files
are numbered in the order of the ranges. So the files in the order of their numbers are the whole,
however many there are, and a reader numbers their lines by running values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions.text import tsv_safe
from termweave.plans.ordered import running_number


def write_lines(lines: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Write `text` in the order of `line`, in a folder for each value of `keys`."""
    keys = keys or []
    order = [*keys, "line"]
    writer = lines.repartitionByRange(*order).sortWithinPartitions(*order).select(*keys, "text").write.mode("overwrite")
    (writer.partitionBy(*keys) if keys else writer).text(path)


def read_lines_back(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, line, text) of what `write_lines` wrote; lines count from 1 in each folder."""
    keys = keys or []
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    rows = spark.read.text(path).select(*keys, F.col("value").alias("text"), number.alias("_file"),
                                        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    return running_number(rows, keys, "_file", "line", ties=["_block", "_row"]).select(*keys, "line", "text")


def _numbered(frame: DataFrame, order: list[str], text: Column) -> DataFrame:
    rows = running_number(frame, [], order[0], "line", ties=order[1:])
    return rows.select("line", text.alias("text"))


def write_json(frame: DataFrame, path: str, order: list[str]) -> None:
    """A JSON object per row, columns in order of their names, NULL included."""
    write_lines(_numbered(frame, order, F.to_json(F.struct(*sorted(frame.columns)), {"ignoreNullFields": "false"})), path)


def write_tsv(frame: DataFrame, path: str, order: list[str]) -> None:
    """A line of column names, then a line per row; NULL is an empty cell."""
    cells = F.concat_ws("\t", *[tsv_safe(F.col(c).cast("string")) for c in frame.columns])
    head = frame.sparkSession.createDataFrame([(0, "\t".join(frame.columns))], "line long, text string")
    write_lines(head.unionByName(_numbered(frame, order, cells)), path)
