"""A training corpus from documents: identify, deduplicate, decontaminate, pack.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last
return the columns of `documents`.

1. language: documents whose language is not found go.
2. lines: passages that occur earlier are deleted; documents of which nothing is left go.
3. near duplicates: one document of each group stays.
4. decontamination: documents that hold a benchmark passage go.
5. packing: the token ids of the rest in sequences of bounded length.

The tables a stage writes for itself lie in the shared folder and are deleted when the next
stage begins, as its result is written by then.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from termweave.llm import decontamination, language, lines, packing, simhash
from termweave.llm.queries import tokenizer_path
from termweave.llm.tables import drop_written, shared_folder, table, written_count

_FIRST: dict[str, int] = {}
# Rows hold whole texts, so few of them go to a Python worker at a time.
BATCH = 1000


def _begin(spark: SparkSession, first: bool = False) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    app = spark.sparkContext.applicationId
    if first:
        _FIRST[app] = written_count(spark)
    elif app in _FIRST:
        drop_written(spark, _FIRST[app])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark, first=True)
    return language.keep_identified(docs)


def delete_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return lines.delete_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", identify_language), ("lines", delete_repeats), ("near_duplicates", drop_near_duplicates),
          ("decontamination", decontaminate), ("packing", pack)]

# Language scores and fingerprints are beyond SQL; tests compare the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    _begin(spark)
    return docs
