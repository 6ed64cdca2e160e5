"""Continuous indexing of new files, and results kept while their inputs have not changed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termweave.model import SOURCE_KEY
from termweave.operators.store import load_index, register_listing, source_batch, update_stored
from termweave.plans import files
from termweave.plans.cut import cut
from termweave.sources.readers import listed_files


def latest_versions(rows: DataFrame) -> DataFrame:
    """Rows of each source's newest version. `version` orders versions of a source. The versions
    are a written table: while they are few, no row is shuffled to the task of its source."""
    newest = cut(rows.groupBy(SOURCE_KEY).agg(F.max("version").alias("version")))
    return rows.join(newest, [*SOURCE_KEY, "version"], "left_semi")


def _commit(checkpoint: str, batch_id: int) -> str:
    """The name under which a batch of a stream is stored, the same when it is replayed."""
    return f"stream-{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}-{batch_id}"


def _started(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None) -> StreamingQuery:
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def index_stream(rows: DataFrame, store_path: str, checkpoint: str, kind: str = "stream",
                 now: Callable[[], Column] = F.current_timestamp, interval: str | None = None) -> StreamingQuery:
    """Keep a stored index up to date from a stream of long rows.

    `rows` streams (source, data_source, version, <long row>). A version newer than the stored
    one replaces its source; rows of the stored version are added to it, so a version may come
    in several batches; an older one is left out. A batch is one version of the stored index: one
    that fails leaves the index as it was and is made again as a whole, and one that was stored
    before the stream noted it is not stored twice. Without `interval` (such as "1 minute") what
    is there now is read and the stream ends.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = cut(latest_versions(batch))
        stored = load_index(spark, store_path)
        known = stored.sources.select(*SOURCE_KEY, "last_modified")
        due = cut(newest.groupBy(SOURCE_KEY).agg(F.max("version").cast("double").alias("mtime"))
                  .join(known, SOURCE_KEY, "left").where("last_modified IS NULL OR mtime >= last_modified")
                  .select(*SOURCE_KEY, F.col("mtime").alias("last_modified"),
                          F.coalesce(F.col("mtime") == F.col("last_modified"), F.lit(False)).alias("_same")))
        kept = newest.join(due.select(SOURCE_KEY), SOURCE_KEY, "left_semi").drop("version")
        new = source_batch(kept, kind, due.drop("_same"), now().cast("double"))
        same = due.where("_same").select(SOURCE_KEY)

        def grown(table: str, keys: list[str] | None) -> DataFrame:
            fresh = getattr(new, table)
            old = getattr(stored, table).select(*fresh.columns).join(same, SOURCE_KEY, "left_semi")
            if keys is None:
                return old.unionByName(fresh).distinct()
            return old.unionByName(fresh.join(old.select(keys), keys, "left_anti"))

        update_stored(spark, store_path, replace(
            new, entities=grown("entities", [*SOURCE_KEY, "id"]),
            attributes=grown("attributes", None), prefixes=grown("prefixes", None)), _commit(checkpoint, batch_id))

    return _started(rows, apply, checkpoint, interval)


def index_files(spark: SparkSession, folder: str, store_path: str, checkpoint: str, readers: dict | None = None,
                per_trigger: int = 1000, interval: str | None = None) -> StreamingQuery:
    """Keep a stored index up to date from the files that arrive in a folder, of every kind a
    folder can be registered with: `register_listing` of each batch of new files. The stream
    itself reads names and times only."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = (spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
             .option("maxFilesPerTrigger", per_trigger).load(folder))

    def apply(batch: DataFrame, batch_id: int) -> None:
        register_listing(batch.sparkSession, store_path, cut(batch), readers, commit=_commit(checkpoint, batch_id))

    return _started(listed_files(found), apply, checkpoint, interval)


# --- results that follow their inputs -----------------------------------------------

STATE = "query string, inputs string"


def input_versions(index_sources: DataFrame) -> DataFrame:
    """(inputs): one text that changes when a source comes, goes or is modified."""
    marks = F.xxhash64("source", "data_source", "last_modified")
    facts = F.concat_ws(":", F.count("*").cast("string"), F.bit_xor(marks).cast("string"),
                        F.sum(F.pmod(marks, F.lit(1 << 30))).cast("string"))
    return index_sources.agg(F.coalesce(facts, F.lit("")).alias("inputs"))


def incremental_results(spark: SparkSession, path: str, queries: dict[str, tuple[DataFrame, Callable[[], DataFrame]]],
                        ) -> tuple[dict[str, DataFrame], DataFrame]:
    """The results of queries by name, and (query, status, error) of this run.

    `queries` gives each one's input table of sources (source, data_source, last_modified) and
    how it is computed. With a result its input versions are stored under `path`; a query runs
    again only when they have changed: a join of stored and current versions tells, not the
    caller. One that fails or is empty keeps its old rows and stays due, and the others go on.
    """
    now = _union([input_versions(sources).select(F.lit(name).alias("query"), "inputs") for name, (sources, _) in queries.items()])
    done = [p for p in files.matching(spark, f"{path}/state/*") if files.exists(spark, f"{p}/_SUCCESS")]
    before = _union([spark.read.schema(STATE + ", run long").parquet(p) for p in done]) if done else (
        spark.createDataFrame([], STATE + ", run long"))
    last = before.groupBy("query").agg(F.max_by("inputs", "run").alias("_inputs"), F.max("run").alias("run"))
    state = {r["query"]: r for r in now.join(last, "query", "left").withColumn(
        "due", ~F.col("inputs").eqNullSafe(F.col("_inputs"))).collect()}  # a row per query
    results, report = {}, []
    for name, (_sources, compute) in queries.items():
        run, status, error = state[name]["run"], "current", None
        if state[name]["due"]:
            new = (run or 0) + 1
            try:
                compute().write.mode("overwrite").parquet(f"{path}/rows/{name}/{new}")
                empty = spark.read.parquet(f"{path}/rows/{name}/{new}").isEmpty()
                status = "empty" if empty else "computed"
                if not empty:
                    spark.createDataFrame([(name, state[name]["inputs"], new)], STATE + ", run long").coalesce(1).write.mode(
                        "overwrite").parquet(f"{path}/state/{name}-{new}")
                    run = new
            except Exception as e:  # noqa: BLE001 whatever a query raises, the others go on
                status, error = "failed", f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
        if run is not None:
            results[name] = spark.read.parquet(f"{path}/rows/{name}/{run}")
        report.append((name, status, error))
    return results, spark.createDataFrame(report, "query string, status string, error string")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
