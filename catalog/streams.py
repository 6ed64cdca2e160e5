"""Continuous indexing, driven by files derived from the driver's tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import query
from catalog.files import written
from catalog.store import doc_rows
from termweave.model import SOURCE_KEY
from termweave.operators import store as W
from termweave.plans.cut import ensure_checkpoint_dir
from termweave.sources import lift
from termweave.streaming import live


def versioned(spark, sf):
    """Two versions of every source, by turns of twenty documents."""
    return doc_rows(spark, sf).withColumn("version", F.floor(F.col("ord") / 20) % 2)


@query("latest_versions", """
WITH d AS (SELECT * FROM documents QUALIFY (doc_id // 20) % 2 = max((doc_id // 20) % 2) OVER (PARTITION BY source))
SELECT source, 'doc:' || (doc_id % 40) AS id, 'ex:chars' AS prop, CAST(n_chars AS VARCHAR) AS value, '' AS lang FROM d
UNION ALL SELECT source, 'doc:' || (doc_id % 40), 'rdfs:label', text, lang FROM d WHERE doc_id % 4 = 0""")
def latest_versions(spark, sf):
    return live.latest_versions(versioned(spark, sf)).select("source", "id", "prop", "value", "lang")


@query("index_stream", """
WITH d AS (SELECT source, 'doc:' || (doc_id % 40) AS id, n_chars, doc_id, text, lang FROM documents
  QUALIFY (doc_id // 20) % 2 = max((doc_id // 20) % 2) OVER (PARTITION BY source))
SELECT id, source, CAST(n_chars AS VARCHAR) AS value, doc_id * 4096 AS ord FROM d
UNION ALL SELECT id, source, text, doc_id * 4096 + 1 FROM d WHERE doc_id % 4 = 0""")
def index_stream(spark, sf):
    """Both versions arrive in two batches, over an index that holds an older state of every
    source; the stored index ends with the newest version of each, whole."""
    rows = versioned(spark, sf)
    # Half of the files are a batch; their number, not their size, grows with the input.
    half = max(1, rows.rdd.getNumPartitions())
    folder = written(spark, f"stream:{sf}", lambda f: rows.repartition(2 * half, "ord").write.parquet(f))
    base = ensure_checkpoint_dir(spark)
    path = f"{base}/index-{uuid.uuid4().hex}"
    older = rows.select(*SOURCE_KEY).distinct().withColumn("last_modified", F.lit(-1.0))
    first = rows.drop("version").withColumn("value", F.lit("outdated"))
    W.save_index(W.source_batch(first, "stream", older, F.lit(0.0)), path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", half).parquet(folder)
    live.index_stream(stream, path, f"{base}/stream-{uuid.uuid4().hex}").awaitTermination()
    return W.load_index(spark, path).attributes.select("id", "source", "value", "ord")


@query("incremental_results", """
SELECT 'nations' AS query, 'computed' AS first, 'current' AS second, n_name AS label FROM nation
UNION ALL SELECT 'parts', 'computed', 'computed', p_name || ' again' FROM part
UNION ALL SELECT 'regions', 'computed', 'failed', r_name FROM region
UNION ALL SELECT 'suppliers', 'computed', 'empty', s_name FROM supplier""")
def incremental_results(spark, sf):
    """Two runs. Between them the sources of three queries change: one gets new rows, one fails,
    one is empty; the fourth query's sources stay, so it does not run."""
    folder = f"{ensure_checkpoint_dir(spark)}/results-{uuid.uuid4().hex}"
    sources = lift.index(spark, sf).sources.select(*SOURCE_KEY, "last_modified")
    later = sources.withColumn("last_modified", F.col("last_modified") + 1)

    def labels(table, col):
        return lift.read(spark, sf, table).select(F.col(col).alias("label"))

    def must_not_run():
        raise AssertionError("its inputs have not changed")

    def fails():
        return labels("region", "r_name").withColumn("label", F.raise_error(F.lit("no such region")).cast("string"))

    first = {"nations": (sources, lambda: labels("nation", "n_name")), "parts": (sources, lambda: labels("part", "p_name")),
             "regions": (sources, lambda: labels("region", "r_name")), "suppliers": (sources, lambda: labels("supplier", "s_name"))}
    second = {"nations": (sources, must_not_run), "regions": (later, fails),
              "parts": (later, lambda: labels("part", "p_name").select(F.concat("label", F.lit(" again")).alias("label"))),
              "suppliers": (later, lambda: labels("supplier", "s_name").limit(0))}
    _rows, one = live.incremental_results(spark, folder, first)
    rows, two = live.incremental_results(spark, folder, second)
    report = one.select("query", F.col("status").alias("first")).join(two.select("query", F.col("status").alias("second")), "query")
    found = [frame.withColumn("query", F.lit(name)) for name, frame in rows.items()]
    return reduce(DataFrame.unionByName, found).join(report, "query").select("query", "first", "second", "label")
