"""A stored index in versions: updates add files, and a small manifest says which of them count.

* `<path>/data/<table>/commit=<name>`  the rows one update wrote. They are never changed.
* `<path>/manifest/<n>`                version n: the live sources with their times and the
  commit that holds the rows of each, and the global prefixes.

An update writes the rows of its own sources and then the next manifest, whose sources come last.
A version counts once they are complete, so an update that dies leaves the version before, and
readers of a version are not disturbed by later ones. Sources that were replaced or removed keep
their rows in old commits until `compact` and `vacuum`; readers leave such rows out by a join
with the manifest, and only for commits of which a source has gone.

The driver sees version numbers and commits, never sources. One writer at a time: an update that
finds a version newer than the one it began from gives up.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave import constants as K
from termweave import model as M
from termweave.model import SOURCE_KEY, Index
from termweave.plans import files

ROW_TABLES = {"entities": M.ENTITIES_SCHEMA, "attributes": M.ATTRIBUTES_SCHEMA, "prefixes": M.PREFIXES_SCHEMA}
# `mates` is how many sources the commit was written with.
MANIFEST_SCHEMA = M.SOURCES_SCHEMA + ", commit string, mates long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _versions(spark: SparkSession, path: str, done: bool) -> list[int]:
    found = files.matching(spark, f"{path}/manifest/*" + ("/sources/_SUCCESS" if done else ""))
    return sorted(int(p.split("/manifest/")[1].split("/")[0]) for p in found)


def current_version(spark: SparkSession, path: str) -> int | None:
    """The newest complete version; None where nothing is stored."""
    return max(_versions(spark, path, done=True), default=None)


def _manifest(spark: SparkSession, path: str, version: int | None) -> DataFrame:
    if version is None:
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/manifest/{version}/sources")


def _globals(spark: SparkSession, path: str, version: int | None) -> DataFrame:
    if version is None:
        defaults = M.literal_table(spark, K.GLOBAL_PREFIXES, ["prefix", "expansion"])
        return defaults.withColumn("trust", F.lit(1))
    return spark.read.schema(M.GLOBALS_SCHEMA).parquet(f"{path}/manifest/{version}/global_prefixes")


def _publish(spark: SparkSession, path: str, base: int | None, manifest: DataFrame, global_prefixes: DataFrame) -> int:
    """Make the next version. What a dead update left under a number is stepped over."""
    if current_version(spark, path) != base:
        raise RuntimeError(f"another update of {path} came first; begin again from the current version")
    version = max(_versions(spark, path, done=False), default=0) + 1
    global_prefixes.select(*_names(M.GLOBALS_SCHEMA)).coalesce(1).write.parquet(f"{path}/manifest/{version}/global_prefixes")
    _manifest_written(manifest, f"{path}/manifest/{version}/sources")
    return version


def _manifest_written(manifest: DataFrame, path: str) -> None:
    manifest.select(*_names(MANIFEST_SCHEMA)).write.parquet(path)


def _write_rows(index: Index, path: str, commit: str) -> None:
    """Rows dealt to even tasks, and in the order of their source and id within files, so that scans can skip."""
    for table, schema in ROW_TABLES.items():
        _rows_written(getattr(index, table).select(*_names(schema)), path, table, commit)


def _rows_written(rows: DataFrame, path: str, table: str, commit: str) -> None:
    order = [c for c in (*SOURCE_KEY, "id") if c in rows.columns]
    # A task sorts a share of bounded size, however many rows a file or a source has.
    dealt = rows.hint("rebalance", *order, *[c for c in ["prefix"] if c in rows.columns])
    dealt.sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/data/{table}/commit={commit}")


def save_index(index: Index, path: str) -> None:
    """A version that holds exactly this index."""
    spark, commit = index.sources.sparkSession, uuid.uuid4().hex
    base = current_version(spark, path)
    _write_rows(index, path, commit)
    sources = index.sources.select(*_names(M.SOURCES_SCHEMA))
    stamped = sources.withColumns({"commit": F.lit(commit), "mates": F.lit(sources.count()).cast("long")})
    _publish(spark, path, base, stamped, index.global_prefixes)


def create_index(spark: SparkSession, path: str) -> None:
    """An empty stored index with the default global prefixes."""
    _publish(spark, path, current_version(spark, path), _manifest(spark, path, None), _globals(spark, path, None))


def load_index(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """The index as of a version, by default the newest."""
    version = current_version(spark, path) if version is None else version
    if version is None:
        raise FileNotFoundError(f"no index is stored at {path}")
    manifest = _manifest(spark, path, version)
    live = manifest.groupBy("commit").agg((F.count("*") == F.max("mates")).alias("whole")).collect()
    whole, partly = [r.commit for r in live if r.whole], [r.commit for r in live if not r.whole]
    held = manifest.where(F.col("commit").isin(partly)).select(*SOURCE_KEY, "commit")

    def read(table: str, commits: list[str]) -> DataFrame:
        schema, base = ROW_TABLES[table], f"{path}/data/{table}"
        if not commits:
            return spark.createDataFrame([], f"{schema}, commit string")
        return spark.read.schema(f"{schema}, commit string").option("basePath", base).parquet(
            *[f"{base}/commit={c}" for c in commits])

    def rows(table: str) -> DataFrame:
        out = read(table, whole)
        if partly:
            some = read(table, partly).join(held, [*SOURCE_KEY, "commit"], "left_semi").select(*out.columns)
            out = out.unionByName(some) if whole else some
        return out.select(*_names(ROW_TABLES[table]))

    return Index(manifest.select(*_names(M.SOURCES_SCHEMA)), rows("entities"), rows("attributes"), rows("prefixes"),
                 _globals(spark, path, version))


def update_stored(spark: SparkSession, path: str, batch: Index, commit: str | None = None) -> bool:
    """Replace the batch's sources in a stored index by the batch's rows; no others are written.

    With a `commit` name given, an update of that name which is there already is not made again;
    what an earlier attempt left unfinished under the name is overwritten. False if nothing
    was to do.
    """
    base = current_version(spark, path)
    manifest = _manifest(spark, path, base)
    if commit is not None and not manifest.where(F.col("commit") == commit).isEmpty():
        return False
    sources = batch.sources.select(*_names(M.SOURCES_SCHEMA)).dropDuplicates(SOURCE_KEY)
    mates = sources.count()
    if not mates:
        return False
    commit = commit or uuid.uuid4().hex
    _write_rows(batch, path, commit)
    kept = manifest.join(sources.select(SOURCE_KEY), SOURCE_KEY, "left_anti").select(*_names(MANIFEST_SCHEMA))
    new = sources.withColumns({"commit": F.lit(commit), "mates": F.lit(mates).cast("long")})
    _publish(spark, path, base, kept.unionByName(new), _globals(spark, path, base))
    return True


def remove_stored(spark: SparkSession, path: str, gone: DataFrame) -> None:
    """A version without the sources of `gone` (source, data_source). No rows are written."""
    base = current_version(spark, path)
    left = _manifest(spark, path, base).join(gone.select(SOURCE_KEY), SOURCE_KEY, "left_anti")
    _publish(spark, path, base, left, _globals(spark, path, base))


def compact(spark: SparkSession, path: str) -> None:
    """The same index written together anew, without rows that no longer count."""
    save_index(load_index(spark, path), path)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete versions but the last `keep` complete ones, and commits that no kept version names.

    To be run while no update runs, as it deletes what dead updates left as well.
    """
    kept = _versions(spark, path, done=True)[-keep:] if keep > 0 else []
    if not kept:
        raise ValueError("at least one version is kept")
    named = {r.commit for v in kept for r in _manifest(spark, path, v).select("commit").distinct().collect()}
    gone = [p for p in files.matching(spark, f"{path}/manifest/*") if int(p.rsplit("/", 1)[1]) not in kept]
    gone += [p for p in files.matching(spark, f"{path}/data/*/commit=*") if p.rsplit("commit=", 1)[1] not in named]
    for folder in gone:
        files.delete(spark, folder)
    return gone
