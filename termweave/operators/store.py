"""Keeping the index up to date: merging entries, replacing, removing and listing sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave import model as M
from termweave.functions.ident import id_kind
from termweave.functions.lang import language_key
from termweave.model import SOURCE_KEY, Index
from termweave.operators.versions import create_index, load_index, save_index, update_stored  # noqa: F401
from termweave.plans.cut import cut
from termweave.plans.ordered import running_number
from termweave.sources.readers import kinds_of, list_files, read_files

SEQ_BITS = 12
TABLES = ["sources", "entities", "attributes", "prefixes"]
SCHEMAS = {"sources": M.SOURCES_SCHEMA, "entities": M.ENTITIES_SCHEMA,
           "attributes": M.ATTRIBUTES_SCHEMA, "prefixes": M.PREFIXES_SCHEMA,
           "global_prefixes": M.GLOBALS_SCHEMA}


def coalesce_entries(rows: DataFrame, keys: list[str] | None = None,
                     prefs: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Long rows to (entities, attributes), one entity per id (and `keys`).

    The first non-empty label stands unless the id has label rows; then the preferred
    language decides. All choices are aggregates, so an id repeated a billion times
    costs one row per task.
    """
    on = keys or []
    place = F.struct("ord", "seq")
    filled = F.when(F.coalesce("label", F.lit("")) != "", place)
    labelled = F.when(F.col("prop") == "rdfs:label", language_key(F.col("lang"), place, prefs))
    merged = rows.groupBy(*on, "id").agg(
        F.coalesce(F.min_by("value", labelled), F.min_by("label", filled),
                   F.min_by("label", place)).alias("label"))
    entities = merged.withColumn("kind", id_kind(F.col("id")))
    attributes = rows.where("prop IS NOT NULL").select(
        *on, "id", "prop", "value", F.coalesce("lang", F.lit("")).alias("lang"),
        (F.col("ord") * (1 << SEQ_BITS) + F.col("seq")).alias("ord"))
    return entities, attributes


def source_batch(rows: DataFrame, kind: str, mtimes: DataFrame, now: Column,
                 prefixes: DataFrame | None = None, prefs: list[str] | None = None) -> Index:
    """New content of many sources from long rows keyed by (source, data_source).

    `mtimes` has (source, data_source, last_modified) of every source to replace, also of
    those that turned out empty; its column `type`, if any, stands before `kind`.
    """
    entities, attributes = coalesce_entries(rows, SOURCE_KEY, prefs)
    spark = rows.sparkSession
    return Index(
        sources=mtimes.select(*SOURCE_KEY, (F.col("type") if "type" in mtimes.columns
                                            else F.lit(kind)).alias("type"), "last_modified",
                              now.cast("double").alias("last_updated")),
        entities=_conform(entities, "entities"),
        attributes=_conform(attributes, "attributes"),
        prefixes=_conform(prefixes, "prefixes") if prefixes is not None
        else spark.createDataFrame([], M.PREFIXES_SCHEMA),
        global_prefixes=spark.createDataFrame([], M.GLOBALS_SCHEMA))


def _conform(frame: DataFrame, table: str) -> DataFrame:
    names = [c.split()[0] for c in SCHEMAS[table].split(", ")]
    return frame.select(*names)


def replace_sources(index: Index, batch: Index) -> Index:
    """Full replacement of the batch's sources; other sources stay as they are."""
    gone = batch.sources.select(SOURCE_KEY)

    def merged(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(gone, SOURCE_KEY, "left_anti").unionByName(new.select(*old.columns))

    return Index(*[merged(getattr(index, t), getattr(batch, t)) for t in TABLES],
                 index.global_prefixes)


def like_literal(col: str, pattern: str) -> Column:
    """LIKE without an escape character and without regard to case."""
    return F.ilike(F.col(col), F.lit(pattern.replace("\\", "\\\\")))


def matching_sources(sources: DataFrame, source: str, data_source: str | None = None,
                     like: bool = False, allow_all: bool = False) -> DataFrame:
    if not like:
        return sources.where((F.col("source") == source)
                             & (F.col("data_source") == (data_source or "")))
    if source in ("", "%") and not allow_all:
        raise ValueError("refusing to match every source without allow_all")
    return sources.where(like_literal("source", source)
                         & like_literal("data_source", "%" if data_source is None else data_source))


def remove_sources(index: Index, source: str, data_source: str | None = None, like: bool = False,
                   allow_all: bool = False) -> tuple[Index, DataFrame]:
    """The index without the matching sources, and the source rows that go (the preview)."""
    gone = matching_sources(index.sources, source, data_source, like, allow_all)
    key = gone.select(SOURCE_KEY)
    left = [getattr(index, t).join(key, SOURCE_KEY, "left_anti") for t in TABLES]
    return Index(*left, index.global_prefixes), gone


def list_sources(index: Index) -> DataFrame:
    counts = index.entities.groupBy(SOURCE_KEY).agg(F.count(F.lit(1)).alias("entities"))
    return index.sources.join(counts, SOURCE_KEY, "left").withColumn(
        "entities", F.coalesce("entities", F.lit(0).cast("long")))


def needs_update(listing: DataFrame, sources: DataFrame) -> DataFrame:
    """`stale` per listed (source, data_source, mtime): unknown or modified since indexing."""
    known = sources.select(*SOURCE_KEY, "last_modified")
    return listing.join(known, SOURCE_KEY, "left").withColumn(
        "stale", F.when(F.col("last_modified").isNull(), True)
        .when(F.col("mtime").isNull(), False)
        .otherwise(F.col("mtime") > F.col("last_modified")))


def add_prefixes(prefixes: DataFrame, new: DataFrame, keys: list[str],
                 overwrite: bool = True) -> DataFrame:
    """Upsert by key; `overwrite=False` keeps what is there. New rows may repeat a key (`pos`)."""
    latest = new.groupBy(*keys).agg(F.max_by("expansion", "pos").alias("expansion"))
    if overwrite:
        kept = prefixes.join(latest.select(keys), keys, "left_anti")
        return kept.select(*keys, "expansion").unionByName(latest)
    return prefixes.select(*keys, "expansion").unionByName(
        latest.join(prefixes.select(keys), keys, "left_anti"))


def remove_prefix(prefixes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefix rows without those of `gone`, and `gone` with a flag whether it existed."""
    key = [*SOURCE_KEY, "prefix"]
    left = prefixes.join(gone.select(key), key, "left_anti")
    report = gone.select(key).join(prefixes.select(*key, F.lit(True).alias("existed")), key, "left")
    return left, report.withColumn("existed", F.coalesce("existed", F.lit(False)))


def canonical_dump(index: Index) -> DataFrame:
    """(line, tbl, json): every row as key-sorted JSON without times, in the order of table and
    text, for golden comparison; `sinks.write_lines` keeps the order in files."""
    frames = []
    for table in TABLES:
        frame = getattr(index, table)
        cols = sorted(c for c in frame.columns if c not in ("ord", "last_modified", "last_updated"))
        frames.append(frame.select(F.lit(table).alias("tbl"), F.to_json(
            F.struct(*cols), {"ignoreNullFields": "false"}).alias("json")))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return running_number(out, [], "tbl", "line", ties=["json"]).select("line", "tbl", "json")


# --- registering ---------------------------------------------------------------------

def register_files(spark: SparkSession, path: str, listing: DataFrame, rows: DataFrame, kind: str,
                   now: Column, force: bool = False, prefixes: DataFrame | None = None) -> DataFrame:
    """Index the stale sources of a listing in one job; (source, status, entities) of all.

    `listing` has (source, data_source, mtime), `rows` long rows of the listed sources. The
    rows of fresh sources are filtered out before any work is done on them.
    """
    index = load_index(spark, path)
    state = needs_update(listing, index.sources)
    if force:
        state = state.withColumn("stale", F.lit(True))
    state = cut(state)
    stale = state.where("stale")
    mtimes = stale.select(*SOURCE_KEY, F.coalesce("mtime", now.cast("double")).alias("last_modified"))
    batch = source_batch(rows.join(stale.select(SOURCE_KEY), SOURCE_KEY, "left_semi"), kind, mtimes,
                         now, None if prefixes is None else prefixes.join(
                             stale.select(SOURCE_KEY), SOURCE_KEY, "left_semi"))
    update_stored(spark, path, batch)
    counts = list_sources(load_index(spark, path)).select(*SOURCE_KEY, "entities")
    status = F.when(~F.col("stale"), "up to date").when(
        F.col("last_modified").isNull(), "registered").otherwise("refreshed")
    return state.join(counts, SOURCE_KEY, "left").select(
        *SOURCE_KEY, status.alias("status"), F.coalesce("entities", F.lit(0).cast("long")).alias("entities"))


def register_folder(spark: SparkSession, path: str, folder: str, readers: dict | None = None,
                    force: bool = False) -> DataFrame:
    """Index a folder's new and modified files; (source, status, entities, error) of all its files.
    See `register_listing`."""
    return register_listing(spark, path, list_files(spark, folder), readers, force)


def register_listing(spark: SparkSession, path: str, files: DataFrame, readers: dict | None = None,
                     force: bool = False, commit: str | None = None) -> DataFrame:
    """Index the new and modified files of a listing (doc, path, mtime, ext).

    Only stale files are read, one reader call per extension; the driver sees their paths. A file
    without a reader, or one that its reader finds damaged, is `failed` with the error and keeps
    the rows it had; the others go on. `force` reads all. Prefixes come with the rows.
    """
    known = kinds_of(readers)
    now = F.unix_timestamp()
    files = files.withColumnRenamed("doc", "source").withColumn("data_source", F.lit(""))
    state = needs_update(files, load_index(spark, path).sources)
    if force:
        state = state.withColumn("stale", F.lit(True))
    state = cut(state.withColumn("readable", F.col("ext").isin(list(known))))
    due = state.where("stale AND readable")
    by_ext: dict[str, list[str]] = {}
    for row in due.select("ext", "path").toLocalIterator():
        by_ext.setdefault(row.ext, []).append(row.path)
    listing = state.where("stale").select(F.col("source").alias("doc"), "ext")
    found = read_files(spark, listing, {ext: (paths, None) for ext, paths in by_ext.items()}, readers)
    errors = cut(found.errors.select(F.col("doc").alias("source"), "error"))
    if found.rows is not None:
        def keyed(frame: DataFrame) -> DataFrame:
            return frame.withColumnRenamed("doc", "source").withColumn("data_source", F.lit(""))

        mtimes = due.join(errors, "source", "left_anti").select(
            *SOURCE_KEY, F.col("ext").alias("type"), F.col("mtime").alias("last_modified"))
        update_stored(spark, path, source_batch(
            keyed(found.rows), "file", mtimes, now, keyed(found.prefixes) if found.prefixes is not None else None), commit)
    counts = list_sources(load_index(spark, path)).select(*SOURCE_KEY, "entities")
    status = (F.when(F.col("error").isNotNull(), "failed").when(~F.col("stale"), "up to date")
              .when(F.col("last_modified").isNull(), "registered").otherwise("refreshed"))
    return state.join(errors, "source", "left").join(counts, SOURCE_KEY, "left").select(
        "source", status.alias("status"), F.coalesce("entities", F.lit(0).cast("long")).alias("entities"), "error")


def refresh_report(statuses: DataFrame, errors: DataFrame) -> DataFrame:
    """(status, n): how many sources went well and how many failed."""
    done = statuses.select("status").unionByName(errors.select(F.lit("failed").alias("status")))
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
