"""Index maintenance queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import query
from catalog.files import written
from catalog.lift_sql import lang_key, lifted
from termweave.functions.text import tsv_safe
from termweave.model import Index
from termweave.operators import store as W
from termweave.operators import versions as V
from termweave.plans.cut import ensure_checkpoint_dir
from termweave.sources import lift, readers, sinks


def doc_rows(spark, sf):
    """Documents as long rows: id per source and number, label the whole text."""
    head = F.col("text")
    docs = lift.read(spark, sf, "documents")
    key = F.col("doc_id")
    return docs.select(
        F.col("source"), F.lit("").alias("data_source"),
        F.concat(F.lit("doc:"), (key % 40).cast("string")).alias("id"),
        F.when(key % 3 == 0, "").otherwise(head).alias("label"),
        F.explode(F.array(
            F.struct(F.lit("ex:chars").alias("prop"), F.col("n_chars").cast("string").alias("value"),
                     F.lit("").alias("lang"), F.lit(0).alias("seq")),
            F.when(key % 4 == 0, F.struct(F.lit("rdfs:label").alias("prop"), head.alias("value"),
                                          F.col("lang").alias("lang"), F.lit(1).alias("seq"))))).alias("c"),
        key.alias("ord")).where("c IS NOT NULL").select(
        "source", "data_source", "id", "label", "c.prop", "c.value", "c.lang", "ord", "c.seq")


DOCS = f"""
WITH d AS (SELECT source, '' AS data_source, 'doc:' || (doc_id % 40) AS id, text AS head, doc_id, lang, n_chars
  FROM documents),
lab AS (SELECT source, id, head FROM d WHERE doc_id % 4 = 0
  QUALIFY row_number() OVER (PARTITION BY source, id ORDER BY {lang_key([":untagged", "en"], order="doc_id")}) = 1),
st AS (SELECT source, id, coalesce(arg_min(head, doc_id) FILTER (doc_id % 3 <> 0 AND head <> ''), '') AS label FROM d GROUP BY source, id),
ent AS (SELECT st.id, coalesce(lab.head, st.label) AS label, st.source, '' AS data_source, 'curie' AS kind
  FROM st LEFT JOIN lab USING (source, id)),
att AS (SELECT id, source, '' AS data_source, 'ex:chars' AS prop, CAST(n_chars AS VARCHAR) AS value, '' AS lang, doc_id * 4096 AS ord FROM d
  UNION ALL SELECT id, source, '', 'rdfs:label', head, lang, doc_id * 4096 + 1 FROM d WHERE doc_id % 4 = 0)
"""


@query("coalesce_entries", DOCS + "SELECT source, data_source, id, label, kind FROM ent")
def coalesce_entries(spark, sf):
    return W.coalesce_entries(doc_rows(spark, sf), ["source", "data_source"])[0]


@query("coalesce_attributes", DOCS + "SELECT source, data_source, id, prop, value, lang, ord FROM att")
def coalesce_attributes(spark, sf):
    return W.coalesce_entries(doc_rows(spark, sf), ["source", "data_source"])[1]


def batch(spark, sf):
    """New content for the sources `sales` and `src1`."""
    rows = doc_rows(spark, sf).where("source in ('src0', 'src1')").withColumn(
        "source", F.when(F.col("source") == "src0", "sales").otherwise(F.col("source")))
    mtimes = rows.select("source", "data_source").distinct().withColumn("last_modified", F.lit(5000.0))
    return W.source_batch(rows, "docs", mtimes, F.lit(6000.0))


REPLACED = lifted("entities", "").rstrip() + ", " + DOCS.strip()[5:]


@query("replace_source", REPLACED + """
SELECT id, label, source, data_source, kind FROM entities WHERE source <> 'sales'
UNION ALL SELECT id, label, CASE source WHEN 'src0' THEN 'sales' ELSE source END, data_source, kind
FROM ent WHERE source IN ('src0', 'src1')""")
def replace_source(spark, sf):
    return W.replace_sources(lift.index(spark, sf), batch(spark, sf)).entities


def new_store(spark, sf):
    path = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    W.save_index(lift.index(spark, sf), path)
    return path


@query("replace_source_stored", REPLACED + lifted("attributes", "").replace("WITH RECURSIVE", ",") + """
SELECT id, prop, value, lang, source, data_source, ord FROM attributes WHERE source <> 'sales'
UNION ALL SELECT id, prop, value, lang, CASE source WHEN 'src0' THEN 'sales' ELSE source END, data_source, ord
FROM att WHERE source IN ('src0', 'src1')""")
def replace_source_stored(spark, sf):
    """The same on tables: affected buckets are overwritten in place."""
    path = new_store(spark, sf)
    W.update_stored(spark, path, batch(spark, sf))
    return W.load_index(spark, path).attributes


@query("needs_update", """
SELECT CAST(o_orderkey AS VARCHAR) AS source, '' AS data_source, CASE WHEN o_orderkey % 3 = 0 THEN true
  WHEN o_orderkey % 7 = 0 THEN false ELSE epoch(o_orderdate) > epoch(TIMESTAMP '1997-01-01') END AS stale FROM orders""")
def needs_update(spark, sf):
    orders = lift.read(spark, sf, "orders")
    key, name = F.col("o_orderkey"), F.col("o_orderkey").cast("string").alias("source")
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double")
    listing = orders.select(name, F.lit("").alias("data_source"),
                            F.when(key % 7 != 0, seconds).alias("mtime"))
    known = orders.where(key % 3 != 0).select(name, F.lit("").alias("data_source"), F.unix_timestamp(
        F.lit("1997-01-01 00:00:00")).cast("double").alias("last_modified"))
    return W.needs_update(listing, known).select("source", "data_source", "stale")


@query("register_sources", """
SELECT source, '' AS data_source, CASE WHEN CAST(substr(source, 4) AS INTEGER) % 2 = 0 THEN 'registered'
  WHEN CAST(substr(source, 4) AS INTEGER) % 3 = 0 THEN 'up to date' ELSE 'refreshed' END AS status,
  CASE WHEN CAST(substr(source, 4) AS INTEGER) % 2 <> 0 AND CAST(substr(source, 4) AS INTEGER) % 3 = 0 THEN 0
  ELSE count(DISTINCT doc_id % 40) END AS entities FROM documents GROUP BY source""")
def register_sources(spark, sf):
    """Even sources are new, odd multiples of three fresh, the others modified."""
    rows = doc_rows(spark, sf)
    number = F.substring("source", 4, 9).cast("int")
    listing = rows.select("source", "data_source").distinct().withColumn("mtime", F.lit(100.0))
    known = listing.where(number % 2 != 0).select(
        "source", "data_source", F.lit("docs").alias("type"),
        F.when(number % 3 == 0, 100.0).otherwise(50.0).alias("last_modified"),
        F.lit(60.0).alias("last_updated"))
    idx = lift.index(spark, sf)
    path = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    W.save_index(Index(known, idx.entities.limit(0), idx.attributes.limit(0), idx.prefixes.limit(0),
                       idx.global_prefixes), path)
    return W.register_files(spark, path, listing, rows, "docs", F.lit(200.0))


def map_files(spark, sf):
    """A JSON file per source that maps its documents to their languages; that of src1 is cut off."""
    docs = lift.read(spark, sf, "documents").select("source", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), "lang")
    text = F.to_json(F.map_from_entries(F.collect_list(F.struct("id", F.coalesce("lang", F.lit(""))))))
    maps = docs.groupBy(F.col("source").alias("doc")).agg(text.alias("t")).select(
        "doc", F.when(F.col("doc") == "src1", F.substring("t", F.lit(1), F.length("t") - 9)).otherwise(F.col("t")).alias("text"))
    return written(spark, f"maps:{sf}", lambda f: maps.repartition("doc").write.partitionBy("doc").text(f))


@query("refresh_all", """
SELECT source, CASE source WHEN 'src1' THEN 'failed' ELSE 'refreshed' END AS status, source = 'src1' AS damaged,
  CASE source WHEN 'src1' THEN 1 ELSE count(*) END AS entities, CASE source WHEN 'src1' THEN 'old' ELSE min(coalesce(lang, '')) END AS label
FROM documents GROUP BY source""")
def refresh_all(spark, sf):
    """All files of a folder are read again; the damaged one keeps the row it had."""
    folder = map_files(spark, sf)
    path = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    old = readers.list_files(spark, folder).select(
        F.col("doc").alias("source"), F.lit("").alias("data_source"), F.lit("doc:old").alias("id"), F.lit("old").alias("label"),
        F.lit(None).cast("string").alias("prop"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("lang"),
        F.lit(0).cast("long").alias("ord"), F.lit(0).alias("seq"))
    mtimes = old.select("source", "data_source").withColumn("last_modified", F.lit(1.0))
    V.save_index(W.source_batch(old, "txt", mtimes, F.lit(2.0)), path)
    done = W.register_folder(spark, path, folder, {"txt": readers.DEFAULT_READERS["json"]}, force=True)
    first = V.load_index(spark, path).entities.groupBy("source").agg(F.min("label").alias("label"))
    return done.join(first, "source").select(
        F.regexp_extract("source", "doc=([^/]+)", 1).alias("source"), "status", F.contains(F.coalesce("error", F.lit("")), F.lit("no JSON object")).alias("damaged"),
        "entities", "label")


@query("remove_sources", lifted("all_rows", """
SELECT id, prop, value, source FROM all_rows WHERE NOT (lower(source) LIKE 's_l%')"""))
def remove_sources(spark, sf):
    left, _gone = W.remove_sources(lift.index(spark, sf, True), "S_L%", like=True)
    return left.attributes.select("id", "prop", "value", "source")


@query("remove_sources_preview", """
SELECT DISTINCT CASE source WHEN 'src0' THEN 'sales' ELSE source END AS source, '' AS data_source, 'docs' AS type,
  CAST(5000 AS DOUBLE) AS last_modified, CAST(6000 AS DOUBLE) AS last_updated FROM documents WHERE source IN ('src0', 'src1')""")
def remove_sources_preview(spark, sf):
    """What a pattern would remove from an index of documents."""
    return W.remove_sources(batch(spark, sf), "S%", like=True)[1]


@query("remove_stored", DOCS + "SELECT source, id, label FROM ent WHERE source NOT IN ('src1', 'src3')")
def remove_stored(spark, sf):
    """Sources leave a stored index without a row being written."""
    rows = doc_rows(spark, sf)
    mtimes = rows.select("source", "data_source").distinct().withColumn("last_modified", F.lit(1.0))
    path = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    V.save_index(W.source_batch(rows, "docs", mtimes, F.lit(2.0)), path)
    V.remove_stored(spark, path, mtimes.where("source IN ('src1', 'src3')"))
    return V.load_index(spark, path).entities.select("source", "id", "label")


@query("list_sources", lifted("sources entities", """
SELECT s.*, (SELECT count(*) FROM entities e WHERE e.source = s.source) AS entities FROM sources s"""))
def list_sources(spark, sf):
    return W.list_sources(lift.index(spark, sf))


def new_prefixes(spark, sf):
    part = lift.read(spark, sf, "part")
    return part.select(F.lit("part").alias("source"), F.lit("").alias("data_source"),
                       F.when(F.col("p_partkey") % 2 == 0, "part").otherwise(F.col("p_type")).alias("prefix"),
                       F.concat(F.lit("http://new/"), F.col("p_partkey").cast("string")).alias("expansion"),
                       F.col("p_partkey").alias("pos"))


_NEW = """
, n AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'part' ELSE p_type END AS prefix,
    'http://new/' || max(p_partkey) AS expansion FROM part GROUP BY 1)"""


@query("add_prefixes", lifted("prefixes", _NEW + """
SELECT * FROM prefixes WHERE NOT (source = 'part' AND prefix IN (SELECT prefix FROM n))
UNION ALL SELECT 'part', '', prefix, expansion FROM n"""))
def add_prefixes(spark, sf):
    return W.add_prefixes(lift.prefixes(spark, sf), new_prefixes(spark, sf),
                          ["source", "data_source", "prefix"])


@query("add_prefixes_keep", lifted("prefixes", _NEW + """
SELECT * FROM prefixes UNION ALL SELECT 'part', '', prefix, expansion FROM n
WHERE prefix NOT IN (SELECT prefix FROM prefixes WHERE source = 'part')"""))
def add_prefixes_keep(spark, sf):
    return W.add_prefixes(lift.prefixes(spark, sf), new_prefixes(spark, sf),
                          ["source", "data_source", "prefix"], overwrite=False)


@query("remove_prefix", lifted("prefixes", "SELECT * FROM prefixes WHERE NOT (source = 'web' AND prefix LIKE 'h%')"))
def remove_prefix(spark, sf):
    rows = lift.prefixes(spark, sf)
    return W.remove_prefix(rows, rows.where("source = 'web' and prefix like 'h%'"))[0]


@query("remove_prefix_report", lifted("prefixes", """
SELECT 'web' AS source, '' AS data_source, prefix, bool_or(source = 'web') AS existed FROM prefixes GROUP BY prefix"""))
def remove_prefix_report(spark, sf):
    rows = lift.prefixes(spark, sf)
    gone = rows.select(F.lit("web").alias("source"), "data_source", "prefix").distinct()
    return W.remove_prefix(rows, gone)[1]


DUMP = """
, dump AS (SELECT row_number() OVER (ORDER BY tbl, json) AS line, * FROM (
SELECT 'sources' AS tbl, '{"data_source":"","source":"' || source || '","type":"table"}' AS json FROM sources
UNION ALL SELECT 'entities', '{"data_source":"","id":"' || id || '","kind":"curie","label":' ||
  coalesce('"' || label || '"', 'null') || ',"source":"' || source || '"}' FROM entities
UNION ALL SELECT 'attributes', '{"data_source":"","id":"' || id || '","lang":"' || lang || '","prop":"' || prop
  || '","source":"' || source || '","value":"' || value || '"}' FROM attributes
UNION ALL SELECT 'prefixes', '{"data_source":"","expansion":"' || expansion || '","prefix":"' || prefix
  || '","source":"' || source || '"}' FROM prefixes))"""


@query("canonical_dump", lifted("sources entities attributes prefixes", DUMP + " SELECT * FROM dump"))
def canonical_dump(spark, sf):
    return W.canonical_dump(lift.index(spark, sf))


def sink_folder(spark):
    return f"{ensure_checkpoint_dir(spark)}/sink-{uuid.uuid4().hex}"


@query("dump_files", lifted("sources entities attributes prefixes", DUMP + " SELECT line, tbl || ' ' || json AS text FROM dump"))
def dump_files(spark, sf):
    """The dump as ordered files, read back with line numbers."""
    dump, folder = W.canonical_dump(lift.index(spark, sf)), sink_folder(spark)
    sinks.write_lines(dump.select("line", F.concat_ws(" ", "tbl", "json").alias("text")), folder)
    return sinks.read_lines_back(spark, folder)


@query("json_files", """
SELECT row_number() OVER (ORDER BY p_name, p_partkey) AS line, '{"p_name":"' || p_name || '","p_partkey":' || p_partkey || ',"size":'
  || CASE WHEN p_size % 5 = 0 THEN 'null' ELSE CAST(p_size AS VARCHAR) END || '}' AS text FROM part""")
def json_files(spark, sf):
    folder = sink_folder(spark)
    rows = lift.read(spark, sf, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("size"))
    sinks.write_json(rows, folder, ["p_name", "p_partkey"])
    return sinks.read_lines_back(spark, folder)


@query("tsv_files", """
SELECT 1 AS line, 'source' || chr(9) || 'doc_id' || chr(9) || 'text' AS text UNION ALL
SELECT 1 + row_number() OVER (ORDER BY source, doc_id), source || chr(9) || doc_id || chr(9)
  || regexp_replace(replace(regexp_replace(coalesce(text, ''), '\\r$', ''), chr(9), ' '), '[\\r\\n]+', ' / ', 'g') FROM documents""")
def tsv_files(spark, sf):
    folder = sink_folder(spark)
    sinks.write_tsv(lift.read(spark, sf, "documents").select("source", "doc_id", "text"), folder, ["source", "doc_id"])
    return sinks.read_lines_back(spark, folder)


@query("tsv_safe", """
SELECT doc_id, regexp_replace(replace(regexp_replace(text, '\\r$', ''), chr(9), ' '), '[\\r\\n]+', ' / ', 'g') AS cell
FROM documents""")
def tsv_safe_text(spark, sf):
    return lift.read(spark, sf, "documents").select("doc_id", tsv_safe(F.col("text")).alias("cell"))
