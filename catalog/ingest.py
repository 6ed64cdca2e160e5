"""Ingest queries: tables, delimited files, JSON maps, triples, prefixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.files import text_files, written
from termweave.sources import lift, readers, tables

WIDE = """
WITH p AS (SELECT * FROM part),
r AS (SELECT 'P' || p_partkey AS id, p_name AS label, 'p_type' AS prop, p_type AS value, '' AS lang, p_partkey AS ord FROM p
  UNION ALL SELECT 'P' || p_partkey, p_name, 'p_size', CAST(p_size AS VARCHAR), '', p_partkey FROM p
  UNION ALL SELECT 'P' || p_partkey, p_name, 'rdfs:label', p_name, CASE WHEN p_partkey % 3 = 0 THEN 'en' ELSE '' END, p_partkey FROM p
  UNION ALL SELECT 'P' || p_partkey, p_name, 'rdfs:label', p_name || ' ko', 'ko', p_partkey FROM p WHERE p_partkey % 4 = 0)
"""


def wide(spark, sf):
    key = F.col("p_partkey")
    return lift.read(spark, sf, "part").select(
        F.concat(F.lit("P"), key.cast("string")).alias("id"), F.col("p_name").alias("label"),
        "p_type", F.col("p_size").cast("string").alias("p_size"),
        F.when(key % 3 == 0, "en").otherwise("").alias("lang"),
        F.when(key % 4 == 0, F.concat("p_name", F.lit(" ko"))).alias("label@ko"),
        key.alias("key"))


@query("ingest_table", WIDE + " SELECT id, label, prop, value, lang, ord FROM r")
def ingest_table(spark, sf):
    frame = wide(spark, sf)
    rows = tables.ingest_table(frame, F.col("key"), frame.columns[:-1])
    return rows.drop("seq")


@query("query_result_source", """
SELECT 'nation:N' || n_nationkey AS id, n_name AS label, 'region' AS prop, r_name AS value, '' AS lang,
  CAST(n_nationkey AS BIGINT) AS ord FROM nation JOIN region ON n_regionkey = r_regionkey""")
def query_result_source(spark, sf):
    nation, region = lift.read(spark, sf, "nation"), lift.read(spark, sf, "region")
    frame = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("nation:N"), F.col("n_nationkey").cast("string")).alias("id"),
        F.col("n_name").alias("label"), F.col("r_name").alias("region"), "n_nationkey")
    return tables.ingest_table(frame, F.col("n_nationkey"), ["id", "label", "region"]).drop("seq")


@query("query_result_has_rows", "SELECT count(*) > 0 AS has_rows FROM documents WHERE n_chars > 5000 AND lang IS NOT NULL")
def query_result_has_rows(spark, sf):
    return tables.has_rows(lift.read(spark, sf, "documents").where("n_chars > 5000 AND lang IS NOT NULL"))


def delimited_lines(spark, sf, sep):
    """The wide table as delimited text, one file per type; labels are quoted."""
    frame = wide(spark, sf)
    cols = [F.col("id"), F.concat(F.lit('"'), "label", F.lit('"')), F.col("p_type"), F.col("p_size"),
            F.col("lang"), F.coalesce(F.col("`label@ko`"), F.lit(""))]
    rows = frame.select(F.col("p_type").alias("doc"), F.col("key").alias("ord"),
                        F.concat_ws(sep, *cols).alias("text"))
    head = sep.join(["id", "label", "p_type", "p_size", "lang", "label@ko"])
    heads = frame.select(F.col("p_type").alias("doc")).distinct().select(
        "doc", F.lit(-1).cast("long").alias("ord"), F.lit(head).alias("text"))
    return heads.union(rows)


@query("read_delimited", WIDE + " SELECT id, label, prop, value, lang FROM r")
def read_delimited(spark, sf):
    folder = text_files(spark, f"csv:{sf}", delimited_lines(spark, sf, ","))
    return readers.read_delimited(spark, folder, ",").select("id", "label", "prop", "value", "lang")


@query("read_delimited_tabs", WIDE + " SELECT id, label, prop, value, lang FROM r")
def read_delimited_tabs(spark, sf):
    folder = text_files(spark, f"tsv:{sf}", delimited_lines(spark, sf, "\t"))
    return readers.read_delimited(spark, folder, "\t").select("id", "label", "prop", "value", "lang")


@query("ingest_json_map", """
SELECT 'k' AS id, json_extract_string(props, '$.k') AS label, CAST(NULL AS VARCHAR) AS prop,
  CAST(NULL AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS lang, event_id FROM events
UNION ALL SELECT 'E' || event_id, event_type, 'user', CAST(user_id AS VARCHAR), '', event_id FROM events
UNION ALL SELECT 'E' || event_id, event_type, 'rdfs:label', event_type || ' de', 'de', event_id FROM events
UNION ALL SELECT 'E' || event_id, event_type, 'rdfs:label', event_type, 'en', event_id FROM events WHERE event_id % 2 = 0
""")
def ingest_json_map(spark, sf):
    events = lift.read(spark, sf, "events")
    nested = F.to_json(F.struct(
        F.col("event_type").alias("label"), F.col("user_id").alias("user"),
        F.when(F.col("event_id") % 2 == 0, "en").otherwise("").alias("lang"),
        F.concat("event_type", F.lit(" de")).alias("label@de")))
    text = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "E'),
                    F.col("event_id").cast("string"), F.lit('": '), nested, F.lit("}"))
    rows = tables.ingest_json_map(events.select("event_id", text.alias("t")), "t", F.col("event_id"))
    return rows.select("id", "label", "prop", "value", "lang",
                       F.shiftright("ord", 24).alias("event_id"))


@query("read_json_map", """
SELECT 'N' || n_nationkey AS id, n_name AS label, 'region' AS prop, CAST(n_regionkey AS VARCHAR) AS value,
  '' AS lang FROM nation
UNION ALL SELECT 'P' || p_partkey, p_name, 'region', CAST(p_partkey % 5 AS VARCHAR), '' FROM part""")
def read_json_map(spark, sf):
    nation = lift.read(spark, sf, "nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"),
        F.col("n_name").alias("label"), F.col("n_regionkey").cast("string").alias("region"))
    part = lift.read(spark, sf, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_name").alias("label"), (F.col("p_partkey") % 5).cast("string").alias("region"))
    entry = F.concat(F.lit('"'), "id", F.lit('": '), F.to_json(F.struct("label", "region")))
    objects = nation.union(part).groupBy(F.col("region").alias("doc")).agg(
        F.concat(F.lit("{\n"), F.array_join(F.collect_list(entry), ",\n"), F.lit("\n}")).alias("text"))
    folder = written(spark, f"jsonmap:{sf}",
                     lambda f: objects.repartition("doc").write.partitionBy("doc").text(f))
    return readers.read_json_map(spark, folder).select("id", "label", "prop", "value", "lang")


@query("ingest_triples_json", """
WITH t AS (SELECT 'src' || n_regionkey AS source, 'd' || n_regionkey AS data_source, 'nation:N' || n_nationkey AS id, n_name AS label,
  'curie' AS kind, n_nationkey AS k FROM nation)
SELECT source, data_source, id, label, kind, 'ex:key' AS prop, CAST(k AS VARCHAR) AS value, '' AS lang FROM t WHERE k % 4 <> 0
UNION ALL SELECT source, data_source, id, label, kind, 'rdfs:label', label || ' "q"', 'en' FROM t WHERE k % 4 <> 0
UNION ALL SELECT source, data_source, id, label, kind, 'rdfs:label', label, '' FROM t WHERE k % 4 <> 0
UNION ALL SELECT source, data_source, id, label, kind, NULL, NULL, NULL FROM t WHERE k % 4 = 0""")
def ingest_triples_json(spark, sf):
    return readers.read_triples_json(spark, term_files(spark, sf)).drop("ord", "seq")


@query("ingest_triples_prefixes", """
SELECT DISTINCT 'src' || n_regionkey AS source, 'd' || n_regionkey AS data_source, p AS prefix, e AS expansion
FROM nation, (VALUES ('nation', 'http://n.example.org/'), ('ex', 'http://ex.example.org/')) v(p, e)""")
def ingest_triples_prefixes(spark, sf):
    return readers.read_triples_prefixes(spark, term_files(spark, sf))


def term_files(spark, sf):
    """A file per region: attributes as pairs, with and without language; a fourth has none."""
    key, quoted = F.col("n_nationkey").cast("string"), F.to_json(F.struct(F.concat("n_name", F.lit(' "q"')).alias("value"), F.lit("en").alias("lang")))
    attrs = F.when(F.col("n_nationkey") % 4 == 0, "[]").otherwise(F.concat(
        F.lit('[["ex:key", "'), key, F.lit('"], ["rdfs:label", '), quoted, F.lit('], ["rdfs:label", {"value": "'), "n_name", F.lit('"}]]')))
    kind = F.when(F.col("n_nationkey") % 2 == 0, '"kind": "curie", ').otherwise("")
    term = F.concat(F.lit('{"id": "nation:N'), key, F.lit('", "label": "'), "n_name", F.lit('", '), kind, F.lit('"attrs": '), attrs, F.lit("}"))
    region = F.col("n_regionkey").cast("string")
    docs = lift.read(spark, sf, "nation").groupBy(F.concat(F.lit("src"), region).alias("file")).agg(
        F.max(region).alias("r"), F.array_join(F.collect_list(term), ",\n").alias("data"))
    text = F.concat(F.lit('{"source": "'), "file", F.lit('", "dataSource": "d'), "r", F.lit('", "type": "json",\n"data": ['), "data",
                    F.lit('],\n"prefixes": [["nation", "http://n.example.org/"], ["ex", "http://ex.example.org/"], ["ex", "http://no.example.org/"]]}'))
    return written(spark, f"termjson:{sf}", lambda f: docs.select("file", text.alias("text")).repartition("file").write.partitionBy("file").text(f))


@query("unescaped_triples", """
SELECT 'http://data.example.org/café/P' || p_partkey AS s, p_name || ' café ' || chr(128512) || chr(128512) || ' "q" ' || chr(92) || 'n' || chr(9)
  || chr(92) || 'uD83D' || chr(13) AS o FROM part""")
def unescaped_triples(spark, sf):
    """Escapes of every kind; an escaped backslash before n is no line break."""
    line = F.concat(F.lit("<http://data.example.org/caf\\u00E9/P"), F.col("p_partkey").cast("string"),
                    F.lit('> <http://www.w3.org/2000/01/rdf-schema#label> "'), "p_name",
                    F.lit(r' caf\u00e9 \U0001F600\uD83D\uDE00 \"q\" \\n\t\uD83D\r" .'))
    lines = lift.read(spark, sf, "part").select(F.col("p_type").alias("doc"), F.col("p_partkey").alias("ord"), line.alias("text"))
    return readers.ntriples(lines).select("s", "o")


NT = """
SELECT 'http://data.example.org/part/P' || p_partkey AS id, p_name || ' "q"' AS label, 'rdfs:label' AS prop,
  p_name || ' "q"' AS value, CASE WHEN p_partkey % 2 = 0 THEN 'en' ELSE '' END AS lang FROM part"""


def nt_lines(spark, sf):
    key = F.col("p_partkey")
    subject = F.concat(F.lit("<http://data.example.org/part/P"), key.cast("string"), F.lit(">"))
    label = F.concat(subject, F.lit(' <http://www.w3.org/2000/01/rdf-schema#label> "'), F.col("p_name"),
                     F.lit(' \\"q\\""'), F.when(key % 2 == 0, "@en").otherwise(""), F.lit(" ."))
    typed = F.concat(subject, F.lit(" <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://t/"),
                     F.col("p_type"), F.lit("> ."))
    size = F.concat(subject, F.lit(' <http://t/size> "'), F.col("p_size").cast("string"),
                    F.lit('"^^<http://www.w3.org/2001/XMLSchema#integer> .'))
    return lift.read(spark, sf, "part").select(
        F.col("p_type").alias("doc"), F.posexplode(F.array(label, typed, size)).alias("p", "text"),
        key.alias("k")).select("doc", (F.col("k") * 3 + F.col("p")).alias("ord"), "text")


@query("labels_from_triples", NT)
def labels_from_triples(spark, sf):
    folder = text_files(spark, f"nt:{sf}", nt_lines(spark, sf))
    rows = tables.labels_from_triples(readers.read_ntriples(spark, folder))
    return rows.select("id", "label", "prop", "value", "lang")


@query("read_ntriples", """
SELECT 'http://data.example.org/part/P' || p_partkey AS s, 'http://www.w3.org/2000/01/rdf-schema#label' AS p,
  p_name || ' "q"' AS o, 'literal' AS o_kind, CASE WHEN p_partkey % 2 = 0 THEN 'en' ELSE '' END AS lang, '' AS datatype FROM part
UNION ALL SELECT 'http://data.example.org/part/P' || p_partkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type',
  'http://t/' || p_type, 'iri', '', '' FROM part
UNION ALL SELECT 'http://data.example.org/part/P' || p_partkey, 'http://t/size', CAST(p_size AS VARCHAR), 'literal', '',
  'http://www.w3.org/2001/XMLSchema#integer' FROM part""")
def read_ntriples(spark, sf):
    folder = text_files(spark, f"nt:{sf}", nt_lines(spark, sf))
    return readers.read_ntriples(spark, folder).drop("doc", "ord")


@query("harvest_prefixes", """
SELECT source AS doc, lang AS prefix, arg_min('http://' || doc_id || '/', doc_id) AS expansion
FROM documents GROUP BY source, lang UNION ALL
SELECT DISTINCT source, '', 'http://' || source || '/' FROM documents""")
def harvest_prefixes(spark, sf):
    docs = lift.read(spark, sf, "documents")
    even = F.col("doc_id") % 2 == 0
    text = F.concat(F.when(even, "  @prefix  ").otherwise("PREFIX "), "lang", F.lit(" : <http://"),
                    F.col("doc_id").cast("string"), F.lit("/> ."))
    empty = F.concat(F.lit("@prefix : <http://"), "source", F.lit("/> ."))
    lines = docs.select(F.col("source").alias("doc"), F.col("doc_id").alias("ord"),
                        F.explode(F.array(text, empty, F.concat(F.lit("x "), text), F.col("text"))).alias("text"))
    return tables.harvest_prefixes(lines)


TERM_LINES = """
SELECT 'part:P' || p_partkey AS id, p_name || chr(10) || 'in, ' || p_brand AS label, 'ex:size' AS prop, CAST(p_size AS VARCHAR) AS value FROM part WHERE p_size IS NOT NULL
UNION ALL SELECT 'part:P' || p_partkey, p_name || chr(10) || 'in, ' || p_brand, 'ex:note', 'say "' || p_type || '"' || chr(10) || chr(10) || '| end' FROM part"""


def broken_lines(spark, sf, sep):
    """Parts as delimited text whose quoted fields hold line breaks, quotes and separators."""
    def quoted(text):
        return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))

    name = F.concat("p_name", F.lit("\nin, "), "p_brand")
    note = F.concat(F.lit('say "'), "p_type", F.lit('"\n\n| end'))
    size = F.coalesce(F.col("p_size").cast("string"), F.lit(""))
    record = F.concat_ws(sep, F.concat(F.lit("part:P"), F.col("p_partkey").cast("string")), quoted(name), size, quoted(note))
    rows = lift.read(spark, sf, "part").select(F.concat(F.lit("f"), (F.col("p_partkey") % 5).cast("string")).alias("doc"),
                                               F.col("p_partkey").alias("ord"), record.alias("text"))
    heads = rows.select("doc").distinct().select("doc", F.lit(-1).cast("long").alias("ord"), F.lit(sep.join(["id", "label", "ex:size", "ex:note"])).alias("text"))
    return heads.union(rows)


@query("read_delimited_breaks", TERM_LINES)
def read_delimited_breaks(spark, sf):
    folder = text_files(spark, f"breaks:{sf}", broken_lines(spark, sf, ","))
    return readers.read_delimited(spark, folder, ",").select("id", "label", "prop", "value")


@query("read_delimited_bars", TERM_LINES)
def read_delimited_bars(spark, sf):
    folder = text_files(spark, f"bars:{sf}", broken_lines(spark, sf, "|"))
    return readers.read_delimited(spark, folder, "|").select("id", "label", "prop", "value")


@query("ingest_dir", WIDE + " SELECT id, label, prop, value, lang FROM r")
def ingest_dir(spark, sf):
    folder = text_files(spark, f"tsv:{sf}", delimited_lines(spark, sf, "\t"))
    names = {"txt": lambda s, path, glob: readers.read_delimited(s, path, "\t", glob)}
    rows, _errors = readers.ingest_dir(spark, folder, names)
    return rows.select("id", "label", "prop", "value", "lang")
