"""Outline documents read into nodes, rows, prefixes and the index."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.files import text_files
from catalog.lift_sql import lifted
from termweave.functions import text as X
from termweave.operators import curation
from termweave.plans.cut import stored
from termweave.sources import lift, outline, readers


def parsed(spark, sf):
    return stored(spark, f"parsed:{sf}", lambda: outline.parsed_lines(lift.outline_lines(spark, sf)))


def nodes(spark, sf):
    return stored(spark, f"nodes:{sf}",
                  lambda: outline.outline_nodes(None, parsed(spark, sf)))


def rows(spark, sf):
    return stored(spark, f"rows:{sf}", lambda: outline.outline_rows(None, parsed(spark, sf)))


def prefixes(spark, sf):
    return stored(spark, f"oprefixes:{sf}", lambda: outline.outline_prefixes(
        None, parsed(spark, sf), nodes(spark, sf)))


@query("outline_nodes", lifted("nodes", """
SELECT doc, node_id, parent_id, level, title, uri, coalesce(label, uri) AS label, rdf_type, section_id, own_id, resourcedefs, nodeclare
FROM nodes"""))
def outline_nodes(spark, sf):
    return outline.outline_nodes(lift.outline_lines(spark, sf)).select(
        "doc", "node_id", "parent_id", "level", "title", "uri", "label", "rdf_type", "section_id",
        "own_id", "resourcedefs", "nodeclare")


@query("outline_rows", lifted("rows", "SELECT * FROM rows"))
def outline_rows(spark, sf):
    return outline.outline_rows(lift.outline_lines(spark, sf))


@query("outline_prefixes", lifted("outline_prefixes", "SELECT * FROM outline_prefixes"))
def outline_prefixes(spark, sf):
    return outline.outline_prefixes(lift.outline_lines(spark, sf)).drop("ord")


@query("read_outline_files", lifted("rows", "SELECT tag, value, count(*) AS n FROM rows GROUP BY tag, value"))
def read_outline_files(spark, sf):
    """The same documents as files on disk."""
    folder = text_files(spark, f"outline:{sf}", lift.outline_lines(spark, sf))
    found = outline.outline_rows(readers.read_lines(spark, folder))
    return found.groupBy("tag", "value").agg(F.count(F.lit(1)).alias("n"))


@query("node_type", lifted("nodes", """
SELECT rdf_type, count(*) AS n FROM nodes GROUP BY rdf_type"""))
def node_type(spark, sf):
    return nodes(spark, sf).groupBy("rdf_type").agg(F.count(F.lit(1)).alias("n"))


@query("entity_from_heading", """
WITH t AS (SELECT p_partkey AS k, p_name AS n FROM part)
SELECT k, CASE k % 10
  WHEN 0 THEN '<http://a.example.org/' || k || '>' WHEN 1 THEN '<http://a.example.org/' || k || '>'
  WHEN 2 THEN 'ex:' || k WHEN 3 THEN 'ex:P' || k
  WHEN 4 THEN '<http://a.example.org/' || k || '> <http://a.example.org/v1>'
  WHEN 5 THEN 'ex:P' || k || ' <http://a.example.org/v1>' WHEN 6 THEN 'ex:P' || k || ' ex:P' || k || '/1'
  WHEN 7 THEN '<urn:isbn:' || k || '>' WHEN 8 THEN '<urn:isbn:' || k || '>' END AS id FROM t""")
def entity_from_heading(spark, sf):
    k, n = F.col("p_partkey").cast("string"), F.col("p_name")
    shape = F.col("p_partkey") % 10
    a = "http://a.example.org/"
    title = (F.when(shape == 0, F.concat(F.lit("<" + a), k, F.lit("> more")))
             .when(shape == 1, F.concat(n, F.lit(f" (<{a}"), k, F.lit(">)")))
             .when(shape == 2, F.concat(F.lit("ex:"), k, F.lit(" and "), n))
             .when(shape == 3, F.concat(n, F.lit(" (ex:P"), k, F.lit(")")))
             .when(shape == 4, F.concat(n, F.lit(f" ({a}"), k, F.lit(f" <{a}v1>)")))
             .when(shape == 5, F.concat(n, F.lit(" (ex:P"), k, F.lit(f" <{a}v1>)")))
             .when(shape == 6, F.concat(n, F.lit(" (ex:P"), k, F.lit(" ex:P"), k, F.lit("/1)")))
             .when(shape == 7, F.concat(F.lit("<urn:isbn:"), k, F.lit(">")))
             .when(shape == 8, F.concat(n, F.lit(" (<urn:isbn:"), k, F.lit(">)")))
             .otherwise(n))
    part = lift.read(spark, sf, "part").withColumn("title", title)
    return part.select(F.col("p_partkey").alias("k"), X.entity_from_heading(F.col("title")).alias("id"))


@query("flatten_outline", lifted("nodes rows", """
, t AS (SELECT doc, node_id, uri, coalesce(label, uri) AS label, rdf_type FROM nodes WHERE uri IS NOT NULL)
SELECT uri AS id, doc AS source, 'rdfs:label' AS prop, label AS value, '' AS lang, node_id * 4 AS ord FROM t
UNION ALL SELECT uri, doc, 'rdf:type', rdf_type, '', node_id * 4 + 1 FROM t WHERE rdf_type IS NOT NULL
UNION ALL SELECT uri, t.doc, tag, value, '', row_id * 4 + 2 FROM t JOIN rows USING (doc, node_id)"""))
def flatten_outline(spark, sf):
    return outline.flatten_outline(nodes(spark, sf), rows(spark, sf))[1].drop("data_source")


@query("flatten_outline_entities", lifted("nodes", """
SELECT uri AS id, coalesce(label, uri) AS label, doc AS source, '' AS data_source, 'curie' AS kind
FROM nodes WHERE uri IS NOT NULL"""))
def flatten_outline_entities(spark, sf):
    return outline.flatten_outline(nodes(spark, sf), rows(spark, sf))[0]
