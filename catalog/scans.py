"""Text scanning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import outlines, query
from catalog.lift_sql import lifted, prio
from termweave.functions import text as X
from termweave.operators import lookup as L
from termweave.operators import scanning as S
from termweave.sources import lift

ACTIVE = ["supply", "geo", "part", "sales"]
PAIRS = [(s, "") for s in ACTIVE]
P = prio(ACTIVE)
D = "http://data.example.org/"

TOK = f"""
, tok AS MATERIALIZED (SELECT place AS doc, 'part:P' || l_partkey AS token, 'curie' AS kind FROM lines
  UNION ALL SELECT place, '{D}supplier/S' || l_suppkey, 'angle-iri' FROM lines
  UNION ALL SELECT place, '{D}nation/N' || (l_suppkey % 25), 'bare-iri' FROM lines
  UNION ALL SELECT place, 'http://a/b', 'bare-iri' FROM lines)"""
LAB = f"""
, lab AS MATERIALIZED (SELECT token, CASE t.kind WHEN 'curie' THEN (CASE WHEN p.label IS NOT NULL THEN p.label END)
    ELSE e.label END AS label FROM (SELECT DISTINCT token, kind FROM tok) t
  LEFT JOIN entities p ON p.id = token AND p.source = 'part'
  LEFT JOIN entities e ON e.id = CASE WHEN starts_with(token, '{D}supplier/') THEN 'supplier:' || substr(token, {len(D) + 10})
    WHEN starts_with(token, '{D}nation/') THEN 'nation:' || substr(token, {len(D) + 8}) END
    AND e.source = (SELECT arg_min(source, {P}) FROM entities x WHERE x.id = e.id))"""


def tokens(spark, sf):
    return S.extract_ids(lift.remarks(spark, sf), ["doc"], "text")


@query("extract_ids", lifted("lines", TOK + " SELECT * FROM tok"))
def extract_ids(spark, sf):
    return tokens(spark, sf)


_SP = r"\s\x0B"
PAGES = """
WITH a AS (SELECT page_id, html, regexp_extract_all(url || ' ' || html, '<(https?://[^\\s<>"'']+)>', 1) AS angle,
    regexp_replace(url || ' ' || html, '<(https?://[^\\s<>"'']+)>', '<>', 'g') AS t FROM pages),
b AS (SELECT page_id, angle, regexp_extract_all(t, 'https?://[^\\s<>"''`,)\\]}]+') AS bare,
    regexp_replace(t, 'https?://[^\\s<>"''`,)\\]}]+', chr(1), 'g') AS u FROM a),
c AS (SELECT page_id, angle, bare, list_filter(regexp_extract_all(u,
    '(?:[A-Za-z][-A-Za-z0-9_.]*|):[A-Za-z_][-\\w./%:' || chr(1) || ']*'), lambda x: NOT contains(x, chr(1))) AS names FROM b)
SELECT page_id, unnest(angle) AS token, 'angle-iri' AS kind FROM c
UNION ALL SELECT page_id, unnest(bare), 'bare-iri' FROM c UNION ALL SELECT page_id, unnest(names), 'curie' FROM c"""


@query("extract_ids_pages", PAGES)
def extract_ids_pages(spark, sf):
    pages = lift.read(spark, sf, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("text"))
    return S.extract_ids(pages, ["page_id"], "text")


@query("scan_tokens", lifted("lines", f"""
, r AS (SELECT place AS doc, 'see part:P' || l_partkey AS a, ' from <{D}supplier/S' || l_suppkey || '>' AS b,
    ' via {D}nation/N' || (l_suppkey % 25) AS c, l_partkey, l_suppkey FROM lines)
, t AS (SELECT doc, 'part:P' || l_partkey AS token, 4 AS s, length(a) AS e, 'curie' AS kind FROM r
  UNION ALL SELECT doc, '{D}supplier/S' || l_suppkey, length(a) + 6, length(a || b), 'angle-iri' FROM r
  UNION ALL SELECT doc, '{D}nation/N' || (l_suppkey % 25), length(a || b) + 5, length(a || b || c), 'bare-iri' FROM r
  UNION ALL SELECT doc, 'http://a/b', length(a || b || c || ', not part:12 or ex:'),
    length(a || b || c || ', not part:12 or ex:http://a/b'), 'bare-iri' FROM r)
SELECT doc, token, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", kind FROM t"""))
def scan_tokens(spark, sf):
    return S.scan_tokens(lift.remarks(spark, sf), ["doc"], "text")


@query("known_tokens", lifted("entities lines", TOK + f"""
SELECT token, kind, count(*) AS n FROM tok WHERE token IN (SELECT id FROM entities) GROUP BY token, kind"""))
def known_tokens(spark, sf):
    counts = tokens(spark, sf).groupBy("token", "kind").agg(F.count(F.lit(1)).alias("n"))
    return S.known_tokens(counts, lift.index(spark, sf), PAIRS)


@query("label_tokens", lifted("entities lines", TOK + LAB + """
SELECT doc, token, kind, label FROM tok LEFT JOIN lab USING (token)"""))
def label_tokens(spark, sf):
    return S.label_texts(lift.remarks(spark, sf), ["doc"], "text", lift.index(spark, sf), PAIRS)


@query("token_stats", lifted("lines", TOK + """
SELECT token, kind, count(*) AS hits, count(DISTINCT doc) AS docs FROM tok GROUP BY token, kind"""))
def token_stats(spark, sf):
    return S.token_stats(tokens(spark, sf), "doc")


@query("approx_token_stats")
def approx_token_stats(spark, sf):
    return S.approx_token_stats(tokens(spark, sf), "doc")


@query("unknown_tokens", lifted("entities lines", TOK + LAB + """
SELECT token, count(*) AS hits FROM tok JOIN lab USING (token) WHERE label IS NULL GROUP BY token"""))
def unknown_tokens(spark, sf):
    return S.unknown_tokens(tokens(spark, sf), lift.index(spark, sf), PAIRS)


@query("annotate_text", lifted("entities lines", TOK + LAB + f"""
SELECT DISTINCT place AS doc, l_partkey AS part, 'see ' || coalesce('[[#part:P' || l_partkey || '][' || a.label || ']]', 'part:P' || l_partkey)
  || ' from ' || '[[#{D}supplier/S' || l_suppkey || '][' || b.label || ']]'
  || ' via ' || '[[#{D}nation/N' || (l_suppkey % 25) || '][' || c.label || ']]'
  || ', not part:12 or ex:http://a/b, line ' || l_linenumber AS text
FROM lines LEFT JOIN lab a ON a.token = 'part:P' || l_partkey
LEFT JOIN lab b ON b.token = '{D}supplier/S' || l_suppkey
LEFT JOIN lab c ON c.token = '{D}nation/N' || (l_suppkey % 25)"""))
def annotate_text(spark, sf):
    texts = lift.remarks(spark, sf).dropDuplicates(["doc", "part"])
    labels = L.resolve_labels(tokens(spark, sf), lift.index(spark, sf), PAIRS)
    return S.annotate_text(texts, ["doc", "part"], "text", labels)


@query("annotate_outline", lifted("entities outline_lines", """
, lab AS (SELECT id, label FROM entities WHERE source = 'part' AND label IS NOT NULL)
SELECT doc, ord, replace(text, 'part:P1 ', '[[#part:P1][' || (SELECT label FROM lab WHERE id = 'part:P1') || ']] ') AS text
FROM outline_lines WHERE NOT starts_with(text, '*') UNION ALL SELECT doc, ord, text FROM outline_lines WHERE starts_with(text, '*')"""))
def annotate_outline(spark, sf):
    """Headings and code blocks are left alone."""
    parsed = outlines.parsed(spark, sf)
    labels = lift.entities(spark, sf).where("source = 'part'").select(F.col("id").alias("token"), "label")
    skip = F.col("is_heading") | (F.coalesce("block", F.lit("")) != "")
    return S.annotate_text(parsed, ["doc", "ord"], "text", labels, skip=skip).select("doc", "ord", "text")


REFS = """
, t AS (SELECT 'ex:T' || doc AS id FROM brands UNION SELECT 'part:P' || p_partkey FROM part)
, hit AS (SELECT t.id, l.doc, l.ord FROM outline_lines l JOIN t
    ON t.id = regexp_extract(l.text, '(part:P[0-9]+|ex:Tb[0-9]+)', 1))
, h AS (SELECT hit.*, (SELECT max(node_id) FROM nodes n WHERE n.doc = hit.doc AND n.node_id <= hit.ord) AS node_id FROM hit)
, ref AS (SELECT h.id, h.doc, h.ord, n.title AS heading, n.node_id = h.ord AS is_heading FROM h JOIN nodes n
    ON n.doc = h.doc AND n.node_id = h.node_id)"""


def references(spark, sf, only=False):
    ids = (lift.brands(spark, sf).select(F.concat(F.lit("ex:T"), "doc").alias("id"))
           .union(lift.read(spark, sf, "part").select(F.concat(F.lit("part:P"), F.col("p_partkey").cast("string")))))
    return ids, S.find_references(ids, outlines.parsed(spark, sf), outlines.nodes(spark, sf), only)


@query("find_references", lifted("outline_lines nodes", REFS + " SELECT id, doc, ord, heading, is_heading FROM ref"))
def find_references(spark, sf):
    return references(spark, sf)[1].drop("context")


@query("find_definitions", lifted("outline_lines nodes", REFS + """
 SELECT id, doc, ord, heading FROM ref WHERE is_heading"""))
def find_definitions(spark, sf):
    return references(spark, sf, True)[1].select("id", "doc", "ord", "heading")


@query("describe", lifted("outline_lines nodes", REFS + """
, n AS (SELECT id, count(*) AS n, arg_min(doc, (doc, ord)) FILTER (is_heading) AS defined_in FROM ref GROUP BY id)
, f AS (SELECT id, doc, ord, CAST(row_number() OVER (PARTITION BY id ORDER BY doc, ord) AS INTEGER) AS place FROM ref
    QUALIFY place <= 10)
SELECT t.id, defined_in, place, doc, ord, greatest(coalesce(n, 0) - 10, 0) AS more
FROM (SELECT DISTINCT id FROM t) t LEFT JOIN n USING (id) LEFT JOIN f USING (id)"""))
def describe(spark, sf):
    ids, refs = references(spark, sf)
    return S.describe(ids, refs)


MENTIONS = """
, v AS (SELECT ord, value, id FROM axioms)
SELECT ord, regexp_matches(value, '(^|[^-_./A-Za-z0-9])' || id || '([^-_./A-Za-z0-9]|$)') AS own,
  regexp_matches(value || '.x', '(^|[^-_:A-Za-z0-9])' || id || '([^-_:A-Za-z0-9]|$)') AS dotted,
  regexp_matches(value || '.x', '(^|[^-_./A-Za-z0-9])' || id || '([^-_./A-Za-z0-9]|$)') AS strict FROM v"""


@query("mentions", lifted("axioms", MENTIONS))
def mentions(spark, sf):
    rows = lift.axioms(spark, sf)
    value, dotted = F.col("value"), F.concat("value", F.lit(".x"))
    return rows.select("ord", X.mentions(value, F.col("id")).alias("own"),
                       X.mentions(dotted, F.col("id"), X.EDIT_NAME).alias("dotted"),
                       X.mentions(dotted, F.col("id")).alias("strict"))


@query("axiom_to_labels", lifted("axioms entities", """
, lab AS (SELECT id, CASE WHEN contains(label, ' ') THEN '''' || label || '''' ELSE label END AS q FROM entities
    WHERE source IN ('part', 'supply') AND label IS NOT NULL AND id <> 'ex:note')
, w AS (SELECT id, ord, value, string_split(value, ' ') AS ws FROM axioms WHERE value <> '')
SELECT DISTINCT w.id, w.ord, coalesce(a.q, w.ws[1]) || coalesce(' ' || CASE WHEN starts_with(ws[2], '(') THEN '(' ELSE '' END
    || coalesce(b.q, ltrim(ws[2], '(')), '') || coalesce(' ' || coalesce(c.q, ws[3]), '') AS value,
  CAST((a.q IS NOT NULL) AS BIGINT) + CAST((b.q IS NOT NULL) AS BIGINT) + CAST((c.q IS NOT NULL) AS BIGINT) AS substitutions
FROM w LEFT JOIN lab a ON a.id = ws[1] LEFT JOIN lab b ON b.id = ltrim(ws[2], '(') LEFT JOIN lab c ON c.id = ws[3]"""))
def axiom_to_labels(spark, sf):
    labels = lift.entities(spark, sf).where(
        "source in ('part', 'supply') and id <> 'ex:note'").select("id", "label")
    rows = lift.axioms(spark, sf).where("value <> ''").dropDuplicates(["id", "ord"])
    table = lift.prefixes(spark, sf).where("source = 'part'").select("prefix", "expansion")
    return S.axiom_to_labels(rows, ["id", "ord"], "value", labels, table)
