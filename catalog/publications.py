"""Publishing queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import outlines, query
from catalog.lift_sql import lifted
from termweave.operators import publishing as X
from termweave.operators import taxonomy as G
from termweave.plans.cut import ensure_checkpoint_dir
from termweave.sources import lift, sinks


def parts(spark, sf):
    return outlines.nodes(spark, sf), outlines.rows(spark, sf), outlines.prefixes(spark, sf)


@query("literal_text", """
WITH p AS (SELECT p_partkey AS k, p_name AS n FROM part)
SELECT k, CASE k % 12 WHEN 0 THEN '"' || k || '.5"' WHEN 1 THEN '<http://a/' || k || '>' WHEN 2 THEN '<http://a/' || k || '>'
  WHEN 3 THEN '<http://a/' || k || '>' WHEN 4 THEN '<urn:x:' || k || '>' WHEN 5 THEN '"urn:uuid:' || k || '"^^xsd:string'
  WHEN 6 THEN '"true"^^xsd:boolean' WHEN 7 THEN '"' || k || '"^^xsd:int' WHEN 8 THEN '<http://data.example.org/part/P' || k || '>'
  WHEN 9 THEN '"' || n || '"@en' WHEN 10 THEN '"zz:' || k || '"'
  ELSE '"say \\"' || n || '\\"' || chr(10) || 'x' || chr(10) || '  y"' END AS text FROM p""")
def literal_text(spark, sf):
    key, k, n = F.col("p_partkey"), F.col("p_partkey").cast("string"), F.col("p_name")
    shapes = [F.concat(k, F.lit(".5")), F.concat(F.lit("[[http://a/"), k, F.lit("]]")),
              F.concat(F.lit("http://a/"), k), F.concat(F.lit("<http://a/"), k, F.lit(">")),
              F.concat(F.lit("<urn:x:"), k, F.lit(">")), F.concat(F.lit("urn:uuid:"), k), F.lit("true"),
              F.concat(F.lit('"'), k, F.lit('"^^xsd:int')), F.concat(F.lit("part:P"), k),
              F.concat(F.lit('"'), n, F.lit('"@en')), F.concat(F.lit("zz:"), k),
              F.concat(F.lit('say "'), n, F.lit('"\n   x\n     y'))]
    raw = shapes[-1]
    for i, shape in enumerate(shapes[:-1]):
        raw = F.when(key % 12 == i, shape).otherwise(raw)
    rows = lift.read(spark, sf, "part").select(key.alias("k"), raw.alias("raw"))
    table = lift.prefixes(spark, sf).where("source = 'part'").select("prefix", "expansion")
    return X.literal_text(rows, "raw", table, "text").select("k", "text")


FRAMES = """
, up AS (SELECT n.*, p.uri AS parent_uri FROM nodes n LEFT JOIN nodes p ON p.doc = n.doc AND p.node_id = n.parent_id)
, note AS (SELECT doc, node_id, -1 AS o, '        rdfs:label "' || label || '"' AS t FROM nodes WHERE label IS NOT NULL AND label <> uri
  UNION ALL SELECT r.doc, r.node_id, r.row_id, coalesce('        Annotations: ' || chr(10) || '            rdfs:seeAlso "' || m.value || '"' || chr(10), '')
    || '        ' || r.tag || ' "' || replace(r.value, chr(10) || '   ', chr(10)) || '"'
    FROM rows r LEFT JOIN rows m ON m.doc = r.doc AND m.parent_row_id = r.row_id
    WHERE r.parent_row_id IS NULL AND r.tag IN ('rdfs:comment', 'ex:unknown'))
, ax AS (SELECT doc, node_id, row_id AS o, '    ' || tag || ': ' || value AS t FROM rows WHERE tag IN ('Types', 'SubClassOf') AND value <> ''
  UNION ALL SELECT doc, node_id, 9000000000, '    Facts: ex:partOf ' || parent_uri FROM up
    WHERE rdf_type = 'owl:NamedIndividual' AND parent_uri IS NOT NULL)
, f AS (SELECT doc, node_id, uri, CASE rdf_type WHEN 'owl:NamedIndividual' THEN 'Individual' WHEN 'owl:Ontology' THEN 'Ontology'
    ELSE 'Class' END || ': ' || uri
  || coalesce(chr(10) || '    Annotations: ' || chr(10) || (SELECT string_agg(t, ',' || chr(10) ORDER BY o) FROM note WHERE note.doc = nodes.doc AND note.node_id = nodes.node_id), '')
  || coalesce(chr(10) || (SELECT string_agg(t, chr(10) ORDER BY o) FROM ax WHERE ax.doc = nodes.doc AND ax.node_id = nodes.node_id), '') AS text
  FROM nodes WHERE uri IS NOT NULL)
, pre AS (SELECT doc, '## Prefixes' || chr(10) || string_agg(printf('Prefix: %-5s <%s>', prefix || ':', expansion), chr(10)
    ORDER BY CASE prefix WHEN 'part' THEN 1 WHEN 'ex' THEN 2 ELSE 3 END) AS text FROM outline_prefixes GROUP BY doc)
, blk AS (SELECT doc, -1 AS ord, CAST(NULL AS BIGINT) AS source_line, text FROM pre UNION ALL SELECT doc, node_id, node_id, text FROM f)"""


@query("frames", lifted("nodes rows outline_prefixes", FRAMES + " SELECT * FROM f"))
def frames(spark, sf):
    return X.frames(*parts(spark, sf))


@query("misc_frames", """
SELECT doc, node_id, ord, text FROM (SELECT 'd' || (l_suppkey % 10) AS doc, l_orderkey AS node_id, place AS ord,
  'DisjointClasses: part:P' || l_partkey || ', supplier:S' || l_suppkey AS text, l_partkey
  FROM (SELECT *, (l_orderkey * 10 + l_linenumber) * 10000000 + l_suppkey AS place FROM lineitem)) WHERE l_partkey % 5 <> 0""")
def misc_frames(spark, sf):
    line = lift.read(spark, sf, "lineitem")
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    rows = line.select(
        F.concat(F.lit("d"), (supp % 10).cast("string")).alias("doc"), F.col("l_orderkey").alias("node_id"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + supp).alias("row_id"),
        F.lit(None).cast("long").alias("parent_row_id"), F.lit("DisjointClasses").alias("tag"),
        F.when(part % 5 == 0, " ").otherwise(F.concat(
            F.lit("part:P"), part.cast("string"), F.lit(", supplier:S"), supp.cast("string"))).alias("value"))
    table = lift.brands(spark, sf).select("doc", F.lit("part").alias("prefix"), F.lit("http://p/").alias("expansion"))
    return X.misc_frames(rows, table)


LINES = FRAMES + """
, ln AS (SELECT doc, ord, source_line, unnest(string_split(text || chr(10), chr(10))) AS text,
    generate_subscripts(string_split(text || chr(10), chr(10)), 1) AS i FROM blk)
, num AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY ord, i) AS line, source_line, text FROM ln)"""


@query("publish_lines", lifted("nodes rows outline_prefixes", LINES + " SELECT doc, line, text FROM num"))
def publish_lines(spark, sf):
    return X.published_lines(X.blocks(*parts(spark, sf))).select("doc", "line", "text")


@query("publish", lifted("nodes rows outline_prefixes", LINES + " SELECT doc, line, text FROM num"))
def publish(spark, sf):
    """Documents written as text files and read back, in the order of the files."""
    folder = f"{ensure_checkpoint_dir(spark)}/published-{uuid.uuid4().hex}"
    X.publish(X.blocks(*parts(spark, sf)), folder)
    return sinks.read_lines_back(spark, folder, ["doc"])


OPEN = "regexp_extract(text, '^(Class|Individual|Ontology): (\\S+)', {n})"


@query("line_map", lifted("nodes rows outline_prefixes", LINES + f"""
SELECT doc, line, {OPEN.format(n=2)} AS uri, {OPEN.format(n=1)} AS frame, source_line FROM num
WHERE {OPEN.format(n=1)} <> ''"""))
def line_map(spark, sf):
    return X.line_map(X.published_lines(X.blocks(*parts(spark, sf))))


@query("lookup_lines", lifted("nodes rows outline_prefixes", LINES + f"""
SELECT doc, line, last_value(nullif({OPEN.format(n=2)}, '') IGNORE NULLS) OVER w AS uri,
  last_value(CASE WHEN {OPEN.format(n=2)} <> '' THEN source_line END IGNORE NULLS) OVER w AS source_line FROM num
WINDOW w AS (PARTITION BY doc ORDER BY line)"""))
def lookup_lines(spark, sf):
    return X.lookup_lines(X.published_lines(X.blocks(*parts(spark, sf))))


@query("to_outline", lifted("edges_acyclic", """
, t AS (SELECT 'P' || p_partkey AS id, [lower(p_name), 'p' || p_partkey] AS k FROM part)
, h(id, level, path) AS (SELECT id, 1, [k] FROM t WHERE id = 'P0' UNION ALL
  SELECT t.id, level + 1, list_append(path, t.k) FROM h JOIN edges_acyclic e ON e.parent = h.id JOIN t ON t.id = e.child)
, o AS (SELECT id, level, row_number() OVER (ORDER BY path) AS place FROM h)
SELECT place, v.line, p_partkey % 4 = 0 AND o.id NOT IN (SELECT parent FROM edges_acyclic) AS apart, o.id, v.text
FROM o JOIN part ON o.id = 'P' || p_partkey, LATERAL (VALUES (CAST(-1 AS BIGINT), repeat('*', level + 2) || ' ' || p_name || ' (' || o.id || ')'),
  (1, ' - ex:brand :: ' || p_brand), (2, ' - ex:size :: ' || p_size)) v(line, text)"""))
def to_outline(spark, sf):
    key = F.col("p_partkey")
    part = lift.read(spark, sf, "part").withColumn("id", F.concat(F.lit("P"), key.cast("string")))
    cells = [("rdf:type", F.lit("owl:Class")), ("ex:brand", F.col("p_brand")), ("ex:size", F.col("p_size").cast("string"))]
    rows = part.select("id", F.inline(F.array(*[
        F.struct(F.lit(p).alias("prop"), v.alias("value"), F.lit(i).alias("ord")) for i, (p, v) in enumerate(cells)])))
    marks = part.where(key % 4 == 0).select("id", F.lit("owl:deprecated").alias("prop"), F.lit("true").alias("value"))
    edges = lift.edges_acyclic(spark, sf)
    ents = part.select("id", F.col("p_name").alias("label"))
    return X.to_outline(ents, rows, edges, G.split_deprecated(ents, marks, edges))


MARK = "#+CHECKSUM: "


@query("content_checksum", f"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '^\\n+', ''), '\\n+$', '') || chr(10) || 'end') AS checksum,
  doc_id % 3 = 0 AS pristine FROM documents""")
def content_checksum(spark, sf):
    key = F.col("doc_id")
    body = F.concat(F.regexp_replace(F.regexp_replace("text", r"^\n+", ""), r"\n+$", ""), F.lit("\nend"))
    stamp = F.when(key % 3 == 0, F.upper(F.sha2(body, 256))).when(key % 3 == 1, F.sha2("text", 256))
    whole = F.coalesce(F.concat(F.lit(MARK), stamp, F.lit("\n"), body), body)
    docs = lift.read(spark, sf, "documents").select("doc_id", whole.alias("t"))
    return docs.select("doc_id", X.content_checksum(F.col("t"), MARK).alias("checksum"),
                       X.is_pristine(F.col("t"), MARK).alias("pristine"))


@query("expand_bare_prefix", """
SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN '<http://data.example.org/part/>' WHEN 1 THEN 'zz:' ELSE 'part:P' || p_partkey END AS value
FROM part""")
def expand_bare_prefix(spark, sf):
    key = F.col("p_partkey")
    rows = lift.read(spark, sf, "part").select(key.alias("k"), F.when(key % 3 == 0, "part:").when(
        key % 3 == 1, "zz:").otherwise(F.concat(F.lit("part:P"), key.cast("string"))).alias("value"))
    return X.expand_bare_prefix(rows, lift.prefixes(spark, sf).where("source = 'part'").select("prefix", "expansion"), [])


@query("section_value", lifted("rows", """
SELECT doc, node_id, arg_min(value, (NOT regexp_matches(value, 'ex:|brand'), row_id)) AS value FROM rows
WHERE regexp_matches(tag, '^(rdfs:comment|Types)$') GROUP BY doc, node_id"""))
def section_value(spark, sf):
    return X.section_value(outlines.rows(spark, sf), "^(rdfs:comment|Types)$", "ex:|brand")
