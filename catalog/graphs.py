"""Graph pattern queries over the lifted triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.lift_sql import lifted
from termweave.operators import patterns as Q
from termweave.sources import lift

T = """
, tri AS (SELECT DISTINCT id AS s, CASE prop WHEN 'SubClassOf' THEN 'rdfs:subClassOf' WHEN 'SubPropertyOf' THEN 'rdfs:subPropertyOf'
    WHEN 'Types' THEN 'rdf:type' ELSE prop END AS p, value AS o,
    CASE WHEN regexp_matches(value, '^(<[^<>\\s]+>|https?://\\S+|([A-Za-z_][-\\w.]*)?:[A-Za-z_][-\\w./]*)$')
      THEN 'iri' ELSE 'literal' END AS o_kind, lang, source FROM all_rows)"""


def graph(spark, sf):
    """A view, not a table: the constants of a pattern filter the index before rows are made distinct."""
    return Q.triples(lift.index(spark, sf, True).attributes)


def sql(body):
    return lifted("all_rows", T + body)


@query("triples", sql(" SELECT * FROM tri"))
def triples(spark, sf):
    return Q.triples(lift.index(spark, sf, True).attributes)


@query("match", sql("""
SELECT a.s AS x, a.o AS t, b.o AS name FROM tri a JOIN tri b ON a.s = b.s
WHERE a.p = 'rdf:type' AND a.o <> 'owl:NamedIndividual' AND b.p = 'rdfs:label'"""))
def match(spark, sf):
    found = Q.match(graph(spark, sf), [("?x", "rdf:type", "?t"), ("?x", "rdfs:label", "?name")])
    return found.where("t <> 'owl:NamedIndividual'")


@query("match_chain", sql("""
SELECT a.s AS x, a.o AS nation, b.o AS region FROM tri a JOIN tri b ON b.s = a.o
WHERE a.p = 'rdf:type' AND b.p = 'rdfs:subClassOf' AND EXISTS (SELECT 1 FROM tri c WHERE c.s = a.s AND c.p = 'rdf:type' AND c.o = 'owl:NamedIndividual')"""))
def match_chain(spark, sf):
    return Q.match(graph(spark, sf), [("?nation", "rdfs:subClassOf", "?region"),
                                      ("?x", "rdf:type", "owl:NamedIndividual"),
                                      ("?x", "rdf:type", "?nation")])


@query("optional", sql("""
SELECT a.s AS x, b.o AS definition FROM (SELECT DISTINCT s FROM tri WHERE p = 'rdf:type' AND o = 'owl:NamedIndividual') a
LEFT JOIN tri b ON b.s = a.s AND b.p = 'skos:definition'"""))
def optional(spark, sf):
    g = graph(spark, sf)
    return Q.optional(Q.match(g, [("?x", "rdf:type", "owl:NamedIndividual")]).distinct(),
                      Q.match(g, [("?x", "skos:definition", "?definition")]))


@query("exists", sql("""
SELECT DISTINCT s AS x FROM tri WHERE p = 'rdf:type' AND o = 'owl:NamedIndividual'
AND s IN (SELECT s FROM tri WHERE p = 'Domain')"""))
def exists(spark, sf):
    g = graph(spark, sf)
    return Q.exists(Q.match(g, [("?x", "rdf:type", "owl:NamedIndividual")]),
                    Q.match(g, [("?x", "Domain", "?d")]))


@query("not_exists", sql("""
SELECT DISTINCT s AS x FROM tri WHERE p = 'rdf:type' AND o = 'owl:NamedIndividual'
AND s NOT IN (SELECT s FROM tri WHERE p = 'rdfs:label')"""))
def not_exists(spark, sf):
    g = graph(spark, sf)
    return Q.not_exists(Q.match(g, [("?x", "rdf:type", "owl:NamedIndividual")]),
                        Q.match(g, [("?x", "rdfs:label", "?d")]))


@query("exists_flag", sql("""
SELECT DISTINCT s AS x, s IN (SELECT s FROM tri WHERE p = 'rdfs:label') AS labelled
FROM tri WHERE p = 'rdf:type' AND o = 'owl:NamedIndividual'"""))
def exists_flag(spark, sf):
    g = graph(spark, sf)
    return Q.exists_flag(Q.match(g, [("?x", "rdf:type", "owl:NamedIndividual")]),
                         Q.match(g, [("?x", "rdfs:label", "?d")]), "labelled")


@query("values", sql(" SELECT s AS x, o AS t FROM tri WHERE p = 'rdf:type' AND o IN ('ptype:PROMO', 'ptype:SMALL', 'nation:N3')"))
def values(spark, sf):
    return Q.values(Q.match(graph(spark, sf), [("?x", "rdf:type", "?t")]), "t",
                    ["ptype:PROMO", "ptype:SMALL", "nation:N3"]).select("x", "t")


@query("filter", sql("""
SELECT s AS x, p, o AS v FROM tri WHERE (o_kind = 'iri' AND s < o) OR (o_kind = 'literal' AND lang IN ('en', 'ko'))"""))
def filter_(spark, sf):
    found = Q.match(graph(spark, sf), [("?x", "?p", "?v")], detail=True)
    return found.where((Q.is_iri("v") & (F.col("x") < F.col("v")))
                       | ((F.col("v_kind") == "literal") & Q.lang_in("v", ["en", "ko"]))).select("x", "p", "v")


@query("count_by", sql("""
, k AS (SELECT DISTINCT s AS x FROM tri WHERE p = 'rdf:type' AND o = 'owl:NamedIndividual')
SELECT x, (SELECT count(*) FROM tri WHERE s = x AND p = 'Facts') AS facts FROM k"""))
def count_by(spark, sf):
    g = graph(spark, sf)
    return Q.count_by(Q.match(g, [("?x", "rdf:type", "owl:NamedIndividual")]).distinct(),
                      Q.match(g, [("?x", "Facts", "?f")]), "f", "facts")


@query("concat_by", sql("""
SELECT s, string_agg(t, ';;' ORDER BY t) AS text FROM (SELECT DISTINCT s, p || ';;' || o AS t FROM tri
  WHERE p IN ('ex:brand', 'ex:size', 'rdf:type')) GROUP BY s"""))
def concat_by(spark, sf):
    g = graph(spark, sf).where("p in ('ex:brand', 'ex:size', 'rdf:type')")
    return Q.concat_by(g, "s", ["p", "o"])


@query("top", sql("""
SELECT x, n FROM (SELECT o AS x, count(*) AS n FROM tri WHERE p = 'rdf:type' GROUP BY o) ORDER BY n DESC, x LIMIT 10"""))
def top(spark, sf):
    found = Q.match(graph(spark, sf), [("?s", "rdf:type", "?x")]).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    return Q.top(found, [F.desc("n"), "x"], 10)


@query("construct", sql("""
, m AS (SELECT a.s AS x, a.o AS n, b.o AS r FROM tri a LEFT JOIN tri b ON b.s = a.o AND b.p = 'rdfs:subClassOf'
  WHERE a.p = 'rdf:type' AND a.o <> 'owl:NamedIndividual')
SELECT x AS s, 'ex:in' AS p, r AS o FROM m WHERE r IS NOT NULL UNION SELECT n, 'ex:holds', x FROM m"""))
def construct(spark, sf):
    g = graph(spark, sf)
    found = Q.optional(Q.match(g, [("?x", "rdf:type", "?n")]).where("n <> 'owl:NamedIndividual'"),
                       Q.match(g, [("?n", "rdfs:subClassOf", "?r")]))
    return Q.construct(found, [("?x", "ex:in", "?r"), ("?n", "ex:holds", "?x")])


def edge_graph(spark, sf):
    e = lift.edges_acyclic(spark, sf)
    return e.select(F.col("child").alias("s"), F.lit("ex:up").alias("p"), F.col("parent").alias("o"))


@query("path", lifted("edges_acyclic", """
, tc(s, o) AS (SELECT child, parent FROM edges_acyclic UNION SELECT tc.s, e.parent FROM tc JOIN edges_acyclic e ON e.child = tc.o)
SELECT s, o FROM tc UNION SELECT 'P' || p_partkey, 'P' || p_partkey FROM part"""))
def path(spark, sf):
    return Q.path(edge_graph(spark, sf), "ex:up", "*")


@query("ask", "SELECT count(*) > 0 AS answer FROM lineitem WHERE l_partkey % 50 = 0")
def ask(spark, sf):
    return Q.ask(Q.match(graph(spark, sf), [("?x", "Domain", "region:R1")]))


@query("restrictions", """
SELECT 'part:P' || p_partkey AS cls, 'ex:size' AS property, CASE WHEN p_size % 2 = 0 THEN 'owl:someValuesFrom'
  ELSE 'owl:allValuesFrom' END AS quantifier, 'ex:S' || p_size AS filler FROM part""")
def restrictions(spark, sf):
    key = F.col("p_partkey").cast("string")
    node = F.concat(F.lit("_:r"), key)
    cells = [(F.concat(F.lit("part:P"), key), F.lit("rdfs:subClassOf"), node),
             (node, F.lit("owl:onProperty"), F.lit("ex:size")),
             (node, F.when(F.col("p_size") % 2 == 0, "owl:someValuesFrom").otherwise("owl:allValuesFrom"),
              F.concat(F.lit("ex:S"), F.col("p_size").cast("string")))]
    rows = lift.read(spark, sf, "part").select(F.inline(F.array(*[
        F.struct(s.alias("s"), p.alias("p"), o.alias("o")) for s, p, o in cells])))
    return Q.restrictions(rows)


@query("label_harvest", sql("""
, l AS (SELECT DISTINCT s, o AS label FROM tri WHERE p = 'rdfs:label' AND lang IN ('', 'en'))
, pr AS (SELECT s, string_agg(t, ';;' ORDER BY t) AS plist FROM (SELECT DISTINCT s, p || ';;' || o AS t FROM tri
    WHERE p IN ('rdf:type', 'skos:definition') AND lang IN ('', 'en')) GROUP BY s)
SELECT s, label, plist FROM l LEFT JOIN pr USING (s)"""))
def label_harvest(spark, sf):
    return Q.label_harvest(graph(spark, sf))
