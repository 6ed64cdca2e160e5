"""Taxonomy queries: edges, cycles, closure, hierarchies, types, axiom summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import outlines, query
from catalog.lift_sql import lifted
from termweave.operators import closure as C
from termweave.operators import taxonomy as G
from termweave.sources import lift

UP = """
, up AS (SELECT n.*, p.uri AS parent_uri, p.node_id AS pid FROM nodes n LEFT JOIN nodes p
    ON p.doc = n.doc AND p.node_id = n.parent_id)"""


@query("parent_edges", lifted("nodes", UP + """
SELECT doc, node_id, uri, 'SubClassOf' AS keyword, parent_uri AS parent FROM up
WHERE uri IS NOT NULL AND parent_uri IS NOT NULL AND rdf_type IN ('owl:NamedIndividual', 'owl:Class')"""))
def parent_edges(spark, sf):
    nodes = outlines.nodes(spark, sf).withColumn("rdf_type", F.when(
        F.col("rdf_type") == "owl:NamedIndividual", "owl:Class").otherwise(F.col("rdf_type")))
    return G.parent_edges(nodes, outlines.rows(spark, sf))


@query("relation_facts", lifted("nodes", UP + """
SELECT doc, node_id, uri, 'Facts' AS keyword, 'ex:partOf ' || parent_uri AS value FROM up
WHERE uri IS NOT NULL AND parent_uri IS NOT NULL AND rdf_type = 'owl:NamedIndividual'"""))
def relation_facts(spark, sf):
    return G.relation_facts(outlines.nodes(spark, sf), outlines.rows(spark, sf))


@query("immediate_parents", lifted("nodes rows", UP + """
, a AS (SELECT doc, uri, parent_uri AS parent, -1 AS ord FROM up WHERE uri IS NOT NULL AND parent_uri IS NOT NULL
  UNION ALL SELECT n.doc, uri, value, row_id FROM nodes n JOIN rows r USING (doc, node_id)
    WHERE tag = 'SubClassOf' AND uri IS NOT NULL)
SELECT doc, uri, parent, CAST(row_number() OVER (PARTITION BY doc, uri ORDER BY ord) AS INTEGER) AS place FROM a"""))
def immediate_parents(spark, sf):
    return G.immediate_parents(outlines.nodes(spark, sf), outlines.rows(spark, sf))


@query("children", """
WITH e AS (SELECT DISTINCT 'S' || l_suppkey AS parent, 'P' || l_partkey AS child FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY child) AS place FROM e)
SELECT parent, child, CAST(place AS INTEGER) AS place, CAST(0 AS BIGINT) AS omitted FROM r""")
def children(spark, sf):
    return G.children(supplied(spark, sf))


@query("children_limited", """
WITH e AS (SELECT DISTINCT 'S' || l_suppkey AS parent, 'P' || l_partkey AS child FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY child) AS place,
  greatest(count(*) OVER (PARTITION BY parent) - 200, 0) AS omitted FROM e)
SELECT parent, child, CAST(place AS INTEGER) AS place, omitted FROM r WHERE place <= 200""")
def children_limited(spark, sf):
    return G.children(supplied(spark, sf), 200)


def supplied(spark, sf):
    return lift.read(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("parent"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("child")).distinct()


SUPERS = """
WITH s AS (SELECT 'part:P' || l_partkey AS child, 'supplier:S' || l_suppkey AS parent FROM lineitem WHERE l_partkey % 3 <> 0
  UNION ALL SELECT 'part:P' || p_partkey, 'owl:Thing' FROM part),
q AS (SELECT 'part:P' || l_partkey AS child, 'nation:N' || (l_suppkey % 25) AS parent FROM lineitem),
b AS (SELECT child, parent FROM (SELECT *, 0 AS k FROM s WHERE parent <> 'owl:Thing' UNION ALL SELECT *, 1 FROM q)
  QUALIFY row_number() OVER (PARTITION BY child ORDER BY k, split_part(parent, ':', 2), parent) = 1)"""


def supers(spark, sf):
    line, key = lift.read(spark, sf, "lineitem"), F.col("l_partkey")
    child = F.concat(F.lit("part:P"), key.cast("string")).alias("child")
    named = line.where(key % 3 != 0).select(
        child, F.concat(F.lit("supplier:S"), F.col("l_suppkey").cast("string")).alias("parent"))
    thing = lift.read(spark, sf, "part").select(
        F.concat(F.lit("part:P"), F.col("p_partkey").cast("string")), F.lit("owl:Thing"))
    equal = line.select(child, F.concat(F.lit("nation:N"), (F.col("l_suppkey") % 25).cast("string")).alias("parent"))
    return named.union(thing), equal


@query("primary_parent", SUPERS + " SELECT child, parent FROM b")
def primary_parent(spark, sf):
    return G.primary_parent(*supers(spark, sf))


@query("extra_supers", SUPERS + " SELECT s.child, s.parent FROM s ANTI JOIN b USING (child, parent)")
def extra_supers(spark, sf):
    named, equal = supers(spark, sf)
    return G.extra_supers(named, G.primary_parent(named, equal))


CYCLES = """
, img(step, node) AS (SELECT 0, child FROM edges_cyclic
  UNION ALL SELECT * FROM (SELECT DISTINCT step + 1, parent FROM img JOIN edges_cyclic ON child = node
    WHERE step < (SELECT count(*) FROM part)))
, cyc AS (SELECT node FROM img WHERE step = (SELECT max(step) FROM img))
, walk(child, here, k) AS (SELECT node, node, 0 FROM cyc
  UNION ALL SELECT w.child, e.parent, k + 1 FROM walk w JOIN edges_cyclic e ON e.child = w.here WHERE k < (SELECT count(*) FROM cyc))
, name AS (SELECT child, min(here) AS cycle FROM walk GROUP BY child)
, wt AS (SELECT 'P' || l_partkey AS child, count(*) AS n FROM lineitem GROUP BY 1)
, root AS (SELECT name.child, cycle FROM name LEFT JOIN wt USING (child)
  QUALIFY row_number() OVER (PARTITION BY cycle ORDER BY coalesce(n, 0) DESC, name.child) = 1)"""


@query("cycle_nodes", lifted("edges_cyclic", CYCLES + " SELECT node FROM cyc"))
def cycle_nodes(spark, sf):
    return C.cycle_nodes(lift.edges_cyclic(spark, sf)).select(F.col("child").alias("node"))


@query("break_cycles", lifted("edges_cyclic", CYCLES + """
 SELECT child, parent FROM edges_cyclic WHERE child NOT IN (SELECT child FROM root)"""))
def break_cycles(spark, sf):
    weight = lift.read(spark, sf, "lineitem").groupBy(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("child")).agg(F.count(F.lit(1)).alias("n"))
    return G.break_cycles(lift.edges_cyclic(spark, sf), weight)


@query("top_level", lifted("edges_acyclic", """
SELECT 'P' || p_partkey AS id FROM part WHERE p_partkey % 3 <> 0 AND (p_partkey = 0 OR (p_partkey // 2) % 3 = 0)"""))
def top_level(spark, sf):
    ids = lift.read(spark, sf, "part").where("p_partkey % 3 <> 0").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"))
    return G.top_level(ids, lift.edges_acyclic(spark, sf))


@query("ordered_hierarchy", lifted("edges_acyclic", """
, t AS (SELECT 'P' || p_partkey AS id, [lower(p_name), 'p' || p_partkey] AS k FROM part)
, h(id, level, path) AS (SELECT id, 1, [k] FROM t WHERE id = 'P0' UNION ALL
  SELECT t.id, level + 1, list_append(path, t.k) FROM h JOIN edges_acyclic e ON e.parent = h.id JOIN t ON t.id = e.child)
SELECT id, level, row_number() OVER (ORDER BY path) AS place FROM h"""))
def ordered_hierarchy(spark, sf):
    part = lift.read(spark, sf, "part")
    terms = part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"),
                        F.col("p_name").alias("sort_key"))
    return G.ordered_hierarchy(terms, lift.edges_acyclic(spark, sf))


@query("sort_key", lifted("entities", """
, x AS (SELECT id, CASE WHEN source = 'sales' THEN NULL ELSE label END AS label FROM entities
  UNION ALL SELECT url, '' FROM pages)
SELECT id, CASE WHEN coalesce(label, '') <> '' THEN label WHEN NOT contains(id, '://') THEN split_part(id, ':', -1)
  WHEN regexp_extract(id, '([^#/]*)$', 1) <> '' THEN regexp_extract(id, '([^#/]*)$', 1) ELSE id END AS sort_key FROM x"""))
def sort_key(spark, sf):
    rows = lift.entities(spark, sf).select(
        "id", F.when(F.col("source") != "sales", F.col("label")).alias("label")).union(
        lift.read(spark, sf, "pages").select("url", F.lit("")))
    return rows.select("id", G.sort_key(F.col("label"), F.col("id")).alias("sort_key"))


TYPED = """
WITH ty AS (SELECT DISTINCT 'part:P' || l_partkey AS id, 'T' || (l_suppkey % 40) AS type FROM lineitem),
e AS (SELECT DISTINCT 'T' || (s_suppkey % 40) AS child, 'T' || ((s_suppkey % 40) // 2) AS parent FROM supplier),
imp AS (SELECT DISTINCT id, parent AS type FROM ty JOIN e ON child = type WHERE parent <> type),
best AS (SELECT ty.id, ty.type FROM ty LEFT JOIN imp ON imp.id = ty.id AND imp.type = ty.type
  QUALIFY row_number() OVER (PARTITION BY ty.id ORDER BY imp.id IS NOT NULL, lower('k' || substr(ty.type, 2)), ty.type) = 1)"""


def typed(spark, sf):
    types = lift.read(spark, sf, "lineitem").select(
        F.concat(F.lit("part:P"), F.col("l_partkey").cast("string")).alias("id"),
        F.concat(F.lit("T"), (F.col("l_suppkey") % 40).cast("string")).alias("type"))
    n = F.col("s_suppkey") % 40
    edges = lift.read(spark, sf, "supplier").select(
        F.concat(F.lit("T"), n.cast("string")).alias("child"),
        F.concat(F.lit("T"), F.floor(n / 2).cast("string")).alias("parent")).distinct()
    keys = types.select("type").distinct().withColumn("sort_key", F.concat(F.lit("K"), F.substring("type", 2, 9)))
    return types, edges, keys


@query("most_specific_type", TYPED + " SELECT id, type FROM best")
def most_specific_type(spark, sf):
    return G.most_specific_type(*typed(spark, sf))


@query("group_by_type", TYPED + """
, g AS (SELECT 'part:P' || p_partkey AS id, coalesce('Kind ' || (CAST(substr(type, 2) AS INTEGER) % 7), 'Unknown') AS lab
  FROM part LEFT JOIN best ON best.id = 'part:P' || p_partkey)
SELECT lab AS type_label, id FROM g""")
def group_by_type(spark, sf):
    types, edges, keys = typed(spark, sf)
    n = F.substring("type", 2, 9).cast("int")
    # Labels that differ in case only fall into one group.
    labels = keys.select(F.col("type").alias("id"), F.concat(
        F.when(n % 2 == 0, "Kind ").otherwise("kind "), (n % 7).cast("string")).alias("label"))
    individuals = lift.read(spark, sf, "part").select(
        F.concat(F.lit("part:P"), F.col("p_partkey").cast("string")).alias("id"))
    rows = G.group_by_type(individuals, G.most_specific_type(types, edges, keys), labels)
    return rows.withColumn("type_label", F.when(F.col("type_label") == "Unknown", "Unknown").otherwise(
        F.concat(F.lit("Kind "), F.substring("type_label", 6, 9))))


@query("split_deprecated", lifted("edges_acyclic", """
SELECT 'P' || p_partkey AS id, p_partkey % 4 = 0 AS deprecated,
  p_partkey % 4 = 0 AND 'P' || p_partkey NOT IN (SELECT parent FROM edges_acyclic) AS apart FROM part"""))
def split_deprecated(spark, sf):
    key = F.col("p_partkey")
    ids = lift.read(spark, sf, "part").select(F.concat(F.lit("P"), key.cast("string")).alias("id"), key)
    marks = ids.where(key % 2 == 0).select("id", F.lit("owl:deprecated").alias("prop"), F.when(
        key % 4 == 0, F.when(key % 8 == 0, "true").otherwise('"true"^^xsd:boolean')).otherwise("false").alias("value"))
    return G.split_deprecated(ids, marks, lift.edges_acyclic(spark, sf))


_TC = """
, tc(src, dst) AS (SELECT child, parent FROM {t} UNION SELECT tc.src, e.parent FROM tc JOIN {t} e ON e.child = tc.dst)"""


def hop(frame):
    return frame.select(F.col("child").alias("src"), F.col("parent").alias("dst"))


@query("closure", lifted("edges_acyclic", _TC.replace("{t}", "edges_acyclic") + " SELECT src, dst FROM tc"))
def closure(spark, sf):
    return C.closure(hop(lift.edges_acyclic(spark, sf)))


@query("closure_cyclic", lifted("edges_cyclic", _TC.replace("{t}", "edges_cyclic") + " SELECT src, dst FROM tc"))
def closure_cyclic(spark, sf):
    return C.closure(hop(lift.edges_cyclic(spark, sf)))


@query("closure_reverse_reflexive", lifted("edges_acyclic", _TC.replace("{t}", "edges_acyclic") + """
 SELECT dst AS src, src AS dst FROM tc UNION SELECT 'P' || p_partkey, 'P' || p_partkey FROM part"""))
def closure_reverse_reflexive(spark, sf):
    return C.closure(hop(lift.edges_acyclic(spark, sf)), 0, reverse=True)


IMPORTS = """
WITH RECURSIVE imp AS (SELECT 'o' || n_nationkey AS ontology, 'o' || ((2 * n_nationkey + 1) % 25) AS imported, 0 AS pos FROM nation
  UNION ALL SELECT 'o' || n_nationkey, 'o' || ((3 * n_nationkey + 2) % 25), 1 FROM nation WHERE n_nationkey % 3 = 0),
roots AS (SELECT 'o' || r_regionkey AS root FROM region),
walk(root, ontology, path, seen) AS (SELECT root, root, CAST([] AS INTEGER[]), [root] FROM roots
  UNION ALL SELECT root, imported, list_append(path, pos), list_append(seen, imported) FROM walk JOIN imp USING (ontology)
    WHERE NOT list_contains(seen, imported)),
ord AS (SELECT root, ontology, min(path) AS path FROM walk GROUP BY root, ontology)"""


def imports(spark, sf):
    k = F.col("n_nationkey")

    def o(n):
        return F.concat(F.lit("o"), n.cast("string"))

    nation = lift.read(spark, sf, "nation")
    links = nation.select(o(k).alias("ontology"), o((k * 2 + 1) % 25).alias("imported"), F.lit(0).alias("pos")).union(
        nation.where(k % 3 == 0).select(o(k), o((k * 3 + 2) % 25), F.lit(1)))
    roots = lift.read(spark, sf, "region").select(o(F.col("r_regionkey")).alias("root"))
    return G.import_order(links, roots)


@query("import_order", IMPORTS + " SELECT root, ontology, array_to_string(path, ',') AS path FROM ord")
def import_order(spark, sf):
    return imports(spark, sf).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ","))


_PROPS = {0: "http://www.w3.org/2000/01/rdf-schema#label", 1: "http://www.w3.org/2004/02/skos/core#prefLabel",
          2: "http://xmlns.com/foaf/0.1/name"}


@query("import_label", IMPORTS + f"""
, l AS (SELECT 'e' || (doc_id % 50) AS id, 'o' || (doc_id % 7 + 1) AS ontology,
    CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 4 END AS rank, text AS value, lang, doc_id FROM documents)
SELECT root, id, CASE WHEN lang <> '' THEN '"' || value || '"@' || lang ELSE value END AS label, ontology
FROM l JOIN ord USING (ontology)
QUALIFY row_number() OVER (PARTITION BY root, id ORDER BY path, rank, NOT starts_with(lang, 'en'), doc_id) = 1""")
def import_label(spark, sf):
    key = F.col("doc_id")
    prop = F.when(key % 3 == 0, _PROPS[0]).when(key % 3 == 1, _PROPS[1]).otherwise(_PROPS[2])
    labels = lift.read(spark, sf, "documents").select(
        F.concat(F.lit("e"), (key % 50).cast("string")).alias("id"),
        F.concat(F.lit("o"), (key % 7 + 1).cast("string")).alias("ontology"), prop.alias("prop"),
        F.col("text").alias("value"), "lang", key.alias("ord"))
    return G.import_label(labels, imports(spark, sf))


NARY = """
WITH m AS (SELECT l_orderkey, l_returnflag, list('part:P' || l_partkey ORDER BY 'part:P' || l_partkey) AS a,
    list(DISTINCT 'part:P' || l_partkey ORDER BY 'part:P' || l_partkey) AS d FROM lineitem GROUP BY ALL),
k AS (SELECT CASE l_returnflag WHEN 'A' THEN 'EquivalentClasses' WHEN 'N' THEN 'DisjointClasses' ELSE 'DifferentIndividuals' END AS keyword,
    CASE WHEN l_returnflag IN ('A', 'N') THEN a ELSE d END AS m FROM m)
SELECT DISTINCT keyword, keyword || ' :: ' || array_to_string(m, ', ') AS clause FROM k WHERE len(m) > 2"""


def member_axioms(spark, sf):
    # An order has a handful of lines.
    line = lift.read(spark, sf, "lineitem")
    rows = line.groupBy("l_orderkey", "l_returnflag").agg(F.collect_list(
        F.concat(F.lit("part:P"), F.col("l_partkey").cast("string"))).alias("members"))
    keyword = F.when(F.col("l_returnflag") == "A", "EquivalentClasses").when(
        F.col("l_returnflag") == "N", "DisjointClasses").otherwise("DifferentIndividuals")
    return rows.select(keyword.alias("keyword"), "members")


@query("nary_clauses", NARY)
def nary_clauses(spark, sf):
    return G.nary_clauses(member_axioms(spark, sf))


@query("general_axioms", """
WITH a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'SubClassOf' ELSE 'EquivalentTo' END AS keyword,
  l_partkey, l_suppkey FROM lineitem)
SELECT keyword, l_orderkey AS ord, l_partkey AS part FROM a
WHERE (keyword = 'SubClassOf' AND l_partkey % 3 = 0) OR (keyword = 'EquivalentTo' AND l_suppkey % 5 = 0)""")
def general_axioms(spark, sf):
    line = lift.read(spark, sf, "lineitem")
    part = F.concat(F.lit("part:P"), F.col("l_partkey").cast("string"))
    some = F.concat(F.lit("ex:has some "), part)
    rows = line.select(
        F.when(F.col("l_linenumber") % 2 == 0, "SubClassOf").otherwise("EquivalentTo").alias("keyword"),
        F.when(F.col("l_partkey") % 3 == 0, some).otherwise(part).alias("subject"),
        F.array(some, F.when(F.col("l_suppkey") % 5 == 0, some).otherwise(part)).alias("members"),
        F.col("l_orderkey").alias("ord"), F.col("l_partkey").alias("part"))
    return G.general_axioms(rows).select("keyword", "ord", "part")


@query("characteristics", """
WITH f AS (SELECT 'p' || (o_custkey % 300) AS id, ['Functional', 'InverseFunctional', 'Transitive', 'Symmetric',
    'Asymmetric', 'Reflexive', 'Irreflexive', 'Odd'][o_orderkey % 8 + 1] AS flag FROM orders),
k AS (SELECT DISTINCT id, flag, list_position(['Functional', 'InverseFunctional', 'Transitive', 'Symmetric',
    'Asymmetric', 'Reflexive', 'Irreflexive'], flag) AS n FROM f WHERE flag <> 'Odd')
SELECT id, string_agg(flag, ', ' ORDER BY n) AS characteristics FROM k GROUP BY id""")
def characteristics(spark, sf):
    names = F.array(*[F.lit(n) for n in [*G.K.CHARACTERISTICS, "Odd"]])
    flags = lift.read(spark, sf, "orders").select(
        F.concat(F.lit("p"), (F.col("o_custkey") % 300).cast("string")).alias("id"),
        F.element_at(names, (F.col("o_orderkey") % 8 + 1).cast("int")).alias("flag"))
    return G.characteristics(flags)


@query("metrics", lifted("all_rows", """
SELECT coalesce(source, '*') AS source, CAST(count_if(prop = 'rdf:type' AND value = 'owl:Class') AS BIGINT) AS classes,
  CAST(count_if(prop = 'rdf:type' AND value = 'owl:ObjectProperty') AS BIGINT) AS object_properties,
  CAST(count_if(prop = 'rdf:type' AND value = 'owl:DatatypeProperty') AS BIGINT) AS data_properties,
  CAST(count_if(prop = 'rdf:type' AND value = 'owl:AnnotationProperty') AS BIGINT) AS annotation_properties,
  CAST(count_if(prop = 'rdf:type' AND value = 'owl:NamedIndividual') AS BIGINT) AS individuals, count(*) AS axioms,
  CAST(count_if(prop IN ('Types', 'SubClassOf', 'SameAs', 'Facts', 'Domain') AND value <> '') AS BIGINT) AS logical_axioms
FROM all_rows GROUP BY ROLLUP (source)"""))
def metrics(spark, sf):
    return G.metrics(lift.index(spark, sf, True).attributes)


@query("signature", lifted("attributes", """
, d AS (SELECT DISTINCT id, value AS kind FROM attributes WHERE prop = 'rdf:type')
, r AS (SELECT * FROM (VALUES ('owl:Class', 'owl:Class'), ('owl:Class', 'owl:ObjectProperty'), ('owl:Class', 'owl:DatatypeProperty'),
  ('owl:Class', 'rdfs:Datatype'), ('owl:Class', 'owl:NamedIndividual'), ('owl:ObjectProperty', 'owl:Class'),
  ('owl:ObjectProperty', 'owl:ObjectProperty'), ('owl:AnnotationProperty', 'owl:Class'), ('owl:AnnotationProperty', 'owl:ObjectProperty'),
  ('owl:AnnotationProperty', 'owl:DatatypeProperty'), ('owl:AnnotationProperty', 'owl:AnnotationProperty'),
  ('owl:AnnotationProperty', 'owl:NamedIndividual'), ('owl:AnnotationProperty', 'rdfs:Datatype'),
  ('owl:NamedIndividual', 'owl:Class'), ('owl:NamedIndividual', 'owl:ObjectProperty'), ('owl:NamedIndividual', 'owl:DatatypeProperty'),
  ('owl:NamedIndividual', 'owl:NamedIndividual'), ('owl:NamedIndividual', 'rdfs:Datatype')) v(subject_kind, kind))
SELECT subject_kind, kind, (SELECT count(*) FROM d WHERE d.kind = r.kind) AS n FROM r"""))
def signature(spark, sf):
    declared = lift.attributes(spark, sf).where("prop = 'rdf:type'").select(
        "id", F.col("value").alias("kind")).distinct()
    return G.signature(declared, declared)
