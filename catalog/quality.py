"""Quality check queries: over outline documents and over the lifted index."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import outlines, query
from catalog.lift_sql import lifted, values
from termweave import constants as K
from termweave.operators import checks as C
from termweave.operators.identifiers import ontology_ids
from termweave.sources import lift


# --- outline documents --------------------------------------------------------------

def issue(check, severity, source, subject, row_ord, message, rest):
    return (f"SELECT '{check}' AS \"check\", '{severity}' AS severity, {source} AS source, {subject} AS subject, "
            f"CAST({row_ord} AS BIGINT) AS row_ord, {message} AS message {rest}")


DESC = """
, descr AS (SELECT r.doc AS source, n.uri AS subject, CASE WHEN node_id = 29 THEN '-class-hierarchy'
    WHEN node_id >= 1000 THEN '-individuals' END AS section, tag, value, row_id AS row_ord
  FROM rows r JOIN nodes n USING (doc, node_id) WHERE node_id < 1000 OR n % 8 <> 0)"""
OUT = {
    "identity": issue("identity", "error", "doc", "title", "node_id", "'ERROR: heading declares no identifier'",
                      "FROM nodes WHERE node_id >= 1000 AND n % 8 <> 0 AND NOT contains(title, '(') "
                      "AND (node_id - 1000) // 10 % 37 <> 0"),
    "header": " UNION ALL ".join([
        issue("header", "error", "doc", "'doc ' || doc", 1, "'ERROR: ontology heading has no ID'", "FROM brands WHERE n % 9 = 0"),
        issue("header", "warning", "doc", "'doc ' || doc", 1, "'WARNING: context local name differs from ID'",
              "FROM brands WHERE n % 9 <> 0 AND n % 5 = 0"),
        issue("header", "error", "doc", "'doc ' || doc", 1, "'ERROR: no output target'", "FROM brands WHERE n % 4 = 0"),
        issue("header", "error", "doc", "'doc ' || doc", 1, "'ERROR: noweb setting missing'", "FROM brands WHERE n % 4 = 0")]),
    "prefix-table": issue("prefix-table", "error", "doc", "'doc ' || doc", 1,
                          "'ERROR: prefix table is missing or malformed'", "FROM brands WHERE n % 10 = 0"),
    "sections": " UNION ALL ".join([
        issue("sections", "warning", "doc", "CASE WHEN n % 5 = 0 THEN 'other' ELSE doc END || s", 1,
              "'WARNING: missing section ' || CASE WHEN n % 5 = 0 THEN 'other' ELSE doc END || s",
              "FROM brands, (VALUES ('-ontology-declaration'), ('-class-hierarchy'), ('-object-property-hierarchy'), "
              "('-data-property-hierarchy'), ('-annotation-property-hierarchy'), ('-individuals')) v(s) "
              "WHERE n % 5 = 0 OR s LIKE '%property%'"),
        issue("sections", "warning", "doc", "doc || '-individuals'", 40,
              "'WARNING: section lacks the resource flag ' || doc || '-individuals'",
              "FROM brands WHERE n % 5 <> 0 AND n % 8 = 0")]),
    "declaration": " UNION ALL ".join([
        issue("declaration", "error", "doc", "title", 18, "'ERROR: ontology declaration names no identifier'",
              "FROM nodes WHERE node_id = 18 AND n % 6 = 0"),
        issue("declaration", "error", "doc", "title", 18, "'ERROR: unknown prefix in ontology identifier zz:' || doc",
              "FROM nodes WHERE node_id = 18 AND n % 6 <> 0 AND n % 7 = 0 AND n % 10 <> 0")]),
    "annotation-property": issue("annotation-property", "warning", "source", "subject", "row_ord",
                                 "'WARNING: not a declared annotation property: ' || tag",
                                 "FROM descr WHERE tag = 'ex:unknown'"),
    "keyword-section": issue("keyword-section", "error", "source", "subject", "row_ord",
                             "'ERROR: SubClassOf is not valid in section -individuals'",
                             "FROM descr WHERE tag = 'SubClassOf' AND section = '-individuals'"),
    "nesting": issue("nesting", "warning", "source", "subject", "row_ord",
                     "'WARNING: prefer nesting over SubClassOf of ' || value", "FROM descr WHERE tag = 'SubClassOf'"),
    "blank-axiom": issue("blank-axiom", "warning", "source", "subject", "row_ord",
                         "'WARNING: axiom row without value: Types'", "FROM descr WHERE tag = 'Types' AND value = ''"),
    "undocumented": issue("undocumented", "warning", "doc", "regexp_extract(title, '\\((part:P[0-9]+)\\)', 1)", "node_id",
                          "'WARNING: term has no authored documentation'",
                          "FROM nodes WHERE node_id >= 1000 AND (node_id - 1000) // 10 % 5 = 0 AND contains(title, '(') AND NOT nodeclare"),
    "duplicate-label": issue("duplicate-label", "warning", "doc", "uri", "node_id",
                             "'WARNING: label \"' || label || '\" is shared by ' || k || ' rows'",
                             "FROM (SELECT *, count(*) OVER (PARTITION BY doc, label) AS k FROM nodes "
                             "WHERE uri IS NOT NULL AND NOT nodeclare AND NOT resourcedefs) WHERE k > 1"),
}


def out(name):
    return lifted("nodes rows", DESC + " " + OUT[name])


def parts(spark, sf):
    return outlines.nodes(spark, sf), outlines.rows(spark, sf), outlines.prefixes(spark, sf)


def names(spark, sf):
    nodes, _rows, prefixes = parts(spark, sf)
    declared = nodes.where("rdf_type = 'owl:Ontology' and uri is not null").select(
        F.col("doc").alias("source"), F.col("uri").alias("id"))
    return ontology_ids(declared, prefixes.where("doc = 'b1'").select("prefix", "expansion"))


def described(spark, sf):
    nodes, rows, _prefixes = parts(spark, sf)
    return C.described_outline(nodes, rows), C.declared_terms(C.outline_types(nodes), ["source"])


@query("check_identity", out("identity"))
def check_identity(spark, sf):
    nodes, _rows, prefixes = parts(spark, sf)
    return C.check_identity(nodes, prefixes)


@query("check_header", out("header"))
def check_header(spark, sf):
    return C.check_header(outlines.nodes(spark, sf))


@query("check_prefix_table", out("prefix-table"))
def check_prefix_table(spark, sf):
    nodes, _rows, prefixes = parts(spark, sf)
    return C.check_prefix_table(nodes, prefixes)


@query("check_presence", lifted("brands", issue(
    "presence", "error", "doc", "doc", 8, "'ERROR: document has no ontology heading'", "FROM brands WHERE n % 3 = 0")))
def check_presence(spark, sf):
    """Documents of every third brand without their first heading."""
    nodes = outlines.nodes(spark, sf)
    return C.check_presence(nodes.where((F.col("level") != 1) | (F.substring("doc", 2, 9).cast("int") % 3 != 0)))


@query("check_sections", out("sections"))
def check_sections(spark, sf):
    return C.check_sections(outlines.nodes(spark, sf))


@query("check_declaration", out("declaration"))
def check_declaration(spark, sf):
    nodes, _rows, prefixes = parts(spark, sf)
    return C.check_declaration(nodes, prefixes)


@query("check_nesting", out("nesting"))
def check_nesting(spark, sf):
    nodes, rows, _prefixes = parts(spark, sf)
    return C.check_nesting(nodes, rows)


@query("check_undocumented", out("undocumented"))
def check_undocumented(spark, sf):
    nodes, rows, _prefixes = parts(spark, sf)
    return C.check_undocumented(nodes, rows, names(spark, sf))


@query("check_duplicate_labels_outline", out("duplicate-label"))
def check_duplicate_labels_outline(spark, sf):
    nodes, rows, _prefixes = parts(spark, sf)
    return C.check_duplicate_labels(C.outline_labels(nodes, rows), ["source"])


ALL_OUT = " UNION ALL ".join(f"({s})" for s in OUT.values())


def issues(spark, sf):
    nodes, rows, prefixes = parts(spark, sf)
    return C.all_issues(nodes, rows, prefixes, names(spark, sf))


@query("quality_report", lifted("nodes rows", DESC + f"""
, iss AS ({ALL_OUT}) SELECT source, "check", severity, count(*) AS n FROM iss GROUP BY ALL"""))
def quality_report(spark, sf):
    return C.quality_report(issues(spark, sf))


@query("quality_verdicts", lifted("nodes rows", DESC + f"""
, iss AS ({ALL_OUT})
, s AS (SELECT b.doc AS source, count_if(severity = 'error') AS e, count_if(severity = 'warning') AS w
    FROM brands b LEFT JOIN iss ON iss.source = b.doc GROUP BY b.doc)
SELECT source, CAST(e AS BIGINT) AS errors, CAST(w AS BIGINT) AS warnings,
  CASE WHEN e > 0 THEN 'fail' WHEN w > 0 THEN 'warn' ELSE 'pass' END AS verdict FROM s"""))
def quality_verdicts(spark, sf):
    docs = lift.brands(spark, sf).select(F.col("doc").alias("source"))
    return C.verdicts(docs, C.quality_report(issues(spark, sf)))


@query("filter_issues", lifted("nodes rows", DESC + f""", iss AS ({ALL_OUT}) SELECT * FROM iss WHERE severity = 'error'"""))
def filter_issues(spark, sf):
    return C.filter_issues(issues(spark, sf), "error")


# --- the lifted index ---------------------------------------------------------------

IDX = """
, ty AS (SELECT id, source, arg_min(value, (ord, value)) AS rdf_type FROM attributes WHERE prop = 'rdf:type' GROUP BY id, source)
, descr AS (SELECT a.source, a.id AS subject, CASE rdf_type WHEN 'owl:Ontology' THEN '-ontology' WHEN 'owl:Class' THEN '-class-hierarchy'
    WHEN 'owl:NamedIndividual' THEN '-individuals' WHEN 'owl:ObjectProperty' THEN '-object-property-hierarchy'
    WHEN 'owl:AnnotationProperty' THEN '-annotation-property-hierarchy' END AS section, prop AS tag, value, ord AS row_ord
  FROM all_rows a LEFT JOIN ty USING (id, source) WHERE prop <> 'rdf:type')
, decl AS (SELECT id, arg_min(rdf_type, (source, rdf_type)) AS rdf_type FROM ty GROUP BY id)
, words AS (SELECT * FROM (SELECT d.*, unnest(regexp_split_to_array(value, '[ \\n\\t,]+')) AS id FROM descr d
    WHERE tag IN ('Types', 'SubClassOf', 'SameAs', 'Facts', 'Domain'))
  WHERE regexp_matches(id, '^[-_./A-Za-z0-9]*:[-_/.A-Za-z0-9]*$'))"""
W = "'WARNING: "


def idx(body):
    return lifted("attributes all_rows", IDX + " " + body)


def index_rows(spark, sf):
    rows = lift.index(spark, sf, True).attributes
    types = rows.where("prop = 'rdf:type'").select("source", "id", F.col("value").alias("rdf_type"))
    return C.described_index(rows), C.declared_terms(types, [])


@query("check_annotation_props", idx(issue(
    "annotation-property", "warning", "source", "subject", "row_ord",
    "'WARNING: not a declared annotation property: ' || tag",
    "FROM descr WHERE contains(tag, ':') AND tag <> 'rdfs:label'")))
def check_annotation_props(spark, sf):
    return C.check_annotation_props(*index_rows(spark, sf), [])


@query("check_axiom_ids", idx(" UNION ALL ".join([
    issue("axiom-names", "warning", "source", "subject", "row_ord", "'WARNING: unknown name in axiom: ' || id",
          "FROM words WHERE id NOT IN (SELECT id FROM decl)"),
    issue("axiom-names", "warning", "source", "subject", "row_ord", "'WARNING: annotation property used in axiom: ' || id",
          "FROM words WHERE id = 'ex:note'"),
    issue("axiom-names", "warning", "source", "subject", "row_ord", "'WARNING: unbalanced parentheses in axiom'",
          "FROM descr WHERE tag = 'Facts' AND contains(value, '(')")])))
def check_axiom_ids(spark, sf):
    return C.check_axiom_ids(*index_rows(spark, sf), [])


@query("check_keyword_section", idx(issue(
    "keyword-section", "error", "source", "subject", "row_ord",
    "'ERROR: ' || tag || ' is not valid in section ' || section",
    "FROM descr WHERE section = '-individuals' AND tag IN ('Domain', 'SubClassOf')")))
def check_keyword_section(spark, sf):
    return C.check_keyword_section(index_rows(spark, sf)[0])


@query("check_keyword_range", idx(issue(
    "keyword-range", "warning", "source", "subject", "row_ord",
    "'WARNING: ' || value || ' is of kind Class but SameAs expects Individual'", "FROM descr WHERE tag = 'SameAs'")))
def check_keyword_range(spark, sf):
    return C.check_keyword_range(*index_rows(spark, sf), [])


@query("check_facts_punning", idx(issue(
    "facts-punning", "error", "source", "subject", "row_ord",
    "'ERROR: class used as an individual without such a declaration: ' || value", "FROM descr WHERE tag = 'SameAs'")))
def check_facts_punning(spark, sf):
    return C.check_facts_punning(*index_rows(spark, sf), [])


@query("check_punning", " UNION ALL ".join([
    issue("punning", "error", "'s'", "'x:' || p_partkey", "NULL", "'ERROR: declared with several property kinds'",
          "FROM part WHERE p_partkey % 3 = 0"),
    issue("punning", "error", "'s'", "'x:' || p_partkey", "NULL", "'ERROR: declared as class and datatype'",
          "FROM part WHERE p_partkey % 10 = 0")]))
def check_punning(spark, sf):
    key = F.col("p_partkey")
    kinds = F.array_compact(F.array(
        F.lit("owl:ObjectProperty"), F.when(key % 3 == 0, "owl:DatatypeProperty"),
        F.when(key % 5 == 0, "owl:Class"), F.when(key % 2 == 0, "rdfs:Datatype")))
    return C.check_punning(lift.read(spark, sf, "part").select(
        F.lit("s").alias("source"), F.concat(F.lit("x:"), key.cast("string")).alias("id"),
        F.explode(kinds).alias("rdf_type")))


@query("check_blank_axiom", idx(issue(
    "blank-axiom", "warning", "source", "subject", "row_ord", "'WARNING: axiom row without value: Facts'",
    "FROM descr WHERE tag = 'Facts' AND value = ''")))
def check_blank_axiom(spark, sf):
    return C.check_blank_axiom(index_rows(spark, sf)[0])


@query("check_recursive", idx(issue(
    "recursive", "warning", "source", "subject", "row_ord", "'WARNING: SubClassOf mentions its own subject'",
    "FROM descr WHERE tag = 'SubClassOf' AND starts_with(subject, 'part:')")))
def check_recursive(spark, sf):
    return C.check_recursive(index_rows(spark, sf)[0])


DUP = issue("duplicate-label", "warning", "source", "id", "ord",
            "'WARNING: label \"' || value || '\"' || CASE WHEN lang <> '' THEN '@' || lang ELSE '' END || "
            "' is shared by ' || k || ' rows'",
            "FROM (SELECT *, count(*) OVER (PARTITION BY value, lang) AS k FROM attributes WHERE prop = 'rdfs:label') WHERE k > 1")


@query("check_duplicate_labels", lifted("attributes", DUP))
def check_duplicate_labels(spark, sf):
    return C.check_duplicate_labels(C.index_labels(lift.attributes(spark, sf)), [])


@query("term_report", lifted("entities attributes", """
, h AS (SELECT e.id, e.source, bool_or(prop = 'rdfs:label') AS l, bool_or(prop = 'skos:definition') AS d
    FROM entities e LEFT JOIN attributes a USING (id, source) GROUP BY e.id, e.source) """ + " UNION ALL ".join([
    issue("missing-label", "error", "source", "id", "NULL", "'ERROR: term has no label'", "FROM h WHERE NOT coalesce(l, false)"),
    issue("missing-definition", "warning", "source", "id", "NULL", "'WARNING: term has no definition'",
          "FROM h WHERE NOT coalesce(d, false)"),
    DUP.replace("PARTITION BY value", "PARTITION BY source, value")])))
def term_report(spark, sf):
    return C.term_report(lift.entities(spark, sf), lift.attributes(spark, sf))


ISSUES = " UNION ALL ".join([
    issue("annotation-property", "warning", "source", "subject", "row_ord", "''",
          "FROM descr WHERE contains(tag, ':') AND tag <> 'rdfs:label'"),
    issue("axiom-names", "warning", "source", "subject", "row_ord", "''", "FROM words WHERE id NOT IN (SELECT id FROM decl)"),
    issue("axiom-names", "warning", "source", "subject", "row_ord", "''", "FROM words WHERE id = 'ex:note'"),
    issue("axiom-names", "warning", "source", "subject", "row_ord", "''", "FROM descr WHERE tag = 'Facts' AND contains(value, '(')"),
    issue("keyword-section", "error", "source", "subject", "row_ord", "''",
          "FROM descr WHERE section = '-individuals' AND tag IN ('Domain', 'SubClassOf')"),
    issue("keyword-range", "warning", "source", "subject", "row_ord", "''", "FROM descr WHERE tag = 'SameAs'"),
    issue("facts-punning", "error", "source", "subject", "row_ord", "''", "FROM descr WHERE tag = 'SameAs'"),
    issue("blank-axiom", "warning", "source", "subject", "row_ord", "''", "FROM descr WHERE tag = 'Facts' AND value = ''"),
    issue("recursive", "warning", "source", "subject", "row_ord", "''", "FROM descr WHERE tag = 'SubClassOf' AND starts_with(subject, 'part:')"),
    DUP])


@query("index_quality_report", idx(f"""
SELECT source, "check", severity, count(*) AS n FROM ({ISSUES}) GROUP BY ALL"""))
def index_quality_report(spark, sf):
    """Every index check, counted per source."""
    return C.quality_report(C.index_issues(lift.index(spark, sf, True).attributes, []))


# Stated anew here: keyword, operand, least, most.
RULES = {
    "owl:Class": "SubClassOf expression 1 -, EquivalentTo expression 1 -, DisjointWith expression 1 -, DisjointUnionOf expression 2 -, HasKey property 1 -",
    "owl:ObjectProperty": "Domain class 1 -, Range class 1 -, Characteristics flag 1 7, SubPropertyOf object_property 1 -, SubPropertyChain object_property 2 -, "
                          "EquivalentTo object_property 1 -, DisjointWith object_property 1 -, InverseOf object_property 1 -",
    "owl:AnnotationProperty": "Domain any_name 1 -, Range any_name 1 -, SubPropertyOf annotation_property 1 -",
    "owl:NamedIndividual": "Types expression 1 -, Facts fact 1 -, SameAs individual 1 -, DifferentFrom individual 1 -",
    "owl:Ontology": "Import document 1 1",
}


@query("legal_keywords", lifted("attributes", f"""
, k AS (SELECT DISTINCT id, value AS kind FROM attributes WHERE prop = 'rdf:type')
, r AS (SELECT kind, string_split(trim(unnest(string_split(rules, ','))), ' ') AS w FROM (VALUES {", ".join(f"('{t}', '{r}')" for t, r in RULES.items())}) v(kind, rules))
SELECT id, kind, w[1] AS keyword, replace(w[2], '_', ' ') AS operand, CAST(w[3] AS INTEGER) AS least,
  CAST(nullif(w[4], '-') AS INTEGER) AS most FROM k JOIN r USING (kind)"""))
def legal_keywords(spark, sf):
    kinds = lift.attributes(spark, sf).where("prop = 'rdf:type'").select("id", F.col("value").alias("kind")).distinct()
    return C.legal_keywords(kinds)


@query("existing_rows", lifted("attributes", """
SELECT id, prop, value FROM attributes WHERE prop NOT IN ('rdfs:label', 'rdf:type', 'puri')"""))
def existing_rows(spark, sf):
    return C.existing_rows(lift.attributes(spark, sf)).select("id", "prop", "value")


@query("axiom_leaves", """
WITH o AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'SubPropertyChain' ELSE 'DisjointWith' END AS tag, o_custkey AS c FROM orders)
SELECT k, tag, 'ex:a' || c AS leaf FROM o UNION ALL SELECT k, tag, 'ex:b' || c FROM o WHERE k % 3 <> 1
""")
def axiom_leaves(spark, sf):
    key, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    a, b = F.concat(F.lit("ex:a"), c), F.concat(F.lit("ex:b"), c)
    value = (F.when(key % 3 == 0, F.concat(a, F.lit("  o "), b))
             .when(key % 3 == 1, F.concat(a, F.lit(" , ex:r some "), b))
             .otherwise(F.concat(a, F.lit(",\n "), b)))
    rows = lift.read(spark, sf, "orders").select(
        key.alias("k"), F.when(key % 3 == 0, "SubPropertyChain").otherwise("DisjointWith").alias("tag"),
        value.alias("value"))
    return C.leaves(rows).drop("value")
