"""Label and attribute lookups by source priority and language."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.lift_sql import lang_key, lifted, prio
from termweave.functions import text as X
from termweave.operators import lookup as L
from termweave.sources import lift

ACTIVE = ["supply", "geo", "part", "sales"]
PAIRS = [(s, "") for s in ACTIVE]
DEFAULT = [":untagged", "en"]
KO = ["ko", "DE", ":untagged"]
P = prio(ACTIVE)
ALL = "entities attributes prefixes global_prefixes"


def ids(spark, sf):
    return lift.entities(spark, sf).select("id").distinct()


def tokens(spark, sf):
    """Every id as it is, as a full IRI, and an id nobody knows."""
    known = lift.entities(spark, sf).select("id")
    local = F.replace("id", F.lit(":"), F.lit("/"))
    return (known.select(F.col("id").alias("token"))
            .union(known.select(F.concat(F.lit(lift.DATA), local)))
            .union(lift.read(spark, sf, "orders").select(
                F.concat(F.lit("part:Q"), F.col("o_orderkey").cast("string")))))


TOKENS = """
, tokens AS (SELECT DISTINCT token FROM (SELECT id AS token FROM entities
  UNION ALL SELECT 'http://data.example.org/' || replace(id, ':', '/') FROM entities
  UNION ALL SELECT 'part:Q' || o_orderkey FROM orders))
, ranked AS (SELECT prefix, expansion, {P} AS p FROM prefixes WHERE {P} IS NOT NULL
    UNION ALL SELECT prefix, expansion, 1073741824 FROM global_prefixes)
, best AS (SELECT prefix, arg_min(expansion, p) AS expansion FROM ranked GROUP BY prefix)
, cand AS (
  SELECT token, token AS id, 1 AS pass, 0 AS l, 0 AS p, '' AS x FROM tokens
  UNION ALL SELECT token, b.expansion || substr(token, instr(token, ':') + 1), 2, 0, 0, ''
    FROM tokens JOIN best b ON b.prefix = split_part(token, ':', 1)
    WHERE contains(token, ':') AND NOT contains(token, '://')
  UNION ALL SELECT token, prefix || ':' || substr(token, length(expansion) + 1), 3, -length(expansion), r.p, prefix
    FROM tokens JOIN ranked r ON contains(token, '://') AND starts_with(token, expansion)
      AND length(token) > length(expansion))""".replace("{P}", P)


@query("pick_by_lang", lifted("attributes", f"""
SELECT id, value, lang FROM (SELECT id, value, lang,
    row_number() OVER (PARTITION BY id ORDER BY {lang_key(KO)}) AS n
  FROM attributes WHERE prop = 'rdfs:label') WHERE n = 1"""))
def pick_by_lang(spark, sf):
    rows = lift.attributes(spark, sf).where("prop = 'rdfs:label'")
    return L.pick_by_lang(rows, ["id"], KO)


def labels_sql(prefs):
    return f"""
, ent AS (SELECT id, {P} AS p, label FROM entities WHERE {P} IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY p) = 1)
, lab AS (SELECT id, {P} AS p, value FROM attributes WHERE prop = 'rdfs:label' AND {P} IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY id, source ORDER BY {lang_key(prefs)}) = 1)
, got AS (SELECT e.id, CASE WHEN l.id IS NOT NULL THEN l.value ELSE e.label END AS label
    FROM ent e LEFT JOIN lab l ON l.id = e.id AND l.p = e.p)"""


@query("get_labels", lifted("entities attributes", labels_sql(DEFAULT) + " SELECT id, label FROM got"))
def get_labels(spark, sf):
    return L.get_labels(ids(spark, sf), lift.index(spark, sf), PAIRS)


@query("get_labels_by_language", lifted(
    "entities attributes", labels_sql(KO) + " SELECT id, label FROM got"))
def get_labels_by_language(spark, sf):
    return L.get_labels(ids(spark, sf), lift.index(spark, sf), PAIRS, KO)


@query("resolve_labels", lifted(ALL, TOKENS + f"""
, ent AS (SELECT id, {P} AS p, label FROM entities WHERE {P} IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY p) = 1)
, hit AS (SELECT token, label FROM cand JOIN ent USING (id) WHERE label IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY token ORDER BY pass, l, cand.p, x) = 1)
SELECT token, label FROM tokens LEFT JOIN hit USING (token)"""))
def resolve_labels(spark, sf):
    return L.resolve_labels(tokens(spark, sf), lift.index(spark, sf), PAIRS)


@query("get_attr", lifted("entities attributes", f"""
, hit AS (SELECT id, value FROM attributes WHERE prop = 'Types' AND {P} IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY {P}, {lang_key(DEFAULT)}) = 1)
SELECT id, value FROM (SELECT DISTINCT id FROM entities) LEFT JOIN hit USING (id)"""))
def get_attr(spark, sf):
    return L.get_attr(ids(spark, sf), "Types", lift.index(spark, sf), PAIRS)


@query("get_attr_any", lifted(ALL, TOKENS + f"""
, val AS (SELECT id, value FROM attributes WHERE prop = 'rdfs:label' AND {P} IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY {P}, {lang_key(DEFAULT)}) = 1)
, hit AS (SELECT token, value FROM cand JOIN val USING (id)
    QUALIFY row_number() OVER (PARTITION BY token ORDER BY pass, l, cand.p, x) = 1)
SELECT token, value FROM tokens LEFT JOIN hit USING (token)"""))
def get_attr_any(spark, sf):
    return L.get_attr_any(tokens(spark, sf), "rdfs:label", lift.index(spark, sf), PAIRS)


OWNED = f"""
, act AS (SELECT *, {P} AS p FROM attributes WHERE {P} IS NOT NULL)
, own AS (SELECT id, min(p) AS p FROM act GROUP BY id)
, view AS (SELECT id, prop, value, source, data_source FROM act JOIN own USING (id, p)
    QUALIFY row_number() OVER (PARTITION BY id, prop ORDER BY {lang_key(DEFAULT)}) = 1)"""


@query("get_all_attrs", lifted("attributes", OWNED + " SELECT * FROM view"))
def get_all_attrs(spark, sf):
    return L.get_all_attrs(ids(spark, sf), lift.index(spark, sf), PAIRS)


@query("get_all_attrs_any", lifted(ALL, TOKENS + OWNED + """
, chosen AS (SELECT token, id FROM cand WHERE id IN (SELECT id FROM view)
    QUALIFY row_number() OVER (PARTITION BY token ORDER BY pass, l, p, x) = 1)
SELECT token, id, prop, value, source FROM chosen JOIN view USING (id)"""))
def get_all_attrs_any(spark, sf):
    return L.get_all_attrs_any(tokens(spark, sf), lift.index(spark, sf), PAIRS)


def iri_index(spark, sf):
    """The index with the ids of source part as full IRIs."""
    idx = lift.index(spark, sf)
    rows = idx.entities.where("source = 'part'").withColumn(
        "id", F.concat(F.lit(lift.DATA + "part/"), F.substring_index("id", ":", -1)))
    return L.Index(idx.sources, rows, idx.attributes, idx.prefixes, idx.global_prefixes)


@query("all_active_ids", lifted("prefixes", """
, x AS (SELECT 'http://data.example.org/part/P' || p_partkey AS id FROM part
  UNION SELECT 'http://data.example.org/part/' || s FROM (VALUES ('suppliedBy'), ('note'), ('part/1.0')) v(s))
SELECT id FROM x UNION
SELECT prefix || ':' || substr(id, length(expansion) + 1) FROM x JOIN prefixes
  ON source IN ('supply', 'geo', 'part', 'sales') AND starts_with(id, expansion)"""))
def all_active_ids(spark, sf):
    return L.all_active_ids(iri_index(spark, sf), PAIRS, include_curies=True)


LABELLED = f"""
, lab AS (SELECT id, source, value FROM attributes WHERE prop = 'rdfs:label'
    QUALIFY row_number() OVER (PARTITION BY id, source ORDER BY {lang_key(DEFAULT)}) = 1)
, named AS (SELECT e.id, {prio(ACTIVE, 'e.source')} AS p,
      CASE WHEN l.id IS NOT NULL THEN l.value ELSE e.label END AS label
    FROM entities e LEFT JOIN lab l ON l.id = e.id AND l.source = e.source
    WHERE e.label IS NOT NULL)
, win AS (SELECT label, min(p) AS p FROM named GROUP BY label)
, known AS (SELECT label, id FROM named JOIN win USING (label, p))"""


@query("all_active_labels", lifted("entities attributes", LABELLED + " SELECT label, id FROM known"))
def all_active_labels(spark, sf):
    return L.all_active_labels(lift.index(spark, sf), PAIRS)


@query("ids_for_label", lifted("entities attributes", LABELLED + """
 SELECT label, id FROM known WHERE label IN (SELECT p_name FROM part WHERE p_size < 10)"""))
def ids_for_label(spark, sf):
    wanted = lift.read(spark, sf, "part").where("p_size < 10").select(F.col("p_name").alias("label"))
    return L.ids_for_label(wanted, lift.index(spark, sf), PAIRS)


@query("label_variants", lifted("attributes", f"""
, r AS (SELECT id, value, lang, {P} AS p FROM attributes WHERE prop = 'rdfs:label' AND {P} IS NOT NULL)
SELECT id, value, lang FROM r JOIN (SELECT id, min(p) AS p FROM r GROUP BY id) USING (id, p)"""))
def label_variants(spark, sf):
    return L.label_variants(ids(spark, sf), lift.index(spark, sf), PAIRS)


@query("attributes_of", lifted("all_rows", """
SELECT id, prop, value, lang, source, data_source FROM all_rows WHERE source = 'part'"""))
def attributes_of(spark, sf):
    return L.attributes_of(ids(spark, sf), lift.index(spark, sf, True), "part")


@query("attributes_of_distinct", lifted("all_rows", """
SELECT id, prop, value, min(source) AS source, arg_min(lang, (source, ord)) AS lang,
  arg_min(data_source, (source, ord)) AS data_source FROM all_rows GROUP BY id, prop, value"""))
def attributes_of_distinct(spark, sf):
    return L.attributes_of(ids(spark, sf), lift.index(spark, sf, True), distinct=True)


@query("supertypes", lifted("all_rows", """
SELECT id, value, prop, source, data_source FROM all_rows
WHERE prop IN ('rdfs:subClassOf', 'rdfs:subPropertyOf', 'SubClassOf', 'SubPropertyOf')"""))
def supertypes(spark, sf):
    return L.supertypes(ids(spark, sf), lift.index(spark, sf, True))


@query("individual_types", lifted("attributes", """
, t AS (SELECT DISTINCT id, value, prop, source, data_source FROM attributes WHERE prop IN ('rdf:type', 'Types'))
SELECT * FROM t a WHERE value <> 'owl:NamedIndividual' AND EXISTS (SELECT 1 FROM t b
  WHERE b.id = a.id AND b.source = a.source AND b.data_source = a.data_source
  AND (b.prop = 'Types' OR b.value = 'owl:NamedIndividual'))"""))
def individual_types(spark, sf):
    return L.individual_types(ids(spark, sf), lift.index(spark, sf))


@query("lookup_items", lifted("entities attributes", LABELLED + f"""
, loc AS (SELECT 'part:P' || p_partkey AS id, 'local ' || p_name AS label, 'owl:Class' AS rdf_type
    FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT 'local:L' || p_partkey, p_name, '' FROM part WHERE p_partkey % 6 = 0)
, ty AS (SELECT id, value FROM attributes WHERE prop = 'rdf:type'
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY {P}, ord) = 1)
, ext AS (SELECT id, min(label) AS label FROM known GROUP BY id)
, cells AS (SELECT coalesce(l.id, e.id) AS id, CASE WHEN l.id IS NOT NULL THEN l.label ELSE e.label END AS label,
    CASE WHEN l.id IS NOT NULL THEN l.rdf_type ELSE coalesce(ty.value, '') END AS rdf_type,
    CASE WHEN l.id IS NULL THEN 'external' WHEN e.id IS NOT NULL THEN 'both' ELSE 'local' END AS origin
    FROM loc l FULL JOIN ext e ON l.id = e.id LEFT JOIN ty ON ty.id = e.id)
, r AS (SELECT id, value, lang, ord, {P} AS p FROM attributes WHERE prop = 'rdfs:label' AND {P} IS NOT NULL)
, vr AS (SELECT id, value, lang, ord, count(*) OVER (PARTITION BY id) AS n FROM r
    JOIN (SELECT id, min(p) AS p FROM r GROUP BY id) USING (id, p))
, vw AS (SELECT * FROM vr QUALIFY row_number() OVER (PARTITION BY id ORDER BY {lang_key(DEFAULT)}) = 1)
, det AS (SELECT c.*, count(*) OVER (PARTITION BY c.label) AS k, vw.n, vw.value AS wv, vw.lang AS wl
    FROM cells c LEFT JOIN vw ON vw.id = c.id)
SELECT id, label, rdf_type, origin, trim(
  CASE WHEN k > 1 THEN id WHEN n > 1 AND wv = label AND wl <> '' THEN '@' || wl ELSE '' END || '  ' ||
  CASE origin WHEN 'external' THEN '[external]' WHEN 'both' THEN '+external' ELSE '' END) AS detail
FROM det"""))
def lookup_items(spark, sf):
    part, key = lift.read(spark, sf, "part"), F.col("p_partkey")
    local = (part.where(key % 2 == 0).select(
        F.concat(F.lit("part:P"), key.cast("string")).alias("id"),
        F.concat(F.lit("local "), "p_name").alias("label"), F.lit("owl:Class").alias("rdf_type"),
        key.alias("ord"))
        .union(part.where(key % 6 == 0).select(
            F.concat(F.lit("local:L"), key.cast("string")), "p_name", F.lit(None).cast("string"), key)))
    return L.lookup_items(local, lift.index(spark, sf), PAIRS)


@query("disambiguate_labels", lifted("entities attributes", LABELLED + """
SELECT label, id, CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN label || '  [' || id || ']'
  ELSE label END AS display FROM known"""))
def disambiguate_labels(spark, sf):
    return L.disambiguate_labels(L.all_active_labels(lift.index(spark, sf), PAIRS))


@query("insert_token", lifted("entities prefixes", """
, x AS (SELECT 'http://data.example.org/part/P' || p_partkey AS id FROM part
  UNION ALL SELECT '<' || url || '>' FROM pages UNION ALL SELECT id FROM entities),
b AS (SELECT DISTINCT id, CASE WHEN starts_with(id, '<') THEN substr(id, 2, length(id) - 2) ELSE id END AS iri FROM x),
c AS (SELECT id, prefix || ':' || substr(iri, length(expansion) + 1) AS curie
    FROM b JOIN prefixes p ON p.source = 'part' AND contains(iri, '://') AND starts_with(iri, expansion))
SELECT id, CASE WHEN NOT contains(iri, '://') THEN iri ELSE coalesce(curie, '<' || iri || '>') END AS token
FROM b LEFT JOIN c USING (id)"""))
def insert_token(spark, sf):
    part = lift.read(spark, sf, "part")
    wanted = (part.select(F.concat(F.lit(lift.DATA + "part/P"), F.col("p_partkey").cast("string")).alias("id"))
              .union(lift.read(spark, sf, "pages").select(F.concat(F.lit("<"), "url", F.lit(">"))))
              .union(lift.entities(spark, sf).select("id")).distinct())
    return L.insert_token(wanted, lift.index(spark, sf), [("part", "")])


@query("entity_summary", lifted("entities attributes", labels_sql(DEFAULT) + OWNED + """
, f AS (SELECT id, max(value) FILTER (prop = 'rdfs:label') AS own, max(value) FILTER (prop = 'rdf:type') AS rdf_type,
    max(value) FILTER (prop = 'skos:definition') AS d, min(source) AS source FROM view GROUP BY id)
, s AS (SELECT id, coalesce(own, label) AS label, rdf_type, replace(d, chr(10), ' ') AS definition, source
    FROM f JOIN got USING (id))
SELECT *, id || CASE WHEN label <> '' THEN '  [' || label || ']' ELSE '' END
  || CASE WHEN rdf_type <> '' THEN '  (' || rdf_type || ')' ELSE '' END
  || CASE WHEN definition <> '' THEN '  -- ' || definition ELSE '' END
  || '   [src: ' || source || ']' AS summary FROM s"""))
def entity_summary(spark, sf):
    return L.entity_summary(ids(spark, sf), lift.index(spark, sf), PAIRS)


@query("entity_card", lifted("attributes", OWNED + """
SELECT id, CASE prop WHEN 'rdf:type' THEN 0 WHEN 'skos:definition' THEN 2 ELSE 5 END AS rank, prop, value, source
FROM view WHERE prop <> 'rdfs:label'"""))
def entity_card(spark, sf):
    return L.entity_card(ids(spark, sf), lift.index(spark, sf), PAIRS)


@query("list_resources", lifted("entities attributes", """
, d AS (SELECT id, source, value FROM attributes WHERE prop = 'skos:definition')
SELECT e.id, 'Individual' AS kind, coalesce(e.label, '--') AS label, coalesce(d.value, '--') AS definition, e.source
FROM entities e LEFT JOIN d USING (id, source)
WHERE starts_with(e.id, 'part:') AND (regexp_matches(e.id, '(?i)WIDGET|ring')
  OR regexp_matches(coalesce(e.label, ''), '(?i)WIDGET|ring'))"""))
def list_resources(spark, sf):
    return L.list_resources(lift.index(spark, sf), "individual", "WIDGET|ring", "part")


@query("list_resources_limited", lifted("entities", """
, e AS (SELECT id, coalesce(label, '--') AS label, source FROM entities WHERE starts_with(id, 'part:'))
SELECT id, label, source, (SELECT count(*) FROM e) AS total FROM e ORDER BY id, source LIMIT 200"""))
def list_resources_limited(spark, sf):
    """The first 200, and how many there are."""
    return L.list_resources(lift.index(spark, sf), prefix="part", limit=200, width=80).select("id", "label", "source", "total")


@query("match_label", """
WITH x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN '"' || upper(p_name) || '"'
  WHEN 2 THEN '"' || p_name || '"@en' ELSE '"' || p_name || '"^^xsd:string' END AS raw FROM part)
SELECT raw, lower(p_name) AS form FROM x JOIN part USING (p_partkey)""")
def match_label(spark, sf):
    return labelled_literals(spark, sf).select("raw", X.match_form(F.col("raw")).alias("form"))


def labelled_literals(spark, sf):
    key, quoted = F.col("p_partkey"), F.concat(F.lit('"'), "p_name", F.lit('"'))
    return lift.read(spark, sf, "part").select(
        "p_partkey", F.when(key % 4 == 0, F.col("p_name")).when(key % 4 == 1, F.upper(quoted))
        .when(key % 4 == 2, F.concat(quoted, F.lit("@en")))
        .otherwise(F.concat(quoted, F.lit("^^xsd:string"))).alias("raw"))


@query("parse_label_literal", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name
  ELSE '"' || p_name || '"^^xsd:string' END AS text, CASE WHEN p_partkey % 4 = 2 THEN 'en' END AS lang
FROM part""")
def parse_label_literal(spark, sf):
    raw = F.col("raw")
    return labelled_literals(spark, sf).select(
        "p_partkey", X.literal_text(raw).alias("text"), X.literal_lang(raw).alias("lang"))


@query("resolve_subjects", lifted("entities", """
, s AS (SELECT DISTINCT subject FROM (SELECT id AS subject FROM entities WHERE source IN ('supply', 'geo')
    UNION ALL SELECT 'ont:part' UNION ALL SELECT '"' || upper(p_name) || '"@en' FROM part
    UNION ALL SELECT 'nobody ' || o_orderkey FROM orders))
, a AS (SELECT DISTINCT subject, id, source FROM s JOIN entities ON subject = id OR subject = split_part(id, ' ', 1))
, b AS (SELECT subject, id, source FROM s JOIN entities
    ON lower(regexp_replace(regexp_replace(subject, '(@[A-Za-z0-9-]+|\\^\\^.*)$', ''), '^"(.*)"$', '\\1')) = lower(label)
    WHERE subject NOT IN (SELECT subject FROM a))
SELECT * FROM a UNION ALL SELECT * FROM b"""))
def resolve_subjects(spark, sf):
    rows = lift.entities(spark, sf)
    part = lift.read(spark, sf, "part")
    subjects = (rows.where("source in ('supply', 'geo')").select(F.col("id").alias("subject"))
                .union(rows.where("id like 'ont:part%'").select(F.substring_index("id", " ", 1)))
                .union(part.select(F.concat(F.lit('"'), F.upper("p_name"), F.lit('"@en'))))
                .union(lift.read(spark, sf, "orders").select(
                    F.concat(F.lit("nobody "), F.col("o_orderkey").cast("string")))))
    return L.resolve_subjects(subjects, rows)


@query("sql", lifted("attributes", """
, q AS (SELECT prop, count(*) AS n FROM attributes GROUP BY prop)
SELECT prop, n, (SELECT greatest(count(*) - 5, 0) FROM q) AS omitted FROM q ORDER BY n DESC, prop LIMIT 5"""))
def sql(spark, sf):
    return L.sql(lift.index(spark, sf),
                 "SELECT prop, count(*) AS n FROM attributes GROUP BY prop ORDER BY n DESC, prop", 5)
