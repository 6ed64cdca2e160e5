"""Search and reuse queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.lift_sql import lifted
from termweave.operators import search as R
from termweave.sources import lift

TYPES = """
, ty AS (SELECT id, source, data_source, arg_min(value, ord) AS rdf_type FROM attributes
    WHERE prop = 'rdf:type' GROUP BY id, source, data_source)
, ont AS (SELECT source, data_source, min(id) AS ontology_iri FROM attributes
    WHERE prop = 'rdf:type' AND value = 'owl:Ontology' GROUP BY source, data_source)"""


def search_sql(queries: str, cap: int | None = None, where: str = "true", fallback: bool = True) -> str:
    """Two passes; a cap takes the first of both and counts the rest."""
    spare = """
, names AS (SELECT query, lower(substr(query, instr(query, ':') + 1)) AS name FROM q
    WHERE regexp_matches(query, '^[A-Za-z_][A-Za-z0-9_-]*:.+$') AND NOT contains(query, '%'))
, b0 AS (SELECT DISTINCT query, e.* FROM names JOIN e
    ON lower(substr(id, instr(id, ':') + 1)) = name OR lower(label) = name)
, b AS (SELECT * FROM b0 ANTI JOIN a USING (query, id, source, data_source))""" if fallback else """
, b AS (SELECT * FROM a WHERE false)"""
    place = "row_number() OVER (PARTITION BY query ORDER BY pass, source NULLS FIRST, label NULLS FIRST, id)"
    return f"""
, q AS ({queries})
, e AS (SELECT id, label, source, data_source FROM entities WHERE {where})
, a AS (SELECT query, e.* FROM q JOIN e
    ON lower(label) LIKE lower(CASE WHEN contains(query, '%') THEN query ELSE '%' || query || '%' END)
    OR lower(id) LIKE lower(CASE WHEN contains(query, '%') THEN query ELSE '%' || query || '%' END))
{spare}
, ab AS (SELECT query, id, label, source, data_source, 1 AS pass FROM a
    UNION ALL SELECT query, id, label, source, data_source, 2 FROM b)
, found AS (SELECT *, {f"greatest(count(*) OVER (PARTITION BY query) - {cap}, 0)" if cap else "CAST(0 AS BIGINT)"} AS omitted
    FROM ab {f"QUALIFY {place} <= {cap}" if cap else ""})
, hits AS (SELECT query, f.id, f.label, rdf_type, ontology_iri, f.source, f.data_source,
    CASE WHEN pass = 2 THEN 'local-name' WHEN lower(f.id) = lower(query) THEN 'exact'
      ELSE 'label-substring' END AS via, omitted
  FROM found f LEFT JOIN ty USING (id, source, data_source) LEFT JOIN ont USING (source, data_source))"""


FIXED = ["widget", "S Nation_1%", "part:P12", "xx:N3", "xx:P7", "%_00000001_%", "ring", "b_lt", "e",
         "geo:nation_4", "no such term"]
FIXED_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in FIXED) + ") v(query)"


@query("search_entities", lifted("entities attributes",
                                 TYPES + search_sql(FIXED_SQL) + " SELECT * FROM hits"))
def search_entities(spark, sf):
    return R.search_entities(R.query_table(spark, FIXED), lift.index(spark, sf))


@query("search_limited", lifted("entities attributes", TYPES + search_sql(FIXED_SQL, 50) + " SELECT * FROM hits"))
def search_limited(spark, sf):
    """The first 50 of each query, and how many are left out."""
    return R.search_entities(R.query_table(spark, FIXED), lift.index(spark, sf), 50)


@query("search_entities_filtered", lifted("entities attributes", TYPES + search_sql(
    FIXED_SQL, None, """id IN (SELECT id FROM attributes t WHERE prop = 'rdf:type'
      AND value = 'owl:NamedIndividual' AND t.source = entities.source)
    AND id IN (SELECT id FROM attributes t WHERE prop = 'rdfs:label' AND lang = 'ko'
      AND t.source = entities.source) AND source = 'part'""", False) + " SELECT * FROM hits"))
def search_entities_filtered(spark, sf):
    return R.search_entities(R.query_table(spark, FIXED), lift.index(spark, sf), 0, "individual",
                             "part", "ko", exact_only=True)


NAMES = """SELECT DISTINCT query FROM (SELECT n_name AS query FROM nation UNION ALL SELECT p_name FROM part
    UNION ALL SELECT 'zz:S' || s_suppkey FROM supplier UNION ALL SELECT s_name FROM supplier)"""


@query("search_many", lifted("entities attributes",
                             TYPES + search_sql(NAMES) + " SELECT * FROM hits"))
def search_many(spark, sf):
    return R.search_entities(names(spark, sf), lift.index(spark, sf))


def names(spark, sf):
    supplier = lift.read(spark, sf, "supplier")
    return (lift.read(spark, sf, "nation").select(F.col("n_name").alias("query"))
            .union(lift.read(spark, sf, "part").select("p_name"))
            .union(supplier.select(F.concat(F.lit("zz:S"), F.col("s_suppkey").cast("string"))))
            .union(supplier.select("s_name")).distinct())


@query("local_name_fallback", lifted("entities", """
, q AS (SELECT DISTINCT 'other:' || CASE WHEN p_partkey % 2 = 0 THEN 'p' || p_partkey ELSE upper(p_name) END AS query
    FROM part)
SELECT DISTINCT query, id, label, source, data_source FROM q JOIN entities
  ON lower(substr(id, instr(id, ':') + 1)) = lower(substr(query, 7)) OR lower(label) = lower(substr(query, 7))"""))
def local_name_fallback(spark, sf):
    key = F.col("p_partkey")
    queries = lift.read(spark, sf, "part").select(F.concat(
        F.lit("other:"), F.when(key % 2 == 0, F.concat(F.lit("p"), key.cast("string")))
        .otherwise(F.upper("p_name"))).alias("query"))
    idx = lift.index(spark, sf)
    return R.local_name_matches(queries, R.filtered(idx, None, None, None))


CITATION = """
, home AS (SELECT id, label, source, data_source FROM entities
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY source, data_source) = 1)
, ont AS (SELECT source, min(id) AS oid FROM attributes WHERE prop = 'rdf:type'
    AND value = 'owl:Ontology' GROUP BY source)
, f AS (SELECT id, source, arg_min(lang, ord) FILTER (prop = 'rdfs:label' AND lang <> '') AS label_lang,
    arg_min(value, ord) FILTER (prop = 'skos:definition') AS definition,
    arg_min(value, ord) FILTER (prop = 'rdf:type') AS rdf_type FROM attributes GROUP BY id, source)
, cite AS (SELECT h.id, h.label, label_lang, definition, rdf_type, h.source, h.data_source,
    split_part(oid, ' ', 2) AS ontology_iri, t.value AS ontology_title
  FROM home h LEFT JOIN f ON f.id = h.id AND f.source = h.source LEFT JOIN ont ON ont.source = h.source
  LEFT JOIN attributes t ON t.id = oid AND t.source = h.source AND t.prop = 'dcterms:title')"""


@query("entity_citation", lifted("entities attributes", CITATION + " SELECT * FROM cite"))
def entity_citation(spark, sf):
    return R.entity_citation(lift.entities(spark, sf).select("id"), lift.index(spark, sf))


@query("borrow_candidates", lifted("entities attributes", CITATION.replace(", ont AS", ", ont1 AS").replace(
    " ont ON ont.", " ont1 ON ont1.") + TYPES + search_sql(
    "SELECT n_name AS query FROM nation UNION SELECT 'R' || p_partkey FROM part", None,
    "id IN (SELECT id FROM attributes t WHERE prop = 'rdf:type' AND value = 'owl:Class' AND t.source = entities.source)")
    + """
, n AS (SELECT query, count(*) AS n FROM hits GROUP BY query)
SELECT q.query, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'one' ELSE 'many' END AS outcome,
  h.id, h.source, h.via, CASE WHEN n = 1 THEN c.definition END AS definition,
  CASE WHEN n = 1 THEN c.ontology_iri END AS ontology_iri
FROM q LEFT JOIN n USING (query) LEFT JOIN hits h ON h.query = q.query LEFT JOIN cite c ON c.id = h.id"""))
def borrow_candidates(spark, sf):
    labels = lift.read(spark, sf, "nation").select(F.col("n_name").alias("query")).union(
        lift.read(spark, sf, "part").select(
            F.concat(F.lit("R"), F.col("p_partkey").cast("string"))))
    return R.borrow_candidates(labels, lift.index(spark, sf))


@query("borrow_flags", lifted("entities attributes", CITATION + """
, c AS (SELECT CASE WHEN source = 'part' AND starts_with(id, 'part:') THEN substr(id, 5) ELSE id END AS id,
    CASE WHEN source = 'supply' THEN id ELSE label END AS label, source, ontology_iri, ontology_title FROM cite)
SELECT id, starts_with(id, ':') AS default_prefix, coalesce(label, '') = '' OR label = id AS label_missing,
  CASE WHEN coalesce(label, '') <> '' AND label <> id THEN label END AS label,
  CASE WHEN coalesce(label, '') <> '' AND label <> id THEN label ELSE substr(id, instr(id, ':') + 1) END AS heading_label,
  CASE WHEN starts_with(id, ':') THEN 'http://d/' END AS namespace,
  CASE WHEN starts_with(id, ':') THEN 'd' END AS suggested_prefix, ontology_iri AS is_defined_by FROM c"""))
def borrow_flags(spark, sf):
    idx = lift.index(spark, sf)
    cited = R.entity_citation(idx.entities.select("id"), idx)
    cited = cited.withColumn("id", F.when(F.col("id").like("part:%"), F.substring("id", 5, 100))
                             .otherwise(F.col("id")))
    cited = cited.withColumn("label", F.when(F.col("source") == "supply", F.col("id"))
                             .otherwise(F.col("label")))
    spaces = idx.prefixes.where("source = 'part' and prefix = 'part'").select(
        "source", "data_source", F.lit("").alias("prefix"), F.lit("http://d/").alias("expansion"))
    return R.borrow_flags(cited, R.Index(idx.sources, idx.entities, idx.attributes, spaces,
                                         idx.global_prefixes))
