"""Identifier and prefix queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.lift_sql import lifted, prio
from termweave.functions import ident as I
from termweave.operators import identifiers as P
from termweave.sources import lift

ACTIVE = ["supply", "geo", "part", "sales", "web"]
PAIRS = [(s, "") for s in ACTIVE]
WEB = [("web", ""), ("part", ""), ("sales", "")]


def url_tokens(spark, sf):
    return lift.read(spark, sf, "pages").select("url")


@query("id_kind", """
SELECT url AS id, 'uri' AS kind FROM pages
UNION ALL SELECT 'part:P' || p_partkey, 'curie' FROM part
UNION ALL SELECT p_name, 'unknown' FROM part""")
def id_kind(spark, sf):
    part = lift.read(spark, sf, "part")
    ids = (lift.read(spark, sf, "pages").select(F.col("url").alias("id"))
           .union(part.select(F.concat(F.lit("part:P"), F.col("p_partkey").cast("string"))))
           .union(part.select("p_name")))
    return ids.select("id", I.id_kind(F.col("id")).alias("kind"))


@query("expand_curie", lifted("entities prefixes global_prefixes", f"""
, ranked AS (SELECT prefix, expansion, {prio(ACTIVE)} AS p FROM prefixes WHERE {prio(ACTIVE)} IS NOT NULL
    UNION ALL SELECT prefix, expansion, 1000 FROM global_prefixes),
best AS (SELECT prefix, arg_min(expansion, p) AS expansion FROM ranked GROUP BY prefix)
SELECT DISTINCT e.id, b.expansion || substr(e.id, instr(e.id, ':') + 1) AS iri
FROM entities e LEFT JOIN best b ON b.prefix = split_part(e.id, ':', 1)"""))
def expand_curie(spark, sf):
    idx = lift.index(spark, sf)
    return P.expand_curie(idx.entities.select("id").distinct(), "id", idx, PAIRS)


_CONTRACT = """
, ranked AS (SELECT prefix, expansion, {prio} AS p FROM prefixes WHERE {prio} IS NOT NULL
    UNION ALL SELECT prefix, expansion, 1073741824 FROM global_prefixes),
iris AS (SELECT DISTINCT url AS iri FROM pages
    UNION SELECT 'http://data.example.org/part/P' || p_partkey FROM part
    UNION SELECT 'http://m.' || p_brand FROM part),
cand AS (SELECT iri, prefix || ':' || substr(iri, length(expansion) + 1) AS curie,
    row_number() OVER (PARTITION BY iri ORDER BY length(expansion) DESC, p, prefix) AS place
  FROM iris JOIN ranked ON length(iri) > length(expansion) AND starts_with(iri, expansion))"""
CONTRACT = _CONTRACT.replace("{prio}", prio(["web", "part", "sales"]))


def iris(spark, sf):
    part = lift.read(spark, sf, "part")
    return (url_tokens(spark, sf).select(F.col("url").alias("iri"))
            .union(part.select(F.concat(F.lit(lift.DATA + "part/P"), F.col("p_partkey").cast("string"))))
            .union(part.select(F.concat(F.lit("http://m."), "p_brand"))).distinct())


@query("contract_uri", lifted("prefixes global_prefixes",
                              CONTRACT + " SELECT iri, curie, CAST(place AS INTEGER) AS place FROM cand"))
def contract_uri(spark, sf):
    idx = lift.index(spark, sf)
    return P.contract_ranked(P.contract_uri(iris(spark, sf), "iri", idx, WEB))


@query("contract_first", lifted("prefixes global_prefixes",
                                CONTRACT + " SELECT iri, curie FROM cand WHERE place = 1"))
def contract_first(spark, sf):
    idx = lift.index(spark, sf)
    return P.contract_first(iris(spark, sf), "iri", idx, WEB)


@query("contract_best", lifted("prefixes", """
, iris AS (SELECT DISTINCT url AS iri FROM pages
    UNION SELECT 'http://data.example.org/part/P' || p_partkey FROM part
    UNION SELECT expansion FROM prefixes),
cand AS (SELECT iri, prefix || ':' || substr(iri, length(expansion) + 1) AS curie,
    row_number() OVER (PARTITION BY iri ORDER BY length(expansion) DESC, prefix) AS place
  FROM iris JOIN prefixes ON starts_with(iri, expansion))
SELECT iri, curie FROM cand WHERE place = 1"""))
def contract_best(spark, sf):
    table = lift.prefixes(spark, sf)
    part = lift.read(spark, sf, "part")
    rows = (url_tokens(spark, sf).select(F.col("url").alias("iri"))
            .union(part.select(F.concat(F.lit(lift.DATA + "part/P"), F.col("p_partkey").cast("string"))))
            .union(table.select("expansion")))
    return P.contract_best(rows, "iri", table)


@query("to_bracketed_iri", lifted("entities prefixes", """
, t AS (SELECT prefix, expansion FROM prefixes WHERE source = 'part'),
names AS (SELECT id FROM entities WHERE source IN ('part', 'sales')
    UNION ALL SELECT p_name FROM part)
SELECT id, CASE WHEN NOT regexp_matches(id, '^([a-zA-Z][-a-zA-Z0-9_.]*|):[-a-zA-Z0-9_./:]*$') THEN id
  WHEN t.expansion IS NOT NULL THEN '<' || t.expansion || substr(id, instr(id, ':') + 1) || '>'
  ELSE id END AS kept,
  CASE WHEN NOT regexp_matches(id, '^([a-zA-Z][-a-zA-Z0-9_.]*|):[-a-zA-Z0-9_./:]*$') THEN id
  WHEN t.expansion IS NOT NULL THEN '<' || t.expansion || substr(id, instr(id, ':') + 1) || '>'
  END AS strict
FROM names LEFT JOIN t ON t.prefix = split_part(id, ':', 1) AND contains(id, ':')"""))
def to_bracketed_iri(spark, sf):
    table = lift.prefixes(spark, sf).where("source = 'part'")
    names = lift.entities(spark, sf).where("source in ('part', 'sales')").select("id").union(
        lift.read(spark, sf, "part").select("p_name"))
    kept = P.to_bracketed_iri(names, "id", table, "kept")
    return P.to_bracketed_iri(kept, "id", table, "strict", noerror=True)


@query("id_parts", lifted("entities", """
, ids AS (SELECT id FROM entities UNION ALL SELECT '<' || url || '>' FROM pages)
SELECT id, CASE WHEN starts_with(id, '<') THEN substr(id, 2, length(id) - 2) ELSE id END AS bare,
  regexp_split_to_array(id, '[ \\t]+')[1] AS first_token,
  regexp_split_to_array(id, '[ \\t]+')[-1] AS last_token,
  substr(id, instr(id, ':') + 1) AS local, split_part(id, ':', 1) AS prefix,
  regexp_extract(id, '([^#/]*)$', 1) AS tail FROM ids"""))
def id_parts(spark, sf):
    ids = lift.entities(spark, sf).select("id").union(
        url_tokens(spark, sf).select(F.concat(F.lit("<"), "url", F.lit(">"))))
    c = F.col("id")
    return ids.select("id", I.strip_brackets(c).alias("bare"),
                      I.first_id_token(c).alias("first_token"), I.last_id_token(c).alias("last_token"),
                      I.local_name(c).alias("local"), I.curie_prefix(c).alias("prefix"),
                      I.iri_tail(c).alias("tail"))


@query("list_prefixes", lifted("prefixes", """
SELECT * FROM prefixes WHERE source = 'web' AND data_source = '' ORDER BY prefix"""))
def list_prefixes(spark, sf):
    return P.list_prefixes(lift.index(spark, sf), "web", "")


@query("prefix_candidates", lifted("prefixes global_prefixes", """
SELECT prefix, expansion FROM prefixes UNION SELECT prefix, expansion FROM global_prefixes"""))
def prefix_candidates(spark, sf):
    return P.prefix_candidates(lift.index(spark, sf))


@query("merge_prefixes", """
WITH r AS (SELECT lang AS doc, source AS prefix, 'http://' || (doc_id % 3) || '/' AS expansion, doc_id AS pos
           FROM documents)
SELECT doc, prefix, arg_max(expansion, pos) AS expansion, min(pos) AS pos,
  count(DISTINCT expansion) > 1 AS conflict FROM r GROUP BY doc, prefix""")
def merge_prefixes(spark, sf):
    rows = lift.read(spark, sf, "documents").select(
        F.col("lang").alias("doc"), F.col("source").alias("prefix"),
        F.concat(F.lit("http://"), (F.col("doc_id") % 3).cast("string"), F.lit("/")).alias("expansion"),
        F.col("doc_id").alias("pos"))
    return P.merge_prefixes(rows, ["doc"])


@query("prefix_block", lifted("prefixes", """
SELECT source, string_agg(printf('Prefix: %-5s <%s>', prefix || ':', expansion), chr(10) ORDER BY prefix) AS omn,
  string_agg(printf('@prefix %-5s <%s> .', prefix || ':', expansion), chr(10) ORDER BY prefix) AS ttl,
  string_agg(printf('PREFIX %-5s <%s>', prefix || ':', expansion), chr(10) ORDER BY prefix) AS sparql
FROM prefixes GROUP BY source"""))
def prefix_block(spark, sf):
    rows = lift.prefixes(spark, sf)
    out = None
    for fmt in ("omn", "ttl", "sparql"):
        block = P.prefix_block(rows, fmt, ["source"], "prefix").withColumnRenamed("block", fmt)
        out = block if out is None else out.join(block, "source")
    return out


@query("strip_prefix_lines", """
SELECT doc_id, text AS stripped FROM documents""")
def strip_prefix_lines(spark, sf):
    docs = lift.read(spark, sf, "documents")
    head = F.concat(F.lit("PREFIX a: <http://a/"), F.col("doc_id").cast("string"),
                    F.lit(">\n@prefix b: <http://b/> .\n"), "text")
    return docs.select("doc_id", P.strip_prefix_lines(head).alias("stripped"))


@query("ontology_ids", lifted("entities prefixes", """
, t AS (SELECT source, unnest(string_split(id, ' ')) AS name FROM entities WHERE starts_with(id, 'ont:')),
x AS (SELECT t.source, name, p.expansion || substr(name, instr(name, ':') + 1) AS iri
      FROM t JOIN prefixes p ON p.source = 'part' AND p.prefix = split_part(name, ':', 1))
SELECT source, name FROM x UNION SELECT source, iri FROM x UNION SELECT source, '<' || iri || '>' FROM x"""))
def ontology_ids(spark, sf):
    declared = lift.entities(spark, sf).where("id like 'ont:%'").select("source", "id")
    return P.ontology_ids(declared, lift.prefixes(spark, sf).where("source = 'part'").select(
        "prefix", "expansion"))
