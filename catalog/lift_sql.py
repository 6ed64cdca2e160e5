"""The lift of the driver's tables, restated in SQL for the independent engine."""

from __future__ import annotations

DATA = "http://data.example.org/"

_SRC = ["geo", "part", "sales", "supply"]


def values(rows: list[tuple]) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"


CTES = {
    "entities": f"""
  SELECT *, CASE WHEN contains(id, '://') THEN 'uri' WHEN contains(id, ':') THEN 'curie'
            ELSE 'unknown' END AS kind FROM (
    SELECT 'part:P' || p_partkey AS id, CASE WHEN p_partkey % 97 <> 0 THEN p_name END AS label,
           'part' AS source, '' AS data_source FROM part
    UNION ALL SELECT 'nation:N' || n_nationkey, n_name, 'geo', '' FROM nation
    UNION ALL SELECT 'region:R' || r_regionkey, r_name, 'geo', '' FROM region
    UNION ALL SELECT 'supplier:S' || s_suppkey, s_name, 'supply', '' FROM supplier
    UNION ALL SELECT 'nation:N' || n_nationkey, 'S ' || n_name, 'supply', '' FROM nation
      WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'customer:C' || c_custkey, c_name, 'sales', '' FROM customer
    UNION ALL SELECT 'nation:N' || n_nationkey, 'C ' || n_name, 'sales', '' FROM nation
      WHERE n_nationkey IN (SELECT c_nationkey FROM customer)
    UNION ALL SELECT a, b, c, '' FROM {values(
        [(f"ont:{s} ont:{s}/1.0", f"Ontology {s}", s) for s in _SRC]
        + [("ex:suppliedBy", "supplied by", "part"), ("ex:note", "note", "part")])} v(a, b, c))""",
    "attributes": f"""
  SELECT 'part:P' || p_partkey AS id, 'part' AS source, '' AS data_source, 'rdf:type' AS prop,
         'owl:NamedIndividual' AS value, '' AS lang, CAST(0 AS BIGINT) AS ord FROM part
  UNION ALL SELECT 'part:P' || p_partkey, 'part', '', 'rdfs:label', p_name,
         ['', 'en', 'de', 'ko'][p_partkey % 4 + 1], 1 FROM part WHERE p_partkey % 7 <> 0
  UNION ALL SELECT 'part:P' || p_partkey, 'part', '', 'rdfs:label', p_name || ' v2',
         ['', 'en', 'de', 'ko'][(p_partkey + 1) % 4 + 1], 2 FROM part
         WHERE p_partkey % 7 <> 0 AND p_partkey % 3 = 0
  UNION ALL SELECT 'part:P' || p_partkey, 'part', '', 'Types', 'ptype:' || p_type, '', 3 FROM part
  UNION ALL SELECT 'part:P' || p_partkey, 'part', '', 'ex:brand', p_brand, '', 4 FROM part
  UNION ALL SELECT 'part:P' || p_partkey, 'part', '', 'ex:size', CAST(p_size AS VARCHAR), '', 5 FROM part
  UNION ALL SELECT 'part:P' || p_partkey, 'part', '', 'skos:definition',
         'A ' || p_name || ' of size ' || p_size, '', 6 FROM part WHERE p_partkey % 5 <> 0
  UNION ALL SELECT 'nation:N' || n_nationkey, 'geo', '', 'rdf:type', 'owl:Class', '', 0 FROM nation
  UNION ALL SELECT 'nation:N' || n_nationkey, 'geo', '', 'SubClassOf', 'region:R' || n_regionkey, '', 1 FROM nation
  UNION ALL SELECT 'region:R' || r_regionkey, 'geo', '', 'rdf:type', 'owl:Class', '', 0 FROM region
  UNION ALL SELECT 'supplier:S' || s_suppkey, 'supply', '', 'rdf:type', 'owl:NamedIndividual', '', 0 FROM supplier
  UNION ALL SELECT 'supplier:S' || s_suppkey, 'supply', '', 'Types', 'nation:N' || s_nationkey, '', 1 FROM supplier
  UNION ALL SELECT 'supplier:S' || s_suppkey, 'supply', '', 'SameAs', 'nation:N' || s_nationkey, '', 2
         FROM supplier WHERE s_suppkey % 9 = 0
  UNION ALL SELECT 'nation:N' || n_nationkey, 'supply', '', 'rdf:type', 'owl:Class', '', 0 FROM nation
         WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)
  UNION ALL SELECT 'nation:N' || n_nationkey, 'supply', '', 'rdfs:label', 'S ' || n_name, 'en', 1 FROM nation
         WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)
  UNION ALL SELECT 'customer:C' || c_custkey, 'sales', '', 'rdf:type', 'owl:NamedIndividual', '', 0 FROM customer
  UNION ALL SELECT 'customer:C' || c_custkey, 'sales', '', 'Types', 'nation:N' || c_nationkey, '', 1 FROM customer
  UNION ALL SELECT 'customer:C' || c_custkey, 'sales', '', 'ex:segment', c_mktsegment, '', 2 FROM customer
  UNION ALL SELECT 'nation:N' || n_nationkey, 'sales', '', 'rdf:type', 'owl:Class', '', 0 FROM nation
         WHERE n_nationkey IN (SELECT c_nationkey FROM customer)
  UNION ALL SELECT a, b, '', c, d, '', e FROM {values(
        [(f"ont:{s} ont:{s}/1.0", s, "rdf:type", "owl:Ontology", 0) for s in _SRC]
        + [(f"ont:{s} ont:{s}/1.0", s, "dcterms:title", f"The {s} terms", 1) for s in _SRC]
        + [("ex:suppliedBy", "part", "rdf:type", "owl:ObjectProperty", 0),
           ("ex:note", "part", "rdf:type", "owl:AnnotationProperty", 0)])} v(a, b, c, d, e)""",
    "lines": """
  SELECT *, (l_orderkey * 10 + l_linenumber) * 10000000 + l_suppkey AS place FROM lineitem""",
    "axioms": """
  SELECT 'part:P' || l_partkey AS id, 'part' AS source, '' AS data_source, 'Facts' AS prop,
    CASE WHEN l_linenumber = 7 THEN 'ex:shippedBy supplier:S' || l_suppkey
         WHEN l_linenumber = 6 AND l_suppkey % 10 = 0 THEN 'ex:note supplier:S' || l_suppkey
         WHEN l_suppkey % 33 = 0 THEN 'ex:suppliedBy (supplier:S' || l_suppkey
         ELSE 'ex:suppliedBy supplier:S' || l_suppkey END AS value, '' AS lang,
    place * 4 + 100 AS ord FROM lines
  UNION ALL SELECT 'part:P' || l_partkey, 'part', '', 'Domain', 'region:R1', '', place * 4 + 101
    FROM lines WHERE l_partkey % 50 = 0
  UNION ALL SELECT 'part:P' || l_partkey, 'part', '', 'Facts', '', '', place * 4 + 102
    FROM lines WHERE l_partkey % 70 = 0
  UNION ALL SELECT 'part:P' || l_partkey, 'part', '', 'SubClassOf',
    'ex:near some part:P' || l_partkey, '', place * 4 + 103 FROM lines WHERE l_partkey % 90 = 0""",
    "all_rows": "SELECT * FROM attributes UNION ALL SELECT * FROM axioms",
    "prefixes": f"""
  SELECT a AS source, '' AS data_source, b AS prefix, c AS expansion FROM {values(
        [("part", "part", DATA + "part/"), ("part", "ptype", DATA + "ptype/"),
         ("part", "ont", DATA + "ont/"), ("geo", "nation", DATA + "nation/"),
         ("geo", "region", DATA + "region/"), ("supply", "supplier", DATA + "supplier/"),
         ("supply", "nation", "http://supply.example.org/nation/"),
         ("sales", "customer", DATA + "customer/"), ("sales", "data", DATA),
         ("web", "web", "http://m."), ("web", "", DATA + "default/")])} v(a, b, c)
  UNION ALL SELECT DISTINCT 'web', '', 'h' || substr(md5(regexp_extract(url, '^(https?://[^/]+/)', 1)), 1, 10),
    regexp_extract(url, '^(https?://[^/]+/)', 1) FROM pages
    WHERE regexp_extract(url, '^(https?://[^/]+/)', 1) <> ''""",
    "global_prefixes": f"""
  SELECT a AS prefix, b AS expansion, 1 AS trust FROM {values([
        ("rdf", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"),
        ("rdfs", "http://www.w3.org/2000/01/rdf-schema#"),
        ("owl", "http://www.w3.org/2002/07/owl#"),
        ("xsd", "http://www.w3.org/2001/XMLSchema#"),
        ("skos", "http://www.w3.org/2004/02/skos/core#"),
        ("dcterms", "http://purl.org/dc/terms/"),
        ("foaf", "http://xmlns.com/foaf/0.1/"),
        ("obo", "http://purl.obolibrary.org/obo/"),
        ("sh", "http://www.w3.org/ns/shacl#"),
        ("prov", "http://www.w3.org/ns/prov#"),
        ("ex", "http://ex.example.org/")])} v(a, b)""",
    "sources": f"""
  SELECT a AS source, '' AS data_source, 'table' AS type, CAST(b AS DOUBLE) AS last_modified,
    CAST(c AS DOUBLE) AS last_updated FROM {values(
        [(s, 1000 + i, 2000 + i) for i, s in enumerate([*_SRC, "web"])])} v(a, b, c)""",
    "remarks": f"""
  SELECT place AS doc, l_partkey AS part, 'see part:P' || l_partkey || ' from <{DATA}supplier/S'
    || l_suppkey || '> via {DATA}nation/N' || (l_suppkey % 25)
    || ', not part:12 or ex:http://a/b, line ' || l_linenumber AS text FROM lines""",
    "edges_acyclic": """
  SELECT 'P' || p_partkey AS child, 'P' || (p_partkey // 2) AS parent FROM part WHERE p_partkey > 0""",
    "edges_cyclic": """
  SELECT 'P' || p_partkey AS child,
    'P' || ((p_partkey * p_partkey + 1) % (SELECT count(*) FROM part)) AS parent FROM part""",
    "brands": """
  SELECT DISTINCT 'b' || substr(p_brand, 7) AS doc, CAST(substr(p_brand, 7) AS INTEGER) AS n FROM part""",
    "outline_lines": """
  SELECT doc, CAST(o AS BIGINT) AS ord, t AS text FROM (
    SELECT doc, unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25,
        26, 27, 28, 29, 30, 31, 32, 33, 34, 40, 41, 42, 43, 44, 45]) AS o, unnest([
      '* doc ' || doc, ':PROPERTIES:', CASE WHEN n % 9 <> 0 THEN ':ID: ' || doc END, ':X-context-type: ontology',
      ':X-context-localname: ' || CASE WHEN n % 5 = 0 THEN 'other' ELSE doc END,
      CASE WHEN n % 4 = 0 THEN ':header-args:omn: :noweb no'
        ELSE ':header-args:omn: :tangle ' || doc || '.omn :noweb yes' END,
      ':END:', '** Prefixes', ':PROPERTIES:', ':prefixdefs: yes', ':END:', '| prefix | uri |', '|--------+-----|',
      CASE WHEN n % 10 <> 0 THEN '| part: | http://data.example.org/part/ |' END,
      CASE WHEN n % 10 <> 0 THEN '| ex: | http://ex.example.org/ |' END,
      CASE WHEN n % 10 <> 0 THEN '| ont: | http://data.example.org/ont/ |' END,
      CASE WHEN n % 10 <> 0 THEN '| part: | http://other.example.org/ |' END,
      '** ' || doc || ' ontology (' || CASE WHEN n % 6 = 0 THEN 'none'
        WHEN n % 7 = 0 THEN 'zz:' || doc || ' zz:' || doc || '/1.0'
        ELSE 'ont:' || doc || ' ont:' || doc || '/1.0' END || ')',
      ':PROPERTIES:', ':ID: ' || doc || '-ontology-declaration', ':resourcedefs: yes', ':END:',
      ' - rdfs:comment :: about ' || doc, '** Classes', ':PROPERTIES:', ':ID: ' || doc || '-class-hierarchy',
      ':resourcedefs: yes', ':END:', '*** Thing of ' || doc || ' (ex:T' || doc || ')', ' - rdfs:comment :: top',
      '#+begin_src omn', 'Class: ex:T' || doc, '#+end_src', 'see part:P1 in prose',
      '** Individuals', ':PROPERTIES:', ':ID: ' || doc || '-individuals',
      ':resourcedefs: ' || CASE WHEN n % 8 = 0 THEN 'no' ELSE 'yes' END,
      ':X-subheading-relation: ex:partOf', ':END:']) AS t FROM brands
    UNION ALL
    SELECT doc, base + unnest([0, 1, 2, 3, 4, 5, 6]), unnest([
      CASE WHEN k % 4 = 3 THEN '**** ' ELSE '*** ' END || p_name || CASE WHEN k % 31 = 0 THEN ''
        ELSE ' (part:P' || k || ')' END || CASE WHEN k % 37 = 0 THEN '  :nodeclare:' ELSE '' END,
      CASE WHEN k % 5 <> 0 THEN ' - rdfs:comment :: size ' || p_size END,
      CASE WHEN k % 5 <> 0 AND k % 3 = 0 THEN '   and brand ' || doc END,
      CASE WHEN k % 5 <> 0 AND k % 7 = 0 THEN '   - rdfs:seeAlso :: meta ' || k END,
      CASE WHEN k % 11 = 0 THEN ' - Types ::' ELSE ' - Types :: ex:T' || doc END,
      CASE WHEN k % 50 = 0 THEN ' - SubClassOf :: ex:T' || doc END,
      CASE WHEN k % 60 = 0 THEN ' - ex:unknown :: odd' END]) FROM bparts)
  WHERE t IS NOT NULL""",
    "bparts": """
  SELECT *, p_partkey AS k, 1000 + p_partkey * 10 AS base, 'b' || substr(p_brand, 7) AS doc,
    CAST(substr(p_brand, 7) AS INTEGER) AS n FROM part""",
    # The node table of the outline documents, straight from the tables.
    "nodes": """
  SELECT *, CASE WHEN uri IS NULL AND NOT nodeclare AND level > 9 THEN '' END AS unused FROM (
    SELECT doc, CAST(1 AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id, 1 AS level, 'doc ' || doc AS title,
      CAST(NULL AS VARCHAR) AS uri, CAST(NULL AS VARCHAR) AS label, CAST(NULL AS VARCHAR) AS rdf_type,
      CAST(NULL AS VARCHAR) AS section_id, CASE WHEN n % 9 <> 0 THEN doc END AS own_id, false AS resourcedefs,
      false AS nodeclare, n FROM brands
    UNION ALL SELECT doc, 8, 1, 2, 'Prefixes', NULL, NULL, NULL, NULL, NULL, false, false, n FROM brands
    UNION ALL SELECT doc, 18, 1, 2, doc || ' ontology (' || CASE WHEN n % 6 = 0 THEN 'none'
        WHEN n % 7 = 0 THEN 'zz:' || doc || ' zz:' || doc || '/1.0'
        ELSE 'ont:' || doc || ' ont:' || doc || '/1.0' END || ')',
      CASE WHEN n % 6 = 0 THEN NULL WHEN n % 7 = 0 THEN 'zz:' || doc || ' zz:' || doc || '/1.0'
        ELSE 'ont:' || doc || ' ont:' || doc || '/1.0' END,
      doc || ' ontology', 'owl:Ontology', NULL, doc || '-ontology-declaration', true, false, n FROM brands
    UNION ALL SELECT doc, 24, 1, 2, 'Classes', NULL, NULL, NULL, NULL, doc || '-class-hierarchy', true, false, n FROM brands
    UNION ALL SELECT doc, 29, 24, 3, 'Thing of ' || doc || ' (ex:T' || doc || ')', 'ex:T' || doc, 'Thing of ' || doc,
      'owl:Class', doc || '-class-hierarchy', NULL, false, false, n FROM brands
    UNION ALL SELECT doc, 40, 1, 2, 'Individuals', NULL, NULL, NULL, NULL, doc || '-individuals', n % 8 <> 0, false, n FROM brands
    UNION ALL SELECT doc, base, CASE WHEN k % 4 = 3 THEN coalesce(last_value(CASE WHEN k % 4 <> 3 THEN base END IGNORE NULLS)
        OVER (PARTITION BY doc ORDER BY k), 40) ELSE 40 END,
      CASE WHEN k % 4 = 3 THEN 4 ELSE 3 END,
      p_name || CASE WHEN k % 31 = 0 THEN '' ELSE ' (part:P' || k || ')' END,
      CASE WHEN k % 31 <> 0 AND k % 37 <> 0 THEN 'part:P' || k END,
      CASE WHEN k % 31 <> 0 THEN p_name END,
      CASE WHEN n % 8 <> 0 THEN 'owl:NamedIndividual' END, CASE WHEN n % 8 <> 0 THEN doc || '-individuals' END,
      NULL, false, k % 37 = 0 OR (k % 4 = 3 AND coalesce(last_value(CASE WHEN k % 4 <> 3 THEN k END IGNORE NULLS)
        OVER (PARTITION BY doc ORDER BY k), 1) % 37 = 0), n FROM bparts)""",
    "rows": """
  SELECT doc, CAST(18 AS BIGINT) AS node_id, CAST(23 AS BIGINT) AS row_id, CAST(NULL AS BIGINT) AS parent_row_id,
    'rdfs:comment' AS tag, 'about ' || doc AS value FROM brands
  UNION ALL SELECT doc, 29, 30, NULL, 'rdfs:comment', 'top' FROM brands
  UNION ALL SELECT doc, base, base + 1, NULL, 'rdfs:comment', 'size ' || p_size
    || CASE WHEN k % 3 = 0 THEN chr(10) || '   and brand ' || doc ELSE '' END FROM bparts WHERE k % 5 <> 0
  UNION ALL SELECT doc, base, base + 3, base + 1, 'rdfs:seeAlso', 'meta ' || k FROM bparts WHERE k % 5 <> 0 AND k % 7 = 0
  UNION ALL SELECT doc, base, base + 4, NULL, 'Types', CASE WHEN k % 11 = 0 THEN '' ELSE 'ex:T' || doc END FROM bparts
  UNION ALL SELECT doc, base, base + 5, NULL, 'SubClassOf', 'ex:T' || doc FROM bparts WHERE k % 50 = 0
  UNION ALL SELECT doc, base, base + 6, NULL, 'ex:unknown', 'odd' FROM bparts WHERE k % 60 = 0""",
    "outline_prefixes": """
  SELECT doc, p AS prefix, e AS expansion FROM brands, (VALUES ('part', 'http://data.example.org/part/'),
    ('ex', 'http://ex.example.org/'), ('ont', 'http://data.example.org/ont/')) v(p, e) WHERE n % 10 <> 0""",
}
_NEEDS = {"outline_lines": ["brands", "bparts"], "nodes": ["brands", "bparts"], "rows": ["brands", "bparts"],
          "outline_prefixes": ["brands"],
          "axioms": ["lines"], "all_rows": ["attributes", "axioms"], "remarks": ["lines"]}


def lifted(tables: str, body: str) -> str:
    """`body` (a SELECT, or more CTEs starting with a comma) over the named lifted tables."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in tables.split():
        add(name)
    parts = ",\n".join(f"{name} AS ({CTES[name]})" for name in wanted)
    return f"WITH RECURSIVE {parts}\n{body.strip()}"


def prio(active: list[str], column: str = "source") -> str:
    """Rank of a source in the active list, NULL when it is not active."""
    whens = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(active))
    return f"CASE {column} {whens} END"


def lang_key(prefs: list[str], lang: str = "lang", order: str = "ord") -> str:
    """ORDER BY list of the language choice."""
    whens = " ".join(f"WHEN '{'' if p == ':untagged' else p.lower()}' THEN {i}"
                     for i, p in enumerate(prefs))
    rank = f"CASE lower({lang}) {whens} ELSE {len(prefs)} END"
    return f"{rank}, CASE WHEN {rank} = {len(prefs)} THEN {lang} ELSE '' END, {order}"
