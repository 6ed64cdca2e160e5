"""Bulk curation queries over outline documents and the lifted index."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import outlines, query
from catalog.lift_sql import lifted
from termweave.operators import curation as K
from termweave.sources import lift


def parts(spark, sf):
    return outlines.nodes(spark, sf), outlines.rows(spark, sf), outlines.parsed(spark, sf)


def part_ids(spark, sf, test):
    key = F.col("p_partkey")
    return lift.read(spark, sf, "part").where(test(key)).select(
        F.concat(F.lit("part:P"), key.cast("string")).alias("id"), key.alias("k"))


UP = """
, up AS (SELECT n.*, p.uri AS parent_uri, (node_id_ - 1000) // 10 AS k FROM (SELECT *, node_id AS node_id_ FROM nodes) n
    LEFT JOIN (SELECT doc AS d, node_id AS i, uri FROM nodes) p(d, i, uri) ON p.d = n.doc AND p.i = n.parent_id)
, refs AS (SELECT parent_uri AS id, 'child' AS class, doc, uri AS holder FROM up WHERE uri IS NOT NULL AND parent_uri IS NOT NULL
  UNION ALL SELECT value, CASE tag WHEN 'Types' THEN 'axiom' ELSE 'axiom-child' END, r.doc, uri FROM rows r JOIN nodes n USING (doc, node_id)
    WHERE uri IS NOT NULL AND starts_with(value, 'ex:T')
  UNION ALL SELECT 'ex:T' || doc, 'code', doc, NULL FROM brands UNION ALL SELECT 'part:P1', 'prose', doc, NULL FROM brands)"""


@query("reference_scan", lifted("nodes rows", UP + " SELECT id, class, count(*) AS n FROM refs GROUP BY id, class"))
def reference_scan(spark, sf):
    ids = part_ids(spark, sf, lambda k: k >= 0).select("id").union(
        lift.brands(spark, sf).select(F.concat(F.lit("ex:T"), "doc")))
    return K.reference_counts(K.reference_scan(ids, *parts(spark, sf)))


def mapping(spark, sf):
    """Even parts move to another name, and so does the class of every document."""
    ids = part_ids(spark, sf, lambda k: k % 2 == 0)
    return ids.select(F.col("id").alias("old"), F.concat(F.lit("part:Q"), F.col("k").cast("string")).alias("new")).union(
        lift.brands(spark, sf).select(F.concat(F.lit("ex:T"), "doc"), F.concat(F.lit("ex:U-"), "doc")))


def renamed(col):
    """SQL for one text after the mapping."""
    return (f"regexp_replace(regexp_replace({col}, 'part:P([0-9]*[02468])([^0-9]|$)', 'part:Q\\1\\2'), "
            "'ex:T(b[0-9]+)', 'ex:U-\\1')")


@query("rename_nodes", lifted("nodes", f"SELECT doc, node_id, {renamed('title')} AS title, {renamed('uri')} AS uri FROM nodes"))
def rename_nodes(spark, sf):
    nodes, rows, _parsed = parts(spark, sf)
    return K.rename_terms(mapping(spark, sf), nodes, rows)[0].select("doc", "node_id", "title", "uri")


@query("rename_inherited", lifted("nodes", f"""
SELECT n.doc, n.node_id, n.level, {renamed('p.uri')} AS parent_uri, coalesce(n.label, {renamed('n.uri')}) AS label
FROM nodes n LEFT JOIN nodes p ON p.doc = n.doc AND p.node_id = n.parent_id"""))
def rename_inherited(spark, sf):
    """Children name their renamed parents."""
    nodes, rows, _parsed = parts(spark, sf)
    return K.rename_terms(mapping(spark, sf), nodes, rows)[0].select("doc", "node_id", "level", "parent_uri", "label")


@query("rename_rows", lifted("rows", f"SELECT doc, row_id, tag, {renamed('value')} AS value FROM rows"))
def rename_rows(spark, sf):
    nodes, rows, _parsed = parts(spark, sf)
    return K.rename_terms(mapping(spark, sf), nodes, rows)[1].select("doc", "row_id", "tag", "value")


@query("rename_lines", lifted("outline_lines", f"""
SELECT doc, ord, CASE WHEN text LIKE 'see %' THEN text ELSE {renamed('text')} END AS text FROM outline_lines"""))
def rename_lines(spark, sf):
    return K.rename_lines(mapping(spark, sf), outlines.parsed(spark, sf)).select("doc", "ord", "text")


@query("rename_iris", """
WITH p AS (SELECT p_partkey AS k FROM part)
SELECT k, '<http://data.example.org/part/' || c || k || '> http://data.example.org/part/P' || k || '/x part:' || c || k
  || ', part:X' || k AS text, CAST(CASE c WHEN 'Q' THEN 2 ELSE 0 END AS INTEGER) AS changed
FROM (SELECT k, CASE WHEN k % 2 = 0 THEN 'Q' ELSE 'P' END AS c FROM p)""")
def rename_iris(spark, sf):
    """Full IRIs count in angles; a longer IRI or name is another one."""
    k = F.col("p_partkey").cast("string")
    base = lift.DATA + "part/P"
    text = F.concat(F.lit("<" + base), k, F.lit("> " + base), k, F.lit("/x part:P"), k, F.lit(", part:X"), k)
    frame = lift.read(spark, sf, "part").select(F.col("p_partkey").alias("k"), text.alias("text"))
    table = lift.prefixes(spark, sf).where("source = 'part'").select("prefix", "expansion")
    changes = K.rewrite_map(mapping(spark, sf), table)
    return K.rewrite_column(frame, ["k"], "text", changes).withColumnRenamed("_changed", "changed")


@query("rename_index", lifted("all_rows", """
, r AS (SELECT *, CASE WHEN contains(value, 'supplier:S') THEN CAST(regexp_extract(value, 'supplier:S([0-9]+)', 1) AS BIGINT) % 3 = 0 ELSE false END AS hit,
    starts_with(id, 'supplier:S') AND CAST(nullif(regexp_extract(id, 'supplier:S([0-9]+)', 1), '') AS BIGINT) % 3 = 0 AS own FROM all_rows)
SELECT CASE WHEN own THEN replace(id, 'supplier:S', 'supplier:Z') ELSE id END AS id, source, prop,
  CASE WHEN hit THEN replace(value, 'supplier:S', 'supplier:Z') ELSE value END AS value, ord, CAST(hit AS INTEGER) AS changed FROM r"""))
def rename_index(spark, sf):
    key = F.col("s_suppkey")
    names = lift.read(spark, sf, "supplier").where(key % 3 == 0).select(
        F.concat(F.lit("supplier:S"), key.cast("string")).alias("old"),
        F.concat(F.lit("supplier:Z"), key.cast("string")).alias("new"))
    return K.rename_index(names, lift.index(spark, sf, True).attributes).select(
        "id", "source", "prop", "value", "ord", "changed")


@query("rename_guard", lifted("nodes", """
, m AS (SELECT 'part:P' || p_partkey AS old, CASE p_partkey % 5 WHEN 0 THEN 'part:Q' || p_partkey WHEN 1 THEN 'part:P' || (p_partkey + 1)
    WHEN 2 THEN 'zz:Q' || p_partkey WHEN 3 THEN 'part:9' || p_partkey ELSE 'part:Q' || p_partkey END AS new FROM part
  UNION ALL SELECT 'part:P' || p_partkey, 'part:R' || p_partkey FROM part WHERE p_partkey % 5 = 4)
, d AS (SELECT split_part(uri, ' ', 1) AS id FROM nodes WHERE uri IS NOT NULL)
SELECT DISTINCT old AS id, 'malformed name' AS reason FROM m WHERE starts_with(new, 'part:9')
UNION ALL SELECT DISTINCT old, 'source is not declared' FROM m WHERE old NOT IN (SELECT id FROM d)
UNION ALL SELECT DISTINCT new, 'target is already declared' FROM m WHERE new IN (SELECT id FROM d)
UNION ALL SELECT DISTINCT new, 'prefix has no namespace' FROM m WHERE starts_with(new, 'zz:')
UNION ALL SELECT old, 'source has several targets' FROM m GROUP BY old HAVING count(DISTINCT new) > 1"""))
def rename_guard(spark, sf):
    ids, k, n = part_ids(spark, sf, lambda k: k >= 0), F.col("k"), F.col("k").cast("string")
    new = (F.when(k % 5 == 1, F.concat(F.lit("part:P"), (k + 1).cast("string"))).when(k % 5 == 2, F.concat(F.lit("zz:Q"), n))
           .when(k % 5 == 3, F.concat(F.lit("part:9"), n)).otherwise(F.concat(F.lit("part:Q"), n)))
    asked = ids.select(F.col("id").alias("old"), new.alias("new")).union(
        ids.where(k % 5 == 4).select("id", F.concat(F.lit("part:R"), n)))
    table = lift.prefixes(spark, sf).where("source = 'part'")
    return K.rename_guard(asked, K.declared(outlines.nodes(spark, sf)), table)


@query("merge_terms", lifted("nodes", """
, gone AS (SELECT doc, node_id, parent_id FROM nodes WHERE node_id >= 1000 AND (node_id - 1000) // 10 % 10 = 4 AND uri IS NOT NULL)
SELECT n.doc, n.node_id, CASE WHEN g.doc IS NOT NULL THEN g.parent_id ELSE n.parent_id END AS parent_id
FROM nodes n LEFT JOIN gone g ON g.doc = n.doc AND g.node_id = n.parent_id
WHERE (n.doc, n.node_id) NOT IN (SELECT (doc, node_id) FROM gone)"""))
def merge_terms(spark, sf):
    nodes, rows, _parsed = parts(spark, sf)
    pairs = part_ids(spark, sf, lambda k: k % 10 == 4).select(F.col("id").alias("old"), F.lit("ex:Tb1").alias("new"))
    return K.merge_terms(pairs, nodes, rows)[0].select("doc", "node_id", "parent_id")


WITHOUT = """
, gone AS (SELECT doc, node_id, parent_id FROM nodes WHERE node_id >= 1000 AND (node_id - 1000) // 10 % 10 = 4 AND uri IS NOT NULL)
, kept AS (SELECT n.* EXCLUDE (parent_id, level), CASE WHEN g.doc IS NOT NULL THEN g.parent_id ELSE n.parent_id END AS parent_id,
    CASE WHEN g.doc IS NOT NULL THEN 3 ELSE n.level END AS level FROM nodes n LEFT JOIN gone g ON g.doc = n.doc AND g.node_id = n.parent_id
  WHERE (n.doc, n.node_id) NOT IN (SELECT (doc, node_id) FROM gone))
SELECT n.doc, n.node_id, n.parent_id, n.level, n.uri, n.rdf_type, n.section_id, p.uri AS parent_uri
FROM kept n LEFT JOIN nodes p ON p.doc = n.doc AND p.node_id = n.parent_id"""
STATE = ["doc", "node_id", "parent_id", "level", "uri", "rdf_type", "section_id", "parent_uri"]


@query("merge_inherited", lifted("nodes", WITHOUT))
def merge_inherited(spark, sf):
    nodes, rows, _parsed = parts(spark, sf)
    pairs = part_ids(spark, sf, lambda k: k % 10 == 4).select(F.col("id").alias("old"), F.lit("ex:Tb1").alias("new"))
    return K.merge_terms(pairs, nodes, rows)[0].select(*STATE)


@query("delete_reparent", lifted("nodes", WITHOUT))
def delete_reparent(spark, sf):
    """What was below a deleted term inherits from what is above it."""
    ids = part_ids(spark, sf, lambda k: k % 10 == 4)
    return K.delete_terms(ids, "reparent", *parts(spark, sf))[0].select(*STATE)


@query("merge_climbs", lifted("edges_acyclic", """
, keep AS (SELECT p_partkey AS k, p_partkey // 2 AS up, CAST(1 AS BIGINT) AS hops FROM part WHERE p_partkey % 5 <> 1 OR p_partkey = 0)
, w(k, up) AS (SELECT k, up FROM keep WHERE k > 0 UNION ALL SELECT k, up // 2 FROM w WHERE up % 5 = 1 AND up > 0)
SELECT k, min(up) AS up FROM w GROUP BY k UNION ALL SELECT 0, NULL FROM part WHERE p_partkey = 0"""))
def merge_climbs(spark, sf):
    """Chains of removed terms in a deep tree: children attach to what is left above."""
    key = F.col("p_partkey")
    nodes = lift.read(spark, sf, "part").select(
        F.lit("d").alias("doc"), key.alias("node_id"),
        F.when(key > 0, F.floor(key / 2)).alias("parent_id"))
    gone = nodes.where("node_id % 5 = 1 AND node_id > 0")
    return K.surviving_parents(nodes, gone).select(F.col("node_id").alias("k"), F.col("parent_id").alias("up"))


@query("relabel", lifted("nodes", """
SELECT doc, node_id, CASE WHEN uri LIKE 'part:P%' AND (node_id - 1000) // 10 % 3 = 0 THEN 'new ' || (node_id - 1000) // 10 || ' (' || uri || ')'
  ELSE title END AS title FROM nodes"""))
def relabel(spark, sf):
    labels = part_ids(spark, sf, lambda k: k % 3 == 0).select(
        "id", F.concat(F.lit("new "), F.col("k").cast("string")).alias("new_label"))
    return K.relabel(outlines.nodes(spark, sf), labels).select("doc", "node_id", "title")


@query("delete_refusals", lifted("nodes rows", UP + """
, w AS (SELECT 'part:P' || p_partkey AS id FROM part WHERE p_partkey % 10 = 4 UNION SELECT 'ex:Tb1')
, d AS (SELECT split_part(uri, ' ', 1) AS id FROM nodes WHERE uri IS NOT NULL)
SELECT id, 'not declared' AS reason FROM w WHERE id NOT IN (SELECT id FROM d)
UNION ALL SELECT DISTINCT w.id, 'still referenced: ' || class FROM w JOIN refs USING (id)
  WHERE class IN ('axiom', 'code') AND w.id IN (SELECT id FROM d) AND (holder IS NULL OR holder NOT IN (SELECT id FROM w))
UNION ALL SELECT DISTINCT w.id, 'has children' FROM w JOIN refs USING (id)
  WHERE class IN ('child', 'axiom-child') AND w.id IN (SELECT id FROM d) AND holder NOT IN (SELECT id FROM w)"""))
def delete_refusals(spark, sf):
    ids = part_ids(spark, sf, lambda k: k % 10 == 4).select("id").union(
        lift.brands(spark, sf).where("n = 1").select(F.concat(F.lit("ex:T"), "doc")))
    return K.delete_terms(ids, "refuse", *parts(spark, sf))[2]


@query("delete_subtrees", lifted("nodes", """
, gone AS (SELECT doc, node_id FROM nodes WHERE uri LIKE 'part:P%' AND (node_id - 1000) // 10 % 10 = 4)
SELECT doc, node_id FROM nodes n WHERE (doc, node_id) NOT IN (SELECT (doc, node_id) FROM gone)
  AND (parent_id IS NULL OR (doc, parent_id) NOT IN (SELECT (doc, node_id) FROM gone))"""))
def delete_subtrees(spark, sf):
    ids = part_ids(spark, sf, lambda k: k % 10 == 4)
    return K.delete_terms(ids, "delete", *parts(spark, sf))[0].select("doc", "node_id")


@query("subtree", lifted("nodes", """
SELECT p.uri AS id, n.doc, n.node_id FROM nodes p JOIN nodes n ON n.doc = p.doc AND (n.node_id = p.node_id OR n.parent_id = p.node_id)
WHERE p.uri LIKE 'part:P%'"""))
def subtree(spark, sf):
    return K.subtree(part_ids(spark, sf, lambda k: k >= 0), outlines.nodes(spark, sf))


@query("is_descendant", lifted("nodes", """
, x AS (SELECT 'part:P' || p_partkey AS id, 'part:P' || (p_partkey + 1) AS other FROM part)
SELECT id, other, EXISTS (SELECT 1 FROM nodes p JOIN nodes n ON n.doc = p.doc AND n.parent_id = p.node_id
  WHERE p.uri = id AND n.uri = other) AS below FROM x"""))
def is_descendant(spark, sf):
    pairs = part_ids(spark, sf, lambda k: k >= 0).select(
        "id", F.concat(F.lit("part:P"), (F.col("k") + 1).cast("string")).alias("other"))
    return K.is_descendant(pairs, outlines.nodes(spark, sf))


MOVES = """
, m AS (SELECT 'part:P' || p_partkey AS id, 'part:P' || (p_partkey + 3) AS target FROM part WHERE p_partkey % 12 = 5
  UNION ALL SELECT 'part:P' || p_partkey, 'part:P' || p_partkey FROM part WHERE p_partkey % 12 = 6)
, j AS (SELECT m.*, a.doc AS ad, a.node_id AS an, a.parent_id AS ap, b.doc AS bd, b.node_id AS bn
    FROM m LEFT JOIN nodes a ON a.uri = m.id LEFT JOIN nodes b ON b.uri = m.target)
, r AS (SELECT *, CASE WHEN ad IS NULL THEN 'source is not declared' WHEN id = target THEN 'target is the term itself'
    WHEN bd IS NULL THEN 'target is not declared' WHEN ad <> bd THEN 'target is in another document'
    WHEN ap = bn THEN 'already there' END AS reason FROM j)"""


def moves(spark, sf):
    ids, k = part_ids(spark, sf, lambda k: (k % 12 == 5) | (k % 12 == 6)), F.col("k")
    target = F.concat(F.lit("part:P"), F.when(k % 12 == 5, k + 3).otherwise(k).cast("string"))
    return ids.select("id", target.alias("target"))


@query("move_refusals", lifted("nodes", MOVES + " SELECT DISTINCT id, reason FROM r WHERE reason IS NOT NULL"))
def move_refusals(spark, sf):
    return K.move_terms(moves(spark, sf), outlines.nodes(spark, sf))[1]


@query("move_terms", lifted("nodes", MOVES + """
SELECT n.doc, n.node_id, coalesce(r.bn, n.parent_id) AS parent_id FROM nodes n
LEFT JOIN r ON r.reason IS NULL AND r.ad = n.doc AND r.an = n.node_id"""))
def move_terms(spark, sf):
    return K.move_terms(moves(spark, sf), outlines.nodes(spark, sf))[0].select("doc", "node_id", "parent_id")


@query("move_inherited", lifted("nodes", MOVES + """
, x AS (SELECT n.* EXCLUDE (parent_id), coalesce(r.bn, n.parent_id) AS parent_id, r.bn IS NOT NULL AS moved FROM nodes n
  LEFT JOIN r ON r.reason IS NULL AND r.ad = n.doc AND r.an = n.node_id)
SELECT x.doc, x.node_id, x.parent_id, CASE WHEN x.moved OR coalesce(p.moved, false) THEN x.level + 1 ELSE x.level END AS level,
  x.uri, x.rdf_type, x.section_id, p.uri AS parent_uri
FROM x LEFT JOIN x p ON p.doc = x.doc AND p.node_id = x.parent_id"""))
def move_inherited(spark, sf):
    """A moved term and all below it change their levels; it names its new parent."""
    return K.move_terms(moves(spark, sf), outlines.nodes(spark, sf))[0].select(*STATE)


FOLD = """
, above AS (SELECT uri AS id, parent_uri AS p FROM up WHERE uri IS NOT NULL AND parent_uri IS NOT NULL
  UNION SELECT uri, value FROM nodes n JOIN rows r USING (doc, node_id) WHERE tag = 'SubClassOf' AND uri IS NOT NULL)
, c AS (SELECT id, count(*) AS n, min(p) AS p FROM above GROUP BY id)
, x AS (SELECT 'part:P' || p_partkey AS id FROM part)"""


@query("fold_into_parent", lifted("nodes rows", UP + FOLD + " SELECT id AS old, p AS new FROM c WHERE n = 1 AND id LIKE 'part:P%'"))
def fold_into_parent(spark, sf):
    return fold(spark, sf)[0]


@query("fold_refusals", lifted("nodes rows", UP + FOLD + """
 SELECT id, CASE WHEN n IS NULL THEN 'no immediate parent' ELSE 'several immediate parents' END AS reason
 FROM x LEFT JOIN c USING (id) WHERE n IS NULL OR n > 1"""))
def fold_refusals(spark, sf):
    return fold(spark, sf)[1]


@query("fold_dropped", lifted("nodes rows", UP + FOLD + """
 SELECT id, r.row_id, tag FROM c JOIN nodes n ON n.uri = c.id JOIN rows r USING (doc, node_id)
 WHERE c.n = 1 AND id LIKE 'part:P%' AND parent_row_id IS NULL"""))
def fold_dropped(spark, sf):
    return fold(spark, sf)[2].select("id", "row_id", "tag")


def fold(spark, sf):
    ids = part_ids(spark, sf, lambda k: k >= 0).select("id", F.lit(None).cast("string").alias("parent"))
    return K.fold_into_parent(ids, outlines.nodes(spark, sf), outlines.rows(spark, sf))


def index_rows(spark, sf):
    return lift.attributes(spark, sf).where("source = 'part' AND id LIKE 'part:P%'").select(
        "id", F.col("ord").alias("row_id"), F.col("prop").alias("keyword"), "value")


def edits(spark, sf):
    """Three edits per part at most; a third of the parts have one that cannot work."""
    key, none = F.col("p_partkey"), F.lit(None).cast("string")

    def edit(n, op, keyword, fragment, match):
        return F.struct((key * 10 + n).alias("edit_no"), F.lit(op).alias("op"), F.lit(keyword).alias("keyword"),
                        (none if fragment is None else F.lit(fragment)).alias("fragment"),
                        (none if match is None else match).alias("match"))

    cases = {
        0: [edit(0, "replace", "Types", "ptype:NEW", None)],
        1: [edit(0, "delete", "ex:size", None, F.concat(F.lit("  "), F.col("p_size").cast("string"), F.lit(" ")))],
        2: [edit(0, "add", "Facts", "ex:a part:P0", None), edit(1, "replace", "Facts", "ex:b part:P0", F.lit("ex:a   part:P0")),
            edit(2, "add", "Facts", "ex:a part:P0", None)],
        3: [edit(0, "delete", "ex:size", None, F.lit("no such size"))],
        4: [edit(0, "replace", "ex:brand", "X", None), edit(1, "replace", "ex:brand", "Y", None),
            edit(2, "delete", "ex:brand", None, F.lit("Y"))],
        5: [edit(0, "add", "Types", "ptype:Z", None), edit(1, "delete", "Types", None, None)],
    }
    chosen = F.array(*cases[5])
    for n, rows in cases.items():
        if n < 5:
            chosen = F.when(key % 6 == n, F.array(*rows)).otherwise(chosen)
    return lift.read(spark, sf, "part").select(
        F.concat(F.lit("part:P"), key.cast("string")).alias("id"), F.inline(chosen))


@query("edit_rows", lifted("attributes", """
, a AS (SELECT id, ord AS row_id, prop AS keyword, value, CAST(substr(id, 7) AS BIGINT) AS k FROM attributes
    WHERE source = 'part' AND id LIKE 'part:P%')
SELECT id, 0 AS added, row_id, keyword, CASE WHEN k % 6 = 0 AND keyword = 'Types' THEN 'ptype:NEW' ELSE value END AS value FROM a
WHERE NOT (k % 6 = 1 AND keyword = 'ex:size') AND NOT (k % 6 = 4 AND keyword = 'ex:brand')
UNION ALL SELECT 'part:P' || p_partkey, 1, p_partkey * 10, 'Facts', 'ex:b part:P0' FROM part WHERE p_partkey % 6 = 2
UNION ALL SELECT 'part:P' || p_partkey, 1, p_partkey * 10 + 2, 'Facts', 'ex:a part:P0' FROM part WHERE p_partkey % 6 = 2
UNION ALL SELECT 'part:P' || p_partkey, 1, p_partkey * 10, 'Types', 'ptype:Z' FROM part WHERE p_partkey % 6 = 5"""))
def edit_rows(spark, sf):
    """The rows of all terms after all edits; those that cannot work change nothing."""
    return K.edit_rows(edits(spark, sf), index_rows(spark, sf))[0]


@query("edit_errors", """
SELECT p_partkey * 10 AS edit_no, 'no matching row' AS reason FROM part WHERE p_partkey % 6 = 3
UNION ALL SELECT p_partkey * 10 + 1, 'several matching rows' FROM part WHERE p_partkey % 6 = 5""")
def edit_errors(spark, sf):
    return K.edit_rows(edits(spark, sf), index_rows(spark, sf))[1]


@query("sweep_empty_rows", lifted("axioms", """
SELECT id, prop AS keyword, ord AS row_id FROM axioms WHERE value = '' """))
def sweep_empty_rows(spark, sf):
    rows = lift.axioms(spark, sf).select("id", F.col("ord").alias("row_id"), F.col("prop").alias("keyword"), "value")
    return K.sweep_empty_rows(rows, rows.select("id"), "Facts")[1]


@query("check_edits", lifted("attributes", """
SELECT 'keyword-section' AS "check", 'error' AS severity, 'part:P' || p_partkey AS subject,
  'ERROR: Domain is not valid in section -individuals' AS message FROM part WHERE p_partkey % 7 = 0
UNION ALL SELECT 'axiom-names', 'warning', 'part:P' || p_partkey, 'WARNING: unknown name in axiom: nosuch:X'
  FROM part WHERE p_partkey % 7 = 1 UNION ALL SELECT 'blank-axiom', 'warning', 'part:P' || p_partkey, 'WARNING: axiom row without value: SameAs'
  FROM part WHERE p_partkey % 7 = 2"""))
def check_edits(spark, sf):
    key, none = F.col("p_partkey"), F.lit(None).cast("string")
    asked = lift.read(spark, sf, "part").where(key % 7 < 3).select(
        key.alias("edit_no"), F.concat(F.lit("part:P"), key.cast("string")).alias("id"),
        F.when(key % 7 == 1, "replace").otherwise("add").alias("op"),
        F.when(key % 7 == 0, "Domain").when(key % 7 == 1, "Types").otherwise("SameAs").alias("keyword"),
        F.when(key % 7 == 0, "region:R1").when(key % 7 == 1, "nosuch:X").otherwise(" ").alias("fragment"), none.alias("match"))
    types = lift.attributes(spark, sf).where("prop = 'rdf:type'").select("source", "id", F.col("value").alias("rdf_type"))
    issues, _errors = K.check_edits(asked, index_rows(spark, sf), types)
    return issues.select("check", "severity", "subject", "message")


INSERTED = """
, a AS (SELECT uri AS anchor, doc, node_id, level, rdf_type, (node_id - 1000) // 10 AS k FROM nodes WHERE uri LIKE 'part:P%')
, t AS (SELECT *, row_number() OVER (ORDER BY k) AS n FROM a WHERE k % 3 = 0 AND rdf_type IS NOT NULL)
, new AS (SELECT 'ex:N' || lpad(CAST(n AS VARCHAR), 6, '0') AS id, 'new ' || k AS label, doc, node_id AS parent_id, level + 1 AS level, anchor, k
  FROM t)"""


def inserted(spark, sf):
    """Terms below every third part; where parts have no kind the anchor is refused."""
    nodes = outlines.nodes(spark, sf)
    wanted = part_ids(spark, sf, lambda k: k % 3 == 0).select(
        F.col("k").alias("ord"), F.col("id").alias("anchor"), F.concat(F.lit("new "), F.col("k").cast("string")).alias("label"))
    typed = nodes.where("uri LIKE 'part:P%' AND rdf_type IS NULL").select(F.col("uri").alias("anchor"))
    new, _refusals = K.insert_terms(wanted.join(typed, "anchor", "left_anti"), nodes, "counter", "ex", True, template="N000000")
    return new


@query("insert_terms", lifted("nodes", INSERTED + " SELECT id, label, doc, parent_id, level, anchor FROM new"))
def insert_terms(spark, sf):
    return inserted(spark, sf).select("id", "label", "doc", "parent_id", "level", "anchor")


@query("with_inserted", lifted("nodes rows", INSERTED + """
, last AS (SELECT doc, max(p) AS m FROM (SELECT doc, node_id AS p FROM nodes UNION ALL SELECT doc, row_id FROM rows) GROUP BY doc)
SELECT doc, node_id, parent_id, level, uri, title FROM nodes
UNION ALL SELECT doc, m + row_number() OVER (PARTITION BY doc ORDER BY k), parent_id, level, id, label || ' (' || id || ')' FROM new JOIN last USING (doc)"""))
def with_inserted(spark, sf):
    """All nodes, the new terms last below their anchors."""
    nodes = outlines.nodes(spark, sf)
    out = K.with_inserted(inserted(spark, sf), nodes, outlines.rows(spark, sf))
    return out.select("doc", "node_id", "parent_id", "level", "uri", "title")


@query("row_template", lifted("nodes rows", """
SELECT DISTINCT 'new:' || n.uri AS id, tag, '' AS value FROM nodes n JOIN rows r USING (doc, node_id)
WHERE parent_row_id IS NULL AND uri LIKE 'part:P%'"""))
def row_template(spark, sf):
    nodes = outlines.nodes(spark, sf)
    new = nodes.where("uri LIKE 'part:P%'").select(F.concat(F.lit("new:"), "uri").alias("id"), F.col("uri").alias("anchor"))
    return K.row_template(new, nodes, outlines.rows(spark, sf)).select("id", "tag", "value")


@query("insert_tree", """
WITH p AS (SELECT DISTINCT p_type AS a, p_brand AS b, p_name AS c FROM part)
SELECT 1 AS level, a AS label, CAST(NULL AS VARCHAR) AS parent FROM p GROUP BY a
UNION ALL SELECT 2, b, a FROM p GROUP BY a, b UNION ALL SELECT 3, c, b FROM p""")
def insert_tree(spark, sf):
    """Shown by labels; ids must be unique for the parents to come out right."""
    paths = lift.read(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.array("p_type", "p_brand", "p_name").alias("path"))
    tree = K.insert_tree(paths, "ex", K.declared(outlines.nodes(spark, sf)))
    up = tree.select(F.col("id").alias("parent"), F.col("label").alias("_label"))
    return tree.join(up, "parent", "left").select("level", "label", F.col("_label").alias("parent"))


DECLARE = """
, t AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'part:P' || o_custkey WHEN 1 THEN 'zz:T' || o_orderkey ELSE 'ex:T' || o_orderkey END AS id,
    o_orderpriority AS label, CASE o_orderkey % 8 WHEN 2 THEN 'no:P' || o_orderkey WHEN 3 THEN 'ex:Tb1' END AS parent FROM orders)
, d AS (SELECT split_part(uri, ' ', 1) AS id FROM nodes WHERE uri IS NOT NULL)
, r AS (SELECT t.*, CASE WHEN id IN (SELECT id FROM d) THEN 'already declared'
    WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'declared twice in the batch' WHEN starts_with(id, 'zz:') THEN 'prefix has no namespace'
    WHEN parent IS NOT NULL AND parent NOT IN (SELECT id FROM d) THEN 'parent is not declared' END AS reason FROM t)"""


def declare(spark, sf):
    key = F.col("o_orderkey")
    n = key.cast("string")
    terms = lift.read(spark, sf, "orders").select(
        F.when(key % 4 == 0, F.concat(F.lit("part:P"), F.col("o_custkey").cast("string")))
        .when(key % 4 == 1, F.concat(F.lit("zz:T"), n)).otherwise(F.concat(F.lit("ex:T"), n)).alias("id"),
        F.col("o_orderpriority").alias("label"),
        F.when(key % 8 == 2, F.concat(F.lit("no:P"), n)).when(key % 8 == 3, "ex:Tb1").alias("parent"))
    table = outlines.prefixes(spark, sf).where("doc = 'b1'")
    return K.declare_terms(terms, K.declared(outlines.nodes(spark, sf)), table)


@query("declare_terms", lifted("nodes", DECLARE + " SELECT id, label, parent FROM r WHERE reason IS NULL"))
def declare_terms(spark, sf):
    return declare(spark, sf)[0]


@query("declare_refusals", lifted("nodes", DECLARE + " SELECT DISTINCT id, reason FROM r WHERE reason IS NOT NULL"))
def declare_refusals(spark, sf):
    return declare(spark, sf)[1]


@query("repair_sections", lifted("brands", """
SELECT doc, CAST(24 AS BIGINT) AS node_id, CASE WHEN n % 5 = 0 THEN 'other' ELSE doc END || '-class-hierarchy' AS own_id, true AS resourcedefs,
  false AS prefixdefs FROM brands WHERE n % 2 = 0
UNION ALL SELECT doc, 40, doc || '-individuals', true, false FROM brands WHERE n % 8 = 0
UNION ALL SELECT doc, 8, NULL, false, true FROM brands WHERE n % 3 = 0"""))
def repair_sections(spark, sf):
    """Documents whose class section lost its id, or whose prefix section lost its flag."""
    n = F.substring("doc", 2, 9).cast("int")
    lost = (F.col("node_id") == 24) & (n % 2 == 0)
    nodes = outlines.nodes(spark, sf).withColumn("own_id", F.when(~lost, F.col("own_id"))).withColumn(
        "prefixdefs", F.col("prefixdefs") & ~((F.col("node_id") == 8) & (n % 3 == 0)))
    return K.repair_sections(nodes)


DIFF = """
WITH b AS (SELECT p_brand, 'part:P' || p_partkey AS id, 'name' AS prop, p_name AS value FROM part
    UNION ALL SELECT p_brand, 'part:P' || p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part),
c AS (SELECT p_brand, 'part:P' || p_partkey AS id, 'name' AS prop, CASE WHEN p_partkey % 11 = 0 THEN p_name || ' new' ELSE p_name END AS value
    FROM part WHERE p_partkey % 10 <> 0 OR p_brand < 'Brand#2'
    UNION ALL SELECT p_brand, 'part:P' || p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 10 <> 0 OR p_brand < 'Brand#2'),
d AS (SELECT 'removed' AS side, * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM c) UNION ALL
      SELECT 'added', * FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM b))"""


def versions(spark, sf):
    key = F.col("p_partkey")
    part = lift.read(spark, sf, "part")

    def rows(frame, name):
        return frame.select("p_brand", F.concat(F.lit("part:P"), key.cast("string")).alias("id"), F.inline(F.array(
            F.struct(F.lit("name").alias("prop"), name.alias("value")),
            F.struct(F.lit("size").alias("prop"), F.col("p_size").cast("string").alias("value")))))

    changed = F.when(key % 11 == 0, F.concat("p_name", F.lit(" new"))).otherwise(F.col("p_name"))
    return rows(part, F.col("p_name")), rows(part.where((key % 10 != 0) | (F.col("p_brand") < "Brand#2")), changed)


@query("diff", DIFF + " SELECT side, id, prop, value, p_name AS label FROM d JOIN part ON id = 'part:P' || p_partkey")
def diff(spark, sf):
    old, new = versions(spark, sf)
    labels = lift.read(spark, sf, "part").select(
        F.concat(F.lit("part:P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("label"))
    return K.diff(old, new, ["p_brand", "id", "prop", "value"], labels).drop("p_brand")


@query("diff_status", DIFF + """
SELECT p_brand, CAST(coalesce(count_if(side = 'removed'), 0) AS BIGINT) AS removed, CAST(coalesce(count_if(side = 'added'), 0) AS BIGINT) AS added,
  CASE WHEN count(side) = 0 THEN 'identical' ELSE 'different' END AS status
FROM (SELECT DISTINCT p_brand FROM b) LEFT JOIN d USING (p_brand) GROUP BY p_brand""")
def diff_status(spark, sf):
    old, new = versions(spark, sf)
    return K.diff_status(old, new, ["p_brand", "id", "prop", "value"], "p_brand")
