"""Outline documents to nodes, description rows, prefixes, and on to the index.

Input is (doc, ord, text) lines of any number of documents. State that a reader would keep
while walking a document (current heading, open drawer, open block) is carried forward in
two levels, so a document that holds a third of all lines is still many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave import constants as K
from termweave.functions.ident import id_kind
from termweave.functions.text import entity_from_heading, heading_label
from termweave.plans.cut import cut
from termweave.plans.ordered import carry_forward

HEADING = r"^(\*+) +(.*?)(?:[ \t]+(:[\w@#%:]+:))?[ \t]*$"
PROPERTY = r"^[ \t]*:(\S+):(?:[ \t]+(.*?))?[ \t]*$"
ITEM = r"^([ \t]*)[-+] +(.*?) ::(?:[ \t]+(.*?))?[ \t]*$"
TABLE = r"^[ \t]*\|(.*)\|[ \t]*$"


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Lines with their heading (`node_id`) and the drawer or block they lie in."""
    text = F.col("text")
    heading = text.rlike(r"^\*+ ")
    drawer = (F.when(heading, "no").when(text.rlike(r"(?i)^[ \t]*:properties:[ \t]*$"), "yes")
              .when(text.rlike(r"(?i)^[ \t]*:end:[ \t]*$"), "no"))
    block = (F.when(heading, "")
             .when(text.rlike(r"(?i)^[ \t]*#\+begin_src"),
                   F.lower(F.regexp_extract(text, r"(?i)begin_src[ \t]+(\S+)", 1)))
             .when(text.rlike(r"(?i)^[ \t]*#\+begin_"), "verbatim")
             .when(text.rlike(r"(?i)^[ \t]*#\+end_"), ""))
    out = carry_forward(lines, ["doc"], "ord", {
        "node_id": F.when(heading, F.col("ord")), "drawer": drawer, "block": block})
    return out.withColumn("is_heading", heading)


def _props(parsed: DataFrame) -> DataFrame:
    """Drawer properties per node; a drawer is a few lines."""
    shape = F.col("text").rlike(PROPERTY) & ~F.col("text").rlike(r"(?i)^[ \t]*:(properties|end):[ \t]*$")
    rows = parsed.where((F.col("drawer") == "yes") & shape & ~F.col("is_heading")).select(
        "doc", "node_id", "ord", F.lower(F.regexp_extract("text", PROPERTY, 1)).alias("key"),
        F.regexp_extract("text", PROPERTY, 2).alias("val"))
    first = rows.groupBy("doc", "node_id", "key").agg(F.min_by("val", "ord").alias("val"))
    return first.groupBy("doc", "node_id").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "val"))).alias("props"))


def _suffixed(props: Column, suffix: str) -> Column:
    """Value of the drawer key that ends in `suffix`, whatever name comes before it."""
    hit = F.filter(F.map_entries(props), lambda e: e["key"].rlike(f"(^|-){suffix}$"))
    return F.get(hit, F.lit(0))["value"]


def section_type(section_id: Column) -> Column:
    """rdf:type that a section's id suffix stands for."""
    out = F.lit(None).cast("string")
    for rdf_type, suffix in K.SECTION_OF_TYPE.items():
        if suffix != "-ontology":
            out = F.when(F.endswith(section_id, F.lit(suffix)), rdf_type).otherwise(out)
    return out


def _headings(parsed: DataFrame) -> DataFrame:
    text = F.col("text")
    raw = F.regexp_extract(text, HEADING, 2)
    tags = F.filter(F.split(F.regexp_extract(text, HEADING, 3), ":"), lambda t: t != "")
    return parsed.where("is_heading").select(
        "doc", "node_id", F.length(F.regexp_extract(text, HEADING, 1)).alias("level"),
        F.regexp_replace(raw, r"^COMMENT[ \t]+", "").alias("title"), tags.alias("tags"),
        raw.rlike(r"^COMMENT[ \t]").alias("commented"))


def _ancestors(heads: DataFrame) -> DataFrame:
    """`ancestors`: (level, node_id) of every ancestor heading, nearest last.

    The latest heading of a lower level is an ancestor when no still lower level came after
    it. Levels are few, so they are carried as columns.
    """
    depth = heads.agg(F.max("level")).first()[0] or 1
    carried = {f"at{n}": F.when(F.col("level") == n, F.col("node_id")) for n in range(1, depth)}
    if not carried:
        return heads.withColumn("ancestors", F.expr("array(struct(0 AS level, 0L AS node_id))")).withColumn(
            "ancestors", F.slice("ancestors", 1, 0))
    out = carry_forward(heads, ["doc"], "node_id", carried)
    steps = []
    for n in range(1, depth):
        lower = [F.coalesce(f"at{m}", F.lit(-1)) for m in range(1, n)]
        above = F.lit(-1).cast("long")
        if lower:
            above = lower[0] if len(lower) == 1 else F.greatest(*lower)
        ok = (F.lit(n) < F.col("level")) & (F.col(f"at{n}") > above)
        steps.append(F.when(ok, F.struct(F.lit(n).alias("level"), F.col(f"at{n}").alias("node_id"))))
    return out.withColumn("ancestors", F.array_compact(F.array(*steps))).drop(*carried)


def outline_nodes(lines: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Node table: one row per heading, with what it inherits from its ancestors.

    Columns: doc, node_id, parent_id, level, title, tags, uri, label, rdf_type, section_id,
    own_id, resourcedefs, prefixdefs, nodeclare, in_ontology, localname, relation, props.
    `relation` is the subheading relation inherited from an ancestor, not the node's own;
    `parent_uri` is the identifier of the nearest ancestor that has one.
    """
    parsed = parsed_lines(lines) if parsed is None else parsed
    heads = _headings(parsed).join(_props(parsed), ["doc", "node_id"], "left")
    heads = heads.withColumn("props", F.coalesce("props", F.expr("cast(map() AS map<string,string>)")))
    props = F.col("props")
    own = heads.select(
        "*", props["id"].alias("own_id"), F.coalesce(props["resourcedefs"] == "yes", F.lit(False)).alias("resourcedefs"),
        F.coalesce(props["prefixdefs"] == "yes", F.lit(False)).alias("prefixdefs"),
        _suffixed(props, "context-type").alias("_context"),
        _suffixed(props, "context-localname").alias("_localname"),
        _suffixed(props, "subheading-relation").alias("own_relation"),
        F.array_contains("tags", "nodeclare").alias("_tagged"))
    uri = F.when(~(F.col("_tagged") | F.col("commented")), entity_from_heading(F.col("title")))
    # Headings are a fraction of the lines; what follows reads them several times.
    own = cut(own.withColumn("uri", uri))
    chain = _ancestors(own.select("doc", "node_id", "level"))
    facts = own.select("doc", F.col("node_id").alias("_aid"), "own_id", "resourcedefs", "_context",
                       "_localname", "own_relation", "_tagged", F.col("uri").alias("_auri"))
    steps = chain.select("doc", "node_id", F.explode("ancestors").alias("a")).select(
        "doc", "node_id", F.col("a.level").alias("_al"), F.col("a.node_id").alias("_aid"))

    def nearest(value: Column, test: Column) -> Column:
        return F.max_by(value, F.when(test, F.col("_al")))

    above = steps.join(facts, ["doc", "_aid"]).groupBy("doc", "node_id").agg(
        F.max_by("_aid", "_al").alias("parent_id"),
        nearest(F.struct("own_id"), F.col("resourcedefs")).alias("_section"),
        F.coalesce(F.bool_or(F.col("_context") == "ontology"), F.lit(False)).alias("_in"),
        nearest(F.col("_localname"), F.col("_localname").isNotNull()).alias("_inherited_name"),
        nearest(F.col("own_id"), F.col("own_id").isNotNull()).alias("_inherited_id"),
        nearest(F.col("own_relation"), F.col("own_relation").isNotNull()).alias("relation"),
        nearest(F.col("_auri"), F.col("_auri").isNotNull()).alias("parent_uri"),
        F.bool_or("_tagged").alias("_under"))
    full = own.join(above, ["doc", "node_id"], "left")
    section = F.col("_section.own_id")
    rdf_type = F.when(section.isNotNull(), section_type(section)).when(
        F.endswith("own_id", F.lit("-ontology-declaration")), "owl:Ontology")
    return full.select(
        "doc", "node_id", "parent_id", "level", "title", "tags", "uri",
        heading_label(F.col("title"), F.col("uri")).alias("label"), rdf_type.alias("rdf_type"),
        section.alias("section_id"), "own_id", "resourcedefs", "prefixdefs",
        (F.col("_tagged") | F.coalesce("_under", F.lit(False))).alias("nodeclare"),
        F.col("_tagged").alias("tagged_nodeclare"),
        F.coalesce(F.col("_in") | (F.col("_context") == "ontology"), F.col("_in"),
                   F.col("_context") == "ontology", F.lit(False)).alias("in_ontology"),
        F.col("_context").alias("context_type"), F.col("_localname").alias("own_localname"),
        F.coalesce("_localname", "_inherited_name").alias("localname"),
        F.coalesce("own_id", "_inherited_id").alias("inherited_id"),
        "own_relation", "relation", "parent_uri", F.col("_section").isNotNull().alias("in_section"),
        "props")


def outline_rows(lines: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Description rows (doc, node_id, row_id, parent_row_id, tag, value).

    A row is a `- tag :: value` item with its indented continuation lines. An item nested
    in another is its meta-annotation when its tag is a compact name; otherwise its text
    belongs to the outer row.
    """
    parsed = parsed_lines(lines) if parsed is None else parsed
    text = F.col("text")
    body = parsed.where(~F.col("is_heading") & (F.col("drawer") == "no")
                        & (F.coalesce("block", F.lit("")) == "") & (F.trim(text) != "")
                        & ~text.rlike(TABLE) & ~text.rlike(r"^[ \t]*(#|:end:|:END:)"))
    indent = F.length(F.regexp_extract(text, r"^([ \t]*)", 1))
    item = text.rlike(ITEM)
    nested = item & (indent >= 2)
    starts = item & (~nested | F.regexp_extract(text, ITEM, 2).rlike(K.TABLE_CURIE))
    body = body.withColumn("_indent", indent).withColumn("_starts", starts).withColumn(
        "_nested", starts & nested)
    # A line at the margin that starts no item closes the list.
    closes = ~F.col("_starts") & (F.col("_indent") == 0)
    state = carry_forward(body, ["doc", "node_id"], "ord", {
        "row_id": F.when(F.col("_starts"), F.col("ord")).when(closes, F.lit(-1).cast("long")),
        "top_id": F.when(F.col("_starts") & ~F.col("_nested"), F.col("ord"))
        .when(closes, F.lit(-1).cast("long"))})
    kept = state.where(F.col("row_id") >= 0)
    piece = F.when(F.col("_starts"), F.regexp_extract(text, ITEM, 3)).otherwise(F.rtrim(text))
    # One description row is one authored value: its lines are few.
    lines_of_row = F.transform(F.sort_array(F.collect_list(F.struct("ord", piece.alias("t")))),
                               lambda e: e["t"])
    value = F.regexp_replace(F.array_join(lines_of_row, "\n"), r"\s+$", "")
    return kept.groupBy("doc", "node_id", "row_id").agg(
        F.max(F.when(F.col("_nested") & (F.col("top_id") >= 0), F.col("top_id"))).alias("parent_row_id"),
        F.max(F.when(F.col("_starts"), F.regexp_extract(text, ITEM, 2))).alias("tag"),
        value.alias("value"))


def outline_prefixes(lines: DataFrame, parsed: DataFrame | None = None,
                     nodes: DataFrame | None = None) -> DataFrame:
    """(doc, prefix, expansion, ord) of the prefix tables; the first row per name wins."""
    parsed = parsed_lines(lines) if parsed is None else parsed
    nodes = outline_nodes(lines, parsed) if nodes is None else nodes
    holders = nodes.where("prefixdefs").select("doc", "node_id")
    cells = F.split(F.regexp_extract("text", TABLE, 1), r"\|")
    rows = parsed.where(F.col("text").rlike(TABLE) & ~F.col("text").rlike(r"^[ \t]*\|[-+]")).join(
        holders, ["doc", "node_id"], "left_semi").select(
        "doc", "ord", F.replace(F.trim(F.get(cells, F.lit(0))), F.lit(":"), F.lit("")).alias("prefix"),
        F.trim(F.get(cells, F.lit(0))).alias("raw"), F.trim(F.get(cells, F.lit(1))).alias("expansion"))
    rows = rows.where(F.col("expansion").isNotNull() & (F.col("raw") != "prefix"))
    return rows.groupBy("doc", "prefix").agg(
        F.min_by("expansion", "ord").alias("expansion"), F.min("ord").alias("ord"))


def flatten_outline(nodes: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and attributes of the documents; the source is the document.

    Every term gets its chosen label first, then its type, then its authored rows without
    labels. A value that is one bracketed IRI loses its brackets, `"x"@en` is split.
    """
    terms = nodes.where("uri IS NOT NULL").withColumn("label", F.coalesce("label", "uri"))
    key = [F.col("uri").alias("id"), F.col("doc").alias("source"), F.lit("").alias("data_source")]
    entities = (terms.groupBy("uri", "doc").agg(F.min_by("label", "node_id").alias("label"))
                .select(*key, "label", id_kind(F.col("uri")).alias("kind"))
                .select("id", "label", "source", "data_source", "kind"))
    fixed = F.array(
        F.struct(F.lit("rdfs:label").alias("prop"), F.col("label").alias("value"), F.lit(0).alias("seq")),
        F.when(F.col("rdf_type").isNotNull(), F.struct(
            F.lit("rdf:type").alias("prop"), F.col("rdf_type").alias("value"), F.lit(1).alias("seq"))))
    first = terms.select(*key, F.col("node_id").alias("_at"), F.inline(F.array_compact(fixed)))
    authored = rows.where(~F.col("tag").isin("rdfs:label", "rdf:type")).join(
        terms.select("doc", "node_id", "uri"), ["doc", "node_id"]).select(
        *key, F.col("row_id").alias("_at"), F.col("tag").alias("prop"), "value",
        F.lit(2).alias("seq"))
    tagged = r'^"([^"]*)"@([A-Za-z][-A-Za-z0-9]*)$'
    value = (F.when(F.col("value").rlike(tagged), F.regexp_extract("value", tagged, 1))
             .otherwise(F.regexp_replace("value", r"^<([^<>\s]+)>$", "$1")))
    both = first.unionByName(authored)
    attributes = both.select(
        "id", "source", "data_source", "prop", value.alias("value"),
        F.regexp_extract("value", tagged, 2).alias("lang"),
        (F.col("_at") * 4 + F.col("seq")).cast("long").alias("ord"))
    return entities, attributes


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
