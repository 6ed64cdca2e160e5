"""Terms as ontology text: literals, frames, documents, line maps, outlines, checksums."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave import constants as K
from termweave.operators.identifiers import to_bracketed_iri
from termweave.operators.taxonomy import ordered_hierarchy, parent_edges, relation_facts, sort_key
from termweave.plans.cut import cut
from termweave.plans.ordered import carry_forward, running_sum
from termweave.sources.sinks import write_lines


def without_indent(value: Column) -> Column:
    """Text whose continuation lines lose their common leading spaces."""
    lines = F.split(value, "\n")
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    indents = F.filter(F.transform(rest, lambda l: F.length(F.regexp_extract(l, "^( *)", 1))), lambda n: n > 0)
    common = F.coalesce(F.array_min(indents), F.lit(0))
    cut = F.transform(rest, lambda l: F.when(
        F.length(F.regexp_extract(l, "^( *)", 1)) >= common, F.substring(l, common + 1, F.length(l))).otherwise(l))
    return F.when(F.size(lines) > 1, F.array_join(F.concat(F.slice(lines, 1, 1), cut), "\n")).otherwise(value)


# An address, alone, in angles or as a link in double brackets.
ADDRESS = r"\A(?:(https?:\S*)|<(https?:[^ ]*|urn:[^>]+)>|\[\[(https?:\S*)\]\])\z"
# Plain values that become typed text, by their datatype; numbers stay plain text.
TYPED = {"": r"[0-9]+\.?[0-9]*", "^^xsd:boolean": "true|false", "^^xsd:string": r"urn:uuid\S+"}
# Literals that the author wrote out: with a datatype, or with a language after some quoted part.
WRITTEN_TYPE, WRITTEN_LANG = r'\A"[^\n]*"\^\^[-\w]*:[-\w]+\z', r'(?s)".*"@[a-z]+'


def literal_text(frame: DataFrame, col: str, prefixes: DataFrame, name: str,
                 keys: list[str] | None = None) -> DataFrame:
    """Annotation value in output form, by the class of value it is.

    Addresses go in angles. Numbers, booleans and UUIDs become text of their datatype. Literals
    that are written out stay. Compact names of known prefixes expand. All else is quoted.
    """
    v = F.col("_v")
    rows = to_bracketed_iri(frame.withColumn("_v", without_indent(F.col(col))), "_v", prefixes, "_iri",
                            keys=keys)
    out = F.when(v.rlike(ADDRESS), F.concat(F.lit("<"), *[F.regexp_extract(v, ADDRESS, g) for g in (1, 2, 3)], F.lit(">")))
    for datatype, shape in TYPED.items():
        out = out.when(v.rlike(rf"\A(?:{shape})\z"), F.concat(F.lit('"'), v, F.lit('"' + datatype)))
    known = F.col("_iri") != v
    out = out.when(v.rlike(WRITTEN_TYPE) | (~known & v.rlike(WRITTEN_LANG)), v).when(known, F.col("_iri"))
    quoted = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return rows.withColumn(name, out.otherwise(quoted)).drop("_v", "_iri")


def frame_type(rdf_type: Column) -> Column:
    out = F.when(rdf_type.isNull(), "Class").otherwise(F.substring_index(rdf_type, ":", -1))
    for name, shown in K.KIND_NAMES.items():
        out = F.when(rdf_type == name, shown).otherwise(out)
    return out


def _joined(order: str, text: str, sep: str) -> Column:
    """Texts of one term in order. A term's rows are what one author wrote under one heading."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))),
                                    lambda e: e[text]), sep)


def _with_meta(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Top rows with `shown` (output value) and `meta`: their nested annotations, in order."""
    shown = literal_text(rows, "value", prefixes, "shown", ["doc"])
    nested = shown.where("parent_row_id IS NOT NULL").withColumn(
        "_line", F.concat("tag", F.lit(" "), "shown"))
    meta = nested.groupBy("doc", "node_id", F.col("parent_row_id").alias("row_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.col("row_id").alias("o"), "_line"))),
                    lambda e: e["_line"]).alias("meta"))
    return shown.where("parent_row_id IS NULL").join(meta, ["doc", "node_id", "row_id"], "left")


def _meta_text(indent: int) -> Column:
    lead = " " * indent
    return F.array_join(F.transform("meta", lambda m: F.concat(F.lit(lead), m)), ",\n")


def _axiom_line(indent: int) -> Column:
    lead, inner = " " * indent, " " * (indent + 4)
    value = F.when(F.col("tag") == "Import", F.col("shown")).otherwise(F.col("value"))
    return (
        F.when(F.col("meta").isNotNull() & (F.col("tag") == "Rule"), F.concat(
            F.lit(lead), "tag", F.lit(": # notes on this rule are left out, the syntax has no place for them\n" + inner),
            value))
        .when(F.col("meta").isNotNull(), F.concat(
            F.lit(lead), "tag", F.lit(": \n" + inner + "Annotations: \n"), _meta_text(indent + 8),
            F.lit("\n" + inner), value))
        .otherwise(F.concat(F.lit(lead), "tag", F.lit(": "), value)))


def _blank(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit(""))) == ""


# Parts of a block, in order of output.
HEAD, NOTES, NOTE, AXIOM, GAP = range(5)


def frame_parts(nodes: DataFrame, rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(doc, node_id, rank, o, text): the frames of the declared terms, a row per part.

    A frame is never one value: a term with very many rows is very many parts.
    """
    terms = nodes.where("uri IS NOT NULL AND NOT tagged_nodeclare")
    top = _with_meta(rows, prefixes).join(terms.select("doc", "node_id"), ["doc", "node_id"], "left_semi")
    top = cut(top.select("doc", "node_id", F.col("row_id").alias("o"), "tag", "value", "shown", "meta"))

    written = top.where("tag = 'rdfs:label'").select("doc", "node_id", F.col("value").alias("label"))
    derived = terms.where(F.col("label").isNotNull() & (F.col("label") != F.col("uri"))).select(
        "doc", "node_id", "label").join(written, ["doc", "node_id", "label"], "left_anti").select(
        "doc", "node_id", F.lit(-1).cast("long").alias("o"), F.lit("rdfs:label").alias("tag"),
        F.col("label").alias("value"))
    derived = literal_text(derived, "value", prefixes, "shown", ["doc"]).withColumn(
        "meta", F.lit(None).cast("array<string>"))
    notes = cut(top.where(~F.col("tag").isin([*K.ALL_KEYWORDS, "rdf:type"])).unionByName(derived))
    last = cut(notes.groupBy("doc", "node_id").agg(F.max("o").alias("_last")))
    lead = " " * 8
    note = F.concat(
        F.when(F.col("meta").isNotNull(), F.concat(F.lit(lead + "Annotations: \n"), _meta_text(12), F.lit("\n")))
        .otherwise(""), F.lit(lead), "tag", F.lit(" "), "shown",
        F.when(F.col("o") < F.col("_last"), ",").otherwise(""))
    note_rows = notes.join(last, ["doc", "node_id"])

    axioms = top.where(F.col("tag").isin(K.FRAME_KEYWORDS) & ~_blank(F.col("value")))
    end = F.lit(1 << 62).alias("o")
    none = [F.lit(None).cast("string").alias("shown"), F.lit(None).cast("array<string>").alias("meta")]
    nested = parent_edges(nodes, rows).select(
        "doc", "node_id", end, F.col("keyword").alias("tag"), F.col("parent").alias("value"), *none)
    facts = relation_facts(nodes, rows).select(
        "doc", "node_id", end, F.col("keyword").alias("tag"), "value", *none)
    axiom_rows = axioms.unionByName(nested).unionByName(facts)

    def part(frame: DataFrame, rank: int, text: Column, o: Column) -> DataFrame:
        return frame.select("doc", "node_id", F.lit(rank).alias("rank"), o.cast("long").alias("o"), text.alias("text"))

    zero = F.lit(0)
    return (
        part(terms, HEAD, F.concat(frame_type(F.col("rdf_type")), F.lit(": "), "uri"), zero)
        .unionByName(part(last, NOTES, F.lit("    Annotations: "), zero))
        .unionByName(part(note_rows, NOTE, note, F.col("o")))
        .unionByName(part(axiom_rows, AXIOM, _axiom_line(4), F.col("o"))))


def frames(nodes: DataFrame, rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(doc, node_id, uri, text): one frame text per declared term, for terms of usual size.

    `publish` works on the parts instead.
    """
    parts = frame_parts(nodes, rows, prefixes).groupBy("doc", "node_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "o", "text"))), lambda p: p["text"]), "\n").alias("text"))
    return nodes.select("doc", "node_id", "uri").join(parts, ["doc", "node_id"])


def misc_frames(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(doc, node_id, ord, text): standalone axioms; blank ones are skipped."""
    top = _with_meta(rows, prefixes).where(F.col("tag").isin(K.MISC_KEYWORDS) & ~_blank(F.col("value")))
    return top.select("doc", "node_id", F.col("row_id").alias("ord"), _axiom_line(0).alias("text"))


def blocks(nodes: DataFrame, rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(doc, ord, rank, o, source_line, text): a document's parts, block after block.

    Blocks are the prefixes, then frames in document order, each followed by a blank line.
    """
    def block(frame: DataFrame, ord_: Column, rank: Column, o: Column, line: Column, text: Column) -> DataFrame:
        return frame.select("doc", ord_.cast("long").alias("ord"), rank.alias("rank"), o.cast("long").alias("o"),
                            line.cast("long").alias("source_line"), text.alias("text"))

    name = F.when(F.endswith("prefix", F.lit(":")), F.col("prefix")).otherwise(F.concat("prefix", F.lit(":")))
    zero, no_line = F.lit(0), F.lit(None)
    heads = block(prefixes.select("doc").distinct(), F.lit(-1), F.lit(HEAD), zero, no_line, F.lit("## Prefixes"))
    names = block(prefixes, F.lit(-1), F.lit(NOTE), F.col("ord"), no_line,
                  F.format_string("Prefix: %-5s <%s>", name, F.col("expansion")))
    node = F.col("node_id")
    terms = block(frame_parts(nodes, rows, prefixes), node * 2, F.col("rank"), F.col("o"), node, F.col("text"))
    misc = block(misc_frames(rows, prefixes), F.col("ord") * 2 + 1, F.lit(HEAD), zero, node, F.col("text"))
    opened = heads.unionByName(terms.where(F.col("rank") == HEAD)).unionByName(misc)
    gaps = opened.withColumn("rank", F.lit(GAP)).withColumn("text", F.lit(""))
    return heads.unionByName(names).unionByName(terms).unionByName(misc).unionByName(gaps)


def published_lines(parts: DataFrame) -> DataFrame:
    """(doc, line, source_line, text): numbered output lines.

    A part's first line follows from a running sum over the parts of its document, in the order
    of blocks, ranks and places, so neither a document nor a term is one value or task.
    """
    sized = running_sum(cut(parts.withColumn("_n", F.size(F.split("text", "\n")))), ["doc"], "ord", F.col("_n"), "_end",
                        ties=["rank", "o", "text"])
    rows = sized.select("doc", "source_line", (F.col("_end") - F.col("_n") + 1).alias("_at"),
                        F.posexplode(F.split("text", "\n")).alias("_i", "text"))
    return rows.select("doc", (F.col("_at") + F.col("_i")).alias("line"), "source_line", "text")


def publish(parts: DataFrame, path: str) -> None:
    """Write each document's lines under `doc=…`, to be read back by `sinks.read_lines_back`."""
    write_lines(published_lines(parts).select("doc", "line", "text"), path, ["doc"])


OPENER = (r"^(Class|ObjectProperty|DataProperty|AnnotationProperty|Individual|Datatype|Ontology):"
          r"[ \t]+([^ \t\n]+)")


def line_map(lines: DataFrame) -> DataFrame:
    """(doc, line, uri, frame, source_line) of the lines that open a frame."""
    return lines.where(F.col("text").rlike(OPENER)).select(
        "doc", "line", F.regexp_extract("text", OPENER, 2).alias("uri"),
        F.regexp_extract("text", OPENER, 1).alias("frame"), "source_line")


def lookup_lines(lines: DataFrame) -> DataFrame:
    """(doc, line, uri, source_line): the frame every output line belongs to."""
    opens = F.col("text").rlike(OPENER)
    return carry_forward(lines.select("doc", "line", "text", F.col("source_line").alias("_s")), ["doc"], "line", {
        "uri": F.when(opens, F.regexp_extract("text", OPENER, 2)),
        "source_line": F.when(opens, F.col("_s"))}).select("doc", "line", "uri", "source_line")


def to_outline(entities: DataFrame, attributes: DataFrame, parent_map: DataFrame,
               deprecated: DataFrame, level: int = 3) -> DataFrame:
    """(place, line, apart, id, text): outline rows of terms in taxonomy order, deprecated ones apart.

    `place` sorts the terms, `line` the rows of a term: -1 is its heading, the others are its
    description rows at their place in the source. A term of very many rows is many rows.
    """
    keyed = entities.select("id", "label", sort_key(F.col("label"), F.col("id")).alias("sort_key"))
    order = ordered_hierarchy(keyed.select("id", "sort_key"), parent_map)
    rows = attributes.where(~F.col("prop").isin(K.HOUSEKEEPING) & ~F.col("prop").isin(K.SUPER_SPELLINGS))
    body = rows.select("id", F.col("ord").cast("long").alias("line"), F.concat(F.lit(" - "), "prop", F.lit(" :: "), "value").alias("text"))
    flags = deprecated.where("apart").select("id", F.lit(True).alias("_apart"))
    head = F.concat(F.repeat(F.lit("*"), F.col("level") + (level - 1)), F.lit(" "),
                    F.coalesce(F.concat("label", F.lit(" ("), "id", F.lit(")")), F.col("id")))
    terms = order.join(keyed.select("id", "label"), "id").join(flags, "id", "left").select(
        "place", F.coalesce("_apart", F.lit(False)).alias("apart"), "id", head.alias("_head"))
    heads = terms.select("place", F.lit(-1).cast("long").alias("line"), "apart", "id", F.col("_head").alias("text"))
    return heads.unionByName(terms.drop("_head").join(body, "id").select(*heads.columns))


def _checksum_line(marker: str) -> str:
    return rf"\A{re.escape(marker)}([a-fA-F0-9]+)\z"


def content_checksum(text: Column, marker: str) -> Column:
    """SHA-256 of the text without checksum lines; leading blank lines do not count."""
    kept = F.filter(F.split(text, r"\r\n|[\n\r\x0B\x0C\u0085  ]"), lambda l: ~l.rlike(_checksum_line(marker)))
    return F.sha2(F.regexp_replace(F.array_join(kept, "\n"), r"\A\n+", ""), 256)


def stored_checksum(text: Column, marker: str) -> Column:
    found = F.regexp_extract(text, rf"(?m)^{re.escape(marker)}([a-fA-F0-9]+)\r?$", 1)
    return F.when(found != "", found)


def is_pristine(text: Column, marker: str) -> Column:
    """Whether the stored checksum is the text's; a text without one is not pristine."""
    stored = stored_checksum(text, marker)
    return F.coalesce(F.lower(stored) == content_checksum(text, marker), F.lit(False))


def expand_bare_prefix(rows: DataFrame, prefixes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose value is only `prefix:` with the namespace in its place."""
    bare = r"^\s*([-\w./]*:)\s*$"
    out = to_bracketed_iri(rows.withColumn("_b", F.when(
        F.col("value").rlike(bare), F.regexp_extract("value", bare, 1))), "_b", prefixes, "_full", True, keys)
    return out.withColumn("value", F.coalesce("_full", "value")).drop("_b", "_full")


def section_value(rows: DataFrame, tag_re: str, value_re: str = "") -> DataFrame:
    """(doc, node_id, value): first row whose tag matches, one with a matching value before."""
    found = rows.where(F.col("tag").rlike(tag_re))
    key = F.struct((~F.col("value").rlike(value_re)).alias("a"), "row_id")
    return found.groupBy("doc", "node_id").agg(F.min_by("value", key).alias("value"))
