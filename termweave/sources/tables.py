"""Tables and JSON maps to long term rows.

A long row is (id, label, prop, value, lang, ord, seq): one attribute of one input row.
`ord` orders input rows, `seq` orders attributes inside a row; an input row without
attributes keeps one long row with a NULL prop, so its label is not lost.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG_COLUMNS = ["id", "label", "prop", "value", "lang", "ord", "seq"]
MAP_TYPE = "map<string,string>"


def _filled(col: Column) -> Column:
    return F.coalesce(col, F.lit("")) != ""


def _attribute(prop: str, value: Column, lang: Column) -> Column:
    return F.struct(F.lit(prop).alias("prop"), value.alias("value"), lang.alias("lang"))


def ingest_table(frame: DataFrame, order: Column, columns: list[str] | None = None) -> DataFrame:
    """Wide table to long rows: first column id, second label, the rest attributes.

    From the third column on, `lang` tags the row's label and `label@TAG` adds a label
    in that language. Blank ids are dropped, blank attributes are skipped.
    """
    names = columns or frame.columns
    ident, label = F.col(f"`{names[0]}`").cast("string"), F.col(f"`{names[1]}`").cast("string")
    blank = F.lit("")
    plain, tagged, row_lang = [], [], None
    for name in names[2:]:
        value = F.col(f"`{name}`").cast("string")
        tag = re.fullmatch(r"label@(.+)", name)
        if name == "lang":
            row_lang = F.coalesce(value, blank)
        elif tag:
            tagged.append(F.when(_filled(value), _attribute("rdfs:label", value, F.lit(tag[1]))))
        else:
            plain.append(F.when(_filled(value), _attribute(name, value, blank)))
    own = [] if row_lang is None else [
        F.when(_filled(label), _attribute("rdfs:label", label, row_lang))]
    cells = [*plain, *own, *tagged]
    empty = F.lit(None).cast("struct<prop:string,value:string,lang:string>")
    rows = F.array_compact(F.array(*cells)) if cells else F.array(empty)
    return (
        frame.where(_filled(ident))
        .select(ident.alias("id"), F.coalesce(label, blank).alias("label"),
                order.cast("long").alias("ord"), F.posexplode_outer(rows).alias("seq", "cell"))
        .select("id", "label", "cell.prop", "cell.value", "cell.lang", "ord",
                F.coalesce("seq", F.lit(0)).alias("seq"))
    )


def query_result_source(frame: DataFrame, order: Column) -> DataFrame:
    """A query result as a source; its first two columns are id and label."""
    return ingest_table(frame, order)


def has_rows(frame: DataFrame) -> DataFrame:
    """One row, one flag: is there anything to keep?"""
    return frame.limit(1).agg((F.count(F.lit(1)) > 0).alias("has_rows"))


def ingest_json_map(texts: DataFrame, text_col: str, order: Column,
                    keep: list[str] | None = None) -> DataFrame:
    """JSON object texts `{"id": "label"}` or `{"id": {"label": …, …}}` to long rows."""
    kept_cols = keep or []
    entries = texts.select(
        *kept_cols, order.cast("long").alias("_doc"),
        F.posexplode(F.map_entries(F.from_json(F.col(text_col), MAP_TYPE))).alias("_at", "e"),
    ).select(*kept_cols, "_doc", "_at", F.col("e.key").alias("id"), F.col("e.value").alias("raw"))
    inner = F.when(F.col("raw").rlike(r"^\s*\{"), F.from_json("raw", MAP_TYPE))
    entries = entries.withColumn("obj", inner)
    label = F.when(F.col("obj").isNull(), F.coalesce("raw", F.lit(""))).otherwise(
        F.coalesce(F.col("obj")["label"], F.lit("")))
    row_lang = F.col("obj")["lang"]
    kept = F.filter(F.map_entries(F.coalesce("obj", F.from_json(F.lit("{}"), MAP_TYPE))),
                    lambda e: ~e["key"].isin("label", "lang"))
    cells = F.transform(kept, lambda e: F.struct(
        F.when(e["key"].rlike(r"^label@.+$"), "rdfs:label").otherwise(e["key"]).alias("prop"),
        F.coalesce(e["value"], F.lit("")).alias("value"),
        F.regexp_extract(e["key"], r"^label@(.+)$", 1).alias("lang")))
    own = F.when(_filled(row_lang) & _filled(label),
                 F.array(_attribute("rdfs:label", label, row_lang)))
    rows = F.concat(cells, F.coalesce(own, F.slice(cells, 1, 0)))
    # The place of an entry in its object, below the place of the object itself.
    return (
        entries.select(*kept_cols, "id", label.alias("label"),
                       (F.col("_doc") * F.lit(1 << 24) + F.col("_at")).alias("ord"),
                       F.posexplode_outer(rows).alias("seq", "cell"))
        .select(*kept_cols, "id", "label", "cell.prop", "cell.value", "cell.lang", "ord",
                F.coalesce("seq", F.lit(0)).alias("seq"))
    )


def labels_from_triples(triples: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Every label triple as a long row, with its language tag."""
    return triples.where(F.col("p").isin(
        "rdfs:label", "http://www.w3.org/2000/01/rdf-schema#label")).select(
        *(keep or []), F.col("s").alias("id"), F.col("o").alias("label"), F.lit("rdfs:label").alias("prop"),
        F.col("o").alias("value"), F.coalesce("lang", F.lit("")).alias("lang"), "ord",
        F.lit(0).alias("seq"))


def harvest_prefixes(lines: DataFrame) -> DataFrame:
    """Prefix declarations at line start of (doc, ord, text); the first one per name wins."""
    shape = r"(?i)^[ \t]*(?:@prefix|prefix)[ \t]+([A-Za-z_][-\w.]*|)[ \t]*:[ \t]*<([^>]*)>"
    found = lines.where(F.col("text").rlike(shape)).select(
        "doc", "ord", F.regexp_extract("text", shape, 1).alias("prefix"),
        F.regexp_extract("text", shape, 2).alias("expansion"))
    return found.groupBy("doc", "prefix").agg(F.min_by("expansion", "ord").alias("expansion"))
