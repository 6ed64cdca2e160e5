"""Files to lines and long rows. Every reader takes many files and splits large ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions.ident import id_kind
from termweave.model import SOURCE_KEY
from termweave.plans.cut import cut
from termweave.sources import outline
from termweave.sources.records import delimited_records, split_delimited
from termweave.sources.tables import MAP_TYPE, harvest_prefixes, ingest_json_map, labels_from_triples

_ROW_BITS = 30
_BLOCK_BITS = 20


def _reader(spark: SparkSession, glob: str | None):
    reader = spark.read.option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", glob) if glob else reader


def read_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(doc, ord, text) of text files; `ord` follows the file without a shuffle.

    Its high bits are the file split's start (splits are at least 1 MiB apart), its low
    bits the row's place in the task, so a large file is read by many tasks.
    """
    place = F.expr(f"(shiftright(_metadata.file_block_start, {_BLOCK_BITS}) << {_ROW_BITS})"
                   f" | (monotonically_increasing_id() & {(1 << _ROW_BITS) - 1})")
    return _reader(spark, glob).text(path).select(
        F.col("_metadata.file_path").alias("doc"), place.alias("ord"),
        F.regexp_replace("value", r"^﻿|\r$", "").alias("text"))


def delimited_rows(lines: DataFrame, sep: str) -> DataFrame:
    """(doc, ord, text) lines of many delimited files to long rows; headers may differ.

    The first non-empty record of a file is its header: one row per file, joined back by file.
    Quoted fields may hold line breaks; a record that is never closed is left out, and
    `delimited_errors` tells.
    """
    records, _unclosed = delimited_records(lines, sep)
    filled = records.where(F.rtrim("text") != "").select(
        "doc", "ord", split_delimited(F.rtrim("text"), sep).alias("v"))
    header = filled.groupBy("doc").agg(F.min_by(F.struct("ord", "v"), "ord").alias("h"))
    header = cut(header.select("doc", F.col("h.ord").alias("_head"), F.col("h.v").alias("h")))
    rows = filled.join(header, "doc").where(F.col("ord") > F.col("_head"))
    blank = F.lit("")
    lang_at = F.expr("array_position(slice(h, 3, greatest(size(h) - 2, 0)), 'lang') + 2")
    rows = rows.withColumn("_lang", lang_at).select(
        "doc", "ord", "_lang",
        F.col("v")[0].alias("id"), F.coalesce(F.get("v", F.lit(1)), blank).alias("label"),
        F.coalesce(F.when(F.col("_lang") > 2, F.get("v", F.col("_lang").cast("int") - 1)), blank)
        .alias("_tag"),
        F.arrays_zip(F.expr("h AS h"), F.expr("v AS v")).alias("z"))
    cells = F.transform("z", lambda c, i: F.when(
        (i >= 2) & (F.coalesce(c["v"], blank) != "") & (i + 1 != F.col("_lang")),
        F.struct(F.when(c["h"].rlike("^label@.+$"), "rdfs:label").otherwise(c["h"]).alias("prop"),
                 c["v"].alias("value"),
                 F.regexp_extract(c["h"], "^label@(.+)$", 1).alias("lang"),
                 F.when(c["h"].rlike("^label@.+$"), 2).otherwise(0).alias("rank"))))
    own = F.when((F.col("_lang") > 2) & (F.col("label") != ""), F.struct(
        F.lit("rdfs:label").alias("prop"), F.col("label").alias("value"),
        F.col("_tag").alias("lang"), F.lit(1).alias("rank")))
    kept = F.array_compact(F.concat(cells, F.array(own)))
    # Plain attributes first, then the row's own label, then the tagged ones.
    ordered = F.concat(F.filter(kept, lambda c: c["rank"] == 0),
                       F.filter(kept, lambda c: c["rank"] == 1),
                       F.filter(kept, lambda c: c["rank"] == 2))
    return (rows.where(F.coalesce("id", blank) != "")
            .select("doc", "id", "label", "ord", F.posexplode_outer(ordered).alias("seq", "c"))
            .select("doc", "id", "label", "c.prop", "c.value", "c.lang", "ord",
                    F.coalesce("seq", F.lit(0)).alias("seq")))


def read_delimited(spark: SparkSession, path: str | list[str], sep: str = ",",
                   glob: str | None = None) -> DataFrame:
    return delimited_rows(read_lines(spark, path, glob), sep)


def delimited_errors(spark: SparkSession, path: str | list[str], sep: str = ",", glob: str | None = None) -> DataFrame:
    """(doc, error) of files with a quoted field that is not closed."""
    _records, unclosed = delimited_records(read_lines(spark, path, glob), sep)
    return unclosed.select("doc", F.lit("a quoted field is not closed").alias("error")).distinct()


def read_listing(spark: SparkSession, path: str | list[str], sep: str = "\t") -> DataFrame:
    """A source listing: delimited rows, `#` lines are comments."""
    return delimited_rows(read_lines(spark, path).where(~F.col("text").rlike("^#")), sep)


def _json_files(spark: SparkSession, path: str | list[str], glob: str | None) -> DataFrame:
    """(doc, value, parsed, terms) of JSON files. A JSON object is one value, so a file is one row;
    `parsed` is NULL for what is no object, `terms` tells files of terms from maps."""
    texts = _reader(spark, glob).text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc"), "value")
    parsed = texts.withColumn("parsed", F.from_json("value", MAP_TYPE))
    return parsed.withColumn("terms", F.coalesce(F.col("parsed")["data"].rlike(r"^\s*\["), F.lit(False)))


def read_json_map(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Rows of JSON objects that map ids to labels or to their attributes."""
    return ingest_json_map(_json_files(spark, path, glob).where(~F.col("terms")), "value", F.lit(0), ["doc"])


def read_json(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Long rows of JSON maps and of files of terms, whichever a file is."""
    files = _json_files(spark, path, glob)
    terms = files.where("terms").select("doc", F.from_json("value", TRIPLES_JSON).alias("f")).select("doc", "f.data")
    rows = _term_rows(terms, ["doc"]).drop("kind")
    maps = ingest_json_map(files.where(~F.col("terms")), "value", F.lit(0), ["doc"])
    return maps.unionByName(rows.select(*maps.columns))


def json_prefixes(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(doc, prefix, expansion) of files of terms."""
    files = _json_files(spark, path, glob).where("terms")
    return _term_prefixes(files.select("doc", F.from_json("value", TRIPLES_JSON)["prefixes"].alias("prefixes")), ["doc"])


def json_errors(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(doc, error) of files that hold no JSON object, such as one that was cut off."""
    files = _json_files(spark, path, glob)
    return files.where("parsed IS NULL").select("doc", F.when(F.trim("value") == "", "the file is empty").otherwise(
        F.concat(F.lit("no JSON object: "), F.substring("value", 1, 60))).alias("error"))


# The documented shape: attributes and prefixes are pairs, and the second of an attribute is a
# text or an object with a text and its language. Mixed arrays are read as texts.
TRIPLES_JSON = ("source string, dataSource string, type string, "
                "data array<struct<id:string,label:string,kind:string,attrs:array<array<string>>>>, "
                "prefixes array<array<string>>")
ATTRIBUTE_VALUE = "value string, lang string"


def _term_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(TRIPLES_JSON).json(path, multiLine=True).select(
        "source", F.coalesce("dataSource", F.lit("")).alias("data_source"), "data", "prefixes")


def read_triples_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source, data_source, id, label, kind, prop, value, lang, ord, seq) from term JSON files.

    A term without attributes keeps one row with a NULL prop. `kind` follows the form of the id
    where it is missing. `read_triples_prefixes` reads the prefixes of the same files.
    """
    return _term_rows(_term_files(spark, path), SOURCE_KEY)


def _term_rows(files: DataFrame, keys: list[str]) -> DataFrame:
    terms = files.select(*keys, F.posexplode("data").alias("ord", "t"))
    rows = terms.select(*keys, "t.id", F.coalesce("t.label", F.lit("")).alias("label"),
                        F.coalesce("t.kind", id_kind(F.col("t.id"))).alias("kind"),
                        F.col("ord").cast("long"), F.posexplode_outer("t.attrs").alias("seq", "a"))
    raw = F.get("a", F.lit(1))
    rows = rows.withColumn("raw", raw).withColumn("o", F.when(raw.rlike(r"^\s*\{"), F.from_json(raw, ATTRIBUTE_VALUE)))
    return rows.select(*keys, "id", "label", "kind", F.get("a", F.lit(0)).alias("prop"),
                       F.coalesce("o.value", "raw").alias("value"),
                       F.when(F.col("a").isNotNull(), F.coalesce("o.lang", F.lit(""))).alias("lang"),
                       "ord", F.coalesce("seq", F.lit(0)).alias("seq"))


def read_triples_prefixes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source, data_source, prefix, expansion) of term JSON files; the first of a name wins."""
    return _term_prefixes(_term_files(spark, path), SOURCE_KEY)


def _term_prefixes(files: DataFrame, keys: list[str]) -> DataFrame:
    pairs = files.select(*keys, F.posexplode("prefixes").alias("at", "p"))
    pairs = pairs.select(*keys, "at", F.get("p", F.lit(0)).alias("prefix"), F.get("p", F.lit(1)).alias("expansion"))
    return pairs.groupBy(*keys, "prefix").agg(F.min_by("expansion", "at").alias("expansion"))


# Fixed pattern: one statement of the line-based RDF syntax.
NTRIPLE = (r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+'
           r'(?:(<[^>]*>|_:\S+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z][-A-Za-z0-9]*)|\^\^<([^>]*)>)?)\s*\.\s*$')


# Fixed patterns and values: the escapes of that syntax. Code units may come as a pair; a half of
# a pair and a number that is no character are no escapes.
UNITS = r"(?:\\u(?![dD][89a-fA-F])[0-9A-Fa-f]{4}|\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2})"
POINT = r"\\U(?:0000(?![dD][89a-fA-F])|000[1-9a-fA-F]|0010)[0-9A-Fa-f]{4}"
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescaped(text: Column) -> Column:
    """Text with its escapes resolved, each once, from left to right; others stay as written."""
    parts = F.regexp_extract_all(text, F.lit(rf"(?s){UNITS}+|{POINT}|\\.|[^\\]+|\\$"), F.lit(0))

    def one(part: Column) -> Column:
        out = F.when(part.rlike(f"^{UNITS}+$"), F.decode(F.unhex(F.replace(part, F.lit("\\u"), F.lit(""))), "UTF-16BE"))
        out = out.when(part.rlike(f"^{POINT}$"), F.decode(F.unhex(F.substring(part, 3, 8)), "UTF-32"))
        for letter, shown in ESCAPES.items():
            out = out.when(part == "\\" + letter, shown)
        return out.otherwise(part)

    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def read_ntriples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return ntriples(read_lines(spark, path))


def ntriples(lines: DataFrame) -> DataFrame:
    """(doc, ord, s, p, o, o_kind, lang, datatype) of line-based RDF."""
    rows = lines.where(F.col("text").rlike(NTRIPLE))

    def group(n: int) -> Column:
        return F.regexp_extract("text", NTRIPLE, n)

    def unwrap(col: Column) -> Column:
        return F.regexp_replace(col, r"^<(.*)>$", "$1")

    node = group(3)
    kind = (F.when(F.startswith(node, F.lit("<")), "iri")
            .when(F.startswith(node, F.lit("_:")), "blank").otherwise("literal"))
    return rows.select(
        "doc", "ord", unescaped(unwrap(group(1))).alias("s"), unescaped(group(2)).alias("p"),
        unescaped(F.when(node != "", unwrap(node)).otherwise(group(4))).alias("o"), kind.alias("o_kind"),
        group(5).alias("lang"), group(6).alias("datatype"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc, path, mtime, ext, length) of a folder tree; file contents are not read.

    `doc` is the name the readers give to the file.
    """
    return listed_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def listed_files(files: DataFrame) -> DataFrame:
    """The same of a table or stream of files as Spark's file reader gives it."""
    return files.select(F.col("_metadata.file_path").alias("doc"), "path",
                        F.col("modificationTime").cast("double").alias("mtime"),
                        F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), "length")


def read_outline(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Long rows of the terms of outline documents; labels are rows of their own."""
    lines = read_lines(spark, path, glob)
    parsed = cut(outline.parsed_lines(lines))
    _entities, attributes = outline.flatten_outline(outline.outline_nodes(lines, parsed), outline.outline_rows(lines, parsed))
    return attributes.select(F.col("source").alias("doc"), "id", F.lit("").alias("label"), "prop", "value", "lang", "ord",
                             F.lit(0).alias("seq"))


def outline_file_prefixes(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    return outline.outline_prefixes(read_lines(spark, path, glob)).select("doc", "prefix", "expansion")


def read_triple_labels(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Long rows of the labels in line-based RDF files."""
    return labels_from_triples(ntriples(read_lines(spark, path, glob)), ["doc"])


def triple_errors(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(doc, error) of line-based RDF files with a line that is no statement."""
    lines = read_lines(spark, path, glob).where(~F.col("text").rlike(r"^\s*(#|$)") & ~F.col("text").rlike(NTRIPLE))
    return lines.groupBy("doc").agg(F.concat(F.lit("no statement: "), F.substring(F.min_by("text", "ord"), 1, 60)).alias("error"))


# Rows of files by their paths or of a folder; of a folder those whose name matches the pattern.
Reader = Callable[[SparkSession, str, str], DataFrame]


@dataclass(frozen=True)
class FileKind:
    """How files of one extension are read: long rows with `doc`, (doc, prefix, expansion), and
    (doc, error) of the files that are not to be trusted."""

    rows: Reader
    prefixes: Reader | None = None
    errors: Reader | None = None


def _delimited(sep: str) -> FileKind:
    return FileKind(lambda spark, path, glob: read_delimited(spark, path, sep, glob),
                    errors=lambda spark, path, glob: delimited_errors(spark, path, sep, glob))


DEFAULT_READERS: dict[str, FileKind] = {
    "csv": _delimited(","),
    "tsv": _delimited("\t"),
    "json": FileKind(read_json, json_prefixes, json_errors),
    "org": FileKind(read_outline, outline_file_prefixes),
    "nt": FileKind(read_triple_labels, errors=triple_errors),
    "ttl": FileKind(read_triple_labels, lambda spark, path, glob: harvest_prefixes(read_lines(spark, path, glob))),
}


def kinds_of(readers: dict[str, FileKind | Reader] | None) -> dict[str, FileKind]:
    """File kinds by extension; a bare reader of rows is a kind without prefixes and errors."""
    return {ext: kind if isinstance(kind, FileKind) else FileKind(kind) for ext, kind in (readers or DEFAULT_READERS).items()}


def _any_case(ext: str) -> str:
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)


@dataclass(frozen=True)
class Folder:
    """What files hold: long rows, prefixes (doc, prefix, expansion), errors (path, error)."""

    rows: DataFrame | None
    prefixes: DataFrame | None
    errors: DataFrame


def read_files(spark: SparkSession, listing: DataFrame, places: dict[str, tuple], readers: dict | None = None) -> Folder:
    """Rows, prefixes and errors of files by extension; `places` has the arguments of a reader.

    Rows of a file with an error are left out, as the file may be half of what it should be.
    Files of the listing whose extension has no reader are errors.
    """
    known = kinds_of(readers)
    errors = listing.where(~F.col("ext").isin(list(known))).select(
        "doc", F.concat(F.lit("unknown extension '"), "ext", F.lit("'")).alias("error"))
    rows, prefixes, found = [], [], []
    for ext in sorted(places):
        kind, args = known[ext], places[ext]
        rows.append(kind.rows(spark, *args))
        prefixes += [kind.prefixes(spark, *args)] if kind.prefixes else []
        found += [kind.errors(spark, *args)] if kind.errors else []
    if found:
        found_errors = cut(outline.union_all(found))
        errors = errors.unionByName(found_errors)
        rows = [r.join(found_errors.select("doc"), "doc", "left_anti") for r in rows]
        prefixes = [p.join(found_errors.select("doc"), "doc", "left_anti") for p in prefixes]
    return Folder(outline.union_all(rows) if rows else None, outline.union_all(prefixes) if prefixes else None, errors)


def ingest_dir(spark: SparkSession, path: str, readers: dict | None = None) -> tuple[DataFrame | None, DataFrame]:
    """Long rows of a folder by lower-cased extension, and (path, error) of the files not read.

    One reader call per extension present; only the extensions come to the driver.
    """
    listing = list_files(spark, path)
    present = {r.ext for r in listing.where(F.col("ext").isin(list(kinds_of(readers)))).select("ext").distinct().collect()}
    found = read_files(spark, listing, {ext: (path, _any_case(ext)) for ext in present}, readers)
    errors = found.errors.join(listing.select("doc", "path"), "doc").select("path", "error")
    return found.rows, errors
