"""Compact name <-> full IRI under prioritised prefix tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave import constants as K
from termweave.functions import ident as I
from termweave.model import ActiveSources, Index, only_active
from termweave.plans.cut import cut

GLOBAL_PRIO = 1 << 30
# Characters after which namespaces usually end.
CUT_CHARS = "/#:_"


def ranked_prefixes(index: Index, active: ActiveSources) -> DataFrame:
    """(prefix, expansion, prio): active sources in order, globals last."""
    scoped = only_active(index.prefixes, active).select("prefix", "expansion", "prio")
    return scoped.unionByName(
        index.global_prefixes.select("prefix", "expansion", F.lit(GLOBAL_PRIO).alias("prio")))


def best_expansions(index: Index, active: ActiveSources) -> DataFrame:
    """One namespace per prefix: the first active source's, else the global one."""
    return ranked_prefixes(index, active).groupBy("prefix").agg(
        F.min_by("expansion", F.struct("prio", "expansion")).alias("expansion"))


def expand_curie(frame: DataFrame, col: str, index: Index, active: ActiveSources,
                 name: str = "iri") -> DataFrame:
    """Full IRI of a compact name; NULL for an unknown prefix or no colon.

    Prefixes of a hot namespace repeat on the left; the right has one row per prefix, so
    the planner broadcasts it while it is small and splits the skewed side when it is not.
    """
    table = cut(best_expansions(index, active).select(
        F.col("prefix").alias("_p"), F.col("expansion").alias("_x")))
    return (
        frame.withColumn("_p", I.curie_prefix(F.col(col)))
        .join(table, "_p", "left")
        .withColumn(name, F.when(F.col("_x").isNotNull(),
                                 F.concat("_x", I.local_name(F.col(col)))))
        .drop("_p", "_x")
    )


def expand_with(frame: DataFrame, col: str, table: DataFrame, name: str) -> DataFrame:
    """Full IRI of a compact name under one prefix table; NULL for an unknown prefix."""
    spaces = table.groupBy(F.col("prefix").alias("_p")).agg(F.min("expansion").alias("_x"))
    return (frame.withColumn("_p", I.curie_prefix(F.col(col))).join(spaces, "_p", "left")
            .withColumn(name, F.concat("_x", I.local_name(F.col(col)))).drop("_p", "_x"))


def prefix_join(iris: DataFrame, col: str, table: DataFrame, allow_equal: bool = False) -> DataFrame:
    """Rows of `iris` with every namespace of `table` that starts the IRI.

    `startswith` would be a nested loop. Instead an IRI is cut where a namespace can end:
    after the usual characters, and at the lengths of the namespaces that end elsewhere
    (a set of numbers, at most as many as the longest namespace has characters). Each cut
    is an equi-join key, so the answer is exact and the work grows with IRIs x cuts.
    """
    table = cut(table)
    odd = (table.where(~F.col("expansion").rlike(f"[{CUT_CHARS}]$"))
           .agg(F.sort_array(F.collect_set(F.length("expansion")))).scalar())
    last = F.length(col) - (0 if allow_equal else 1)
    at_char = F.filter(
        F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
        lambda i: F.substring(F.col(col), i, F.lit(1)).rlike(f"[{CUT_CHARS}]") & (i <= last))
    at_odd = F.filter("_odd", lambda n: (n <= last) & (n >= 0))
    cuts = F.array_distinct(F.concat(at_char, at_odd))
    return (
        iris.withColumn("_odd", odd).withColumn("_len", F.explode(cuts)).drop("_odd")
        .withColumn("expansion", F.substring(F.col(col), F.lit(1), F.col("_len")))
        .join(table, "expansion")
        .withColumnRenamed("_len", "ns_length")
    )


def contract_uri(frame: DataFrame, col: str, index: Index, active: ActiveSources) -> DataFrame:
    """All candidate CURIEs of each distinct IRI: (iri, curie, ns_length, prio, prefix).

    Order of preference: longest namespace, then source priority, globals last; equal
    places fall back to the prefix name.
    """
    iris = frame.select(F.col(col).alias("iri")).where(I.is_uri(F.col("iri"))).distinct()
    return prefix_join(iris, "iri", ranked_prefixes(index, active)).select(
        "iri",
        F.concat("prefix", F.lit(":"),
                 F.substring(F.col("iri"), F.col("ns_length") + 1, F.length("iri"))).alias("curie"),
        "ns_length", "prio", "prefix")


def candidate_order() -> Column:
    return F.struct((-F.col("ns_length")).alias("a"), F.col("prio").alias("b"),
                    F.col("prefix").alias("c"))


def contract_ranked(candidates: DataFrame) -> DataFrame:
    """Candidates with their place 1, 2, … per IRI (an IRI has few)."""
    listed = candidates.groupBy("iri").agg(
        F.sort_array(F.collect_list(F.struct(candidate_order().alias("k"), "curie"))).alias("l"))
    return listed.select("iri", F.posexplode("l").alias("pos", "e")).select(
        "iri", F.col("e.curie").alias("curie"), (F.col("pos") + 1).alias("place"))


def contract_first(frame: DataFrame, col: str, index: Index, active: ActiveSources) -> DataFrame:
    """(iri, curie): the preferred CURIE of each distinct IRI that has one."""
    return contract_uri(frame, col, index, active).groupBy("iri").agg(
        F.min_by("curie", candidate_order()).alias("curie"))


def contract_best(frame: DataFrame, col: str, table: DataFrame) -> DataFrame:
    """(iri, curie) by longest namespace alone; the IRI may equal the namespace."""
    iris = frame.select(F.col(col).alias("iri")).where(I.is_uri(F.col("iri"))).distinct()
    found = prefix_join(iris, "iri", table.select("prefix", "expansion"), allow_equal=True)
    curie = F.concat("prefix", F.lit(":"),
                     F.substring(F.col("iri"), F.col("ns_length") + 1, F.length("iri")))
    return found.groupBy("iri").agg(
        F.min_by(curie, F.struct((-F.col("ns_length")).alias("a"), "prefix")).alias("curie"))


def to_bracketed_iri(frame: DataFrame, col: str, table: DataFrame | None, name: str = "iri",
                     noerror: bool = False, keys: list[str] | None = None) -> DataFrame:
    """CURIE to `<iri>`; an unknown prefix gives NULL (`noerror`) or the text unchanged.

    `table` has (prefix, expansion), and the `keys` columns when prefixes are per document.
    """
    if table is None:
        return frame.withColumn(name, F.col(col))
    on = keys or []
    spaces = table.select(*on, F.col("prefix").alias("_p"), F.col("expansion").alias("_x"))
    shaped = F.col(col).rlike(K.TABLE_CURIE)
    unknown = F.lit(None).cast("string") if noerror else F.col(col)
    return (
        frame.withColumn("_p", F.when(shaped, F.regexp_extract(F.col(col), K.TABLE_CURIE, 1)))
        .join(spaces, [*on, "_p"], "left")
        .withColumn(name, F.when(~shaped, F.col(col))
                    .when(F.col("_x").isNotNull(),
                          F.concat(F.lit("<"), "_x",
                                   F.regexp_extract(F.col(col), K.TABLE_CURIE, 2), F.lit(">")))
                    .otherwise(unknown))
        .drop("_p", "_x")
    )


def list_prefixes(index: Index, source: str | None = None,
                  data_source: str | None = None) -> DataFrame:
    rows = index.prefixes
    if source is not None:
        rows = rows.where(F.col("source") == source)
    if data_source is not None:
        rows = rows.where(F.col("data_source") == data_source)
    return rows.orderBy("source", "data_source", "prefix")


def prefix_candidates(index: Index) -> DataFrame:
    """Distinct namespaces ever bound to each prefix, anywhere."""
    return (index.prefixes.select("prefix", "expansion")
            .union(index.global_prefixes.select("prefix", "expansion")).distinct())


def merge_prefixes(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, prefix, expansion, pos) to one row per name: last value, first place.

    `conflict` tells whether the name was bound to different namespaces.
    """
    return rows.groupBy(*(keys or []), "prefix").agg(
        F.max_by("expansion", "pos").alias("expansion"),
        F.min("pos").alias("pos"),
        (F.min("expansion") != F.max("expansion")).alias("conflict"))


# Fixed formats of a prefix declaration.
PREFIX_LINES = {"omn": "Prefix: %-5s <%s>", "ttl": "@prefix %-5s <%s> .",
                "sparql": "PREFIX %-5s <%s>"}


def prefix_lines(rows: DataFrame, fmt: str) -> DataFrame:
    """One declaration line per prefix row; a header row is skipped."""
    name = F.when(F.endswith("prefix", F.lit(":")), F.col("prefix")).otherwise(
        F.concat("prefix", F.lit(":")))
    header = (F.col("prefix") == "prefix") & (F.col("expansion") == "uri")
    return rows.where(~header).withColumn(
        "line", F.format_string(PREFIX_LINES[fmt], name, F.col("expansion")))


def prefix_block(rows: DataFrame, fmt: str, keys: list[str], order: str) -> DataFrame:
    """The declarations of each key as one text. A prefix table is one document's header."""
    return prefix_lines(rows, fmt).groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "line"))),
                                 lambda e: e["line"]), "\n").alias("block"))


def strip_prefix_lines(col: Column) -> Column:
    """Text without its prefix declarations."""
    return F.regexp_replace(col, r"(?im)^[ \t]*(?:@prefix|prefix)[ \t]+[-\w.]*:[^\n]*\n?", "")


def ontology_ids(declared: DataFrame, table: DataFrame) -> DataFrame:
    """Names an ontology goes by. `declared` has (source, id), id maybe "iri version-iri"."""
    parts = declared.select("source", F.explode(I.id_tokens(F.col("id"))).alias("name"))
    full = to_bracketed_iri(parts, "name", table, "iri", noerror=True)
    names = F.array(F.col("name"), I.strip_brackets(F.col("name")), F.col("iri"),
                    I.strip_brackets(F.col("iri")))
    return (full.select("source", F.explode(F.array_compact(names)).alias("name")).distinct())
