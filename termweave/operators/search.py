"""Search over all sources, and reuse of existing terms before new ones are coined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave import constants as K
from termweave.functions import ident as I
from termweave.model import TERM_KEY, Index, literal_table
from termweave.plans.cut import cut
from termweave.plans.ordered import top_per_group

CURIE_QUERY = r"^[A-Za-z_][A-Za-z0-9_-]*:.+$"
# Result order; a missing label comes first.
ORDER = ["source", "label", "id", "data_source"]
GRAM = 3


def kind_type(kind: str | None) -> str | None:
    if not kind:
        return None
    if kind.lower() not in K.KIND_TYPES:
        raise ValueError(f"unknown kind {kind!r}; expected one of {', '.join(K.KIND_TYPES)}")
    return K.KIND_TYPES[kind.lower()]


def query_table(spark, texts: list[str]) -> DataFrame:
    if any(not t for t in texts):
        raise ValueError("a query must be a non-empty string")
    return literal_table(spark, [(t,) for t in texts], ["query"])


def _pattern(query: Column) -> Column:
    """LIKE pattern: a text without `%` is a substring. `_` stays a wildcard."""
    bare = F.lower(F.replace(query, F.lit("\\"), F.lit("\\\\")))
    return F.when(F.contains(query, F.lit("%")), bare).otherwise(
        F.concat(F.lit("%"), bare, F.lit("%")))


def filtered(index: Index, kind: str | None, source: str | None, lang: str | None) -> DataFrame:
    """Entities that pass the kind, source and language filters."""
    rows = index.entities if source is None else index.entities.where(F.col("source") == source)
    rdf_type = kind_type(kind)
    if rdf_type:
        typed = index.attributes.where((F.col("prop") == "rdf:type") & (F.col("value") == rdf_type))
        rows = rows.join(typed.select(TERM_KEY), TERM_KEY, "left_semi")
    if lang:
        spoken = index.attributes.where((F.col("prop") == "rdfs:label") & (F.col("lang") == lang))
        rows = rows.join(spoken.select(TERM_KEY), TERM_KEY, "left_semi")
    return rows.select("id", "label", "source", "data_source")


def _grams(text: Column, size: Column) -> Column:
    """Distinct substrings of the given size; [''] for size 0, none of a shorter text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(
        starts, lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def _gram_size(piece: Column) -> Column:
    """The largest of 0, 1, 2, 3, 6, 12, 24 … that fits in the piece, so at least half of it."""
    length = F.length(piece)
    doubled = F.length(F.bin(F.floor(length / GRAM))) - 1
    return F.when(length < GRAM, length).otherwise((F.lit(GRAM) * F.pow(F.lit(2), doubled)).cast("int"))


def _offered(rows: DataFrame, sizes: Column) -> DataFrame:
    """Every row with each gram of its label and id, in the given sizes."""
    offered = rows.withColumn("_sizes", sizes).select(
        *rows.columns, F.lower(F.coalesce("label", F.lit(""))).alias("_l"),
        F.lower("id").alias("_i"), F.explode("_sizes").alias("_size"))
    return offered.select("*", F.explode(F.array_union(
        _grams(F.col("_l"), F.col("_size")), _grams(F.col("_i"), F.col("_size")))).alias("_gram"))


def substring_candidates(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query, _like, _l, _i, + columns of `rows`): the pairs that share the query's rarest gram.

    A row that matches holds every literal piece of the pattern, so it holds each gram of that
    piece: the query probes with the rarest gram of its longest piece, rows offer all of theirs.
    A gram takes half of its piece or more: of names that differ by a number, three letters
    would be shared by a fixed share of all rows, and the pairs grow with the square.
    Rows offer only gram sizes some query needs. A query of wildcards alone meets every row.
    """
    wanted = queries.select("query").distinct().withColumn("_like", _pattern(F.col("query")))
    pieces = F.split(F.lower("query"), "[%_]")
    longest = F.element_at(F.array_sort(
        pieces, lambda a, b: F.length(b) - F.length(a)), 1)
    sized = wanted.withColumn("_piece", longest).withColumn("_size", _gram_size(F.col("_piece")))
    probes = cut(sized.select("query", "_like", "_size",
                              F.explode(_grams(F.col("_piece"), F.col("_size"))).alias("_gram")))
    rows = rows.repartition("id")  # a file of many short names is small, but its grams are not
    sizes = sized.agg(F.collect_set("_size")).scalar()  # 3 and one per doubling of the longest piece
    counts = _offered(rows, sizes).join(
        probes.select("_size", "_gram").distinct(), ["_size", "_gram"],
        "left_semi").groupBy("_size", "_gram").agg(F.count(F.lit(1)).alias("_n"))
    # A gram nobody offers proves that the query has no match.
    chosen = cut(probes.join(counts, ["_size", "_gram"], "left")
                 .groupBy("query", "_like", "_size")
                 .agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"),
                      F.min(F.coalesce("_n", F.lit(0))).alias("_n")).where("_n > 0").drop("_n"))
    sizes = F.coalesce(chosen.agg(F.collect_set("_size")).scalar(), F.array().cast("array<int>"))
    return _offered(rows, sizes).join(chosen, ["_size", "_gram"]).select(
        "query", "_like", "_l", "_i", *rows.columns)


def substring_matches(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query, id, label, source, data_source) where label or id is LIKE the query.

    LIKE against a table of patterns would be a nested loop, so it decides among the candidates.
    """
    return (substring_candidates(queries, rows)
            .where(F.like(F.col("_l"), F.col("_like")) & F.col("label").isNotNull()
                   | F.like(F.col("_i"), F.col("_like")))
            .select("query", *rows.columns))


def local_name_matches(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose local name or label equals the local name of a CURIE-shaped query."""
    curies = queries.where(F.col("query").rlike(CURIE_QUERY) & ~F.contains("query", F.lit("%")))
    wanted = curies.select("query", F.lower(I.local_name(F.col("query"))).alias("_name")).distinct()
    names = F.array_compact(F.array_distinct(F.array(F.lower(I.local_name(F.col("id"))),
                                                     F.lower("label"))))
    return (rows.select("*", F.explode(names).alias("_name")).join(wanted, "_name")
            .select("query", *rows.columns).distinct())


def ontology_of_source(index: Index) -> DataFrame:
    """(source, data_source, ontology_iri): the ontology declared in each source."""
    declared = index.attributes.where(
        (F.col("prop") == "rdf:type") & (F.col("value") == "owl:Ontology"))
    return declared.groupBy("source", "data_source").agg(
        F.min_by("id", F.struct("ord", "id")).alias("ontology_iri"))


def first_values(rows: DataFrame, prop: str, name: str) -> DataFrame:
    return (rows.where(F.col("prop") == prop).groupBy(TERM_KEY)
            .agg(F.min_by("value", "ord").alias(name)))


def search_entities(queries: DataFrame, index: Index, limit: int | None = None,
                    kind: str | None = None, source: str | None = None, lang: str | None = None,
                    exact_only: bool = False) -> DataFrame:
    """Entities matching each query by substring, then by local name under other prefixes.

    `via` is exact, label-substring or local-name. All matches are returned unless a positive
    limit is stated; `omitted` then counts what it leaves out of the query.
    """
    rows = filtered(index, kind, source, lang)
    # The matches are few and read twice; the entities behind them are many.
    primary = cut(substring_matches(queries, rows).withColumn(
        "via", F.when(F.lower("id") == F.lower("query"), "exact").otherwise("label-substring")))
    found = primary.withColumn("_pass", F.lit(1))
    if not exact_only:
        seen = primary.select("query", *TERM_KEY)
        spare = local_name_matches(queries, rows).join(seen, ["query", *TERM_KEY], "left_anti")
        found = found.unionByName(spare.withColumns({"via": F.lit("local-name"), "_pass": F.lit(2)}))
    omitted = F.lit(0).cast("long")
    if limit is not None and limit > 0:
        found = cut(found)
        totals = found.groupBy("query").agg(F.count("*").alias("_all"))
        found = top_per_group(found, ["query"], ["_pass", *ORDER], limit, "_n").join(totals, "query")
        omitted = F.greatest(F.col("_all") - limit, omitted)
    found = found.withColumn("omitted", omitted)
    types = first_values(index.attributes, "rdf:type", "rdf_type")
    return (found.join(types, TERM_KEY, "left")
            .join(ontology_of_source(index), ["source", "data_source"], "left")
            .select("query", "id", "label", "rdf_type", "ontology_iri", "source", "data_source", "via", "omitted"))


def entity_citation(ids: DataFrame, index: Index) -> DataFrame:
    """One row per known id: label, its language, definition, type and ontology."""
    wanted = ids.select(I.strip_brackets(F.col("id")).alias("id")).distinct()
    home = index.entities.join(wanted, "id", "left_semi").groupBy("id").agg(
        F.min_by(F.struct("label", "source", "data_source"),
                 F.struct("source", "data_source")).alias("h"))
    home = home.select("id", "h.label", "h.source", "h.data_source")
    rows = index.attributes.where(F.col("prop").isin("rdf:type", "rdfs:label", "skos:definition"))
    rows = rows.join(wanted, "id", "left_semi")

    def first(value: str, test: Column) -> Column:
        return F.min_by(value, F.when(test, F.col("ord")))

    facts = rows.groupBy(TERM_KEY).agg(
        first("lang", (F.col("prop") == "rdfs:label") & (F.coalesce("lang", F.lit("")) != ""))
        .alias("label_lang"),
        first("value", F.col("prop") == "skos:definition").alias("definition"),
        first("value", F.col("prop") == "rdf:type").alias("rdf_type"))
    titles = first_values(index.attributes, "dcterms:title", "ontology_title").withColumnRenamed(
        "id", "ontology_iri")
    ontology = ontology_of_source(index).join(
        titles, ["ontology_iri", "source", "data_source"], "left")
    return (home.join(facts, TERM_KEY, "left").join(ontology, ["source", "data_source"], "left")
            .select("id", "label", "label_lang", "definition", "rdf_type", "source", "data_source",
                    I.last_id_token(F.col("ontology_iri")).alias("ontology_iri"), "ontology_title"))


def borrow_candidates(labels: DataFrame, index: Index, kind: str = "class",
                      source: str | None = None, lang: str | None = None) -> DataFrame:
    """(query, outcome, id, …): `none`, `one` with its citation, or `many` listed; no guessing."""
    queries = labels.select("query").distinct()
    rows = cut(search_entities(queries, index, None, kind or "class", source, lang))
    counts = rows.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    listed = queries.join(counts, "query", "left").join(
        rows.select("query", "id", "source", "via"), "query", "left")
    outcome = F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "one").otherwise("many")
    out = cut(listed.select("query", outcome.alias("outcome"), "id", "source", "via"))
    cited = entity_citation(out.where("outcome = 'one'").select("id"), index).select(
        "id", F.lit("one").alias("outcome"), "definition", "ontology_iri")
    return out.join(cited, ["id", "outcome"], "left").select(
        "query", "outcome", "id", "source", "via", "definition", "ontology_iri")


def borrow_flags(citations: DataFrame, index: Index) -> DataFrame:
    """What has to be settled before a cited term is borrowed, as flags; gaps stay NULL.

    default_prefix: the id has the empty prefix, so a prefix must be chosen; `namespace` is then
    what its source binds to that prefix, and `suggested_prefix` the word that this ends in, in lower case.
    label_missing: there is none but the id itself; `heading_label` is then the local name.
    is_defined_by: the ontology of the term's source.
    """
    empty = index.prefixes.where(F.col("prefix") == "").groupBy("source", "data_source").agg(
        F.min("expansion").alias("namespace"))
    bare = F.col("id").rlike("^:[^:]")
    word = F.lower(F.regexp_extract("namespace", r"([A-Za-z][A-Za-z0-9_-]*)[^A-Za-z0-9_-]*$", 1))
    no_label = F.coalesce(F.trim("label").isin("") | (F.col("label") == F.col("id")), F.lit(True))
    return citations.join(empty, ["source", "data_source"], "left").select(
        "id", bare.alias("default_prefix"), no_label.alias("label_missing"), F.when(~no_label, F.col("label")).alias("label"),
        F.when(no_label, I.local_name(F.col("id"))).otherwise(F.col("label")).alias("heading_label"),
        F.when(bare, F.col("namespace")).alias("namespace"),
        F.when(bare & (word != ""), word).alias("suggested_prefix"),
        F.col("ontology_iri").alias("is_defined_by"))
