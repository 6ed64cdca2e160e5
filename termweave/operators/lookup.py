"""Labels and attributes by source priority and language.

"First source that has it" and "preferred language" are `min_by` aggregates: they combine
map-side, so a popular id or property costs one row per task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave import constants as K
from termweave.functions import ident as I
from termweave.functions.lang import language_key, pick_by_language
from termweave.functions.text import match_form
from termweave.model import ActiveSources, Index, only_active
from termweave.operators.identifiers import contract_first, contract_uri, expand_curie
from termweave.plans.cut import cut

LABEL = "rdfs:label"


def pick_by_lang(rows: DataFrame, keys: list[str], prefs: list[str] | None = None) -> DataFrame:
    """One (value, lang) per key by language preference."""
    key = language_key(F.col("lang"), F.col("ord"), prefs)
    best = rows.groupBy(*keys).agg(F.min_by(F.struct("value", "lang"), key).alias("b"))
    return best.select(*keys, "b.value", "b.lang")


def _wanted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id"), "id", "left_semi")


def get_labels(ids: DataFrame, index: Index, active: ActiveSources,
               prefs: list[str] | None = None) -> DataFrame:
    """(id, label) for distinct ids, from the first active source that has the id."""
    owner = _wanted(only_active(index.entities, active), ids).groupBy("id").agg(
        F.min_by(F.struct("prio", "label"), "prio").alias("o"))
    rows = _wanted(only_active(index.attributes.where(F.col("prop") == LABEL), active), ids)
    picked = rows.groupBy("id", "prio").agg(
        pick_by_language(F.col("value"), F.col("lang"), F.col("ord"), prefs).alias("value"),
        F.lit(True).alias("hit"))
    owned = owner.select("id", "o.prio", "o.label")
    return (
        ids.select("id").join(owned, "id", "left").join(picked, ["id", "prio"], "left")
        .select("id", F.when(F.col("hit"), F.col("value")).otherwise(F.col("label")).alias("label"))
    )


def distinct_tokens(tokens: DataFrame) -> DataFrame:
    """The tokens to resolve, written once: the passes below read them several times, and
    each would otherwise scan the texts they come from again."""
    return cut(tokens.select("token").distinct())


def lookup_candidates(distinct: DataFrame, index: Index, active: ActiveSources) -> DataFrame:
    """(token, id, pass, place): the literal id, the expanded CURIE, the contracted IRIs."""
    none = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit("").alias("c"))
    literal = distinct.select("token", F.col("token").alias("id"), F.lit(1).alias("pass"),
                              none.alias("place"))
    curies = distinct.where(I.is_curie(F.col("token")))
    expanded = expand_curie(curies, "token", index, active, "id").where("id IS NOT NULL").select(
        "token", "id", F.lit(2).alias("pass"), none.alias("place"))
    contracted = contract_uri(distinct, "token", index, active).select(
        F.col("iri").alias("token"), F.col("curie").alias("id"), F.lit(3).alias("pass"),
        F.struct((-F.col("ns_length")).alias("a"), F.col("prio").alias("b"),
                 F.col("prefix").alias("c")).alias("place"))
    return literal.unionByName(expanded).unionByName(contracted)


def resolve_labels(tokens: DataFrame, index: Index, active: ActiveSources) -> DataFrame:
    """(token, label) for distinct tokens by three passes over the stored labels.

    A NULL label of the winning source ends its candidate, not the search.
    """
    distinct = distinct_tokens(tokens)
    candidates = lookup_candidates(distinct, index, active)
    owner = _wanted(only_active(index.entities, active), candidates).groupBy("id").agg(
        F.min_by("label", "prio").alias("label")).where("label IS NOT NULL")
    best = candidates.join(owner, "id").groupBy("token").agg(
        F.min_by("label", F.struct("pass", "place")).alias("label"))
    return distinct.join(best, "token", "left")


def get_attr(ids: DataFrame, prop: str, index: Index, active: ActiveSources,
             prefs: list[str] | None = None) -> DataFrame:
    """(id, value): the property from the first active source that has it."""
    rows = _wanted(only_active(index.attributes.where(F.col("prop") == prop), active), ids)
    key = F.struct(F.col("prio"), language_key(F.col("lang"), F.col("ord"), prefs))
    best = rows.groupBy("id").agg(F.min_by("value", key).alias("value"))
    return ids.select("id").distinct().join(best, "id", "left")


def get_attr_any(tokens: DataFrame, prop: str, index: Index, active: ActiveSources,
                 prefs: list[str] | None = None) -> DataFrame:
    """(token, value): `get_attr` with the three passes of `resolve_labels`."""
    distinct = distinct_tokens(tokens)
    candidates = lookup_candidates(distinct, index, active)
    values = get_attr(candidates, prop, index, active, prefs).where("value IS NOT NULL")
    best = candidates.join(values, "id").groupBy("token").agg(
        F.min_by("value", F.struct("pass", "place")).alias("value"))
    return distinct.join(best, "token", "left")


def get_all_attrs(ids: DataFrame, index: Index, active: ActiveSources,
                  prefs: list[str] | None = None) -> DataFrame:
    """(id, prop, value, source, data_source): one value per property of the owning source.

    The first source with any row for the id owns it; lower sources are not merged.
    """
    rows = _wanted(only_active(index.attributes, active), ids)
    per_prop = rows.groupBy("id", "prio", "prop", "source", "data_source").agg(
        pick_by_language(F.col("value"), F.col("lang"), F.col("ord"), prefs).alias("value"))
    owner = rows.groupBy("id").agg(F.min("prio").alias("prio"))
    return per_prop.join(owner, ["id", "prio"], "left_semi").select(
        "id", "prop", "value", "source", "data_source")


def get_all_attrs_any(tokens: DataFrame, index: Index, active: ActiveSources,
                      prefs: list[str] | None = None) -> DataFrame:
    """(token, id, prop, value, source): the view of the first candidate that has one."""
    distinct = distinct_tokens(tokens)
    candidates = lookup_candidates(distinct, index, active)
    rows = get_all_attrs(candidates.select("id").distinct(), index, active, prefs)
    chosen = candidates.join(rows.select("id").distinct(), "id", "left_semi").groupBy("token").agg(
        F.min_by("id", F.struct("pass", "place")).alias("id"))
    return chosen.join(rows, "id").select("token", "id", "prop", "value", "source")


def all_active_ids(index: Index, active: ActiveSources, include_curies: bool = False) -> DataFrame:
    """Distinct ids of active sources, and the CURIE forms of those that are IRIs."""
    ids = only_active(index.entities, active).select("id").distinct()
    if not include_curies:
        return ids
    curies = contract_uri(ids, "id", index, active).select(F.col("curie").alias("id"))
    return ids.unionByName(curies).distinct()


def labelled_ids(index: Index, active: ActiveSources, prefs: list[str] | None = None) -> DataFrame:
    """(id, prio, label) of every active entity with a stored label."""
    stored = only_active(index.entities.where("label IS NOT NULL"), active).select(
        "id", "prio", "label")
    rows = only_active(index.attributes.where(F.col("prop") == LABEL), active)
    picked = rows.groupBy("id", "prio").agg(
        pick_by_language(F.col("value"), F.col("lang"), F.col("ord"), prefs).alias("value"),
        F.lit(True).alias("hit"))
    return stored.join(picked, ["id", "prio"], "left").select(
        "id", "prio", F.when(F.col("hit"), F.col("value")).otherwise(F.col("label")).alias("label"))


def all_active_labels(index: Index, active: ActiveSources,
                      prefs: list[str] | None = None) -> DataFrame:
    """(label, id): the first source that owns a label keeps all its ids.

    The winner per label is an aggregate joined back, not a window, so a label shared by a
    third of all ids is never one task's partition.
    """
    rows = labelled_ids(index, active, prefs).where("label IS NOT NULL")
    winner = cut(rows.groupBy("label").agg(F.min("prio").alias("prio")))
    return rows.join(winner, ["label", "prio"], "left_semi").select("label", "id")


def ids_for_label(labels: DataFrame, index: Index, active: ActiveSources,
                  prefs: list[str] | None = None) -> DataFrame:
    wanted = labels.select("label").distinct()
    return all_active_labels(index, active, prefs).join(wanted, "label", "left_semi")


def label_variants(ids: DataFrame, index: Index, active: ActiveSources) -> DataFrame:
    """(id, value, lang): all label rows of the first source that has any."""
    rows = _wanted(only_active(index.attributes.where(F.col("prop") == LABEL), active), ids)
    owner = rows.groupBy("id").agg(F.min("prio").alias("prio"))
    return rows.join(owner, ["id", "prio"], "left_semi").select("id", "value", "lang")


def attributes_of(ids: DataFrame, index: Index, source: str | None = None,
                  distinct: bool = False) -> DataFrame:
    """Raw rows of the ids; `distinct` keeps one per (prop, value), of the smallest source."""
    rows = index.attributes
    if source is not None:
        rows = rows.where(F.col("source") == source)
    rows = _wanted(rows, ids)
    if not distinct:
        return rows.select("id", "prop", "value", "lang", "source", "data_source")
    key = F.struct("source", "ord")
    return rows.groupBy("id", "prop", "value").agg(
        F.min("source").alias("source"), F.min_by("lang", key).alias("lang"),
        F.min_by("data_source", key).alias("data_source"))


def supertypes(ids: DataFrame, index: Index, source: str | None = None) -> DataFrame:
    rows = index.attributes.where(F.col("prop").isin(K.SUPER_SPELLINGS))
    if source is not None:
        rows = rows.where(F.col("source") == source)
    return _wanted(rows, ids).select("id", "value", "prop", "source", "data_source")


def individual_types(ids: DataFrame, index: Index, source: str | None = None) -> DataFrame:
    """Asserted types of individuals; classes with an rdf:type are not individuals.

    The guard is a flag of the (id, source) group, so one aggregate serves both sides.
    """
    rows = index.attributes.where(F.col("prop").isin(K.TYPE_SPELLINGS))
    if source is not None:
        rows = rows.where(F.col("source") == source)
    rows = _wanted(rows, ids).select("id", "value", "prop", "source", "data_source").distinct()
    guard = rows.where((F.col("prop") == "Types") | (F.col("value") == "owl:NamedIndividual"))
    return (rows.where(F.col("value") != "owl:NamedIndividual")
            .join(guard.select("id", "source", "data_source").distinct(),
                  ["id", "source", "data_source"], "left_semi"))


def label_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("label_count"))


def id_suffix(ident: Column, curie: Column) -> Column:
    """Short form that tells two ids with one label apart."""
    return F.coalesce(curie, F.when(I.is_uri(ident), I.iri_tail(ident)).otherwise(ident))


def lookup_items(local: DataFrame, index: Index, active: ActiveSources, scope: str = "both",
                 prefs: list[str] | None = None) -> DataFrame:
    """(id, label, rdf_type, origin, detail) over local and indexed terms.

    One item per canonical id; the local one wins. The detail tells apart ids that share a
    label, shows the language of a lone label with variants, and the origin in scope both.
    """
    own = local.select(I.canonical_id(F.col("id")).alias("id"), "label",
                       F.coalesce("rdf_type", F.lit("")).alias("rdf_type"), "ord").where("id <> ''")
    own = own.groupBy("id").agg(
        F.min_by(F.struct(F.col("label"), F.col("rdf_type")), "ord").alias("l"))
    known = all_active_labels(index, active, prefs).select(
        I.canonical_id(F.col("id")).alias("id"), "label").where("id <> ''")
    known = known.groupBy("id").agg(F.min("label").alias("x_label"))
    types = get_attr(known, "rdf:type", index, active, prefs).select(
        "id", F.col("value").alias("x_type"))
    known = known.join(types, "id", "left")
    if scope == "local":
        known = known.limit(0)
    if scope == "external":
        own = own.limit(0)
    cells = cut(own.join(known, "id", "full_outer").select(
        "id",
        F.when(F.col("l").isNotNull(), F.col("l.label")).otherwise(F.col("x_label")).alias("label"),
        F.when(F.col("l").isNotNull(), F.col("l.rdf_type"))
        .otherwise(F.coalesce("x_type", F.lit(""))).alias("rdf_type"),
        F.when(F.col("l").isNull(), "external").when(F.col("x_label").isNotNull(), "both")
        .otherwise("local").alias("origin")))
    variants = label_variants(cells, index, active).groupBy("id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct("value", "lang"),
                 language_key(F.col("lang"), F.lit(0), prefs)).alias("w"))
    curies = contract_first(cells, "id", index, active).withColumnRenamed("iri", "id")
    tag = F.when((F.col("n") > 1) & (F.col("w.value") == F.col("label")) & (F.col("w.lang") != ""),
                 F.concat(F.lit("@"), F.col("w.lang"))).otherwise("")
    suffix = F.when(F.col("label_count") > 1, id_suffix(F.col("id"), F.col("curie"))).otherwise(tag)
    mark = F.lit("") if scope != "both" else (
        F.when(F.col("origin") == "external", "[external]")
        .when(F.col("origin") == "both", "+external").otherwise(""))
    return (
        cells.join(cut(label_counts(cells)), "label", "left").join(variants, "id", "left")
        .join(curies, "id", "left")
        .select("id", "label", "rdf_type", "origin",
                F.trim(F.concat(suffix, F.lit("  "), mark)).alias("detail"))
    )


def disambiguate_labels(rows: DataFrame) -> DataFrame:
    """(label, id) with `display`: `label  [id]` where a label names several ids."""
    several = cut(label_counts(rows).where("label_count > 1").select("label", F.lit(True).alias("_dup")))
    suffix = id_suffix(F.col("id"), F.lit(None).cast("string"))
    return (rows.join(several, "label", "left")
            .withColumn("display", F.when(F.col("_dup"), F.concat("label", F.lit("  ["), suffix,
                                                                 F.lit("]"))).otherwise(F.col("label")))
            .drop("_dup"))


def insert_token(ids: DataFrame, index: Index, active: ActiveSources) -> DataFrame:
    """(id, token): a CURIE as it is, an IRI contracted, else in angle brackets."""
    bare = ids.select("id", I.canonical_id(F.col("id")).alias("iri"))
    curies = contract_first(bare, "iri", index, active)
    return bare.join(curies, "iri", "left").select(
        "id", F.when(~I.is_uri(F.col("iri")), F.col("iri"))
        .otherwise(F.coalesce("curie", F.concat(F.lit("<"), "iri", F.lit(">")))).alias("token"))


def _first_of(props: list[str]) -> Column:
    return F.coalesce(*[F.max(F.when((F.col("prop") == p) & (F.col("value") != ""), F.col("value")))
                        for p in props])


def entity_summary(ids: DataFrame, index: Index, active: ActiveSources,
                   prefs: list[str] | None = None) -> DataFrame:
    """(id, label, rdf_type, definition, source, summary) of the ids the index describes; line
    breaks of a definition become spaces."""
    rows = get_all_attrs(ids, index, active, prefs)
    facts = rows.groupBy("id").agg(
        F.max(F.when(F.col("prop") == LABEL, F.col("value"))).alias("own_label"),
        F.max(F.when(F.col("prop") == "rdf:type", F.col("value"))).alias("rdf_type"),
        _first_of(K.SUMMARY_DEFINITIONS).alias("definition"), F.min("source").alias("source"))
    labels = get_labels(facts, index, active, prefs)
    short = F.replace("definition", F.lit("\n"), F.lit(" "))
    both = facts.join(labels, "id").select(
        "id", F.coalesce("own_label", "label").alias("label"), "rdf_type",
        short.alias("definition"), "source")
    return both.withColumn("summary", F.concat(
        F.concat_ws("  ", "id",
                    F.when(F.col("label") != "", F.concat(F.lit("["), "label", F.lit("]"))),
                    F.when(F.col("rdf_type") != "", F.concat(F.lit("("), "rdf_type", F.lit(")")))),
        F.when(F.col("definition") != "", F.concat(F.lit("  -- "), "definition")).otherwise(""),
        F.concat(F.lit("   [src: "), "source", F.lit("]"))))


FEATURED = ["rdf:type", *K.SUMMARY_DEFINITIONS]


def entity_card(ids: DataFrame, index: Index, active: ActiveSources,
                prefs: list[str] | None = None) -> DataFrame:
    """(id, rank, prop, value, source): featured properties first, then the others by name."""
    rank = F.lit(len(FEATURED))
    for place, prop in reversed(list(enumerate(FEATURED))):
        rank = F.when(F.col("prop") == prop, F.lit(place)).otherwise(rank)
    return get_all_attrs(ids, index, active, prefs).where(F.col("prop") != LABEL).select(
        "id", rank.alias("rank"), "prop", "value", "source")


def list_resources(index: Index, kind: str | None = None, match: str | None = None,
                   prefix: str | None = None, limit: int | None = None, width: int | None = None) -> DataFrame:
    """Catalogue (id, kind, label, definition, source): label or `--`, definition or `--`.

    All that match, in no order, unless a `limit` is stated: then the first by id and source, with
    the number of all that match in `total`. `width` cuts definitions for display."""
    rows = index.attributes.where(
        F.col("prop").isin(["rdf:type", *K.LISTING_DEFINITIONS]))
    facts = rows.groupBy("id", "source", "data_source").agg(
        F.min_by("value", F.when(F.col("prop") == "rdf:type", F.col("ord"))).alias("rdf_type"),
        F.coalesce(*[F.min_by("value", F.when((F.col("prop") == p) & (F.col("value") != ""),
                                              F.col("ord")))
                     for p in K.LISTING_DEFINITIONS]).alias("text"))
    pretty = F.lit("(unknown)")
    for rdf_type, name in K.KIND_NAMES.items():
        pretty = F.when(F.col("rdf_type") == rdf_type, name).otherwise(pretty)
    shown = index.entities
    if prefix:
        shown = shown.where(I.curie_prefix(F.col("id")) == prefix)
    if match:
        pattern = f"(?i){match}"
        shown = shown.where(F.col("id").rlike(pattern)
                            | F.coalesce("label", F.lit("")).rlike(pattern))
    out = shown.join(facts, ["id", "source", "data_source"], "left").withColumn("kind", pretty)
    if kind and kind.lower() != "all":
        names = {n.lower(): n for n in K.KIND_NAMES.values()}
        if kind.lower() not in names:
            raise ValueError(f"unknown kind {kind!r}; use one of {', '.join(names.values())}")
        out = out.where(F.col("kind") == names[kind.lower()])
    label = F.when((F.coalesce("label", F.lit("")) == "") | (F.col("label") == F.col("id")),
                   "--").otherwise(F.col("label"))
    text = F.coalesce("text", F.lit("--"))
    if width is not None:
        text = F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)
    found = out.select("id", "kind", label.alias("label"), text.alias("definition"), "source")
    if limit is None:
        return found
    total = found.agg(F.count("*").alias("total"))  # one row
    return found.orderBy("id", "source").limit(limit).crossJoin(total)


def resolve_subjects(subjects: DataFrame, entities: DataFrame) -> DataFrame:
    """(subject, id, source): declarations by id or first token; by label only if none."""
    wanted = subjects.select("subject").distinct()
    forms = entities.select(
        "id", "source",
        F.explode(F.array_distinct(F.array(F.col("id"), I.first_id_token(F.col("id"))))).alias("subject"))
    by_id = wanted.join(forms, "subject").select("subject", "id", "source").distinct()
    rest = wanted.join(by_id.select("subject").distinct(), "subject", "left_anti")
    by_label = rest.withColumn("_m", match_form(F.col("subject"))).join(
        entities.select("id", "source", match_form(F.col("label")).alias("_m")), "_m")
    return by_id.unionByName(by_label.select("subject", "id", "source"))


def sql(index: Index, query: str, limit: int | None = None) -> DataFrame:
    """Ad-hoc read query over the index views, all rows or the first `limit`.

    Every row shown carries the number of rows the limit left out.
    """
    index.views()
    spark = index.entities.sparkSession
    rows = spark.sql(query)
    if limit is None:
        return rows.withColumn("omitted", F.lit(0).cast("long"))
    left_out = rows.agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0))).scalar()
    return rows.limit(limit).withColumn("omitted", left_out)
