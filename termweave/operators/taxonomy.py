"""Parents, hierarchies, types and axiom summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave import constants as K
from termweave.functions import ident as I
from termweave.functions.text import axiom_leaves
from termweave.operators import closure as C
from termweave.plans.cut import cut
from termweave.plans.ordered import running_number, running_sum, top_per_group

BARE_CURIE = r"^[A-Za-z_][A-Za-z0-9_-]*:[A-Za-z_][A-Za-z0-9_.-]+$"


def short_form(ident: Column) -> Column:
    """Last segment of an IRI, local part of a compact name."""
    return F.when(I.is_uri(ident), I.iri_tail(ident)).otherwise(I.local_name(ident))


def parent_edges(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc, uri, keyword, parent) that nesting adds to the authored rows."""
    keyword = F.when(F.col("rdf_type") == "owl:Class", "SubClassOf").when(
        F.endswith("rdf_type", F.lit("Property")), "SubPropertyOf")
    nested = nodes.where("uri IS NOT NULL AND parent_uri IS NOT NULL AND NOT tagged_nodeclare").select(
        "doc", "node_id", "uri", keyword.alias("keyword"), F.col("parent_uri").alias("parent"))
    authored = rows.where("parent_row_id IS NULL").select(
        "doc", "node_id", F.col("tag").alias("keyword"), F.col("value").alias("parent"))
    return nested.where("keyword IS NOT NULL").join(
        authored, ["doc", "node_id", "keyword", "parent"], "left_anti").select(
        "doc", "node_id", "uri", "keyword", "parent")


def relation_facts(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc, uri, keyword, value): facts from an individual to its immediate parent."""
    value = F.concat("relation", F.lit(" "), "parent_uri")
    nested = nodes.where("rdf_type = 'owl:NamedIndividual' AND relation IS NOT NULL "
                         "AND uri IS NOT NULL AND parent_uri IS NOT NULL AND NOT tagged_nodeclare")
    nested = nested.select("doc", "node_id", "uri", F.lit("Facts").alias("keyword"), value.alias("value"))
    authored = rows.where("parent_row_id IS NULL AND tag = 'Facts'").select("doc", "node_id", "value")
    return nested.join(authored, ["doc", "node_id", "value"], "left_anti").select(
        "doc", "node_id", "uri", "keyword", "value")


def immediate_parents(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc, uri, parent, place): nesting parent first, then bare super rows, deduplicated."""
    terms = nodes.where("uri IS NOT NULL")
    holders = nodes.where("uri IS NOT NULL AND coalesce(context_type, '') <> 'ontology'").select(
        "doc", F.col("node_id").alias("parent_id"), F.col("uri").alias("parent"))
    nested = terms.select("doc", "node_id", "uri", "parent_id").join(
        holders, ["doc", "parent_id"]).select("doc", "uri", "parent", F.lit(-1).cast("long").alias("ord"))
    supers = rows.where(F.col("tag").isin("SubClassOf", "SubPropertyOf")
                        & F.col("parent_row_id").isNull() & F.trim("value").rlike(BARE_CURIE))
    written = supers.join(terms.select("doc", "node_id", "uri"), ["doc", "node_id"]).select(
        "doc", "uri", F.trim("value").alias("parent"), F.col("row_id").alias("ord"))
    first = nested.unionByName(written).groupBy("doc", "uri", "parent").agg(F.min("ord").alias("ord"))
    return running_number(first, ["doc", "uri"], "ord", "place").select(
        "doc", "uri", "parent", F.col("place").cast("int"))


def children(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(parent, child, place, omitted): children by name; with a limit the first, the rest counted."""
    if limit is None:
        placed = running_number(edges.select("parent", "child"), ["parent"], "child", "place")
        return placed.select("parent", "child", F.col("place").cast("int").alias("place"), F.lit(0).cast("long").alias("omitted"))
    first = top_per_group(edges, ["parent"], ["child"], limit, "place")
    counts = edges.groupBy("parent").agg(F.count(F.lit(1)).alias("_n"))
    return first.join(counts, "parent").select(
        "parent", "child", "place", F.greatest(F.col("_n") - limit, F.lit(0)).cast("long").alias("omitted"))


def primary_parent(supers: DataFrame, equivalents: DataFrame) -> DataFrame:
    """(child, parent): the first named super by short form, else the first equivalent."""
    def best(rows: DataFrame, rank: int) -> DataFrame:
        named = rows.where((F.col("parent") != "owl:Thing") & (F.col("parent") != F.col("child")))
        return named.withColumn("_rank", F.lit(rank))

    # A super that is the term itself still counts, an equivalent does not.
    own = supers.where(F.col("parent") != "owl:Thing").withColumn("_rank", F.lit(0))
    both = own.unionByName(best(equivalents, 1))
    key = F.struct(F.col("_rank").alias("a"), short_form(F.col("parent")).alias("b"), F.col("parent"))
    return both.groupBy("child").agg(F.min_by("parent", key).alias("parent"))


def break_cycles(parent_map: DataFrame, weight: DataFrame) -> DataFrame:
    return C.break_cycles(parent_map, weight, short_form(F.col("child")))


def top_level(entities: DataFrame, parent_map: DataFrame) -> DataFrame:
    """(id): terms without a parent, or with one outside the set; never Thing."""
    inside = entities.select(F.col("id").alias("parent"))
    held = parent_map.join(inside, "parent", "left_semi").select(F.col("child").alias("id"))
    return entities.select("id").where(F.col("id") != "owl:Thing").join(held, "id", "left_anti")


def sort_key(label: Column, ident: Column) -> Column:
    """Label, else local name, else the last part of the IRI."""
    last = F.substring_index(ident, ":", -1)
    return (F.when(F.coalesce(label, F.lit("")) != "", label)
            .when(F.contains(ident, F.lit(":")) & (last != "") & ~I.is_uri(ident), last)
            .when(I.iri_tail(ident) != "", I.iri_tail(ident)).otherwise(ident))


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """(id, size) of a forest (id, up): how many nodes a subtree has, its root included.

    Round k knows each node's ancestor 2^k above and the size of its subtree down to less than
    2^k below. What lies deeper is below a node 2^k further down, whose count is known as well:
    counts are summed per ancestor, in every task first. A row stays three values.
    """
    state, reach, total = cut(nodes.select("id", "up", F.lit(1).cast("long").alias("size"))), 1, None
    while not state.where("up IS NOT NULL").isEmpty():
        total = state.count() if total is None else total
        if reach > total:
            raise ValueError("the parent map has a cycle; break cycles first")
        deeper = state.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("_deeper"))
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_far"))
        state = cut(state.join(deeper, "id", "left").join(above, "up", "left").select(
            "id", F.col("_far").alias("up"), (F.col("size") + F.coalesce("_deeper", F.lit(0))).alias("size")))
        reach *= 2
    return state.select("id", "size")


def ancestor_sums(nodes: DataFrame, names: list[str]) -> DataFrame:
    """(id, …) of a forest (id, up, …): each named value summed over a node and its ancestors, in
    rounds that double the distance."""
    state = cut(nodes.select("id", "up", *names))
    while not state.where("up IS NOT NULL").isEmpty():
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_far"), *[F.col(n).alias(f"_{n}") for n in names])
        state = cut(state.join(above, "up", "left").select(
            "id", F.col("_far").alias("up"), *[(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in names]))
    return state.drop("up")


def ordered_hierarchy(entities: DataFrame, parent_map: DataFrame) -> DataFrame:
    """(id, level, place): places 1, 2, 3 … in depth-first order, siblings by sort key without
    regard to case.

    `entities` has (id, sort_key). A node stands one place after its parent, and further by the
    sizes of the subtrees of its earlier siblings: a running sum, so that neither the children of
    one parent nor a path are one value. Rounds grow with the logarithm of the depth, rows do not
    grow, and nothing is sorted as a whole. A map with a cycle is refused.
    """
    inside = entities.select(F.col("id").alias("parent"))
    parents = parent_map.join(inside, "parent", "left_semi").select(F.col("child").alias("id"), F.col("parent").alias("up"))
    nodes = cut(entities.join(parents, "id", "left").select("id", "up", F.lower("sort_key").alias("k"), F.lower("id").alias("i")))
    sized = nodes.join(subtree_sizes(nodes), "id")
    placed = running_sum(sized, ["up"], "k", F.col("size"), "_upto", ties=["i", "id"])
    steps = placed.select("id", "up", F.lit(1).cast("long").alias("level"), (F.col("_upto") - F.col("size") + 1).alias("place"))
    return ancestor_sums(steps, ["level", "place"]).select("id", F.col("level").cast("int").alias("level"), "place")


def most_specific_type(types: DataFrame, edges: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, type): the asserted type that is no direct super of another asserted type.

    If every type is, all count again. Ties by sort key. `keys` is (type, sort_key). The
    supers of the asserted types are compared with the types, so types are not paired.
    """
    supers = types.join(edges.select(F.col("child").alias("type"), F.col("parent").alias("sup")), "type")
    implied = supers.where(F.col("sup") != F.col("type")).select(
        "id", F.col("sup").alias("type")).distinct().withColumn("_implied", F.lit(1))
    rows = types.distinct().join(implied, ["id", "type"], "left").join(keys, "type", "left")
    key = F.struct(F.coalesce("_implied", F.lit(0)).alias("a"), F.lower("sort_key").alias("b"), F.col("type"))
    return rows.groupBy("id").agg(F.min_by("type", key).alias("type"))


def group_by_type(individuals: DataFrame, chosen: DataFrame, labels: DataFrame) -> DataFrame:
    """(type_label, id) rows, groups without regard to case; `Unknown` without a type.

    Groups stay rows: a group may hold a third of all individuals.
    """
    named = chosen.join(labels.select(F.col("id").alias("type"), "label"), "type", "left").select(
        "id", F.coalesce("label", "type").alias("type_label"))
    rows = individuals.select("id").join(named, "id", "left").withColumn(
        "type_label", F.coalesce("type_label", F.lit("Unknown")))
    shown = cut(rows.select("type_label").distinct().groupBy(F.lower("type_label").alias("_k")).agg(
        F.min("type_label").alias("shown")))
    return rows.withColumn("_k", F.lower("type_label")).join(shown, "_k").select(
        F.col("shown").alias("type_label"), "id")


def split_deprecated(entities: DataFrame, attributes: DataFrame, parent_map: DataFrame) -> DataFrame:
    """(id, deprecated, apart): deprecated terms stand apart unless they are someone's parent."""
    marked = attributes.where((F.col("prop") == "owl:deprecated")
                              & F.lower(F.regexp_extract("value", r'^"?([^"^]*)', 1)).isin("true", "1"))
    flagged = marked.select("id").distinct().withColumn("deprecated", F.lit(True))
    holders = parent_map.select(F.col("parent").alias("id")).distinct().withColumn("_holds", F.lit(True))
    out = entities.select("id").join(flagged, "id", "left").join(holders, "id", "left")
    deprecated = F.coalesce("deprecated", F.lit(False))
    return out.select("id", deprecated.alias("deprecated"),
                      (deprecated & F.col("_holds").isNull()).alias("apart"))


def import_order(imports: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, ontology, path): imports depth-first from each root; paths order ontologies.

    `imports` is (ontology, imported, pos). Paths are relaxed until none gets smaller; a
    path never visits an ontology twice.
    """
    state = cut(roots.select("root", F.col("root").alias("ontology"),
                             F.expr("cast(array() AS array<int>)").alias("path"),
                             F.array("root").alias("seen")))
    links = imports.select(F.col("ontology").alias("at"), "imported", F.col("pos").cast("int").alias("pos"))
    while True:
        longer = state.join(links, F.col("ontology") == F.col("at")).where(
            ~F.array_contains("seen", F.col("imported"))).select(
            "root", F.col("imported").alias("ontology"), F.concat("path", F.array("pos")).alias("path"),
            F.concat("seen", F.array("imported")).alias("seen"))
        best = state.unionByName(longer).groupBy("root", "ontology").agg(
            F.min("path").alias("path"), F.min_by("seen", "path").alias("seen"))
        before, state = state, cut(best)
        kept = before.select("root", "ontology", F.col("path").alias("_was"))
        if state.join(kept, ["root", "ontology"], "left").where(~F.col("path").eqNullSafe(F.col("_was"))).isEmpty():
            return state.select("root", "ontology", "path")


def import_label(labels: DataFrame, order: DataFrame) -> DataFrame:
    """(root, id, label, ontology): label by ontology order, property order, English first."""
    rank = F.lit(len(K.LABEL_PROPERTIES))
    for place, prop in reversed(list(enumerate(K.LABEL_PROPERTIES))):
        rank = F.when(F.col("prop") == prop, F.lit(place)).otherwise(rank)
    rows = labels.where(F.col("prop").isin(K.LABEL_PROPERTIES)).withColumn("_rank", rank)
    lang = F.coalesce("lang", F.lit(""))
    shown = F.when(lang != "", F.concat(F.lit('"'), "value", F.lit('"@'), lang)).otherwise(F.col("value"))
    key = F.struct("path", "_rank", (~F.startswith(F.lower(lang), F.lit("en"))).alias("c"), "ord")
    return rows.join(order, "ontology").groupBy("root", "id").agg(
        F.min_by(F.struct(shown.alias("label"), "ontology"), key).alias("b")).select(
        "root", "id", "b.label", "b.ontology")


def nary_clauses(axioms: DataFrame) -> DataFrame:
    """(keyword, clause): clauses of more than two members, sorted, without duplicates."""
    members = F.when(F.col("keyword").isin("DifferentIndividuals", "SameIndividual"),
                     F.array_distinct("members")).otherwise(F.col("members"))
    rows = axioms.withColumn("_m", members).where(F.size("_m") > 2)
    clause = F.concat("keyword", F.lit(" :: "), F.array_join(F.array_sort("_m"), ", "))
    return rows.select("keyword", clause.alias("clause")).distinct()


def extra_supers(supers: DataFrame, parent_map: DataFrame) -> DataFrame:
    """Super rows (child, parent) other than the chosen parent and the term itself."""
    return supers.where(F.col("parent") != F.col("child")).join(
        parent_map, ["child", "parent"], "left_anti")


def is_named(value: Column) -> Column:
    return value.rlike(r"^(<[^<>\s]+>|[A-Za-z_][-\w.]*:[-\w./]+|:[-\w./]+)$")


def general_axioms(axioms: DataFrame) -> DataFrame:
    """Axioms without a named term: subclass axioms with an anonymous subject, equivalences
    without any named member. `axioms` is (keyword, subject, members)."""
    anonymous = (F.col("keyword") == "SubClassOf") & ~is_named(F.col("subject"))
    unnamed = (F.col("keyword") == "EquivalentTo") & ~F.exists("members", is_named)
    return axioms.where(anonymous | unnamed)


def characteristics(flags: DataFrame) -> DataFrame:
    """(id, characteristics): property flags (id, flag) as one list in fixed order."""
    marks = [F.max(F.when(F.col("flag") == name, F.lit(name))) for name in K.CHARACTERISTICS]
    return flags.groupBy("id").agg(F.concat_ws(", ", *marks).alias("characteristics")).where(
        "characteristics <> ''")


LOGICAL = K.FRAME_KEYWORDS[:-1] + K.MISC_KEYWORDS


def metrics(attributes: DataFrame, by_source: bool = True) -> DataFrame:
    """Counts of kinds, axioms and logical axioms, per source with a total row, or in all."""
    def kind(name: str) -> Column:
        return F.count_if((F.col("prop") == "rdf:type") & (F.col("value") == name))

    logical = F.count_if(F.col("prop").isin(LOGICAL) & (F.trim("value") != ""))
    cols = [kind("owl:Class").alias("classes"), kind("owl:ObjectProperty").alias("object_properties"),
            kind("owl:DatatypeProperty").alias("data_properties"),
            kind("owl:AnnotationProperty").alias("annotation_properties"),
            kind("owl:NamedIndividual").alias("individuals"),
            F.count(F.lit(1)).alias("axioms"), logical.alias("logical_axioms")]
    if not by_source:
        return attributes.agg(*cols)
    return attributes.rollup("source").agg(*cols).withColumn("source", F.coalesce("source", F.lit("*")))


def signature(subjects: DataFrame, declared: DataFrame) -> DataFrame:
    """(subject_kind, kind, n): sizes of the buckets a subject's axioms can refer to.

    `subjects` is (kind), `declared` (id, kind). The names themselves are `declared` rows of
    a bucket's kind; they are not copied per subject.
    """
    rules = [(s, k) for s, kinds in K.REFERABLE_KINDS.items() for k in kinds]
    sizes = declared.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    frame = subjects.select(F.col("kind").alias("subject_kind")).distinct()
    pairs = F.lit(None)
    for s in K.REFERABLE_KINDS:
        pairs = F.when(F.col("subject_kind") == s, F.array(*[F.lit(k) for r, k in rules if r == s])
                       if K.REFERABLE_KINDS[s] else F.expr("cast(array() AS array<string>)")).otherwise(pairs)
    return frame.withColumn("kind", F.explode(pairs)).join(sizes, "kind", "left").select(
        "subject_kind", "kind", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def leaf_edges(rows: DataFrame) -> DataFrame:
    """(child, parent) from super rows whose value is bare names."""
    supers = rows.where(F.col("prop").isin(K.SUPER_SPELLINGS))
    return supers.select(F.col("id").alias("child"), F.explode(
        axiom_leaves(F.col("prop"), F.col("value"))).alias("parent"))
