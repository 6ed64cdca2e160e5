"""Graph patterns over triples as joins. Solutions are DataFrames with a column per variable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.model import literal_table
from termweave.operators.closure import closure

# Axiom keywords and the RDF properties they stand for.
SPELLINGS = {"SubClassOf": "rdfs:subClassOf", "SubPropertyOf": "rdfs:subPropertyOf",
             "Types": "rdf:type"}

Pattern = tuple[str, str, str]


def triples(rows: DataFrame) -> DataFrame:
    """Attribute rows as a set of (s, p, o, o_kind, lang, source). The kind follows from the value,
    so it is told once rows are distinct, and only where it is asked for."""
    prop = F.col("prop")
    for keyword, spelled in SPELLINGS.items():
        prop = F.when(F.col("prop") == keyword, spelled).otherwise(prop)
    node = r"^(<[^<>\s]+>|https?://\S+|([A-Za-z_][-\w.]*)?:[A-Za-z_][-\w./]*)$"
    kind = (F.when(F.startswith("value", F.lit("_:")), "blank")
            .when(F.col("value").rlike(node), "iri").otherwise("literal"))
    distinct = rows.select(F.col("id").alias("s"), prop.alias("p"), "value",
                           F.coalesce("lang", F.lit("")).alias("lang"), "source").distinct()
    return distinct.select("s", "p", F.col("value").alias("o"), kind.alias("o_kind"), "lang", "source")


def _variables(pattern: Pattern) -> list[str]:
    return list(dict.fromkeys(t[1:] for t in pattern if t.startswith("?")))


def _scan(graph: DataFrame, pattern: Pattern, detail: bool) -> DataFrame:
    """Solutions of one pattern: constants filter the scan, variables name its columns."""
    out, names = graph, {}
    for place, term in zip(("s", "p", "o"), pattern):
        if not term.startswith("?"):
            out = out.where(F.col(place) == term)
        elif term[1:] in names:
            out = out.where(F.col(place) == F.col(names[term[1:]]))
        else:
            names[term[1:]] = place
    cols = [F.col(place).alias(name) for name, place in names.items()]
    if detail and pattern[2].startswith("?"):
        cols += [F.col("o_kind").alias(f"{pattern[2][1:]}_kind"),
                 F.col("lang").alias(f"{pattern[2][1:]}_lang")]
    return out.select(*cols)


def match(graph: DataFrame, patterns: list[Pattern], detail: bool = False) -> DataFrame:
    """Basic graph pattern: patterns join on the variables they share.

    Patterns are taken in an order in which each shares a variable with those before it, so
    no product of unrelated solutions arises; patterns that cannot be connected are refused.
    `detail` adds `<o>_kind` and `<o>_lang` for object variables.
    """
    left = list(patterns)
    first = left.pop(0)
    out, bound = _scan(graph, first, detail), set(_variables(first))
    while left:
        nxt = next((p for p in left if not _variables(p) or bound & set(_variables(p))), None)
        if nxt is None:
            raise ValueError("patterns share no variable; join them by a value first")
        left.remove(nxt)
        found, shared = _scan(graph, nxt, detail), sorted(bound & set(_variables(nxt)))
        if not _variables(nxt):
            present = found.limit(1).agg((F.count(F.lit(1)) > 0).alias("c")).scalar()
            out = out.where(present)
            continue
        out = out.join(found, shared)
        bound |= set(_variables(nxt))
    return out


def _shared(left: DataFrame, right: DataFrame) -> list[str]:
    names = [c for c in left.columns if c in right.columns]
    if not names:
        raise ValueError("solutions share no variable")
    return names


def optional(solutions: DataFrame, found: DataFrame) -> DataFrame:
    return solutions.join(found, _shared(solutions, found), "left")


def exists(solutions: DataFrame, found: DataFrame) -> DataFrame:
    """Both sides grow with the graph, so neither is broadcast."""
    return solutions.join(found.hint("merge"), _shared(solutions, found), "left_semi")


def not_exists(solutions: DataFrame, found: DataFrame) -> DataFrame:
    return solutions.join(found.hint("merge"), _shared(solutions, found), "left_anti")


def exists_flag(solutions: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Solutions with a boolean column instead of a filter."""
    on = _shared(solutions, found)
    return (solutions.join(found.select(on).distinct().withColumn(name, F.lit(True)), on, "left")
            .withColumn(name, F.coalesce(name, F.lit(False))))


def values(solutions: DataFrame, var: str, items: list[str]) -> DataFrame:
    """Inline bindings of a bound variable."""
    bindings = literal_table(solutions.sparkSession, [(i,) for i in items], [var])
    return solutions.join(bindings, var, "left_semi")


def is_iri(var: str) -> Column:
    return F.col(f"{var}_kind") == "iri"


def is_blank(var: str) -> Column:
    return F.col(f"{var}_kind") == "blank"


def lang_in(var: str, tags: list[str]) -> Column:
    return F.col(f"{var}_lang").isin(tags)


def count_by(keys: DataFrame, found: DataFrame, var: str, name: str = "n") -> DataFrame:
    """Count of `var` per key row, zero included. Counts meet the keys, not the solutions."""
    on = _shared(keys, found)
    counts = found.groupBy(on).agg(F.count(var).alias(name))
    return keys.join(counts, on, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def concat_by(solutions: DataFrame, key: str, parts: list[str], sep: str = ";;",
              name: str = "text") -> DataFrame:
    """Distinct joined parts per key as one text, in order. Duplicates go before grouping."""
    rows = solutions.select(key, F.concat_ws(sep, *parts).alias("_t")).distinct()
    return rows.groupBy(key).agg(
        F.array_join(F.sort_array(F.collect_list("_t")), sep).alias(name))


def top(solutions: DataFrame, order: list[Column | str], limit: int) -> DataFrame:
    return solutions.distinct().orderBy(*order).limit(limit)


def construct(solutions: DataFrame, template: list[Pattern]) -> DataFrame:
    """New triples (s, p, o); a triple with an unbound part is dropped, the result is a set."""
    def term(t: str) -> Column:
        return F.col(t[1:]) if t.startswith("?") else F.lit(t)

    rows = [F.struct(term(s).alias("s"), term(p).alias("p"), term(o).alias("o")) for s, p, o in template]
    return (solutions.select(F.inline(F.array(*rows)))
            .where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").distinct())


def path(graph: DataFrame, prop: str, kind: str = "+") -> DataFrame:
    """(s, o) along one or more (`+`) or any number (`*`) of steps of a property."""
    edges = graph.where(F.col("p") == prop).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    return closure(edges, 0 if kind == "*" else 1).select(
        F.col("src").alias("s"), F.col("dst").alias("o"))


def ask(solutions: DataFrame) -> DataFrame:
    return solutions.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))


def restrictions(graph: DataFrame) -> DataFrame:
    """(cls, property, quantifier, filler) through restriction nodes."""
    node = match(graph, [("?cls", "rdfs:subClassOf", "?r"), ("?r", "owl:onProperty", "?property")])
    fillers = graph.where(F.col("p").isin("owl:someValuesFrom", "owl:allValuesFrom", "owl:hasValue")).select(
        F.col("s").alias("r"), F.col("p").alias("quantifier"), F.col("o").alias("filler"))
    return node.join(fillers, "r").select("cls", "property", "quantifier", "filler")


# Properties harvested beside a label.
HARVESTED = ["rdf:type", "skos:definition", "rdfs:comment", "skos:prefLabel", "skos:altLabel",
             "iof-av:naturalLanguageDefinition"]


def label_harvest(graph: DataFrame, keep: Column | None = None, limit: int | None = None) -> DataFrame:
    """(s, label, plist): untagged or English labels of IRI subjects with their properties."""
    subjects = graph.where((F.col("p") == "rdfs:label") & F.col("lang").isin("", "en")
                           & ~F.startswith("s", F.lit("_:")))
    if keep is not None:
        subjects = subjects.where(keep)
    labels = subjects.select("s", F.col("o").alias("label")).distinct()
    props = graph.where(F.col("p").isin(HARVESTED) & (F.col("o_kind") != "blank")
                        & F.col("lang").isin("", "en")).join(labels.select("s"), "s", "left_semi")
    out = labels.join(concat_by(props, "s", ["p", "o"], name="plist"), "s", "left")
    return out if limit is None else top(out, ["s", "label"], limit)
