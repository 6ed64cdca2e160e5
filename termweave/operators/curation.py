"""Bulk edits of outline tables: refusals first, then new tables and a change log.

Tables are `nodes` and `rows` of the outline source. Every operator returns its refusals;
nothing should be written while there are any.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave import constants as K
from termweave.functions import ident as I
from termweave.functions.pieces import applied_changes, occurrences, pieces, rewritten
from termweave.functions.text import heading_label, normal_space
from termweave.operators import checks as C
from termweave.operators.closure import MAX_ROUNDS, closure, cycle_nodes
from termweave.operators.identifiers import expand_with
from termweave.operators.inheritance import inherited
from termweave.operators.minting import mint_batch
from termweave.operators.taxonomy import immediate_parents
from termweave.plans.cut import cut
from termweave.plans.ordered import running_number, running_sum, running_values

STRICT_CURIE = r"^[A-Za-z_][A-Za-z0-9_-]*:[A-Za-z_][A-Za-z0-9_.-]*$"
CODE_LANGS = ["omn", "sparql"]


def declared(nodes: DataFrame) -> DataFrame:
    """(doc, node_id, id) of every declared term; a composite id counts by its first token."""
    return nodes.where("uri IS NOT NULL").select(
        "doc", "node_id", I.first_id_token(F.col("uri")).alias("id"))


def _refusal(rows: DataFrame, subject: str, reason: Column) -> DataFrame:
    return rows.select(F.col(subject).alias("id"), reason.alias("reason")).where("reason IS NOT NULL").distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# --- references ---------------------------------------------------------------------

def reference_scan(subjects: DataFrame, nodes: DataFrame, rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """(id, class, doc, holder, ord, keyword): every reference to the subjects.

    Classes: child (nested), axiom-child (a super row names it), axiom, annotation, code and
    prose. Rows of the subject itself are no references. Texts are cut into pieces once,
    whatever the number of subjects.
    """
    wanted = subjects.select("id").distinct()
    names = declared(nodes)
    below = names.join(nodes.select("doc", "node_id", "parent_id"), ["doc", "node_id"]).select(
        "doc", F.col("id").alias("holder"), F.col("node_id").alias("ord"), F.col("parent_id"))
    nested = below.join(names.select("doc", F.col("node_id").alias("parent_id"), "id"), ["doc", "parent_id"]).join(
        wanted, "id", "left_semi").select("id", F.lit("child").alias("class"), "doc", "holder", "ord",
                                          F.lit("").alias("keyword"))
    hits = occurrences(rows, ["doc", "node_id", "row_id", "tag"], "value", wanted).select(
        "id", "doc", "node_id", F.col("row_id").alias("ord"), F.col("tag").alias("keyword")).distinct()
    held = hits.join(names.withColumnRenamed("id", "holder"), ["doc", "node_id"]).where(
        F.col("holder") != F.col("id"))
    kind = (F.when(F.col("keyword").isin("SubClassOf", "SubPropertyOf"), "axiom-child")
            .when(F.col("keyword").isin(K.ALL_KEYWORDS), "axiom").otherwise("annotation"))
    in_rows = held.select("id", kind.alias("class"), "doc", "holder", "ord", "keyword")
    text = F.col("text")
    block = F.coalesce("block", F.lit(""))
    prose = (~F.col("is_heading") & (F.col("drawer") == "no") & (block == "")
             & ~text.rlike(r"^[ \t]*(\||#|:|$)") & ~text.rlike(r"^[ \t]"))
    code = block.isin(CODE_LANGS) & ~text.rlike(r"(?i)^[ \t]*#\+(begin|end)_")
    lines = parsed.where(prose | code).select(
        "doc", "ord", "text", F.when(code, "code").otherwise("prose").alias("class"))
    in_lines = occurrences(lines, ["doc", "ord", "class"], "text", wanted).select(
        "id", "class", "doc", F.lit(None).cast("string").alias("holder"), "ord",
        F.lit("").alias("keyword")).distinct()
    return _union([nested, in_rows, in_lines])


def reference_counts(references: DataFrame) -> DataFrame:
    return references.groupBy("id", "class").agg(F.count(F.lit(1)).alias("n"))


# --- renaming -----------------------------------------------------------------------

def rewrite_map(mapping: DataFrame, prefixes: DataFrame | None) -> DataFrame:
    """(id, new, is_iri): the compact names, and their full forms where prefixes are known."""
    plain = mapping.select(F.col("old").alias("id"), "new", F.lit(False).alias("is_iri"))
    if prefixes is None:
        return plain
    full = expand_with(expand_with(mapping, "old", prefixes, "_o"), "new", prefixes, "_n").where(
        "_o IS NOT NULL AND _n IS NOT NULL")
    return plain.unionByName(full.select(F.col("_o").alias("id"), F.col("_n").alias("new"),
                                         F.lit(True).alias("is_iri")))


def rewrite_column(frame: DataFrame, keys: list[str], col: str, changes: DataFrame) -> DataFrame:
    """The frame with whole-token names of `col` rewritten, and `_changed`: how many.

    A full IRI counts only in angles or between spaces. Only texts that hold a name are
    taken apart; their changes come back per text, as many as there are texts, so they are
    never broadcast.
    """
    hits = occurrences(frame.where(F.contains(F.col(col), F.lit(":"))), keys, col, changes, around=True)
    bounded = F.col("before").rlike(r"^[<\s]?$") & F.col("next").rlike(r"^[>\s]?$")
    hits = hits.where(~F.col("is_iri") | bounded)
    per_text = hits.groupBy(*keys).agg(F.collect_list(F.struct("at", "n", "new")).alias("_c"))
    p = pieces(F.col(col))
    return (frame.join(per_text.hint("merge"), keys, "left")
            .withColumn("_changed", F.when(F.col("_c").isNull(), 0).otherwise(applied_changes(p, F.col("_c"))))
            .withColumn(col, F.when(F.col("_c").isNull(), F.col(col)).otherwise(rewritten(p, F.col("_c"))))
            .drop("_c"))


def rename_terms(mapping: DataFrame, nodes: DataFrame, rows: DataFrame,
                 prefixes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and rows with every reference rewritten. Prose is left alone (see the scan).

    A node's `parent_uri` is the parent's `uri`, so it is rewritten like it.
    """
    changes = rewrite_map(mapping, prefixes)
    key = ["doc", "node_id"]
    named = nodes
    for col in ("title", "uri", "parent_uri"):
        named = rewrite_column(named, key, col, changes).drop("_changed")
    named = named.withColumn("label", heading_label(F.col("title"), F.col("uri"))).select(*nodes.columns)
    row_key = ["doc", "node_id", "row_id"]
    tagged = rewrite_column(rows, row_key, "tag", changes).drop("_changed")
    return named, rewrite_column(tagged, row_key, "value", changes).drop("_changed")


def rename_lines(mapping: DataFrame, parsed: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """Parsed lines with names rewritten in headings, rows and code blocks; not in prose."""
    text = F.col("text")
    block = F.coalesce("block", F.lit(""))
    rewritable = F.col("is_heading") | block.isin(CODE_LANGS) | ((block == "") & text.rlike(r"^[ \t]+-[ \t]"))
    changed = rewrite_column(parsed.where(rewritable), ["doc", "ord"], "text", rewrite_map(mapping, prefixes))
    kept = parsed.where(~rewritable).withColumn("_changed", F.lit(0))
    return changed.unionByName(kept.select(*changed.columns))


def rename_index(mapping: DataFrame, attributes: DataFrame) -> DataFrame:
    """Attribute rows with subjects and values rewritten, and `changed` per row."""
    subject = mapping.select(F.col("old").alias("id"), F.col("new").alias("_new"))
    keys = ["_subject", "source", "data_source", "prop", "ord", "value"]
    moved = attributes.withColumnRenamed("id", "_subject").withColumn("_text", F.col("value"))
    out = rewrite_column(moved, keys, "_text", rewrite_map(mapping, None)).withColumn(
        "value", F.col("_text")).withColumnRenamed("_subject", "id")
    return out.join(subject, "id", "left").withColumn("id", F.coalesce("_new", "id")).select(
        "id", "source", "data_source", "prop", "value", "lang", "ord", F.col("_changed").alias("changed"))


def rename_guard(mapping: DataFrame, names: DataFrame, prefixes: DataFrame, op: str = "rename") -> DataFrame:
    """Refusals (id, reason) of a mapping (old, new): nothing is renamed while there are any."""
    known = names.select("id").distinct()
    source, target = mapping.select(F.col("old").alias("id"), "new"), mapping.select(F.col("new").alias("id"))
    shape = _refusal(mapping, "old", F.when(
        ~F.col("old").rlike(STRICT_CURIE) | ~F.col("new").rlike(STRICT_CURIE), "malformed name"))
    unknown = _refusal(source.join(known, "id", "left_anti"), "id", F.lit("source is not declared"))
    if op == "merge":
        aim = _refusal(target.join(known, "id", "left_anti"), "id", F.lit("target is not declared"))
    else:
        aim = _refusal(target.join(known, "id", "left_semi"), "id", F.lit("target is already declared"))
    bound = prefixes.select(F.col("prefix").alias("_p")).distinct()
    unbound = _refusal(target.withColumn("_p", I.curie_prefix(F.col("id"))).join(bound, "_p", "left_anti"),
                       "id", F.lit("prefix has no namespace"))
    twice = _refusal(mapping.groupBy("old").agg(F.countDistinct("new").alias("_n")), "old",
                     F.when(F.col("_n") > 1, "source has several targets"))
    return _union([shape, unknown, aim, unbound, twice])


def relabel(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes whose declared label is replaced; `labels` is (id, new_label)."""
    new = labels.select(F.col("id").alias("_id"), "new_label")
    out = nodes.withColumn("_id", I.first_id_token(F.col("uri"))).join(new, "_id", "left")
    tail = F.regexp_extract("title", r"( \([^()]*\).*)$", 1)
    # A heading that is a bare name keeps it in parentheses.
    tail = F.when(tail == "", F.concat(F.lit(" ("), "uri", F.lit(")"))).otherwise(tail)
    return out.withColumn("title", F.when(F.col("new_label").isNotNull(), F.concat("new_label", tail))
                          .otherwise(F.col("title"))).withColumn(
        "label", F.coalesce("new_label", "label")).drop("_id", "new_label")


# --- removing -----------------------------------------------------------------------

def surviving_parents(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc, node_id, parent_id) of the nodes that stay; children of removed nodes climb.

    Removed nodes point to their parents; chains of removed nodes halve per round.
    """
    removed = nodes.join(gone.select("doc", "node_id"), ["doc", "node_id"], "left_semi")
    jump = cut(removed.select("doc", F.col("node_id").alias("at"), F.col("parent_id").alias("up")))
    for _ in range(MAX_ROUNDS):
        nxt = jump.select("doc", F.col("at").alias("up"), F.col("up").alias("far"), F.lit(True).alias("_hit"))
        longer = cut(jump.join(nxt, ["doc", "up"], "left").select(
            "doc", "at", F.when(F.col("_hit"), F.col("far")).otherwise(F.col("up")).alias("up"), "_hit"))
        jump = longer.drop("_hit")
        if longer.where("_hit").isEmpty():
            break
    else:
        raise ValueError("parents form a cycle")
    stay = nodes.join(gone.select("doc", "node_id"), ["doc", "node_id"], "left_anti")
    climb = jump.select("doc", F.col("at").alias("parent_id"), F.col("up").alias("_up"), F.lit(True).alias("_c"))
    return stay.join(climb, ["doc", "parent_id"], "left").select(
        "doc", "node_id", F.when(F.col("_c"), F.col("_up")).otherwise(F.col("parent_id")).alias("parent_id"))


def without_nodes(nodes: DataFrame, rows: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables without the removed nodes and their rows; children attach to what is above and
    inherit from there."""
    parents = surviving_parents(nodes, gone)
    kept = cut(nodes.drop("parent_id").join(parents, ["doc", "node_id"]).select(*nodes.columns))
    return inherited(kept, nodes), rows.join(gone.select("doc", "node_id"), ["doc", "node_id"], "left_anti")


def merge_terms(mapping: DataFrame, nodes: DataFrame, rows: DataFrame,
                prefixes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """References to `old` become `new`, the old headings go, their children climb."""
    gone = cut(declared(nodes).join(mapping.select(F.col("old").alias("id")), "id", "left_semi").select(
        "doc", "node_id"))
    left, left_rows = without_nodes(nodes, rows, gone)
    return rename_terms(mapping, left, left_rows, prefixes)


def subtree(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, doc, node_id): the terms' nodes and everything nested below."""
    edges = nodes.where("parent_id IS NOT NULL").select(
        F.concat_ws("\u001f", "doc", F.col("parent_id").cast("string")).alias("src"),
        F.concat_ws("\u001f", "doc", F.col("node_id").cast("string")).alias("dst"))
    heads = declared(nodes).join(ids.select("id").distinct(), "id", "left_semi").withColumn(
        "src", F.concat_ws("\u001f", "doc", F.col("node_id").cast("string")))
    below = closure(edges, 0, starts=heads)
    found = heads.select("id", "src").distinct().join(below, "src")
    return found.select("id", F.substring_index("dst", "\u001f", 1).alias("doc"),
                        F.substring_index("dst", "\u001f", -1).cast("long").alias("node_id")).distinct()


def is_descendant(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (id, other) with `below`: other lies in the subtree of id."""
    members = subtree(pairs, nodes).join(declared(nodes).withColumnRenamed("id", "other"), ["doc", "node_id"]).select(
        "id", "other", F.lit(True).alias("below")).where("id <> other").distinct()
    return pairs.join(members, ["id", "other"], "left").withColumn("below", F.coalesce("below", F.lit(False)))


def delete_terms(ids: DataFrame, cascade: str, nodes: DataFrame, rows: DataFrame,
                 parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, rows, refusals, notes) for cascade `refuse`, `reparent` or `delete`.

    Axiom and code references from terms that stay always refuse; annotation and prose
    mentions are only noted.
    """
    if cascade not in ("refuse", "reparent", "delete"):
        raise ValueError(f"unknown cascade {cascade!r}")
    wanted = ids.select("id").distinct()
    names = declared(nodes)
    own = names.join(wanted, "id", "left_semi")
    gone = cut((subtree(wanted, nodes) if cascade == "delete" else own).select("doc", "node_id").distinct())
    going = names.join(gone, ["doc", "node_id"], "left_semi").select("id").distinct()
    found = cut(reference_scan(going, nodes, rows, parsed))
    outside = found.join(going.select(F.col("id").alias("holder")), "holder", "left_anti")
    unknown = _refusal(wanted.join(names.select("id"), "id", "left_anti"), "id", F.lit("not declared"))
    dangling = _refusal(outside.where(F.col("class").isin("axiom", "code")), "id",
                        F.concat(F.lit("still referenced: "), F.col("class")))
    refusals = [unknown, dangling]
    held = outside.where(F.col("class").isin("child", "axiom-child"))
    if cascade == "refuse":
        refusals.append(_refusal(held, "id", F.lit("has children")))
    notes = outside.where(F.col("class").isin("annotation", "prose"))
    left, left_rows = without_nodes(nodes, rows, gone)
    return left, left_rows, _union(refusals), notes


# --- moving and folding -------------------------------------------------------------

def move_terms(moves: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, refusals) for moves (id, target): the term goes below the target, with all that
    is nested below it, and inherits from there.

    Refused: unknown or ambiguous names, another kind, the term itself, no change, several
    targets, a place below the term (also by several moves together), nesting of datatypes.
    Refused moves are not made, all others are. Moves that lead below the term itself are taken out
    until none does; in a document with a cycle of its own no move is made.
    """
    names = declared(nodes).join(nodes.select("doc", "node_id", "parent_id", "rdf_type"), ["doc", "node_id"])
    several = names.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.first("doc").alias("_doc"),
                                      F.min("node_id").alias("_node"), F.min("parent_id").alias("_up"),
                                      F.min("rdf_type").alias("_type"))
    a = several.select("id", *[F.col(c).alias("a" + c) for c in ("_n", "_doc", "_node", "_up", "_type")])
    b = several.select(F.col("id").alias("target"), *[F.col(c).alias("b" + c) for c in ("_n", "_doc", "_node", "_up", "_type")])
    asked = cut(moves.join(a, "id", "left").join(b, "target", "left"))
    reason = (F.when(F.col("a_n").isNull(), "source is not declared").when(F.col("a_n") > 1, "source is ambiguous")
              .when(F.col("id") == F.col("target"), "target is the term itself")
              .when(F.col("b_n").isNull(), "target is not declared").when(F.col("b_n") > 1, "target is ambiguous")
              .when(F.col("a_doc") != F.col("b_doc"), "target is in another document")
              .when(~F.col("a_type").eqNullSafe(F.col("b_type")), "target is of another kind")
              .when(F.col("a_type") == "rdfs:Datatype", "datatypes do not nest")
              .when(F.col("a_up") == F.col("b_node"), "already there"))
    refused = _refusal(asked, "id", reason)
    fine = asked.withColumn("_r", reason).where("_r IS NULL").select(
        F.col("a_doc").alias("doc"), F.col("a_node").alias("node_id"), F.col("b_node").alias("_to"), "id")
    twice = _refusal(fine.groupBy("id").agg(F.countDistinct("_to").alias("_k")), "id",
                     F.when(F.col("_k") > 1, "several targets"))
    one = fine.groupBy("doc", "node_id").agg(F.min("_to").alias("_to"), F.max("_to").alias("_l")).where("_to = _l").drop("_l")
    one, circular = cut(one), []
    key = [F.concat_ws("\u001f", "doc", F.col(c).cast("string")).alias(n) for c, n in (
        ("node_id", "child"), ("parent_id", "parent"))]

    def withheld(some: DataFrame, reason: str) -> DataFrame:
        some = cut(some.select("doc", "node_id"))
        circular.append(_refusal(fine.join(some, ["doc", "node_id"], "left_semi"), "id", F.lit(reason)))
        return cut(one.join(some, ["doc", "node_id"], "left_anti"))

    # A move that is taken out puts its term back, which can close a cycle with another move.
    while True:
        moved = nodes.join(one, ["doc", "node_id"], "left")
        moved = cut(moved.withColumn("parent_id", F.coalesce("_to", "parent_id")).select(*nodes.columns))
        loops = cut(cycle_nodes(moved.where("parent_id IS NOT NULL").select(*key)).select("child"))
        if loops.isEmpty():
            return inherited(moved, nodes), _union([refused, twice, *circular])
        looping = cut(one.select("doc", "node_id", key[0]).join(loops, "child", "left_semi"))
        if looping.isEmpty():
            break
        one = withheld(looping, "target lies below the term")
    # Cycles that no move is part of: such a document can't be inherited anew and stays as it was.
    held = cut(nodes.select("doc", key[0]).join(loops, "child", "left_semi").select("doc").distinct())
    withheld(one.join(held, "doc", "left_semi"), "document has a cycle")
    made = inherited(moved.join(held, "doc", "left_anti"), nodes.join(held, "doc", "left_anti"))
    made = made.unionByName(nodes.join(held, "doc", "left_semi"))
    return made, _union([refused, twice, *circular])


def fold_into_parent(ids: DataFrame, nodes: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mapping, refusals, dropped): merge each term (id, parent or NULL) into a parent.

    The parent must be the only immediate one, or the one named. `dropped` lists the
    term's own rows, which the fold does not keep. Apply the mapping with `merge_terms`.
    """
    above = immediate_parents(nodes, rows).select(I.first_id_token(F.col("uri")).alias("id"),
                                                  F.col("parent").alias("_p")).distinct()
    counts = above.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.min("_p").alias("_only"))
    named = above.select("id", F.col("_p").alias("parent"), F.lit(True).alias("_named")).distinct()
    asked = ids.join(counts, "id", "left").join(named, ["id", "parent"], "left")
    reason = (F.when(F.col("_n").isNull(), "no immediate parent")
              .when(F.col("parent").isNotNull() & F.col("_named").isNull(), "not an immediate parent")
              .when(F.col("parent").isNull() & (F.col("_n") > 1), "several immediate parents"))
    mapping = asked.withColumn("_r", reason).where("_r IS NULL").select(
        F.col("id").alias("old"), F.coalesce("parent", "_only").alias("new"))
    own = declared(nodes).join(mapping.select(F.col("old").alias("id")), "id", "left_semi")
    dropped = rows.where(~F.col("tag").isin("rdf:type", "rdfs:label") & F.col("parent_row_id").isNull()).join(
        own, ["doc", "node_id"]).select("id", "doc", "row_id", "tag", "value")
    return mapping, _refusal(asked, "id", reason), dropped


# --- row edits ----------------------------------------------------------------------

def edit_rows(edits: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of a batch of edits (edit_no, id, op, keyword, fragment, match).

    Rows of a term and keyword that no edit names stay as they are, and only the others are worked
    through; see `_worked_through`.
    """
    out, others, errors = _worked_through(edits, rows)
    left = out.where("coalesce(end, '') <> 'gone'").select(
        "id", "added", "row_id", "keyword", F.coalesce("_text", "value").alias("value"))
    return left.unionByName(others.select("id", F.lit(0).alias("added"), "row_id", "keyword", "value")), errors


def _worked_through(edits: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(worked, others, errors): rows that edits name and rows added, each with `end`, NULL where it
    is left alone and `gone` where it is deleted, and `_text`, its new value; then all other rows.

    `rows` is (id, row_id, keyword, value). Edits apply in order of edit_no: `add`;
    `replace` and `delete` of the one row of the keyword (whose value is `match`, when
    given, up to white space); `delete-empty` of all blank rows. None or several matches
    are an error, and errors are judged as if all edits before had worked. An edit that is an
    error changes no row; callers that void a batch with errors ask for them first.

    No edit is replayed. An edit without `match` leaves exactly its own row, so it opens a
    new segment of its (id, keyword); within a segment the rows of one value live by a
    running sum of what is added and taken. Values taken when the sum is one belong to the
    latest row added, which links each edit to the row it changes. All sides of the joins grow
    with the batch, so none is broadcast.
    """
    key = ["id", "keyword"]
    e = edits.withColumn("nf", normal_space(F.col("match"))).withColumn(
        "loose", F.col("op").isin("replace", "delete") & F.col("match").isNull())
    # A sweep empties the blank value of its keyword, or of all keywords of the term.
    pairs = rows.select(*key).union(e.where("keyword IS NOT NULL").select(*key)).distinct()
    sweeps = e.where("op = 'delete-empty'").withColumnRenamed("keyword", "_k").join(pairs, "id").where(
        F.col("_k").isNull() | (F.col("_k") == F.col("keyword"))).drop("_k")
    e = e.where("op <> 'delete-empty'").unionByName(sweeps)
    named = cut(e.select(*[F.col(c).alias("_" + c) for c in key]).distinct()).hint("merge")
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("keyword").eqNullSafe(F.col("_keyword"))
    others, rows = rows.join(named, same, "left_anti"), rows.join(named, same, "left_semi")
    e = running_sum(e, key, "edit_no", F.col("loose").cast("int"), "_seg")
    e = e.withColumn("seg", F.when(F.col("loose"), F.col("_seg") - 1).otherwise(F.col("_seg")))

    def event(frame: DataFrame, seg: Column, value: Column, at: Column, delta: int, token: Column) -> DataFrame:
        return frame.select(*key, seg.cast("long").alias("seg"), normal_space(value).alias("v"),
                            at.cast("long").alias("t"), F.lit(delta).alias("delta"), token.alias("token"),
                            F.lit(None).cast("long").alias("taker"))

    no = F.col("edit_no")
    own = F.concat(F.lit("e"), no.cast("string"))
    row_token = F.concat_ws("\u001f", F.lit("r"), "id", F.col("row_id").cast("string"))
    # Rows start before all edits.
    start = event(rows, F.lit(0), F.col("value"), F.shiftright("row_id", 2) - (1 << 61), 1, row_token)
    made = event(e.where("op = 'add' OR (op = 'replace' AND NOT loose)"), F.col("seg"), F.col("fragment"),
                 no * 2 + 1, 1, own)
    opened = event(e.where("op = 'replace' AND loose"), F.col("seg") + 1, F.col("fragment"), no * 2 + 1, 1, own)
    taken = event(e.where("op IN ('replace', 'delete') AND NOT loose"), F.col("seg"), F.col("nf"), no * 2, -1,
                  F.lit(None).cast("string")).withColumn("taker", F.shiftright("t", 1))
    marks = event(e.where("op = 'delete-empty'"), F.col("seg"), F.lit(""), no * 2, 0,
                  F.lit(None).cast("string"))
    live = [*key, "seg", "v"]
    events = running_sum(_union([start, made, opened, taken, marks]), live, "t", (F.col("delta") == 0).cast("int"),
                         "epoch", ties=["delta", "token"])
    before = running_values(events, [*live, "epoch"], "t", {"alive": F.col("delta")}, {"maker": F.col("token")},
                            ties=["delta", "token"])

    takers = before.where("taker IS NOT NULL")
    wrong = takers.where("alive <> 0").select(F.col("taker").alias("edit_no"), "alive")
    errors = wrong.select("edit_no", F.when(F.col("alive") < 0, "no matching row").otherwise(
        "several matching rows").alias("reason"))
    last = events.groupBy(*key, "seg", "v").agg(F.max("epoch").alias("epoch"))
    ends = events.join(last.hint("merge"), [*key, "seg", "v", "epoch"]).groupBy(*key, "seg", "v").agg(
        F.sum("delta").alias("n"), F.max_by("token", F.when(F.col("delta") == 1, F.struct("t", "token"))).alias("maker"))
    totals = ends.groupBy(*key, "seg").agg(F.sum("n").alias("total"),
                                           F.max_by("maker", "n").alias("maker"))
    loose = e.where("loose").select(*key, "seg", "edit_no", "op").join(totals.hint("merge"), [*key, "seg"], "left")
    errors = errors.unionByName(loose.where("coalesce(total, 0) <> 1").select("edit_no", F.when(
        F.coalesce("total", F.lit(0)) < 1, "no matching row").otherwise("several matching rows").alias("reason")))

    ops = e.select("edit_no", "op", "fragment")
    links = takers.select(F.col("taker").alias("edit_no"), "maker").unionByName(loose.select("edit_no", "maker"))
    links = links.join(errors.select("edit_no").hint("merge"), "edit_no", "left_anti").join(ops.hint("merge"), "edit_no").select(
        F.col("maker").alias("token"),
        F.when(F.col("op") == "replace", own).otherwise(F.lit("gone")).alias("next")).where("token IS NOT NULL")
    dead = events.where("delta = 1").join(last.withColumnRenamed("epoch", "_last").hint("merge"), [*key, "seg", "v"]).where(
        F.col("epoch") < F.col("_last")).select("token", F.lit("gone").alias("next")).join(
        links.select("token").hint("merge"), "token", "left_anti")
    final = _chain_ends(links.unionByName(dead).groupBy("token").agg(F.max("next").alias("next")))
    texts = e.select(own.alias("end"), F.col("fragment").alias("_text"))
    added = e.where("op = 'add'").select("id", no.alias("row_id"), "keyword", F.col("fragment").alias("value"),
                                         own.alias("token"), F.lit(1).alias("added"))
    base = rows.select("id", "row_id", "keyword", "value", row_token.alias("token"), F.lit(0).alias("added"))
    out = base.unionByName(added).join(final.hint("merge"), "token", "left").join(texts.hint("merge"), "end", "left")
    return out.select("id", "added", "row_id", "keyword", "value", "end", "_text"), others, errors


def _chain_ends(links: DataFrame) -> DataFrame:
    """(token, end): where each chain token -> next -> … ends, by pointer doubling."""
    state = cut(links.select("token", F.col("next").alias("end")))
    for _ in range(MAX_ROUNDS):
        nxt = state.select(F.col("token").alias("end"), F.col("end").alias("far"))
        longer = cut(state.join(nxt.hint("merge"), "end", "left").select("token", F.coalesce("far", "end").alias("end"), "far"))
        state = longer.select("token", "end")
        if longer.where("far IS NOT NULL").isEmpty():
            return state
    raise RuntimeError("edit chains did not end")


def sweep_empty_rows(rows: DataFrame, ids: DataFrame, keyword: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows without blank ones of the terms, and the keywords removed (id, keyword, row_id)."""
    blank = rows.where(F.trim(F.coalesce("value", F.lit(""))) == "")
    if keyword:
        blank = blank.where(F.col("keyword") == keyword)
    gone = blank.join(ids.select("id").distinct(), "id", "left_semi")
    left = rows.join(gone.select("id", "row_id"), ["id", "row_id"], "left_anti")
    return left, gone.select("id", "keyword", "row_id")


def check_edits(edits: DataFrame, rows: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(issues, errors): what a batch of edits would introduce, without keeping it.

    `types` is (source, id, rdf_type). Issues are compared without row places, as a bag. A row has
    its issues whatever the other rows are, so those of rows left alone are the same before and
    after and only rows that come or go are checked.
    """
    out, _others, errors = _worked_through(edits, rows)
    out = cut(out.where("added = 1 OR end IS NOT NULL"))
    come = out.where("coalesce(end, '') <> 'gone'").select("id", "keyword", F.coalesce("_text", "value").alias("value"))
    go = out.where("added = 0").select("id", "keyword", "value")
    declared_ = C.declared_terms(types, [])
    sections = types.groupBy("id").agg(F.min("rdf_type").alias("_t")).select(
        F.col("id").alias("subject"), C.section_suffix(F.col("_t")).alias("section"))

    def issues(frame: DataFrame) -> DataFrame:
        described = frame.select(F.lit("draft").alias("source"), F.col("id").alias("subject"),
                                 F.col("keyword").alias("tag"), "value", F.lit(None).cast("long").alias("row_ord"))
        described = described.join(sections, "subject", "left")
        return _union([C.check_axiom_ids(described, declared_, []), C.check_keyword_section(described),
                       C.check_keyword_range(described, declared_, []), C.check_blank_axiom(described)])

    return issues(come).exceptAll(issues(go)), errors


# --- adding -------------------------------------------------------------------------

NESTING_TYPES = ["owl:Class", "owl:ObjectProperty", "owl:DatatypeProperty", "owl:AnnotationProperty",
                 "owl:NamedIndividual"]


def insert_terms(wanted: DataFrame, nodes: DataFrame, scheme: str, prefix: str, child: bool = False,
                 **options) -> tuple[DataFrame, DataFrame]:
    """(new nodes, refusals) for (ord, anchor, label): siblings or children of the anchors.

    Ids are minted free of collisions with all declared ones. The rows of a new term start
    as blank rows of its anchor's keywords (`row_template`).
    """
    names = declared(nodes)
    at = names.join(nodes.select("doc", "node_id", "parent_id", "level", "rdf_type"), ["doc", "node_id"])
    first = at.groupBy("id").agg(F.min_by(F.struct("doc", "node_id", "parent_id", "level", "rdf_type"),
                                          F.struct("doc", "node_id")).alias("a"))
    asked = wanted.join(first, F.col("anchor") == F.col("id"), "left").drop("id")
    reason = F.when(F.col("a").isNull(), "anchor is not declared")
    if child:
        reason = reason.when(~F.coalesce(F.col("a.rdf_type").isin(NESTING_TYPES), F.lit(False)),
                             "terms of this kind do not nest")
    refusals = _refusal(asked, "anchor", reason)
    fine = asked.withColumn("_r", reason).where("_r IS NULL")
    ids = mint_batch(fine.select("ord", "label"), scheme, prefix, names, **options)
    parent = F.col("a.node_id") if child else F.col("a.parent_id")
    level = F.col("a.level") + 1 if child else F.col("a.level")
    return fine.join(ids, "ord").select(
        "ord", "id", "label", F.col("a.doc").alias("doc"), parent.alias("parent_id"), level.alias("level"),
        F.col("a.rdf_type").alias("rdf_type"), "anchor"), refusals


def with_inserted(new: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes with the new terms of `insert_terms`: each is the last below its parent, in the
    order of the request, and inherits from there. Their places follow all places of the
    document; the blank rows of `row_template` may be added below them.
    """
    places = nodes.select("doc", F.col("node_id").alias("p")).union(rows.select("doc", F.col("row_id").alias("p")))
    last = places.groupBy("doc").agg(F.max("p").alias("_last"))
    numbered = running_number(new, ["doc"], "ord", "_n").join(last, "doc")
    given = {"doc": F.col("doc"), "node_id": F.col("_last") + F.col("_n"), "parent_id": F.col("parent_id"), "uri": F.col("id"),
             "label": F.col("label"), "title": F.concat("label", F.lit(" ("), "id", F.lit(")")), "tags": F.array(),
             "resourcedefs": F.lit(False), "prefixdefs": F.lit(False), "tagged_nodeclare": F.lit(False),
             "props": F.map_from_arrays(F.array(), F.array())}
    added = numbered.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in nodes.schema])
    return inherited(cut(nodes.unionByName(added)), nodes)


def row_template(new: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, tag, value) blank rows of new terms: one per tag of the anchor, in its order."""
    names = declared(nodes).withColumnRenamed("id", "anchor")
    tags = rows.where("parent_row_id IS NULL").join(names, ["doc", "node_id"]).groupBy("anchor", "tag").agg(
        F.min("row_id").alias("ord"))
    return new.select("id", "anchor").join(tags, "anchor").select("id", "tag", F.lit("").alias("value"), "ord")


def insert_tree(paths: DataFrame, prefix: str, names: DataFrame) -> DataFrame:
    """(id, parent, label, level) for label paths (ord, path): each prefix of a path is a term.

    One table of path prefixes serves all levels; ids are slugs in order of first mention.
    """
    steps = paths.select("ord", F.posexplode("path").alias("at", "label"), "path").select(
        "ord", (F.col("at") + 1).alias("level"), "label",
        F.array_join(F.expr("slice(path, 1, at + 1)"), "\u001f").alias("key"),
        F.array_join(F.expr("slice(path, 1, at)"), "\u001f").alias("up"))
    first = steps.groupBy("key").agg(
        F.min("ord").alias("_first"), F.first("label").alias("label"), F.first("up").alias("up"), F.first("level").alias("level"))
    first = running_number(first, [], "_first", "ord", ties=["level"]).drop("_first")
    ids = cut(first.join(mint_batch(first.select("ord", "label"), "slug", prefix, names), "ord"))
    parents = ids.select(F.col("key").alias("up"), F.col("id").alias("parent"))
    return ids.join(parents, "up", "left").select("id", "parent", "label", "level")


def declare_terms(terms: DataFrame, names: DataFrame, prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refusals) for external terms (id, label, parent) to declare as they are."""
    known = names.select("id").distinct()
    flagged = (terms.join(known.withColumn("_known", F.lit(True)), "id", "left")
               .join(known.select(F.col("id").alias("parent"), F.lit(True).alias("_up")), "parent", "left")
               .withColumn("_p", I.curie_prefix(F.col("id")))
               .join(prefixes.select(F.col("prefix").alias("_p")).distinct().withColumn("_b", F.lit(True)), "_p", "left"))
    counts = terms.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    flagged = flagged.join(counts, "id")
    reason = (F.when(~F.col("id").rlike(STRICT_CURIE), "malformed name").when(F.col("_known"), "already declared")
              .when(F.col("_n") > 1, "declared twice in the batch").when(F.col("_b").isNull(), "prefix has no namespace")
              .when(F.col("parent").isNotNull() & F.col("_up").isNull(), "parent is not declared"))
    accepted = flagged.withColumn("_r", reason).where("_r IS NULL").select("id", "label", "parent")
    return accepted, _refusal(flagged, "id", reason)


def repair_sections(nodes: DataFrame) -> DataFrame:
    """(doc, node_id, own_id, resourcedefs, prefixdefs) of level-2 headings that need repair.

    The first heading of each well-known name gets the section id of its ontology and the
    resource flag; prefix headings get the prefix flag.
    """
    suffix = F.lit(None).cast("string")
    for title, tail in K.SECTION_TITLES.items():
        suffix = F.when(F.lower("title") == title.lower(), tail).otherwise(suffix)
    level2 = nodes.where("level = 2").withColumn("_s", suffix)
    first = level2.where("_s IS NOT NULL").groupBy("doc", "_s").agg(F.min("node_id").alias("node_id"))
    named = level2.join(first, ["doc", "_s", "node_id"]).select(
        "doc", "node_id", F.coalesce("own_id", F.concat(F.coalesce("localname", "inherited_id"), "_s")).alias("new_id"),
        F.lit(True).alias("new_flag"), "own_id", "resourcedefs", F.col("prefixdefs").alias("new_prefix"), "prefixdefs")
    heads = level2.where("title LIKE 'Prefixes%'").select(
        "doc", "node_id", F.col("own_id").alias("new_id"), F.col("resourcedefs").alias("new_flag"), "own_id",
        "resourcedefs", F.lit(True).alias("new_prefix"), "prefixdefs")
    changed = ~F.col("new_id").eqNullSafe(F.col("own_id")) | (F.col("new_flag") != F.col("resourcedefs")) | (
        F.col("new_prefix") != F.col("prefixdefs"))
    return named.unionByName(heads).where(changed).select(
        "doc", "node_id", F.col("new_id").alias("own_id"), F.col("new_flag").alias("resourcedefs"),
        F.col("new_prefix").alias("prefixdefs"))


# --- comparing ----------------------------------------------------------------------

def diff(baseline: DataFrame, current: DataFrame, cols: list[str], labels: DataFrame | None = None) -> DataFrame:
    """(side, cols…, label): rows only in the baseline or only in the current version, as bags."""
    old, new = baseline.select(*cols), current.select(*cols)
    out = old.exceptAll(new).withColumn("side", F.lit("removed")).unionByName(
        new.exceptAll(old).withColumn("side", F.lit("added")))
    return out if labels is None else out.join(labels.select("id", "label"), "id", "left")


def diff_status(baseline: DataFrame, current: DataFrame, cols: list[str], key: str) -> DataFrame:
    """(key, removed, added, status) per ontology; `identical` when nothing differs."""
    sides = diff(baseline, current, cols)
    everyone = baseline.select(key).union(current.select(key)).distinct()
    counts = sides.groupBy(key).agg(F.count_if(F.col("side") == "removed").alias("removed"),
                                    F.count_if(F.col("side") == "added").alias("added"))
    zero = F.lit(0).cast("long")
    return everyone.join(counts, key, "left").select(
        key, F.coalesce("removed", zero).alias("removed"), F.coalesce("added", zero).alias("added"),
        F.when(F.coalesce(F.col("removed") + F.col("added"), zero) == 0, "identical").otherwise("different").alias("status"))
