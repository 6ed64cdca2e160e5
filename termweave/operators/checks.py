"""Quality checks. Each returns issues (check, severity, source, subject, row_ord, message).

Axiom checks read described rows: (source, subject, section, tag, value, row_ord), where
`section` is the id suffix of the section the term belongs to. Outlines and the index both
give such rows, so one check serves documents and corpora. `declared` has one row per id,
with the `scope` columns (["source"] per document, [] for the whole corpus).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave import constants as K
from termweave.functions import ident as I
from termweave.functions import text as X
from termweave.model import TERM_KEY
from termweave.operators.identifiers import to_bracketed_iri
from termweave.plans.cut import cut

ISSUE = ["check", "severity", "source", "subject", "row_ord", "message"]


def classify_severity(message: Column) -> Column:
    return (F.when(F.startswith(message, F.lit("ERROR")), "error")
            .when(F.startswith(message, F.lit("WARNING")), "warning").otherwise("info"))


def filter_issues(issues: DataFrame, level: str | None = None) -> DataFrame:
    """`error`: errors only; `warning`: errors and warnings; otherwise all."""
    kept = {"error": ["error"], "warning": ["error", "warning"]}.get(level or "")
    return issues.where(F.col("severity").isin(kept)) if kept else issues


def _issues(rows: DataFrame, check: str, message: Column, source: str = "source",
            subject: str | Column = "subject", row_ord: str = "row_ord") -> DataFrame:
    """Issues of the rows whose message is not NULL."""
    return rows.select(
        F.lit(check).alias("check"), message.alias("message"), F.col(source).alias("source"),
        (F.col(subject) if isinstance(subject, str) else subject).alias("subject"),
        F.col(row_ord).cast("long").alias("row_ord")).where("message IS NOT NULL").select(
        "check", classify_severity(F.col("message")).alias("severity"), "source", "subject",
        "row_ord", "message")


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# --- described rows -----------------------------------------------------------------

def section_suffix(rdf_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, suffix in K.SECTION_OF_TYPE.items():
        out = F.when(rdf_type == name, suffix).otherwise(out)
    return out


def _suffix_of_id(section_id: Column) -> Column:
    out = F.lit(None).cast("string")
    for suffix in K.SECTION_OF_TYPE.values():
        if suffix != "-ontology":
            out = F.when(F.endswith(section_id, F.lit(suffix)), suffix).otherwise(out)
    return out


def described_outline(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Authored rows inside an ontology and inside a resource section."""
    scope = nodes.where("in_ontology AND (in_section OR resourcedefs)").select(
        "doc", "node_id", F.col("uri").alias("subject"),
        _suffix_of_id(F.when(F.col("resourcedefs"), F.col("own_id")).otherwise(F.col("section_id")))
        .alias("section"))
    return rows.join(scope, ["doc", "node_id"]).select(
        F.col("doc").alias("source"), "subject", "section", "tag", "value",
        F.col("row_id").alias("row_ord"))


def described_index(attributes: DataFrame) -> DataFrame:
    """Attribute rows of the index with the section of their term's type."""
    types = cut(term_types(attributes).select(
        *TERM_KEY, section_suffix(F.col("rdf_type")).alias("section")))
    return attributes.where(F.col("prop") != "rdf:type").join(types, TERM_KEY, "left").select(
        "source", F.col("id").alias("subject"), "section", F.col("prop").alias("tag"), "value",
        F.col("ord").alias("row_ord"))


def term_types(attributes: DataFrame) -> DataFrame:
    """(id, source, data_source, rdf_type): the first asserted type per term."""
    return attributes.where(F.col("prop") == "rdf:type").groupBy(TERM_KEY).agg(
        F.min_by("value", F.struct("ord", "value")).alias("rdf_type"))


def declared_terms(types: DataFrame, scope: list[str]) -> DataFrame:
    """One row per id (and scope): its first type and the flags punning needs."""
    def has(*names: str) -> Column:
        return F.bool_or(F.coalesce(F.col("rdf_type").isin(*names), F.lit(False)))

    return cut(types.groupBy(*scope, "id").agg(
        F.min_by("rdf_type", F.struct("source", "rdf_type")).alias("rdf_type"),
        has("owl:Class").alias("is_class"), has("owl:NamedIndividual").alias("is_individual"),
        has("owl:ObjectProperty", "owl:DatatypeProperty").alias("is_property")))


def outline_types(nodes: DataFrame) -> DataFrame:
    return nodes.where("uri IS NOT NULL").select(
        F.col("doc").alias("source"), F.col("uri").alias("id"), "rdf_type")


# --- checks on headings -------------------------------------------------------------

def _unknown_prefix(nodes: DataFrame, col: str, prefixes: DataFrame) -> DataFrame:
    """`_unknown`: the id is a compact name whose prefix its document does not bind.

    A document without any prefix binds none and is reported by the prefix table check.
    """
    bound = prefixes.select("doc").distinct().withColumn("_bound", F.lit(True))
    resolved = to_bracketed_iri(nodes, col, prefixes, "_iri", noerror=True, keys=["doc"])
    return resolved.join(bound, "doc", "left").withColumn(
        "_unknown", F.col("_bound").isNotNull() & F.col(col).isNotNull() & F.col("_iri").isNull())


def check_identity(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    rows = nodes.where("in_ontology AND in_section AND NOT resourcedefs AND NOT tagged_nodeclare")
    rows = rows.withColumn("_id", X.entity_from_heading(F.col("title")))
    rows = _unknown_prefix(rows, "_id", prefixes)
    ahead = F.regexp_extract("title", r"^(.*) \([^()]+\)$", 1)
    label = F.when(ahead != "", ahead).otherwise(F.col("title"))
    odd = F.contains(label, F.lit('"')) & ~label.rlike(r'^"[^"]+"@[A-Za-z-]+$')
    message = (F.when(F.col("_id").isNull(), "ERROR: heading declares no identifier")
               .when(F.col("_unknown"), _text("ERROR: unknown prefix in identifier ", F.col("_id")))
               .when(odd, "WARNING: label has quotes but is not a \"text\"@lang literal"))
    return _issues(rows, "identity", message, "doc", "title", "node_id")


def check_header(nodes: DataFrame) -> DataFrame:
    rows = nodes.where("level = 1 AND context_type = 'ontology'")
    args = F.coalesce(F.col("props")["header-args:omn"], F.lit(""))
    own, name = F.coalesce("own_id", F.lit("")), F.col("own_localname")
    messages = F.array_compact(F.array(
        F.when(own == "", "ERROR: ontology heading has no ID"),
        F.when(F.col("own_id").isNotNull() & (name != F.col("own_id")),
               "WARNING: context local name differs from ID"),
        F.when(~args.rlike(r":tangle[ \t]+[^ \t:]+\.omn"), "ERROR: no output target"),
        F.when(~args.rlike(r":noweb[ \t]+yes(\s|$)"), "ERROR: noweb setting missing")))
    rows = rows.select("doc", "title", "node_id", F.explode(messages).alias("m"))
    return _issues(rows, "header", F.col("m"), "doc", "title", "node_id")


def check_prefix_table(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    rows = nodes.where("level = 1 AND context_type = 'ontology'").join(
        prefixes.select("doc"), "doc", "left_anti")
    return _issues(rows, "prefix-table", F.lit("ERROR: prefix table is missing or malformed"),
                   "doc", "title", "node_id")


def check_presence(nodes: DataFrame) -> DataFrame:
    found = (F.col("level") == 1) & (F.col("context_type") == "ontology")
    rows = nodes.groupBy("doc").agg(
        F.bool_or(F.coalesce(found, F.lit(False))).alias("_any"), F.min("node_id").alias("node_id"))
    message = F.when(~F.col("_any"), "ERROR: document has no ontology heading")
    return _issues(rows, "presence", message, "doc", "doc", "node_id")


def check_sections(nodes: DataFrame) -> DataFrame:
    """Each required section is looked up by its id; six rows per document, no product."""
    first = nodes.where("level = 1 AND context_type = 'ontology'").groupBy("doc").agg(
        F.min_by("own_localname", "node_id").alias("_name"), F.min("node_id").alias("_at"))
    wanted = first.where("_name IS NOT NULL").select(
        "doc", "_at", F.explode(F.array(*[F.concat("_name", F.lit(s)) for s in K.REQUIRED_SECTIONS]))
        .alias("section"))
    have = nodes.where("own_id IS NOT NULL").groupBy("doc", F.col("own_id").alias("section")).agg(
        F.max_by("resourcedefs", "node_id").alias("_flag"), F.max("node_id").alias("_node"))
    rows = wanted.join(have, ["doc", "section"], "left").withColumn("_row", F.coalesce("_node", "_at"))
    message = (F.when(F.col("_node").isNull(), _text("WARNING: missing section ", F.col("section")))
               .when(~F.col("_flag"), _text("WARNING: section lacks the resource flag ", F.col("section"))))
    return _issues(rows, "sections", message, "doc", "section", "_row")


def check_declaration(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    rows = nodes.where("own_id LIKE '%-ontology-declaration'").withColumn(
        "_id", I.first_id_token(X.entity_from_heading(F.col("title"))))
    rows = _unknown_prefix(rows, "_id", prefixes)
    message = (F.when(F.col("_id").isNull(), "ERROR: ontology declaration names no identifier")
               .when(F.col("_unknown"), _text("ERROR: unknown prefix in ontology identifier ", F.col("_id"))))
    return _issues(rows, "declaration", message, "doc", "title", "node_id")


# --- checks on rows -----------------------------------------------------------------

def check_annotation_props(rows: DataFrame, declared: DataFrame, scope: list[str]) -> DataFrame:
    used = rows.where(F.col("tag").rlike(K.AXIOM_CURIE) & ~F.col("tag").isin(K.KNOWN_ANNOTATIONS))
    known = declared.where(F.col("rdf_type") == "owl:AnnotationProperty").select(
        *scope, F.col("id").alias("tag"))
    return _issues(used.join(known, [*scope, "tag"], "left_anti"), "annotation-property",
                   _text("WARNING: not a declared annotation property: ", F.col("tag")))


def check_axiom_ids(rows: DataFrame, declared: DataFrame, scope: list[str]) -> DataFrame:
    """Undeclared names, annotation properties in axioms, unbalanced parentheses."""
    axioms = rows.where(F.col("tag").isin([k for k in K.ALL_KEYWORDS if k != "Import"]))
    words = axioms.withColumn("id", F.explode(X.axiom_words(F.col("value")))).where(
        ~F.col("id").isin(K.BUILTIN_NAMES))
    known = declared.select(*scope, "id", F.coalesce("rdf_type", F.lit("")).alias("_type"))
    found = words.join(known, [*scope, "id"], "left")
    outside = F.coalesce("section", F.lit("")) != "-annotation-property-hierarchy"
    message = (F.when(F.col("_type").isNull(), _text("WARNING: unknown name in axiom: ", F.col("id")))
               .when((F.col("_type") == "owl:AnnotationProperty") & outside,
                     _text("WARNING: annotation property used in axiom: ", F.col("id"))))
    unbalanced = F.when(~X.balanced_parentheses(F.col("value")),
                        "WARNING: unbalanced parentheses in axiom")
    return _issues(found, "axiom-names", message).unionByName(
        _issues(axioms, "axiom-names", unbalanced))


def allowed_keyword(section: Column, tag: Column) -> Column:
    out = F.lit(None).cast("boolean")
    for suffix, names in K.SECTION_KEYWORDS.items():
        out = F.when(section == suffix, tag.isin(names)).otherwise(out)
    return out


def check_keyword_section(rows: DataFrame) -> DataFrame:
    """Keywords their section does not allow; keywords that stand alone fit everywhere."""
    framed = rows.where(F.col("tag").isin(K.FRAME_KEYWORDS) & (F.col("section") != "-ontology"))
    message = F.when(~allowed_keyword(F.col("section"), F.col("tag")),
                     _text("ERROR: ", F.col("tag"), " is not valid in section ", F.col("section")))
    return _issues(framed, "keyword-section", message)


def expected_type(section: Column, tag: Column) -> Column:
    out = F.lit(None).cast("string")
    for suffix, kinds in K.VALUE_TYPES.items():
        for keyword, rdf_type in kinds.items():
            out = F.when((section == suffix) & (tag == keyword), rdf_type).otherwise(out)
    return out


def _kind_name(rdf_type: Column) -> Column:
    out = rdf_type
    for name, shown in K.KIND_NAMES.items():
        out = F.when(rdf_type == name, shown).otherwise(out)
    return out


def check_keyword_range(rows: DataFrame, declared: DataFrame, scope: list[str]) -> DataFrame:
    """Bare names of another kind than the keyword expects; undeclared ones are skipped."""
    wanted = rows.withColumn("_want", expected_type(F.col("section"), F.col("tag"))).where(
        "_want IS NOT NULL")
    leaves = wanted.withColumn("id", F.explode(X.axiom_leaves(F.col("tag"), F.col("value"))))
    found = leaves.join(declared.where("rdf_type IS NOT NULL").select(*scope, "id", "rdf_type"),
                        [*scope, "id"])
    builtin = (F.col("_want") == "rdfs:Datatype") & F.col("id").isin(K.BUILTIN_NAMES)
    message = F.when((F.col("rdf_type") != F.col("_want")) & ~builtin, _text(
        "WARNING: ", F.col("id"), " is of kind ", _kind_name(F.col("rdf_type")), " but ", F.col("tag"),
        " expects ", _kind_name(F.col("_want"))))
    return _issues(found, "keyword-range", message)


def check_facts_punning(rows: DataFrame, declared: DataFrame, scope: list[str]) -> DataFrame:
    used = rows.where(F.col("tag").isin("Facts", "SameAs", "DifferentFrom"))
    words = used.withColumn("id", F.explode(X.axiom_words(F.col("value"))))
    punned = declared.where("is_class AND NOT is_individual").select(*scope, "id", "is_property")
    found = words.join(punned, [*scope, "id"]).where(
        ~((F.col("tag") == "Facts") & F.col("is_property")))
    return _issues(found, "facts-punning", _text(
        "ERROR: class used as an individual without such a declaration: ", F.col("id")))


def check_punning(types: DataFrame) -> DataFrame:
    """One id with two property kinds, or class and datatype. `types` is (source, id, rdf_type)."""
    kinds = types.groupBy("source", "id").agg(
        F.countDistinct(F.when(F.col("rdf_type").isin(
            "owl:ObjectProperty", "owl:DatatypeProperty", "owl:AnnotationProperty"),
            F.col("rdf_type"))).alias("_props"),
        F.bool_or(F.col("rdf_type") == "owl:Class").alias("_class"),
        F.bool_or(F.col("rdf_type") == "rdfs:Datatype").alias("_data"))
    messages = F.array_compact(F.array(
        F.when(F.col("_props") > 1, "ERROR: declared with several property kinds"),
        F.when(F.col("_class") & F.col("_data"), "ERROR: declared as class and datatype")))
    rows = kinds.select("source", "id", F.lit(None).cast("long").alias("row_ord"),
                        F.explode(messages).alias("m"))
    return _issues(rows, "punning", F.col("m"), subject="id")


def check_nesting(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Direct children of a section whose super row names a heading of the document."""
    sections = nodes.where("level = 2 AND resourcedefs").select("doc", F.col("node_id").alias("parent_id"))
    direct = nodes.join(sections, ["doc", "parent_id"], "left_semi").select("doc", "node_id", "uri")
    named = r"^(?:<[^<>\s]+>|[A-Za-z_][-A-Za-z0-9_.]*:[-A-Za-z0-9_./]+)$"
    supers = rows.where(F.col("tag").isin("SubClassOf", "SubPropertyOf")
                        & F.col("parent_row_id").isNull() & F.col("value").rlike(named))
    declared = nodes.where("uri IS NOT NULL").select("doc", I.first_id_token(F.col("uri")).alias("value"))
    found = supers.join(direct, ["doc", "node_id"]).join(declared, ["doc", "value"], "left_semi")
    return _issues(found, "nesting", _text("WARNING: prefer nesting over ", F.col("tag"), " of ",
                                           F.col("value")), "doc", "uri", "row_id")


def check_blank_axiom(rows: DataFrame) -> DataFrame:
    blank = rows.where(F.col("tag").isin(K.ALL_KEYWORDS)
                       & (F.trim(F.coalesce("value", F.lit(""))) == ""))
    return _issues(blank, "blank-axiom", _text("WARNING: axiom row without value: ", F.col("tag")))


HEADING_NAME = r"\(([A-Za-z_][-A-Za-z0-9_.]*:[^) \t]+)\)"


def check_undocumented(nodes: DataFrame, rows: DataFrame, names: DataFrame) -> DataFrame:
    """Headings with a name but no authored documentation; a label is not enough.

    `names` is (source, name), what each document's ontology goes by. A term defined by
    another ontology is exempt.
    """
    terms = nodes.where(~F.col("nodeclare")).withColumn(
        "_name", F.regexp_extract("title", HEADING_NAME, 1)).where("_name <> ''")
    own = rows.where("parent_row_id IS NULL")
    documented = own.where(F.col("tag").isin(K.DOCUMENTATION_KEYS)).select("doc", "node_id")
    defined = own.where("tag = 'rdfs:isDefinedBy'").groupBy("doc", "node_id").agg(
        F.min_by("value", "row_id").alias("name"))
    by_name = names.select(F.col("source").alias("doc"), "name")
    foreign = defined.join(by_name, ["doc", "name"], "left_anti").join(
        by_name.select("doc"), "doc", "left_semi").select("doc", "node_id")
    bare = terms.join(documented.union(foreign), ["doc", "node_id"], "left_anti")
    return _issues(bare, "undocumented", F.lit("WARNING: term has no authored documentation"),
                   "doc", "_name", "node_id")


def check_recursive(rows: DataFrame) -> DataFrame:
    """Axiom values that mention their own subject."""
    subject = I.first_id_token(F.col("subject"))
    own = rows.where(F.col("tag").isin(K.RECURSION_KEYWORDS) & F.contains("subject", F.lit(":")))
    own = own.withColumn("subject", subject).where(X.mentions(F.col("value"), F.col("subject")))
    return _issues(own, "recursive", _text("WARNING: ", F.col("tag"), " mentions its own subject"))


def check_duplicate_labels(labels: DataFrame, scope: list[str]) -> DataFrame:
    """Label rows (source, subject, text, lang, row_ord) whose text and tag occur twice or more.

    Shared texts are counted, not gathered, so a label of a third of all terms is one row in
    the count; the rows that carry it then join that row.
    """
    key = [*scope, "text", "_lang"]
    rows = labels.where("text IS NOT NULL").withColumn("_lang", F.coalesce("lang", F.lit("")))
    shared = cut(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    found = rows.join(shared, key)
    return _issues(found, "duplicate-label", _text(
        "WARNING: label \"", F.col("text"), "\"", F.when(F.col("_lang") != "", F.concat(
            F.lit("@"), "_lang")).otherwise(""), " is shared by ", F.col("_n").cast("string"), " rows"))


def outline_labels(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Label rows of documents: authored ones, and the heading's unless it is among them."""
    terms = nodes.where("uri IS NOT NULL AND NOT nodeclare AND NOT resourcedefs")
    written = rows.where("tag = 'rdfs:label' AND parent_row_id IS NULL").select(
        "doc", "node_id", "value", F.col("row_id").alias("row_ord"))
    derived = terms.where(F.col("label") != F.col("uri")).select(
        "doc", "node_id", F.col("label").alias("value"), F.col("node_id").alias("row_ord"))
    derived = derived.join(written.select("doc", "node_id", "value"), ["doc", "node_id", "value"], "left_anti")
    both = derived.unionByName(written).join(terms.select("doc", "node_id", "uri"), ["doc", "node_id"])
    return both.select(F.col("doc").alias("source"), I.first_id_token(F.col("uri")).alias("subject"),
                       X.literal_text(F.col("value")).alias("text"),
                       X.literal_lang(F.col("value")).alias("lang"), "row_ord")


def index_labels(attributes: DataFrame) -> DataFrame:
    return attributes.where("prop = 'rdfs:label'").select(
        "source", F.col("id").alias("subject"), F.col("value").alias("text"), "lang",
        F.col("ord").alias("row_ord"))


FINDING = "struct<check:string,subject:string,message:string>"
PROBE = "struct<kind:string,id:string,want:string,punned:boolean>"


def row_issues(rows: DataFrame, declared: DataFrame, scope: list[str], recursive: bool = True) -> DataFrame:
    """All checks on described rows in one scan; the same issues as by the single checks.

    A row yields its findings, those it settles alone, and its probes, the names whose
    declaration decides. Both are written once; the probes then meet the declarations in one
    join, where each gives the issues of all checks that asked for the name.
    """
    tag, value, subject = F.col("tag"), F.col("value"), F.col("subject")

    def finding(check: str, test: Column, message: Column, of: Column = subject) -> Column:
        return F.when(test, F.struct(F.lit(check).alias("check"), of.alias("subject"), message.alias("message")))

    axiom = tag.isin([k for k in K.ALL_KEYWORDS if k != "Import"])
    alone = [
        finding("axiom-names", axiom & ~X.balanced_parentheses(value), F.lit("WARNING: unbalanced parentheses in axiom")),
        finding("keyword-section", tag.isin(K.FRAME_KEYWORDS) & (F.col("section") != "-ontology") & ~allowed_keyword(F.col("section"), tag),
                _text("ERROR: ", tag, " is not valid in section ", F.col("section"))),
        finding("blank-axiom", tag.isin(K.ALL_KEYWORDS) & (F.trim(F.coalesce(value, F.lit(""))) == ""),
                _text("WARNING: axiom row without value: ", tag))]
    if recursive:
        own = I.first_id_token(subject)
        alone.append(finding("recursive", tag.isin(K.RECURSION_KEYWORDS) & F.contains(subject, F.lit(":")) & X.mentions(value, own),
                             _text("WARNING: ", tag, " mentions its own subject"), own))

    def probe(kind: str, name: Column, want: Column, punned: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("id"), want.alias("want"), punned.alias("punned"))

    none, no = F.lit(None).cast("string"), F.lit(False)
    punned, want, empty = tag.isin("Facts", "SameAs", "DifferentFrom"), expected_type(F.col("section"), tag), F.lit(None).cast(f"array<{PROBE}>")
    probes = [
        F.when(axiom, F.transform(X.axiom_words(value), lambda w: probe("word", w, none, punned))).otherwise(empty),
        F.when(want.isNotNull(), F.transform(X.axiom_leaves(tag, value), lambda w: probe("leaf", w, want, no))).otherwise(empty),
        F.when(tag.rlike(K.AXIOM_CURIE) & ~tag.isin(K.KNOWN_ANNOTATIONS), F.array(probe("tag", tag, none, no))).otherwise(empty)]
    # A finding is a probe without a name, so that one pass writes both.
    as_probe = F.transform(F.array_compact(F.array(*alone)), lambda f: F.struct(
        f.alias("finding"), F.lit(None).cast(PROBE).alias("probe")))
    asked = F.transform(F.flatten(F.array_compact(F.array(*probes))), lambda p: F.struct(
        F.lit(None).cast(FINDING).alias("finding"), p.alias("probe")))
    keys = ["source", "subject", "section", "tag", "row_ord"]
    found = cut(rows.select(*keys, F.inline(F.concat(as_probe, asked))))
    settled = found.where("finding IS NOT NULL").select(
        "finding.check", "finding.message", "source", "finding.subject", "row_ord")

    known = declared.select(*scope, "id", F.coalesce("rdf_type", F.lit("")).alias("_type"), "is_class", "is_individual", "is_property")
    met = found.where("probe IS NOT NULL").select(*keys, "probe.*").join(known, [*scope, "id"], "left")
    kind, name, rdf_type = F.col("kind"), F.col("id"), F.col("_type")
    builtin = name.isin(K.BUILTIN_NAMES)
    note = rdf_type == "owl:AnnotationProperty"
    outside = F.coalesce("section", F.lit("")) != "-annotation-property-hierarchy"
    plain = (kind == "word") & ~builtin
    other = (kind == "leaf") & (rdf_type != "") & (rdf_type != F.col("want")) & ~((F.col("want") == "rdfs:Datatype") & builtin)
    as_individual = (kind == "word") & F.col("punned") & F.col("is_class") & ~F.col("is_individual") & ~(
        (tag == "Facts") & F.col("is_property"))
    decided = [
        finding("annotation-property", (kind == "tag") & ~F.coalesce(note, no), _text("WARNING: not a declared annotation property: ", name)),
        finding("axiom-names", plain & rdf_type.isNull(), _text("WARNING: unknown name in axiom: ", name)),
        finding("axiom-names", plain & note & outside, _text("WARNING: annotation property used in axiom: ", name)),
        finding("keyword-range", other, _text("WARNING: ", name, " is of kind ", _kind_name(rdf_type), " but ", tag,
                                              " expects ", _kind_name(F.col("want")))),
        finding("facts-punning", as_individual, _text("ERROR: class used as an individual without such a declaration: ", name))]
    named = met.select("source", "row_ord", F.explode(F.array_compact(F.array(*decided))).alias("f")).select(
        "f.check", "f.message", "source", "f.subject", "row_ord")
    return settled.unionByName(named).select(
        "check", classify_severity(F.col("message")).alias("severity"), "source", "subject",
        F.col("row_ord").cast("long").alias("row_ord"), "message")


def all_issues(nodes: DataFrame, rows: DataFrame, prefixes: DataFrame, names: DataFrame) -> DataFrame:
    """Every check over outline documents."""
    described, types = described_outline(nodes, rows), outline_types(nodes)
    scope = ["source"]
    declared = declared_terms(types, scope)
    awake = nodes.where("NOT nodeclare").select(F.col("doc").alias("source"), F.col("uri").alias("subject"))
    visible = described.join(awake.where("subject IS NOT NULL"), ["source", "subject"], "left_semi")
    return reduce(DataFrame.unionByName, [
        check_identity(nodes, prefixes), check_header(nodes), check_prefix_table(nodes, prefixes),
        check_presence(nodes), check_sections(nodes), check_declaration(nodes, prefixes),
        row_issues(described, declared, scope, recursive=False), check_punning(types), check_nesting(nodes, rows),
        check_undocumented(nodes, rows, names), check_recursive(visible),
        check_duplicate_labels(outline_labels(nodes, rows), scope)])


def index_issues(attributes: DataFrame, scope: list[str]) -> DataFrame:
    """The checks that need no headings, over an index."""
    described = described_index(attributes)
    types = attributes.where("prop = 'rdf:type'").select("source", "id", F.col("value").alias("rdf_type"))
    declared = declared_terms(types, scope)
    return reduce(DataFrame.unionByName, [
        row_issues(described, declared, scope), check_punning(types), check_duplicate_labels(index_labels(attributes), scope)])


def quality_report(issues: DataFrame) -> DataFrame:
    """(source, check, severity, n)."""
    return issues.groupBy("source", "check", "severity").agg(F.count(F.lit(1)).alias("n"))


def verdicts(sources: DataFrame, report: DataFrame) -> DataFrame:
    """(source, errors, warnings, verdict) for every source, also the clean ones."""
    def total(level: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("severity") == level, F.col("n"))), F.lit(0).cast("long"))

    sums = sources.select("source").distinct().join(report, "source", "left").groupBy("source").agg(
        total("error").alias("errors"), total("warning").alias("warnings"))
    return sums.withColumn("verdict", F.when(F.col("errors") > 0, "fail").when(
        F.col("warnings") > 0, "warn").otherwise("pass"))


def term_report(entities: DataFrame, attributes: DataFrame) -> DataFrame:
    """Missing label, missing definition, duplicate label, per source."""
    key = ["id", "source"]
    have = attributes.where(F.col("prop").isin("rdfs:label", "skos:definition")).groupBy(*key).agg(
        F.bool_or(F.col("prop") == "rdfs:label").alias("_label"),
        F.bool_or(F.col("prop") == "skos:definition").alias("_definition"))
    rows = entities.select(*key).distinct().join(have, key, "left").withColumn(
        "row_ord", F.lit(None).cast("long"))
    missing = F.array_compact(F.array(
        F.when(~F.coalesce("_label", F.lit(False)), F.struct(
            F.lit("missing-label").alias("c"), F.lit("ERROR: term has no label").alias("m"))),
        F.when(~F.coalesce("_definition", F.lit(False)), F.struct(
            F.lit("missing-definition").alias("c"), F.lit("WARNING: term has no definition").alias("m")))))
    gaps = rows.select(*key, "row_ord", F.inline(missing)).select(
        F.col("c").alias("check"), classify_severity(F.col("m")).alias("severity"), "source",
        F.col("id").alias("subject"), "row_ord", F.col("m").alias("message"))
    return gaps.unionByName(check_duplicate_labels(index_labels(attributes), ["source"]))


def legal_keywords(kinds: DataFrame) -> DataFrame:
    """(id, kind, keyword, operand, least, most): keywords a term of a kind may carry, what they
    take and how many; `most` is NULL where there is no greatest number."""
    rules = [(kind, keyword, *takes) for kind, of in K.OPERANDS.items() for keyword, takes in of.items()]
    table = kinds.sparkSession.createDataFrame(rules, "kind string, keyword string, operand string, least int, most int")
    return kinds.join(table, "kind").select(*kinds.columns, "keyword", "operand", "least", "most")


def existing_rows(attributes: DataFrame) -> DataFrame:
    """Authored rows of the terms, without what the index keeps for itself."""
    return attributes.where(~F.col("prop").isin(K.HOUSEKEEPING))


def leaves(rows: DataFrame) -> DataFrame:
    """(…, leaf) for each bare name of an axiom value."""
    return rows.withColumn("leaf", F.explode(X.axiom_leaves(F.col("tag"), F.col("value"))))
