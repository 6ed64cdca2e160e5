"""The driver's tables read as a term index, axioms, edges and texts.

Every rule is a projection of whole tables, so the same SQL can restate it.
"""

from __future__ import annotations

from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave import constants as K
from termweave.functions.ident import id_kind
from termweave.model import Index, literal_table
from termweave.plans.cut import stored

DATA = "http://data.example.org/"
SOURCES = ["geo", "part", "sales", "supply"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _kept(build):
    """Store the lifted table on first use: an index is a set of stored tables."""
    @wraps(build)
    def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stored(spark, f"{build.__name__}:{sf_dir}", lambda: build(spark, sf_dir))
    return kept


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _entity(ident: Column, label: Column, source: str) -> list[Column]:
    return [ident.alias("id"), label.cast("string").alias("label"),
            F.lit(source).alias("source"), F.lit("").alias("data_source")]


def _term(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


@_kept
def entities(spark: SparkSession, sf: str) -> DataFrame:
    part, nation, region = (read(spark, sf, t) for t in ("part", "nation", "region"))
    supplier, customer = read(spark, sf, "supplier"), read(spark, sf, "customer")
    fixed = literal_table(
        spark,
        [(f"ont:{s} ont:{s}/1.0", f"Ontology {s}", s) for s in SOURCES]
        + [("ex:suppliedBy", "supplied by", "part"), ("ex:note", "note", "part")],
        ["id", "label", "source"],
    ).select("id", "label", "source", F.lit("").alias("data_source"))
    with_suppliers = nation.join(
        supplier.select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi")
    with_customers = nation.join(
        customer.select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi")
    frames = [
        part.select(_entity(_term("part:P", "p_partkey"),
                            F.when(F.col("p_partkey") % 97 != 0, F.col("p_name")), "part")),
        nation.select(_entity(_term("nation:N", "n_nationkey"), F.col("n_name"), "geo")),
        region.select(_entity(_term("region:R", "r_regionkey"), F.col("r_name"), "geo")),
        supplier.select(_entity(_term("supplier:S", "s_suppkey"), F.col("s_name"), "supply")),
        with_suppliers.select(_entity(_term("nation:N", "n_nationkey"),
                                      F.concat(F.lit("S "), "n_name"), "supply")),
        customer.select(_entity(_term("customer:C", "c_custkey"), F.col("c_name"), "sales")),
        with_customers.select(_entity(_term("nation:N", "n_nationkey"),
                                      F.concat(F.lit("C "), "n_name"), "sales")),
        fixed,
    ]
    return _union(frames).withColumn("kind", id_kind(F.col("id")))


def _rows(frame: DataFrame, ident: Column, source: str,
          cells: list[tuple[int, str, Column, Column | None, Column | None]]) -> DataFrame:
    """Attribute rows of one table; ord is the cell's place."""
    structs = []
    for seq, prop, value, lang, keep in cells:
        cell = F.struct(F.lit(prop).alias("prop"), value.cast("string").alias("value"),
                        (F.lit("") if lang is None else lang).alias("lang"),
                        F.lit(seq).cast("long").alias("ord"))
        structs.append(cell if keep is None else F.when(keep, cell))
    return frame.select(
        ident.alias("id"), F.lit(source).alias("source"), F.lit("").alias("data_source"),
        F.inline(F.array_compact(F.array(*structs))))


@_kept
def attributes(spark: SparkSession, sf: str) -> DataFrame:
    part, nation, region = (read(spark, sf, t) for t in ("part", "nation", "region"))
    supplier, customer = read(spark, sf, "supplier"), read(spark, sf, "customer")
    key, individual = F.col("p_partkey"), F.lit("owl:NamedIndividual")
    tags = F.array(*[F.lit(t) for t in ("", "en", "de", "ko")])

    def tag(shift: int) -> Column:
        return F.element_at(tags, ((key + shift) % 4 + 1).cast("int"))

    with_suppliers = nation.join(
        supplier.select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi")
    with_customers = nation.join(
        customer.select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi")
    fixed = literal_table(
        spark,
        [(f"ont:{s} ont:{s}/1.0", s, "rdf:type", "owl:Ontology", 0) for s in SOURCES]
        + [(f"ont:{s} ont:{s}/1.0", s, "dcterms:title", f"The {s} terms", 1) for s in SOURCES]
        + [("ex:suppliedBy", "part", "rdf:type", "owl:ObjectProperty", 0),
           ("ex:note", "part", "rdf:type", "owl:AnnotationProperty", 0)],
        ["id", "source", "prop", "value", "ord"],
    ).select("id", "source", F.lit("").alias("data_source"), "prop", "value",
             F.lit("").alias("lang"), F.col("ord").cast("long"))
    frames = [
        _rows(part, _term("part:P", "p_partkey"), "part", [
            (0, "rdf:type", individual, None, None),
            (1, "rdfs:label", F.col("p_name"), tag(0), key % 7 != 0),
            (2, "rdfs:label", F.concat("p_name", F.lit(" v2")), tag(1),
             (key % 3 == 0) & (key % 7 != 0)),
            (3, "Types", F.concat(F.lit("ptype:"), "p_type"), None, None),
            (4, "ex:brand", F.col("p_brand"), None, None),
            (5, "ex:size", F.col("p_size"), None, None),
            (6, "skos:definition",
             F.concat(F.lit("A "), "p_name", F.lit(" of size "), F.col("p_size").cast("string")),
             None, key % 5 != 0)]),
        _rows(nation, _term("nation:N", "n_nationkey"), "geo", [
            (0, "rdf:type", F.lit("owl:Class"), None, None),
            (1, "SubClassOf", _term("region:R", "n_regionkey"), None, None)]),
        _rows(region, _term("region:R", "r_regionkey"), "geo", [
            (0, "rdf:type", F.lit("owl:Class"), None, None)]),
        _rows(supplier, _term("supplier:S", "s_suppkey"), "supply", [
            (0, "rdf:type", individual, None, None),
            (1, "Types", _term("nation:N", "s_nationkey"), None, None),
            (2, "SameAs", _term("nation:N", "s_nationkey"), None, F.col("s_suppkey") % 9 == 0)]),
        _rows(with_suppliers, _term("nation:N", "n_nationkey"), "supply", [
            (0, "rdf:type", F.lit("owl:Class"), None, None),
            (1, "rdfs:label", F.concat(F.lit("S "), "n_name"), F.lit("en"), None)]),
        _rows(customer, _term("customer:C", "c_custkey"), "sales", [
            (0, "rdf:type", individual, None, None),
            (1, "Types", _term("nation:N", "c_nationkey"), None, None),
            (2, "ex:segment", F.col("c_mktsegment"), None, None)]),
        _rows(with_customers, _term("nation:N", "n_nationkey"), "sales", [
            (0, "rdf:type", F.lit("owl:Class"), None, None)]),
        fixed,
    ]
    return _union(frames)


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The order lines, dealt by order: the given file is a single row group, so one task reads it."""
    return read(spark, sf, "lineitem").repartition("l_orderkey", "l_linenumber")


@_kept
def axioms(spark: SparkSession, sf: str) -> DataFrame:
    """One or more axiom rows per order line, as attribute rows of source `part`."""
    line = order_lines(spark, sf)
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    supplier = _term("supplier:S", "l_suppkey")
    fact = (
        F.when(F.col("l_linenumber") == 7, F.concat(F.lit("ex:shippedBy "), supplier))
        .when((F.col("l_linenumber") == 6) & (supp % 10 == 0), F.concat(F.lit("ex:note "), supplier))
        .when(supp % 33 == 0, F.concat(F.lit("ex:suppliedBy ("), supplier))
        .otherwise(F.concat(F.lit("ex:suppliedBy "), supplier)))
    # A place that follows order, line and supplier; unique within a part.
    place = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + supp

    def cell(prop: str, value: Column) -> Column:
        return F.struct(F.lit(prop).alias("prop"), value.alias("value"))

    ident = _term("part:P", "l_partkey")
    cells = F.array(
        cell("Facts", fact),
        F.when(part % 50 == 0, cell("Domain", F.lit("region:R1"))),
        F.when(part % 70 == 0, cell("Facts", F.lit(""))),
        F.when(part % 90 == 0, cell("SubClassOf", F.concat(F.lit("ex:near some "), ident))))
    return line.select(
        ident.alias("id"), F.lit("part").alias("source"), F.lit("").alias("data_source"),
        place.alias("place"), F.posexplode(cells).alias("pos", "c"),
    ).where(F.col("c").isNotNull()).select(
        "id", "source", "data_source", "c.prop", "c.value", F.lit("").alias("lang"),
        (F.col("place") * 4 + F.col("pos") + 100).alias("ord"))


@_kept
def prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed namespaces per source, and one per host of `pages` under source `web`."""
    fixed = literal_table(
        spark,
        [("part", "part", DATA + "part/"), ("part", "ptype", DATA + "ptype/"),
         ("part", "ont", DATA + "ont/"), ("geo", "nation", DATA + "nation/"),
         ("geo", "region", DATA + "region/"), ("supply", "supplier", DATA + "supplier/"),
         ("supply", "nation", "http://supply.example.org/nation/"),
         ("sales", "customer", DATA + "customer/"), ("sales", "data", DATA),
         ("web", "web", "http://m."), ("web", "", DATA + "default/")],
        ["source", "prefix", "expansion"],
    ).select("source", F.lit("").alias("data_source"), "prefix", "expansion")
    host = F.regexp_extract("url", r"^(https?://[^/]+/)", 1)
    hosts = (read(spark, sf, "pages").select(host.alias("expansion"))
             .where("expansion <> ''").distinct()
             .select(F.lit("web").alias("source"), F.lit("").alias("data_source"),
                     F.concat(F.lit("h"), F.substring(F.md5("expansion"), 1, 10)).alias("prefix"),
                     "expansion"))
    return fixed.unionByName(hosts)


def global_prefixes(spark: SparkSession) -> DataFrame:
    return literal_table(spark, [*K.GLOBAL_PREFIXES, ("ex", "http://ex.example.org/")],
                         ["prefix", "expansion"]).withColumn("trust", F.lit(1))


def sources(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, [(s, "", "table", 1000.0 + i, 2000.0 + i) for i, s in enumerate([*SOURCES, "web"])],
        ["source", "data_source", "type", "last_modified", "last_updated"])


def index(spark: SparkSession, sf: str, with_axioms: bool = False) -> Index:
    rows = attributes(spark, sf)
    if with_axioms:
        rows = rows.unionByName(axioms(spark, sf))
    return Index(sources(spark), entities(spark, sf), rows, prefixes(spark, sf),
                 global_prefixes(spark))


def remarks(spark: SparkSession, sf: str) -> DataFrame:
    """A text per order line with one CURIE, one angle IRI, one bare IRI and a composite."""
    line = order_lines(spark, sf)
    text = F.concat(
        F.lit("see part:P"), F.col("l_partkey").cast("string"), F.lit(" from <" + DATA + "supplier/S"),
        F.col("l_suppkey").cast("string"), F.lit("> via " + DATA + "nation/N"),
        (F.col("l_suppkey") % 25).cast("string"), F.lit(", not part:12 or ex:http://a/b, line "),
        F.col("l_linenumber").cast("string"))
    return line.select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000
         + F.col("l_suppkey")).alias("doc"), F.col("l_partkey").alias("part"), text.alias("text"))


def edges_acyclic(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part").where("p_partkey > 0")
    return part.select(_term("P", "p_partkey").alias("child"),
                       F.concat(F.lit("P"), F.floor(F.col("p_partkey") / 2).cast("string")).alias("parent"))


def edges_cyclic(spark: SparkSession, sf: str) -> DataFrame:
    """k -> (k*k + 1) mod n: a functional graph with short cycles and long tails."""
    part = read(spark, sf, "part")
    n = part.agg(F.count(F.lit(1))).scalar()
    k = F.col("p_partkey")
    return part.select(_term("P", "p_partkey").alias("child"),
                       F.concat(F.lit("P"), ((k * k + 1) % n).cast("string")).alias("parent"))


def triples(spark: SparkSession, sf: str) -> DataFrame:
    from termweave.operators.patterns import triples as as_triples

    return as_triples(attributes(spark, sf).unionByName(axioms(spark, sf)))


def brands(spark: SparkSession, sf: str) -> DataFrame:
    """(doc, n): one outline document per part brand."""
    return read(spark, sf, "part").select(
        F.substring("p_brand", 7, 9).alias("n")).distinct().select(
        F.concat(F.lit("b"), "n").alias("doc"), F.col("n").cast("int").alias("n"))


@_kept
def outline_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Outline documents: a header, sections, and one heading with rows per part."""
    doc, n = F.col("doc"), F.col("n")

    def c(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    head = [
        (1, c("* doc ", doc)), (2, c(":PROPERTIES:")),
        (3, F.when(n % 9 != 0, c(":ID: ", doc))),
        (4, c(":X-context-type: ontology")),
        (5, c(":X-context-localname: ", F.when(n % 5 == 0, "other").otherwise(doc))),
        (6, F.when(n % 4 == 0, ":header-args:omn: :noweb no")
         .otherwise(c(":header-args:omn: :tangle ", doc, ".omn :noweb yes"))),
        (7, c(":END:")), (8, c("** Prefixes")), (9, c(":PROPERTIES:")), (10, c(":prefixdefs: yes")),
        (11, c(":END:")), (12, c("| prefix | uri |")), (13, c("|--------+-----|")),
        (14, F.when(n % 10 != 0, c("| part: | http://data.example.org/part/ |"))),
        (15, F.when(n % 10 != 0, c("| ex: | http://ex.example.org/ |"))),
        (16, F.when(n % 10 != 0, c("| ont: | http://data.example.org/ont/ |"))),
        (17, F.when(n % 10 != 0, c("| part: | http://other.example.org/ |"))),
        (18, c("** ", doc, " ontology (", F.when(n % 6 == 0, "none")
               .when(n % 7 == 0, c("zz:", doc, " zz:", doc, "/1.0"))
               .otherwise(c("ont:", doc, " ont:", doc, "/1.0")), ")")),
        (19, c(":PROPERTIES:")), (20, c(":ID: ", doc, "-ontology-declaration")),
        (21, c(":resourcedefs: yes")), (22, c(":END:")), (23, c(" - rdfs:comment :: about ", doc)),
        (24, c("** Classes")), (25, c(":PROPERTIES:")), (26, c(":ID: ", doc, "-class-hierarchy")),
        (27, c(":resourcedefs: yes")), (28, c(":END:")), (29, c("*** Thing of ", doc, " (ex:T", doc, ")")),
        (30, c(" - rdfs:comment :: top")), (31, c("#+begin_src omn")), (32, c("Class: ex:T", doc)),
        (33, c("#+end_src")), (34, c("see part:P1 in prose")),
        (40, c("** Individuals")), (41, c(":PROPERTIES:")), (42, c(":ID: ", doc, "-individuals")),
        (43, c(":resourcedefs: ", F.when(n % 8 == 0, "no").otherwise("yes"))),
        (44, c(":X-subheading-relation: ex:partOf")), (45, c(":END:")),
    ]

    def emit(frame, lines):
        cells = [F.when(t.isNotNull(), F.struct(F.lit(o).alias("o"), t.alias("text"))) for o, t in lines]
        return frame.select("doc", "base", F.inline(F.array_compact(F.array(*cells)))).select(
            "doc", (F.col("base") + F.col("o")).cast("long").alias("ord"), "text")

    k = F.col("p_partkey")
    part = read(spark, sf, "part").withColumn(
        "doc", F.concat(F.lit("b"), F.substring("p_brand", 7, 9))).withColumn(
        "base", F.lit(1000) + k * 10)
    body = [
        (0, c(F.when(k % 4 == 3, "**** ").otherwise("*** "), F.col("p_name"),
              F.when(k % 31 == 0, "").otherwise(c(" (part:P", k.cast("string"), ")")),
              F.when(k % 37 == 0, "  :nodeclare:").otherwise(""))),
        (1, F.when(k % 5 != 0, c(" - rdfs:comment :: size ", F.col("p_size").cast("string")))),
        (2, F.when((k % 5 != 0) & (k % 3 == 0), c("   and brand ", doc))),
        (3, F.when((k % 5 != 0) & (k % 7 == 0), c("   - rdfs:seeAlso :: meta ", k.cast("string")))),
        (4, F.when(k % 11 == 0, c(" - Types ::")).otherwise(c(" - Types :: ex:T", doc))),
        (5, F.when(k % 50 == 0, c(" - SubClassOf :: ex:T", doc))),
        (6, F.when(k % 60 == 0, c(" - ex:unknown :: odd"))),
    ]
    return emit(brands(spark, sf).withColumn("base", F.lit(0)), head).unionByName(emit(part, body))
