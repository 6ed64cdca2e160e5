"""Files and outline documents of our own, read and published."""

import pytest
from pyspark.sql import functions as F

from termweave.operators import checks as C
from termweave.operators import publishing as X
from termweave.operators import taxonomy as G
from termweave.operators.identifiers import ontology_ids
from termweave.sources import outline, readers

DOC = """* zoo
:PROPERTIES:
:ID: zoo
:A-context-type: ontology
:A-context-localname: zoo
:header-args:omn: :tangle zoo.omn :noweb yes
:END:
** Prefixes
:PROPERTIES:
:prefixdefs: yes
:END:
| prefix | uri             |
|--------+-----------------|
| ex:    | http://ex.org/  |
| ex:    | http://late.org/ |
** zoo ontology (ex:zoo ex:zoo/1)
:PROPERTIES:
:ID: zoo-ontology-declaration
:resourcedefs: yes
:END:
 - rdfs:comment :: a zoo
** Classes
:PROPERTIES:
:ID: zoo-class-hierarchy
:resourcedefs: yes
:END:
*** animal (ex:animal)
 - rdfs:comment :: any animal
   that lives
   - rdfs:seeAlso :: http://see.org/x
 - SubClassOf :: ex:has some ex:leg
**** dog (ex:dog)
 - rdfs:label :: "Hund"@de
 - SubClassOf :: ex:dog
 - DisjointWith ::
**** "cat"@en (ex:cat)
*** no name
*** lump (ex:lump) :nodeclare:
**** under lump (ex:under)
*** animal (ex:twin)
 - SubClassOf :: ex:animal
** Individuals
:PROPERTIES:
:ID: zoo-individuals
:resourcedefs: yes
:A-subheading-relation: ex:partOf
:END:
*** rex (ex:rex)
 - Types :: ex:dog
 - Domain :: ex:animal
**** leg (ex:leg1)
***** toe (ex:toe1)
 - Facts :: ex:partOf ex:leg1
"""


@pytest.fixture(scope="module")
def zoo(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("docs") / "zoo.org"
    path.write_text(DOC, encoding="utf-8")
    lines = readers.read_lines(spark, str(path)).withColumn("doc", F.lit("zoo"))
    parsed = outline.parsed_lines(lines)
    nodes = outline.outline_nodes(lines, parsed).cache()
    rows = outline.outline_rows(lines, parsed).cache()
    return nodes, rows, outline.outline_prefixes(lines, parsed, nodes).cache()


def test_nodes(zoo):
    got = {r.uri: r for r in zoo[0].collect() if r.uri}
    assert got["ex:dog"].rdf_type == "owl:Class" and got["ex:dog"].parent_uri == "ex:animal"
    assert got["ex:zoo ex:zoo/1"].rdf_type == "owl:Ontology"
    assert got["ex:cat"].label == '"cat"@en' and got["ex:toe1"].relation == "ex:partOf"
    assert "ex:lump" not in got and got["ex:under"].nodeclare


def test_rows(zoo):
    rows = {(r.tag, r.value): r for r in zoo[1].collect()}
    outer = rows[("rdfs:comment", "any animal\n   that lives")]
    assert rows[("rdfs:seeAlso", "http://see.org/x")].parent_row_id == outer.row_id
    assert ("DisjointWith", "") in rows
    assert [(r.prefix, r.expansion) for r in zoo[2].collect()] == [("ex", "http://ex.org/")]


def test_nesting_makes_edges_and_facts(zoo):
    nodes, rows, _p = zoo
    edges = {(r.uri, r.parent) for r in G.parent_edges(nodes, rows).collect()}
    assert edges == {("ex:dog", "ex:animal"), ("ex:cat", "ex:animal")}
    facts = {(r.uri, r.value) for r in G.relation_facts(nodes, rows).collect()}
    # The fact of the toe is authored already; a leg points at its immediate parent.
    assert facts == {("ex:leg1", "ex:partOf ex:rex")}


def test_frames(zoo):
    text = {r.uri: r.text for r in X.frames(*zoo).collect()}
    assert text["ex:animal"] == (
        'Class: ex:animal\n    Annotations: \n        rdfs:label "animal",\n        Annotations: \n'
        '            rdfs:seeAlso <http://see.org/x>\n        rdfs:comment "any animal\nthat lives"\n'
        '    SubClassOf: ex:has some ex:leg')
    assert text["ex:dog"] == (
        'Class: ex:dog\n    Annotations: \n        rdfs:label "dog",\n        rdfs:label "Hund"@de\n'
        '    SubClassOf: ex:dog\n    SubClassOf: ex:animal')
    assert text["ex:leg1"].endswith("    Facts: ex:partOf ex:rex")
    assert "ex:lump" not in text


def test_issues(zoo):
    nodes, rows, prefixes = zoo
    names = ontology_ids(nodes.where("rdf_type = 'owl:Ontology'").select(F.col("doc").alias("source"), F.col("uri").alias("id")),
                         prefixes.select("prefix", "expansion"))
    found = {}
    for r in C.all_issues(nodes, rows, prefixes, names).collect():
        found.setdefault(r.check, set()).add(r.subject)
    assert found["identity"] == {"no name"}
    assert found["recursive"] == {"ex:dog"}
    assert found["blank-axiom"] == {"ex:dog"}
    assert found["nesting"] == {"ex:twin"}
    assert found["duplicate-label"] == {"ex:animal", "ex:twin"}
    assert found["keyword-section"] == {"ex:rex"}
    assert found["undocumented"] >= {"ex:dog", "ex:cat", "ex:rex"} and "ex:animal" not in found["undocumented"]
    assert found["sections"] == {"zoo-object-property-hierarchy", "zoo-data-property-hierarchy", "zoo-annotation-property-hierarchy"}
    assert "header" not in found and "declaration" not in found and "prefix-table" not in found


def test_published_lines_are_numbered(zoo):
    lines = X.published_lines(X.blocks(*zoo)).orderBy("line").collect()
    assert [r.line for r in lines] == list(range(1, len(lines) + 1))
    assert lines[0].text == "## Prefixes" and lines[1].text == "Prefix: ex:   <http://ex.org/>"
    opens = {r.uri: r.line for r in X.line_map(X.published_lines(X.blocks(*zoo))).collect()}
    assert lines[opens["ex:dog"] - 1].text == "Class: ex:dog"


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿\nid,label,definition,lang,label@ko\nex:a,"A, or ""a""",one,en,가\n,none,x,,\nb,,,,\n', "utf-8")
    (tmp_path / "B.TSV").write_text("id\tlabel\tkind\nc\tC\tthing\n", "utf-8")
    (tmp_path / "odd.bin").write_text("?", "utf-8")
    rows, errors = readers.ingest_dir(spark, str(tmp_path))
    got = sorted((r.id, r.label, r.prop or "", r.value or "", r.lang or "") for r in rows.collect())
    assert got == [("b", "", "", "", ""), ("c", "C", "kind", "thing", ""), ("ex:a", 'A, or "a"', "definition", "one", ""),
                   ("ex:a", 'A, or "a"', "rdfs:label", 'A, or "a"', "en"), ("ex:a", 'A, or "a"', "rdfs:label", "가", "ko")]
    assert [r.error for r in errors.collect()] == ["unknown extension 'bin'"]


def test_large_file_keeps_line_order(spark, tmp_path):
    path = tmp_path / "big.txt"
    path.write_text("".join(f"line {i:07d}\n" for i in range(700_000)), "utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
    try:
        lines = readers.read_lines(spark, str(path))
        assert lines.rdd.getNumPartitions() > 2
        ranked = lines.orderBy("ord").select("text").toPandas()["text"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert ranked.is_monotonic_increasing and len(ranked) == 700_000
