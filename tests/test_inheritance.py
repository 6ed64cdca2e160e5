"""Edited documents against the same documents written and read anew."""

import pytest
from pyspark.sql import functions as F

from termweave.operators import curation as K
from termweave.operators.inheritance import inherited
from termweave.operators.taxonomy import parent_edges
from termweave.sources import outline

HEAD = ["* doc", ":PROPERTIES:", ":ID: d", ":X-context-type: ontology", ":X-context-localname: d", ":END:", "** Classes",
        ":PROPERTIES:", ":ID: d-class-hierarchy", ":resourcedefs: yes", ":X-subheading-relation: ex:partOf", ":END:"]
TOP, MID, LEAF, OTHER = "*** Top (ex:Top)", "**** Mid (ex:Mid)", "***** Leaf (ex:Leaf)", "*** Other (ex:Other) :nodeclare:"
DERIVED = ["level", "parent_uri", "relation", "rdf_type", "section_id", "in_section", "nodeclare", "in_ontology", "localname",
           "inherited_id", "label"]


def read(spark, *headings):
    lines = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate([*HEAD, *headings])], "doc string, ord long, text string")
    parsed = outline.parsed_lines(lines)
    return outline.outline_nodes(None, parsed), outline.outline_rows(None, parsed), parsed


def state(nodes):
    return {r["title"]: tuple(r) for r in nodes.select("title", "uri", *DERIVED).collect()}


def edges(nodes, rows):
    return {(r["uri"], r["parent"]) for r in parent_edges(nodes, rows).collect()}


def test_nothing_changes_without_an_edit(spark):
    nodes, _rows, _parsed = read(spark, TOP, MID, LEAF, "***** (deep", "******* ex:Deep", OTHER, "*** Below (ex:Below)")
    assert state(inherited(nodes, nodes)) == state(nodes)


def test_rename(spark):
    nodes, rows, _parsed = read(spark, TOP, MID, LEAF, "***** ex:Mid2", "****** x (ex:X)")
    pairs = spark.createDataFrame([("ex:Mid", "ex:New"), ("ex:Mid2", "ex:New2")], "old string, new string")
    got, got_rows = K.rename_terms(pairs, nodes, rows)
    want = read(spark, TOP, "**** Mid (ex:New)", LEAF, "***** ex:New2", "****** x (ex:X)")[0]
    assert state(got) == state(want)
    assert edges(got, got_rows) == {("ex:New", "ex:Top"), ("ex:Leaf", "ex:New"), ("ex:New2", "ex:New"), ("ex:X", "ex:New2")}


def test_merge_and_reparent(spark):
    nodes, rows, parsed = read(spark, TOP, MID, LEAF, OTHER)
    want = state(read(spark, TOP, "**** Leaf (ex:Leaf)", OTHER)[0])
    pairs = spark.createDataFrame([("ex:Mid", "ex:Top")], "old string, new string")
    assert state(K.merge_terms(pairs, nodes, rows)[0]) == want
    left, left_rows, refusals, _notes = K.delete_terms(pairs.select(F.col("old").alias("id")), "reparent", nodes, rows, parsed)
    assert refusals.collect() == []
    assert state(left) == want
    assert edges(left, left_rows) == {("ex:Leaf", "ex:Top")}


def test_move_with_all_below(spark):
    nodes, rows, _parsed = read(spark, TOP, MID, LEAF, "*** Other (ex:Other)", "**** Under (ex:Under)")
    moves = spark.createDataFrame([("ex:Mid", "ex:Under")], "id string, target string")
    got, refusals = K.move_terms(moves, nodes)
    assert refusals.collect() == []
    want = read(spark, TOP, "*** Other (ex:Other)", "**** Under (ex:Under)", "***** Mid (ex:Mid)", "****** Leaf (ex:Leaf)")[0]
    assert state(got) == state(want)
    assert ("ex:Mid", "ex:Under") in edges(got, rows)


@pytest.mark.parametrize("pairs", [[("ex:Top", "ex:Leaf")], [("ex:Mid", "ex:Other"), ("ex:Other", "ex:Leaf")],
                                   [("ex:Leaf", "ex:Other"), ("ex:Leaf", "ex:Top")]])
def test_refused_moves_are_not_made(spark, pairs):
    nodes, _rows, _parsed = read(spark, TOP, MID, LEAF, "*** Other (ex:Other)")
    got, refusals = K.move_terms(spark.createDataFrame(pairs, "id string, target string"), nodes)
    assert refusals.collect()
    assert state(got) == state(nodes)


def test_one_circular_move_leaves_the_others(spark):
    nodes, _rows, _parsed = read(spark, TOP, MID, LEAF, "*** Other (ex:Other)", "*** Third (ex:Third)")
    moves = spark.createDataFrame([("ex:Top", "ex:Leaf"), ("ex:Third", "ex:Other")], "id string, target string")
    got, refusals = K.move_terms(moves, nodes)
    assert [(r["id"], r["reason"]) for r in refusals.collect()] == [("ex:Top", "target lies below the term")]
    assert state(got) == state(read(spark, TOP, MID, LEAF, "*** Other (ex:Other)", "**** Third (ex:Third)")[0])


def test_a_cycle_elsewhere_leaves_the_moves(spark):
    nodes, _rows, _parsed = read(spark, TOP, MID, LEAF, OTHER.replace(" :nodeclare:", ""))
    ring = nodes.where("uri IN ('ex:Top', 'ex:Mid')").withColumn("doc", F.lit("ring"))
    ids = {r["uri"]: r["node_id"] for r in ring.collect()}
    ring = ring.withColumn("parent_id", F.when(F.col("uri") == "ex:Top", ids["ex:Mid"]).otherwise(ids["ex:Top"])).withColumn(
        "uri", F.concat("uri", F.lit("Ring")))
    moves = spark.createDataFrame([("ex:Mid", "ex:Other")], "id string, target string")
    got, refusals = K.move_terms(moves, nodes.unionByName(ring.select(*nodes.columns)))
    assert refusals.collect() == []
    want = read(spark, TOP, "*** Other (ex:Other)", "**** Mid (ex:Mid)", "***** Leaf (ex:Leaf)")[0]
    assert state(got.where("doc = 'd'")) == state(want)
    assert got.where("doc = 'ring'").count() == 2


def test_inserted_terms_are_nodes(spark):
    nodes, rows, _parsed = read(spark, TOP, MID, " - rdfs:comment :: text", OTHER)
    wanted = spark.createDataFrame([(1, "ex:Mid", "New one"), (2, "ex:Top", "New two")], "ord long, anchor string, label string")
    new, refusals = K.insert_terms(wanted, nodes, "slug", "ex", child=True)
    assert refusals.collect() == []
    got = K.with_inserted(new, nodes, rows)
    want = read(spark, TOP, MID, "***** New one (ex:new-one)", "**** New two (ex:new-two)", OTHER)[0]
    assert state(got) == state(want)
    assert got.select("doc", "node_id").distinct().count() == got.count()
    assert ("ex:new-one", "ex:Mid") in edges(got, rows)


def test_relabel_keeps_the_name(spark):
    nodes, _rows, _parsed = read(spark, TOP, "**** ex:Bare")
    labels = spark.createDataFrame([("ex:Bare", "Shown")], "id string, new_label string")
    want = read(spark, TOP, "**** Shown (ex:Bare)")[0]
    assert state(K.relabel(nodes, labels)) == state(want)
