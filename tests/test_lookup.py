"""Priority, language and identifier rules on small rows."""

import pytest

from termweave.model import Index
from termweave.operators import identifiers as P
from termweave.operators import lookup as L
from termweave.operators import search as R
from termweave.sources.lift import global_prefixes


def index(spark, entities=(), attributes=(), prefixes=()):
    def table(rows, schema):
        return spark.createDataFrame(list(rows), schema)

    return Index(
        table([], "source string, data_source string, type string, last_modified double, last_updated double"),
        table(entities, "id string, label string, source string, data_source string, kind string"),
        table(attributes, "id string, source string, data_source string, prop string, value string, lang string, ord long"),
        table(prefixes, "source string, data_source string, prefix string, expansion string"),
        global_prefixes(spark))


def test_prefix_priority_follows_active_order(spark):
    idx = index(spark, prefixes=[("A", "", "ex", "http://a/"), ("B", "", "ex", "http://b/")])
    rows = spark.createDataFrame([("ex:hello",), ("rdfs:label",), ("nope:x",), ("plain",)], "id string")
    for active, want in (([("A", ""), ("B", "")], "http://a/hello"), ([("B", ""), ("A", "")], "http://b/hello")):
        got = {r.id: r.iri for r in P.expand_curie(rows, "id", idx, active).collect()}
        assert got == {"ex:hello": want, "rdfs:label": "http://www.w3.org/2000/01/rdf-schema#label",
                       "nope:x": None, "plain": None}


def test_contraction_is_strict_and_ranked(spark):
    idx = index(spark, prefixes=[("A", "", "s", "http://x/"), ("A", "", "l", "http://x/ab"), ("B", "", "t", "http://x/"),
                                 ("A", "", "odd", "http://x/abc")])
    iris = spark.createDataFrame([("http://x/abcd",), ("http://x/",)], "iri string")
    found = P.contract_ranked(P.contract_uri(iris, "iri", idx, [("B", ""), ("A", "")])).collect()
    assert [r.curie for r in sorted(found, key=lambda r: r.place)] == ["odd:d", "l:cd", "t:abcd", "s:abcd"]


LABELS = [("w", "Widget", "en", 1), ("w", "위젯", "ko", 2), ("w", "plain", "", 3), ("one", "Einzig", "de", 1),
          ("two", "zwei", "de", 1), ("two", "deux", "Fr", 2), ("tie", "b", "en", 1), ("tie", "a", "EN", 2)]


@pytest.mark.parametrize("prefs, want", [
    (None, {"w": "plain", "one": "Einzig", "two": "deux", "tie": "b"}),
    (["KO"], {"w": "위젯", "one": "Einzig", "two": "deux", "tie": "a"}),
    (["en", "de"], {"w": "Widget", "one": "Einzig", "two": "zwei", "tie": "b"}),
])
@pytest.mark.parametrize("parts", [1, 5])
def test_language_choice(spark, prefs, want, parts):
    rows = spark.createDataFrame(LABELS, "id string, value string, lang string, ord long").repartition(parts)
    assert {r.id: r.value for r in L.pick_by_lang(rows, ["id"], prefs).collect()} == want


def test_null_label_ends_the_source_but_not_the_search(spark):
    idx = index(spark, entities=[("ex:a", None, "A", "", "curie"), ("http://e/a", "far", "A", "", "uri"),
                                 ("ex:a", "low", "B", "", "curie")], prefixes=[("A", "", "ex", "http://e/")])
    active = [("A", ""), ("B", "")]
    ids = spark.createDataFrame([("ex:a",)], "id string")
    assert L.get_labels(ids, idx, active).first().label is None
    tokens = ids.withColumnRenamed("id", "token")
    assert L.resolve_labels(tokens, idx, active).first().label == "far"


def test_label_owner_keeps_all_its_ids(spark):
    idx = index(spark, entities=[("a", "x", "A", "", "unknown"), ("b", "x", "A", "", "unknown"), ("c", "x", "B", "", "unknown"),
                                 ("d", None, "A", "", "unknown"), ("e", "", "B", "", "unknown")],
                attributes=[("d", "A", "", "rdfs:label", "hidden", "", 1)])
    got = sorted((r.label, r.id) for r in L.all_active_labels(idx, [("A", ""), ("B", "")]).collect())
    assert got == [("", "e"), ("x", "a"), ("x", "b")]


def test_a_source_owns_the_whole_view(spark):
    idx = index(spark, attributes=[("a", "A", "", "p", "1", "", 1), ("a", "B", "", "p", "2", "", 1), ("a", "B", "", "q", "3", "", 2)])
    ids = spark.createDataFrame([("a",)], "id string")
    rows = L.get_all_attrs(ids, idx, [("A", ""), ("B", "")]).collect()
    assert [(r.prop, r.value, r.source) for r in rows] == [("p", "1", "A")]


def test_borrowed_terms_get_heading_and_prefix(spark):
    idx = index(spark, prefixes=[("A", "", "", "http://x.org/Pets#"), ("B", "", "", "urn:9/")])
    cited = spark.createDataFrame([(":dog", None, "A"), (":cat", "Cat", "A"), ("ex:ant", "ex:ant", "A"), (":bee", "Bee", "B"), (":cow", " ", "C")],
                                  "id string, label string, source string").selectExpr("*", "'' AS data_source", "'http://o' AS ontology_iri")
    got = {r.id: (r.heading_label, r.namespace, r.suggested_prefix) for r in R.borrow_flags(cited, idx).collect()}
    assert got == {":dog": ("dog", "http://x.org/Pets#", "pets"), ":cat": ("Cat", "http://x.org/Pets#", "pets"), "ex:ant": ("ant", None, None),
                   ":bee": ("Bee", "urn:9/", None), ":cow": ("cow", None, None)}


def test_numbered_names_meet_few_rows(spark):
    """Three letters of a name that differs by its number are shared by a fixed share of all rows."""
    numbers = spark.range(4000).selectExpr("lpad(id, 9, '0') AS n")
    rows = numbers.selectExpr("concat('x:C', n) AS id", "concat('Name#', n) AS label", "'A' AS source", "'' AS data_source")
    queries = numbers.selectExpr("concat('Name#', n) AS query").union(spark.sql("SELECT 'zz:S' || id FROM range(4000)"))
    assert R.substring_candidates(queries, rows).count() <= 10 * 4000
    found = R.substring_matches(queries, rows)
    assert found.count() == 4000 and found.where("query <> label").count() == 0


@pytest.mark.parametrize("query, want", [
    ("abcdefg", {1, 2}), ("abcdefghijklm", {2}), ("m", {2}), ("xy", {3}), ("%", {1, 2, 3}), ("ab%lm", set()), ("ab%lm%", {2}), ("%klm_", {2}), ("klm_%", set()),
    ("abcdefghijklmnopqrstuvwxyz", set()), ("é", {3})])
def test_substrings_of_every_length(spark, query, want):
    rows = spark.createDataFrame([(1, "abcdefg"), (2, "ABCDEFGHIJKLM/"), (3, "éxy")], "n int, label string").selectExpr(
        "n", "concat(':', n) AS id", "label", "'A' AS source", "'' AS data_source")
    got = R.substring_matches(R.query_table(spark, [query]), rows)
    assert {r.n for r in got.collect()} == want
