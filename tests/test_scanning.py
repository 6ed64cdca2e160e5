"""Identifier spans: pass order, overlaps and masks; native extraction agrees with spans."""

import random

import pytest
from pyspark.sql import functions as F

from test_lookup import index as lookup_index

from termweave.functions import text as X
from termweave.operators import curation as K
from termweave.operators import scanning as S

CASES = {
    "see ex:dog and <http://a.b/c> or http://d/e, x": [("ex:dog", 4, 10, "curie"), ("http://a.b/c", 15, 29, "angle-iri"),
                                                     ("http://d/e", 33, 43, "bare-iri")],
    "ex:http://a/b": [("http://a/b", 3, 13, "bare-iri")],
    "ex:foo/http://a/b z": [("http://a/b", 7, 17, "bare-iri")],
    "part:12 :x _y a:b:c": [(":x", 8, 10, "curie"), ("a:b:c", 14, 19, "curie")],
    "12part:P1": [("part:P1", 2, 9, "curie")],
    "<http://a,http://b> p:q": [("http://a,http://b", 0, 19, "angle-iri"), ("p:q", 20, 23, "curie")],
    "no-break http://a/b ex:c": [("http://a/b", 9, 19, "bare-iri"), ("ex:c", 20, 24, "curie")],
    "": [],
}


def test_spans(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "doc long, text string")
    got = {}
    for r in S.scan_tokens(rows, ["doc"], "text").collect():
        got.setdefault(r.doc, []).append((r.token, r.start, r.end, r.kind))
    for i, want in enumerate(CASES.values()):
        assert sorted(got.get(i, []), key=lambda h: h[1]) == want


def test_hit_cap_follows_pass_order(spark):
    rows = spark.createDataFrame([(1, "ex:a ex:b http://c/d")], "doc long, text string")
    got = S.scan_tokens(rows, ["doc"], "text", max_hits=2).collect()
    assert [r.token for r in got] == ["ex:a", "http://c/d"]


def test_native_extraction_agrees_with_spans(spark):
    rng = random.Random(5)
    bits = ["ex:a", "http://", "a/b", "<", ">", " ", ":", "x.y", "12", "-", "_q", ",", "https://h/p", "ü", " ", "\u0001", "%", "\n"]
    texts = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(600)]
    rows = spark.createDataFrame(texts, "doc long, text string")
    spans = S.scan_tokens(rows.where(~F.contains("text", F.lit("\u0001"))), ["doc"], "text").select("doc", "token", "kind")
    plain = S.extract_ids(rows.where(~F.contains("text", F.lit("\u0001"))), ["doc"], "text")
    assert sorted(map(tuple, spans.collect())) == sorted(map(tuple, plain.collect()))


def test_one_pass_finds_what_three_find():
    """Every hit of the three passes and no other, names that run into an IRI included."""
    rng = random.Random(6)
    bits = ["ex:", "a", "http://", "https://", "h", "htt", "://", "a/b", "<", ">", " ", ":", "x.y", "12", "-", "_q", ",", "ü", "\u00a0", "%", "\n", "\u0001", "'"]
    for _ in range(60_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert list(S._scan_all(text)) == S._scan(text, 1 << 30), text


def test_a_control_character_stays_in_its_identifier(spark):
    rows = spark.createDataFrame([(1, "http://a/\u0001b")], "doc long, text string")
    assert [r.token for r in S.extract_ids(rows, ["doc"], "text").collect()] == ["http://a/\u0001b"]


def test_texts_are_cut_up_once(spark):
    """Counting unknown tokens goes through the texts once, not again for the counts."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    texts = spark.createDataFrame([(i, f"ex:a{i % 7} <http://b/{i}>") for i in range(100)], "doc long, text string").mapInArrow(
        seen, "doc long, text string")
    assert S.unknown_tokens(S.extract_ids(texts, ["doc"], "text"), lookup_index(spark), [("A", "")]).count() == 107
    assert read.value == 100


@pytest.mark.parametrize("value, curie, check, edit", [
    ("ex:dog", "ex:dog", True, True), ("ex:dogfood", "ex:dog", False, False), ("a (ex:dog)", "ex:dog", True, True),
    ("ex:dog.", "ex:dog", False, True), ("ex:dog/x", "ex:dog", False, True), ("x:ex:dog", "ex:dog", True, False),
    ("ex:dog ex:dog", "ex:dog", True, True), ("a+b", "a+b", True, True)])
def test_mentions(spark, value, curie, check, edit):
    row = spark.createDataFrame([(value, curie)], "v string, c string").select(
        X.mentions(F.col("v"), F.col("c")).alias("check"), X.mentions(F.col("v"), F.col("c"), X.EDIT_NAME).alias("edit")).first()
    assert (row.check, row.edit) == (check, edit)


def test_rewriting_names(spark):
    rows = spark.createDataFrame([(1, "ex:dog ex:dog, (ex:dog) ex:dogs ex:dog."), (2, "ex:a/b ex:a ex:a/bc"), (3, "nothing")],
                                 "k long, t string")
    mapping = spark.createDataFrame([("ex:dog", "ex:hound"), ("ex:a/b", "ex:z"), ("ex:a", "ex:y")], "old string, new string")
    out = {r.k: (r.t, r._changed) for r in K.rewrite_column(rows, ["k"], "t", K.rewrite_map(mapping, None)).collect()}
    assert out == {1: ("ex:hound ex:hound, (ex:hound) ex:dogs ex:hound.", 4), 2: ("ex:z ex:y ex:y/bc", 3), 3: ("nothing", 0)}


def test_balanced_parentheses(spark):
    cases = {"": True, "(a)": True, ")(": False, "(()": False, "a ) (": False, "((x) (y))": True, "))((": False}
    rows = spark.createDataFrame([(c,) for c in cases], "v string")
    got = {r.v: r.b for r in rows.select("v", X.balanced_parentheses(F.col("v")).alias("b")).collect()}
    assert got == cases


def test_a_frequent_name_is_no_single_task(spark):
    pieces = spark.sql("SELECT id AS doc, a.* FROM range(2000) LATERAL VIEW inline(array(struct(0 AS _at, 'ex:by' AS _name), "
                       "struct(1 AS _at, CAST(NULL AS string) AS _name), struct(2 AS _at, 'ex:o' || id AS _name))) a")
    largest = S.dealt_names(pieces, ["doc"]).groupBy("_key", "_part").count().agg({"count": "max"}).first()[0]
    assert largest < 2000 / 4


def test_axioms_show_labels_of_frequent_and_rare_names(spark):
    axioms = spark.sql("SELECT id AS doc, 'ex:by  (ex:o' || id || ') ex:none' AS value FROM range(50)")
    labels = spark.sql("SELECT 'ex:by' AS id, 'made by' AS label UNION ALL SELECT 'ex:o' || id, 'O' || id FROM range(0, 50, 2)")
    table = spark.createDataFrame([("ex", "http://e/")], "prefix string, expansion string")
    got = {r.doc: (r.value, r.substitutions) for r in S.axiom_to_labels(axioms, ["doc"], "value", labels, table).collect()}
    assert got == {i: (f"'made by'  (O{i}) ex:none", 2) if i % 2 == 0 else (f"'made by'  (ex:o{i}) ex:none", 1) for i in range(50)}
