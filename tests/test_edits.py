"""Batched row edits against replay, slugs against a loop."""

import random

import pytest
from pyspark.sql import functions as F

from termweave.operators import curation as K
from termweave.operators import minting as I


def norm(text):
    return None if text is None else " ".join(text.split())


def replay(rows, edits):
    """Edits one by one; returns rows or the first edit that cannot work."""
    state = [dict(id=i, key=("r", r), keyword=k, value=v) for i, r, k, v in rows]
    for no, i, op, keyword, fragment, match in edits:
        if op == "delete-empty":
            state = [s for s in state if not (s["id"] == i and keyword in (None, s["keyword"]) and not norm(s["value"]))]
        elif op == "add":
            state.append(dict(id=i, key=("e", no), keyword=keyword, value=fragment))
        else:
            hits = [s for s in state if s["id"] == i and s["keyword"] == keyword
                    and (match is None or norm(s["value"]) == norm(match))]
            if len(hits) != 1:
                return None, no
            if op == "delete":
                state.remove(hits[0])
            else:
                hits[0]["value"] = fragment
    return sorted((s["id"], *s["key"], s["keyword"], s["value"]) for s in state), None


def batch(rng, rows, size):
    edits = []
    for no in range(size):
        i, keyword = rng.choice("ab"), rng.choice(["P", "Q"])
        op = rng.choice(["add", "add", "replace", "delete", "delete-empty", "replace"])
        value = rng.choice(["", "x", "y", "z z", " z  z "])
        match = rng.choice([None, "x", "y", "z z", ""])
        if op == "delete-empty":
            edits.append((no, i, op, rng.choice([keyword, None]), None, None))
        elif op == "add":
            edits.append((no, i, op, keyword, value, None))
        else:
            edits.append((no, i, op, keyword, value if op == "replace" else None, match))
        if replay(rows, edits)[1] is not None:
            edits.pop()
    return edits


EDITS = "edit_no long, id string, op string, keyword string, fragment string, match string"
ROWS = "id string, row_id long, keyword string, value string"


@pytest.mark.parametrize("seed", range(4))
def test_edits_equal_replay(spark, seed):
    rng = random.Random(seed)
    rows = [("a", 1, "P", "x"), ("a", 2, "P", " y "), ("a", 3, "Q", ""), ("b", 4, "P", "z  z"), ("b", 5, "Q", "x"), ("b", 6, "Q", "")]
    edits = batch(rng, rows, 40)
    want, bad = replay(rows, edits)
    assert bad is None
    out, errors = K.edit_rows(spark.createDataFrame(edits, EDITS).repartition(3), spark.createDataFrame(rows, ROWS))
    assert errors.collect() == []
    got = sorted((r.id, "e" if r.added else "r", r.row_id, r.keyword, r.value) for r in out.collect())
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_first_error_is_found(spark, seed):
    rng = random.Random(100 + seed)
    rows = [("a", 1, "P", "x"), ("a", 2, "P", "x"), ("b", 3, "Q", "y")]
    edits = batch(rng, rows, 15)
    edits.append((99, "a", "replace", "Zed", "v", None))
    _want, bad = replay(rows, edits)
    _out, errors = K.edit_rows(spark.createDataFrame(edits, EDITS), spark.createDataFrame(rows, ROWS))
    found = errors.agg(F.min("edit_no")).first()[0]
    assert found == bad == 99


def test_slugs_skip_what_is_taken(spark):
    labels = ["Dog", "dog!", "Dog 2", "dog", "DOG", "??", "", "cat", "cat"]
    frame = spark.createDataFrame(list(enumerate(labels)), "ord long, label string").repartition(4)
    existing = spark.createDataFrame([("ex:dog-3",), ("ex:cat",), ("zz:dog-4",)], "id string")
    got = [r.id for r in I.mint_slug(frame, "ex", existing).orderBy("ord").collect()]
    assert got == ["ex:dog", "ex:dog-4", "ex:dog-2", "ex:dog-5", "ex:dog-6", "ex:x", "ex:x-2", "ex:cat-2", "ex:cat-3"]


def test_many_equal_slugs(spark):
    taken = [2, 3, 4, 7, 11]
    frame = spark.range(0, 30).select(F.col("id").alias("ord"), F.lit("new").alias("label"))
    existing = spark.createDataFrame([(f"ex:new-{n}",) for n in taken], "id string")
    got = [r.id for r in I.mint_slug(frame, "ex", existing).orderBy("ord").collect()]
    free = (n for n in range(2, 100) if n not in taken)
    assert got == ["ex:new"] + [f"ex:new-{next(free)}" for _ in range(29)]


def test_counter_goes_on(spark):
    frame = spark.createDataFrame([(5, "b"), (2, "a")], "ord long, label string")
    existing = spark.createDataFrame([("GO:GO_0000041",), ("GO:GO_x",), ("XX:GO_0000099",)], "id string")
    got = {r.ord: r.id for r in I.mint_counter(frame, "GO", "GO_0000000", existing).collect()}
    assert got == {2: "GO:GO_0000042", 5: "GO:GO_0000043"}


def test_checked_ids_survive_a_crowded_day(spark):
    frame = spark.range(0, 5000).select(F.col("id").alias("ord"), F.lit("x").alias("label"))
    existing = spark.createDataFrame([("ex:none",)], "id string")
    ids = I.mint_checked(frame, "ex", "class", existing, F.lit("2024-01-01").cast("date"))
    row = I.verify_ids(ids, "acme").agg(F.countDistinct("id").alias("n"), F.bool_and("valid").alias("ok")).first()
    assert (row.n, row.ok) == (5000, True)
    changed = ids.withColumn("id", F.concat(F.substring("id", 1, 13), F.lit("0")))
    assert I.verify_ids(changed, "acme").where("valid").count() < 400


def test_checked_ids_go_on_after_a_full_day(spark, monkeypatch):
    monkeypatch.setattr(I, "SPACE", 256)
    frame = spark.range(0, 1000).select(F.col("id").alias("ord"), F.lit("x").alias("label")).repartition(3)
    existing, day = spark.createDataFrame([("ex:none",)], "id string"), F.lit("2024-01-01").cast("date")
    ids = I.mint_checked(frame, "ex", "class", existing, day)
    both = ids.union(I.mint_checked(frame, "ex", "class", ids.select("id"), day))
    row = I.verify_ids(both, "acme").agg(F.countDistinct("id").alias("n"), F.bool_and("valid").alias("ok"),
                                         F.countDistinct(F.substring("id", 6, 4)).alias("days")).first()
    assert (row.n, row.ok, row.days) == (2000, True, 8)


def test_edits_that_cannot_work_change_nothing(spark):
    rows = spark.createDataFrame([("a", 1, "T", "x"), ("a", 2, "T", "y"), ("b", 3, "T", "x"), ("c", 4, "T", "z"), ("c", 5, "T", " z")],
                                 "id string, row_id long, keyword string, value string")
    edits = spark.createDataFrame([(1, "a", "delete", "T", None, None), (2, "b", "replace", "T", "new", "none"), (3, "b", "add", "T", "w", None),
                                   (4, "c", "replace", "T", "v", "z"), (5, "b", "delete", "T", None, "x")],
                                  "edit_no long, id string, op string, keyword string, fragment string, match string")
    out, errors = K.edit_rows(edits, rows)
    assert {r.edit_no for r in errors.collect()} == {1, 2, 4}
    assert sorted((r.id, r.row_id, r.value) for r in out.collect()) == [
        ("a", 1, "x"), ("a", 2, "y"), ("b", 3, "w"), ("c", 4, "z"), ("c", 5, " z")]


def test_only_rows_that_come_or_go_are_checked(spark, monkeypatch):
    """Rows that no edit names are neither worked through nor checked, and issues are those of all."""
    rows = [("ex:a", 4, "Types", "ex:C"), ("ex:a", 8, "Types", "no:1"), ("ex:b", 4, "Types", "no:1"), ("ex:c", 4, "SameAs", " ")]
    rows += [(f"ex:n{i}", 4, "Types", "no:2") for i in range(300)]
    rows += [(None, 4, "Types", "no:3"), ("ex:a", 12, None, "x")]
    edits = [(1, "ex:a", "replace", "Types", "no:1", "ex:C"), (2, "ex:b", "replace", "Types", "no:4", None),
             (3, "ex:c", "delete-empty", None, None, None), (4, "ex:c", "add", "SameAs", " ", None), (5, "ex:a", "add", "Domain", "ex:C", None),
             (6, "ex:a", "delete", None, None, "x")]
    frame = spark.createDataFrame(rows, ROWS)
    types = spark.createDataFrame([("s", i, t) for i, t in [("ex:a", "owl:NamedIndividual"), ("ex:b", "owl:NamedIndividual"),
                                                            ("ex:c", "owl:NamedIndividual"), ("ex:C", "owl:Class")]], "source string, id string, rdf_type string")
    checked, plain = [], K.C.check_blank_axiom

    def noted(described):
        checked.append(described.count())
        return plain(described)

    monkeypatch.setattr(K.C, "check_blank_axiom", noted)
    issues, errors = K.check_edits(spark.createDataFrame(edits, EDITS), frame, types)
    assert sorted((r.check, r.subject, r.message.split(": ")[-1]) for r in issues.collect()) == [
        ("axiom-names", "ex:a", "no:1"), ("axiom-names", "ex:b", "no:4"), ("keyword-section", "ex:a", "ERROR: Domain is not valid in section -individuals".split(": ")[-1])]
    assert errors.count() == 0
    assert sorted(checked) == [4, 4]
    left, _errors = K.edit_rows(spark.createDataFrame(edits, EDITS), frame)
    assert left.count() == len(rows) + 2 - 2
