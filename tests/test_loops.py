"""Closure, cycles, import order, hierarchy order against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from termweave.operators import closure as C
from termweave.operators import taxonomy as G


def reach(edges):
    out, ahead = set(), {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    for start in ahead:
        todo, seen = list(ahead[start]), set()
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += ahead.get(n, ())
        out |= {(start, n) for n in seen}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_closure(spark, seed):
    rng = random.Random(seed)
    edges = {(f"n{rng.randint(0, 25)}", f"n{rng.randint(0, 25)}") for _ in range(30)} | {(f"c{i}", f"c{i + 1}") for i in range(20)}
    frame = spark.createDataFrame(sorted(edges), "src string, dst string").repartition(3)
    assert {tuple(r) for r in C.closure(frame).collect()} == reach(edges)
    back = {(b, a) for a, b in reach(edges)}
    assert {tuple(r) for r in C.closure(frame, reverse=True).collect()} == back
    starts = spark.createDataFrame([("c3",), ("n1",)], "src string")
    some = {tuple(r) for r in C.closure(frame, starts=starts).collect()}
    assert some == {p for p in reach(edges) if p[0] in ("c3", "n1")}


@pytest.mark.parametrize("seed", range(4))
def test_closure_of_nested_cycles(spark, seed):
    """Cycles of several lengths that share nodes or follow each other, self loops, tails, hubs."""
    rng = random.Random(seed)
    edges = {("a", "a")} | {(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)} | {(f"q{i}", f"q{(i + 1) % 4}") for i in range(4)}
    edges |= {("r3", "q1"), ("q2", "t0"), ("t0", "t1"), ("t1", "a"), ("h", "r5")} | {(f"in{i}", "h") for i in range(12)}
    edges |= {("h", f"out{i}") for i in range(12)} | {(f"n{rng.randint(0, 12)}", f"n{rng.randint(0, 12)}") for _ in range(16)}
    edges |= {("q3", "r0")} if seed % 2 else set()
    frame = spark.createDataFrame(sorted(edges), "src string, dst string").repartition(3)
    got = [tuple(r) for r in C.closure(frame).collect()]
    assert set(got) == reach(edges) and len(got) == len(set(got))
    nodes = {n for e in edges for n in e}
    assert {tuple(r) for r in C.closure(frame, min_hops=0, reverse=True).collect()} == {(b, a) for a, b in reach(edges)} | {(n, n) for n in nodes}
    starts = spark.createDataFrame([("in3",), ("q0",), ("nowhere",)], "src string")
    assert {tuple(r) for r in C.closure(frame, starts=starts).collect()} == {p for p in reach(edges) if p[0] in ("in3", "q0")}


def test_a_long_cycle_becomes_one_node(spark):
    """A ring of n nodes has n^2 pairs; no round joins n^3 rows."""
    n = 200
    ring = spark.range(n).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("src"),
                                 F.concat(F.lit("c"), ((F.col("id") + 1) % n).cast("string")).alias("dst"))
    assert C.closure(ring).distinct().count() == n * n


def test_no_edges(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert C.closure(none).collect() == [] and C.closure(none, starts=none.select("src")).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_break_cycles(spark, seed):
    rng = random.Random(seed)
    n = 40
    parent = {f"x{i}": f"x{rng.randint(0, n - 1)}" for i in range(n) if rng.random() < 0.9}
    weight = {k: rng.randint(0, 3) for k in parent}
    cycles = set()
    for start in parent:
        seen, at = [], start
        while at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        if at in seen:
            cycles.add(frozenset(seen[seen.index(at):]))
    roots = {min(c, key=lambda e: (-weight[e], e)) for c in cycles}
    edges = spark.createDataFrame(sorted(parent.items()), "child string, parent string")
    w = spark.createDataFrame(sorted(weight.items()), "child string, n long")
    left = {r.child for r in G.break_cycles(edges, w).collect()}
    assert left == set(parent) - roots


def test_import_order_is_depth_first(spark):
    links = {"a": ["b", "c", "d"], "b": ["d", "a"], "c": ["e"], "d": ["e", "f"], "e": ["c"], "f": []}
    order, seen = [], set()

    def visit(o):
        if o not in seen:
            seen.add(o)
            order.append(o)
            for nxt in links[o]:
                visit(nxt)

    visit("a")
    rows = [(o, n, i) for o, ns in links.items() for i, n in enumerate(ns)]
    got = G.import_order(spark.createDataFrame(rows, "ontology string, imported string, pos int"),
                         spark.createDataFrame([("a",)], "root string"))
    assert [r.ontology for r in got.orderBy("path").collect()] == order


def test_hierarchy_is_listed_depth_first(spark):
    terms = spark.createDataFrame([("r", "Root"), ("b", "beta"), ("a", "Alpha"), ("c", "gamma"), ("o", "orphan")], "id string, sort_key string")
    up = spark.createDataFrame([("b", "r"), ("a", "r"), ("c", "a"), ("o", "elsewhere")], "child string, parent string")
    rows = sorted(G.ordered_hierarchy(terms, up).collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == [1, 2, 3, 4, 5]
    assert [(r.id, r.level) for r in rows] == [("o", 1), ("r", 1), ("a", 2), ("c", 3), ("b", 2)]
    loop = spark.createDataFrame([("r", "a"), ("a", "r")], "child string, parent string")
    with pytest.raises(ValueError):
        G.ordered_hierarchy(terms, loop)


def test_most_specific_type(spark):
    types = spark.createDataFrame([("i", "Animal"), ("i", "Dog"), ("j", "A"), ("j", "B")], "id string, type string")
    edges = spark.createDataFrame([("Dog", "Animal"), ("A", "B"), ("B", "A")], "child string, parent string")
    keys = types.select("type", F.col("type").alias("sort_key")).distinct()
    assert {r.id: r.type for r in G.most_specific_type(types, edges, keys).collect()} == {"i": "Dog", "j": "A"}


@pytest.mark.parametrize("seed", range(3))
def test_places_of_random_forests(spark, seed):
    """Ties in the sort key go by id; hubs and several roots; parents outside count for nothing."""
    rng = random.Random(seed)
    n = 150
    up = {i: rng.choice([0, 0, 1, rng.randrange(i), None]) for i in range(1, n)}
    key = {i: rng.choice(["A", "a", "b", "C"]) for i in range(n)}
    children = {}
    for i in range(n):
        children.setdefault(up.get(i), []).append(i)
    order = []

    def visit(i, level):
        order.append((f"n{i:03}", level))
        for c in sorted(children.get(i, []), key=lambda c: (key[c].lower(), f"n{c:03}")):
            visit(c, level + 1)

    for root in sorted(children[None], key=lambda c: (key[c].lower(), f"n{c:03}")):
        visit(root, 1)
    terms = spark.createDataFrame([(f"n{i:03}", key[i]) for i in range(n)], "id string, sort_key string").repartition(4)
    edges = spark.createDataFrame([(f"n{i:03}", f"n{p:03}") for i, p in up.items() if p is not None] + [("n000", "elsewhere")],
                                  "child string, parent string")
    got = sorted(G.ordered_hierarchy(terms, edges).collect(), key=lambda r: r.place)
    assert [(r.id, r.level) for r in got] == order and [r.place for r in got] == list(range(1, n + 1))


def test_a_chain_of_ten_thousand(spark):
    """Deep hierarchies keep small rows: the written tables stay of one size."""
    n = 10_000
    terms = spark.range(n).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), F.lit("x").alias("sort_key"))
    edges = spark.range(1, n).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("child"),
                                     F.concat(F.lit("c"), (F.col("id") - 1).cast("string")).alias("parent"))
    got = G.ordered_hierarchy(terms, edges)
    assert got.where("place <> level OR id <> concat('c', place - 1)").count() == 0 and got.count() == n
