"""Running values over ranges give the answer of one pass, whatever the partitions and values."""

import random

import pytest
from pyspark.sql import functions as F

from termweave.plans.ordered import carry_forward, running_number, running_sum, top_per_group

ROWS = [(f"k{i % 3}", i * 7 % 101, random.Random(i).choice([None, i]), i % 5) for i in range(101)]


@pytest.fixture(params=[True, False], ids=["merged", "ranges"], autouse=True)
def ranges(spark, request):
    """With and without merging of small ranges, so that groups go on across ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(request.param).lower())
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(params=[1, 7])
def frame(spark, request):
    return spark.createDataFrame(ROWS, "k string, o long, c long, v int").repartition(request.param)


def groups():
    out = {}
    for k, o, c, v in sorted(ROWS, key=lambda r: (r[0], r[1])):
        out.setdefault(k, []).append((o, c, v))
    return out


def test_running_sum(frame):
    got = {(r.k, r.o): r.s for r in running_sum(frame, ["k"], "o", F.col("v"), "s").collect()}
    for k, rows in groups().items():
        total = 0
        for o, _c, v in rows:
            total += v
            assert got[(k, o)] == total


def test_running_number_without_keys(frame):
    got = sorted((r.o, r.n) for r in running_number(frame, [], "o", "n").collect())
    assert [n for _o, n in got] == list(range(1, len(ROWS) + 1))


def test_carry_forward(frame):
    got = {(r.k, r.o): r.last for r in carry_forward(frame, ["k"], "o", {"last": F.col("c")}).collect()}
    for k, rows in groups().items():
        last = None
        for o, c, _v in rows:
            last = c if c is not None else last
            assert got[(k, o)] == last


@pytest.mark.parametrize("limit", [3, 2000])
def test_top_per_group(frame, limit):
    got = {(r.k, r.o): r.place for r in top_per_group(frame, ["k"], ["o"], limit, "place").collect()}
    want = {(k, o): i + 1 for k, rows in groups().items() for i, (o, _c, _v) in enumerate(rows[:limit])}
    assert got == want


SHAPES = {"sparse": lambda i: i << 40, "dense": lambda i: i, "tied": lambda i: 7, "clustered": lambda i: 1 << (i % 50)}


@pytest.mark.parametrize("shape", sorted(SHAPES))
@pytest.mark.parametrize("keys", [["k"], ["k", "j"], []])
def test_any_order_and_empty_keys(spark, shape, keys):
    """NULL keys are a group; tied rows get distinct numbers; a group may fill many ranges."""
    dice = random.Random(4)
    rows = [(dice.choice(["a", "a", "a", None, "b"]), dice.choice([1, None]), SHAPES[shape](i), i, dice.choice([None, f"c{i}"])) for i in range(400)]
    frame = spark.createDataFrame(rows, "k string, j long, o long, i long, c string").repartition(5)
    got = running_number(frame, keys, "o", "n", ["i"]).collect()
    carried = {r.i: r.last for r in carry_forward(frame, keys, "o", {"last": F.col("c")}, ["i"]).collect()}
    sums = {r.i: r.s for r in running_sum(frame, keys, "o", F.col("i"), "s", ["i"]).collect()}
    groups = {}
    for k, j, o, i, c in sorted(rows, key=lambda r: (r[2], r[3])):
        groups.setdefault(tuple({"k": k, "j": j}[x] for x in keys), []).append((i, c))
    assert len(got) == 400
    for members in groups.values():
        last, total = None, 0
        for n, (i, c) in enumerate(members, 1):
            last, total = c or last, total + i
            assert carried[i] == last and sums[i] == total
    numbers = {r.i: r.n for r in got}
    assert all([numbers[i] for i, _ in m] == list(range(1, len(m) + 1)) for m in groups.values())


def test_full_ties_are_spread(spark):
    """Rows equal in every column are still dealt to many ranges and numbered through."""
    frame = spark.createDataFrame([("k", 1)] * 5000, "k string, o long").repartition(4)
    got = running_number(frame, ["k"], "o", "n")
    assert sorted(r.n for r in got.collect()) == list(range(1, 5001))


def test_no_rows(spark):
    none = spark.createDataFrame([], "k string, o long")
    assert running_number(none, ["k"], "o", "n").collect() == []
    assert carry_forward(none, [], "o", {"k": F.col("k")}).columns == ["o", "k"]
