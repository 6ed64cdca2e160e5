"""Loops over edges: closure and cycles. Each round is written out before the next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.plans.cut import cut

MAX_ROUNDS = 64


class _Pairs:
    """Reached pairs as tables that are appended to, one a round; read as their union."""

    MERGE = 12

    def __init__(self, first: DataFrame):
        self.tables = [first]

    def add(self, table: DataFrame) -> None:
        self.tables.append(table)
        if len(self.tables) > self.MERGE:
            self.tables = [cut(self.all())]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.tables)


def _new_pairs(delta: DataFrame, step: DataFrame, reached: DataFrame) -> DataFrame:
    """Pairs of `delta` continued by `step` that are not reached yet."""
    ahead = step.select(F.col("src").alias("mid"), F.col("dst").alias("far"))
    new = delta.select("src", F.col("dst").alias("mid")).join(ahead, "mid").select(
        "src", F.col("far").alias("dst")).distinct()
    return cut(new.join(reached, ["src", "dst"], "left_anti"))


def _contracted(pairs: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs with one node for each set of nodes that reach each other, and `members`
    (node, rep) brought up to date. Nodes on a cycle are those that reach themselves."""
    on = cut(pairs.where("src = dst").select(F.col("src").alias("node")))
    inner = cut(pairs.join(on.select(F.col("node").alias("src")), "src", "left_semi").join(
        on.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
    back = inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    reps = cut(inner.join(back, ["src", "dst"]).groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("rep")))
    # Sets found before are nodes of this one.
    later = reps.select(F.col("node").alias("rep"), F.col("rep").alias("_now"))
    moved = members.join(later, "rep", "left").select("node", F.coalesce("_now", "rep").alias("rep"))
    members = cut(moved.unionByName(reps.join(members.select("node"), "node", "left_anti")))
    src, dst = (reps.select(F.col("node").alias(end), F.col("rep").alias(f"_{end}")) for end in ("src", "dst"))
    left = pairs.join(src, "src", "left").join(dst, "dst", "left").select(
        F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst"))
    return cut(left.where("src <> dst").distinct()), members


def _expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of nodes from pairs of representatives, and all pairs within each set."""
    src = members.select(F.col("rep").alias("src"), F.col("node").alias("_src"))
    dst = members.select(F.col("rep").alias("dst"), F.col("node").alias("_dst"))
    across = pairs.join(src, "src", "left").join(dst, "dst", "left").select(
        F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst"))
    within = members.select(F.col("node").alias("src"), "rep").join(
        members.select(F.col("node").alias("dst"), "rep"), "rep").select("src", "dst")
    return across.unionByName(within)


def _all_pairs(pairs: DataFrame) -> DataFrame:
    """Round k joins the pairs found last with all pairs, which doubles the covered distance: a
    pair at distance d in (2^k, 2^k+1] splits at step 2^k, whose first half was new in the last
    round. As soon as nodes of a cycle reach themselves the cycle becomes one node: its s nodes
    would else meet in s^3 joined rows. Its pairs are made at the end."""
    members = cut(pairs.sparkSession.createDataFrame([], pairs.schema).select(F.col("src").alias("node"), F.col("dst").alias("rep")))
    reached, delta = _Pairs(pairs), pairs
    for _ in range(MAX_ROUNDS):
        seen = delta.agg(F.count("*").alias("n"), F.count_if(F.col("src") == F.col("dst")).alias("loops")).first()
        if not seen["n"]:
            break
        if seen["loops"]:
            pairs, members = _contracted(reached.all(), members)
            reached, delta = _Pairs(pairs), pairs
        found = _new_pairs(delta, reached.all(), reached.all())
        reached.add(found)
        delta = found
    else:
        raise RuntimeError("closure did not end")
    return _expanded(reached.all(), members) if not members.isEmpty() else reached.all()


def closure(edges: DataFrame, min_hops: int = 1, reverse: bool = False,
            starts: DataFrame | None = None) -> DataFrame:
    """(src, dst) reachable in at least `min_hops` steps.

    `starts` (src) is the normal form: the frontier walks edge by edge from the sources asked
    for, and the work stays with them. Without it all pairs are made, which grow with the square
    of what hangs together; see `_all_pairs`. Rounds append what they find.
    """
    pairs = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    if reverse:
        pairs = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    pairs = cut(pairs.distinct())
    if starts is None:
        out = _all_pairs(pairs)
    else:
        delta = cut(pairs.join(starts.select("src").distinct(), "src", "left_semi"))
        reached = _Pairs(delta)
        while not delta.isEmpty():
            delta = _new_pairs(delta, pairs, reached.all())
            reached.add(delta)
        out = reached.all()
    if min_hops == 0:
        nodes = pairs.select(F.explode(F.array("src", "dst")).alias("n")) if starts is None else (
            starts.select(F.col("src").alias("n")))
        out = out.union(nodes.select("n", F.col("n").alias("m"))).distinct()
    return out


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """(child, parent) of the nodes that lie on cycles of a map child -> parent.

    Round k keeps the image of 2^k steps and the map on it. Chains that end at a root leave
    the domain, tails drop out, and the image stops shrinking exactly when only cycles are
    left: then 2^k steps permute it.
    """
    base = cut(edges.select("child", "parent").where("parent IS NOT NULL"))
    step, size = base, base.count()
    for _ in range(MAX_ROUNDS):
        image = step.select(F.col("parent").alias("node")).distinct()
        hop = step.select(F.col("child").alias("node"), F.col("parent").alias("mid"))
        again = step.select(F.col("child").alias("mid"), F.col("parent").alias("far"))
        step = cut(image.join(hop, "node").join(again, "mid").select(
            F.col("node").alias("child"), F.col("far").alias("parent")))
        left = step.count()
        if left == size:
            break
        size = left
    else:
        raise RuntimeError("cycle search did not end")
    on = step.select(F.col("child").alias("node"))
    return base.join(on, F.col("child") == F.col("node"), "left_semi")


def cycle_names(on_cycles: DataFrame) -> DataFrame:
    """(child, cycle): every node with the smallest node of its cycle, by pointer doubling."""
    state = cut(on_cycles.select("child", F.col("parent").alias("hop"),
                                 F.least("child", "parent").alias("cycle")))
    total, covered = state.count(), 1
    while covered < total:
        other = state.select(F.col("child").alias("at"), F.col("hop").alias("far"),
                             F.col("cycle").alias("low"))
        state = cut(state.join(other, F.col("hop") == F.col("at")).select(
            "child", F.col("far").alias("hop"), F.least("cycle", "low").alias("cycle")))
        covered *= 2
    return state.select("child", "cycle")


def break_cycles(edges: DataFrame, weight: DataFrame, short_form: Column) -> DataFrame:
    """The parent map without the parent edge of each cycle's root.

    The root is the node with the largest `weight` (child, n), then the smallest
    `short_form` of `child`.
    """
    on_cycles = cut(cycle_nodes(edges))
    ranked = cycle_names(on_cycles).join(weight, "child", "left").withColumn("_short", short_form)
    order = F.struct((-F.coalesce("n", F.lit(0))).alias("a"), F.col("_short").alias("b"), "child")
    roots = ranked.groupBy("cycle").agg(F.min_by("child", order).alias("root"))
    return edges.join(roots, F.col("child") == F.col("root"), "left_anti")
