"""Texts cut into name runs and single other characters.

An identifier is a fixed row of pieces, and it occurs in a text as a whole token exactly
where that row occurs. So whole-token search is an equi-join on short rows of pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions.text import EDIT_NAME
from termweave.plans.cut import cut

# Fixed value: ids that may be sent to every task; a broadcast is sized by compressed files, in
# which names that differ by a number take next to nothing.
FEW_IDS = 50_000

_PIECE = rf"[{EDIT_NAME}]+|[^{EDIT_NAME}]"


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s)({_PIECE})"), F.lit(1))


def _rows_of(text_pieces: Column, sizes: Column) -> Column:
    """(at, n, token) of every row of n pieces that could be an identifier (has a colon)."""
    count = F.size(text_pieces)

    def of_size(n: Column) -> Column:
        starts = F.when(count >= n, F.sequence(F.lit(1), count - n + 1)).otherwise(
            F.expr("cast(array() AS array<int>)"))
        return F.transform(starts, lambda at: F.struct(
            at.alias("at"), n.alias("n"),
            F.array_join(F.slice(text_pieces, at, n), "").alias("token"),
            F.coalesce(F.get(text_pieces, at - 2), F.lit("")).alias("before"),
            F.coalesce(F.get(text_pieces, at + n - 1), F.lit("")).alias("next")))

    found = F.flatten(F.transform(sizes, of_size))
    name = f"[{EDIT_NAME}]"
    return F.filter(found, lambda c: F.contains(c["token"], F.lit(":")) & (
        c["token"].rlike(f"{name}$") | ~c["next"].rlike(f"^{name}")))


def occurrences(rows: DataFrame, keys: list[str], text_col: str, ids: DataFrame,
                id_col: str = "id", around: bool = False) -> DataFrame:
    """(keys, at, n, id, + other columns of `ids`): whole-token occurrences of the ids.

    `around` adds the pieces `before` and `next` to each occurrence.
    `ids` has one row per id. The work is pieces x distinct id sizes (one for plain compact
    names), whatever the number of ids.
    """
    ids = cut(ids)
    if ids.count() > FEW_IDS:
        ids = ids.hint("merge")
    sizes = ids.agg(F.sort_array(F.collect_set(F.size(pieces(F.col(id_col)))))).scalar()
    sliced = rows.select(*keys, pieces(F.col(text_col)).alias("_p")).withColumn("_sizes", sizes)
    offered = sliced.select(*keys, F.inline(_rows_of(F.col("_p"), F.col("_sizes"))))
    if not around:
        offered = offered.drop("before", "next")
    return offered.withColumnRenamed("token", id_col).join(ids, id_col)


def rewritten(text_pieces: Column, changes: Column) -> Column:
    """Text after replacing (at, n, new) rows of pieces; the earliest, longest change wins."""
    ordered = F.array_sort(changes, lambda a, b: F.when(a["at"] != b["at"], a["at"] - b["at"])
                           .otherwise(b["n"] - a["n"]))
    start = F.struct(F.lit(1).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        kept = F.array_join(F.slice(text_pieces, acc["pos"], c["at"] - acc["pos"]), "")
        return F.when(c["at"] < acc["pos"], acc).otherwise(F.struct(
            (c["at"] + c["n"]).alias("pos"), F.concat(acc["out"], kept, c["new"]).alias("out")))

    def finish(acc: Column) -> Column:
        rest = F.slice(text_pieces, acc["pos"], F.greatest(F.size(text_pieces) - acc["pos"] + 1, F.lit(0)))
        return F.concat(acc["out"], F.array_join(rest, ""))

    return F.aggregate(ordered, start, step, finish)


def applied_changes(text_pieces: Column, changes: Column) -> Column:
    """Number of changes `rewritten` applies (overlapping ones are passed over)."""
    ordered = F.array_sort(changes, lambda a, b: F.when(a["at"] != b["at"], a["at"] - b["at"])
                           .otherwise(b["n"] - a["n"]))
    start = F.struct(F.lit(1).alias("pos"), F.lit(0).alias("k"))
    return F.aggregate(ordered, start, lambda acc, c: F.when(c["at"] < acc["pos"], acc).otherwise(
        F.struct((c["at"] + c["n"]).alias("pos"), (acc["k"] + 1).alias("k"))), lambda acc: acc["k"])
