"""Ordered running values over groups of any size, as prefix sums over ranges of rows.

A window over one group runs in one task, so a source that holds a third of all rows would stall
it. Here rows are dealt by ranges of (group, order, place), which a sample of the rows makes even,
whatever their values: sparse, dense or all tied. Every task runs through its range once, in
Arrow batches, and starts anew where the group changes. Only the group that a range begins with
can have come from the ranges before; what it brings along is found from the first and the last
row of each range, so the driver sees two rows per task. The rows are written once and read back
with what their range brings along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.plans.cut import cut

FIRST, LAST = 1, 2
MARKS = [T.StructField("_range", T.IntegerType()), T.StructField("_begun", T.BooleanType()), T.StructField("_mark", T.ByteType())]


class _Scan:
    """Running values of one range of ordered rows."""

    def __init__(self, keys: list[str], sums: list[str], carried: list[str], passed: list[str]):
        self.keys, self.sums, self.carried, self.passed = keys, sums, carried, passed
        self.last_key: list | None = None
        self.totals = [0] * len(sums)
        self.values: list[pa.Array | None] = [None] * len(carried)
        self.begun = True  # still in the group the range began with

    def _changes(self, batch: pa.RecordBatch) -> np.ndarray:
        """Rows whose group is not that of the row before."""
        n = batch.num_rows
        out = np.zeros(n, bool)
        first = [batch[k][0] for k in self.keys]
        out[0] = self.last_key is not None and first != self.last_key
        for k in self.keys:
            a, b = batch[k].slice(0, n - 1), batch[k].slice(1)
            same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            out[1:] |= ~same.to_numpy(zero_copy_only=False)
        self.last_key = [batch[k][n - 1] for k in self.keys]
        return out

    def run(self, batch: pa.RecordBatch) -> list[pa.Array]:
        changes = self._changes(batch)
        heads = np.flatnonzero(changes)
        group = np.cumsum(changes)
        out = []
        for i, name in enumerate(self.sums):
            values = pc.fill_null(batch[name], 0).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(values)
            before = np.concatenate(([-self.totals[i]], upto[heads] - values[heads]))
            running = upto - before[group]
            self.totals[i] = int(running[-1])
            out.append(pa.array(running))
        start = np.concatenate(([0], heads))[group]
        place = np.arange(batch.num_rows)
        for i, name in enumerate(self.carried):
            column = batch[name]
            held = self.values[i] if self.values[i] is not None else pa.nulls(1, column.type)
            filled = pc.is_valid(column).to_numpy(zero_copy_only=False)
            latest = np.maximum.accumulate(np.where(filled, place, -1))
            own = latest >= start
            # Place 0 is what came along, for rows of the group that goes on.
            taken = pa.concat_arrays([held, column]).take(pa.array(np.where(own, latest + 1, 0), mask=~own & (group > 0)))
            self.values[i] = taken.slice(batch.num_rows - 1, 1)
            out.append(taken)
        begun = (group == 0) & self.begun
        self.begun = bool(begun[-1])
        return [*[batch[c] for c in self.passed], *out, pa.array(begun)]


def running_values(frame: DataFrame, keys: list[str], order: str, sums: dict[str, Column] | None = None,
                   carried: dict[str, Column] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Several running sums and carried values of one order at once. Rows tied in the group, the
    order and the ties come in any order, but each once."""
    sums, carried, ties = sums or {}, carried or {}, ties or []
    made = [*sums, *carried]
    passed = [c for c in frame.columns if c not in made]
    work = frame.withColumns({**{f"_s_{n}": v.cast("long") for n, v in sums.items()},
                              **{f"_c_{n}": v for n, v in carried.items()}, "_place": F.monotonically_increasing_id()})
    by = [*keys, order, *ties, "_place"]
    fields = {f.name: f for f in work.schema.fields}
    types = [T.LongType() for _ in sums] + [fields[f"_c_{n}"].dataType for n in carried]
    schema = T.StructType([T.StructField(c, fields[c].dataType) for c in passed]
                          + [T.StructField(n, t) for n, t in zip(made, types)] + MARKS)
    names, summed, kept = schema.fieldNames(), [f"_s_{n}" for n in sums], [f"_c_{n}" for n in carried]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, state = TaskContext.get().partitionId(), _Scan(keys, summed, kept, passed)
        waiting, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            if waiting is not None:
                yield pa.RecordBatch.from_arrays(waiting, names=names)
            mark = np.zeros(batch.num_rows, np.int8)
            mark[0], first = (FIRST if first else 0), False
            *columns, begun = state.run(batch)
            waiting = [*columns, pa.array(np.full(batch.num_rows, part, np.int32)), begun, pa.array(mark)]
        if waiting is not None:
            mark = waiting[-1].to_numpy(zero_copy_only=False).copy()
            mark[-1] |= LAST
            yield pa.RecordBatch.from_arrays([*waiting[:-1], pa.array(mark)], names=names)

    scanned = cut(work.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(scan, schema))
    brought = _brought_along(scanned.where("_mark > 0").select(*keys, *made, *names[-3:]).collect(), keys, list(sums), list(carried))
    if not brought:
        return scanned.select(*passed, *made)
    along = frame.sparkSession.createDataFrame(brought, T.StructType(
        [T.StructField("_range", T.IntegerType())] + [T.StructField(f"_along_{n}", t) for n, t in zip(made, types)]))
    rows = scanned.join(along, "_range", "left")
    ours = F.col("_begun")
    return rows.select(*passed, *[F.when(ours, F.col(n) + F.coalesce(f"_along_{n}", F.lit(0))).otherwise(F.col(n)).alias(n) for n in sums],
                       *[F.when(ours, F.coalesce(n, f"_along_{n}")).otherwise(F.col(n)).alias(n) for n in carried])


def _brought_along(marks: list, keys: list[str], sums: list[str], carried: list[str]) -> list[tuple]:
    """For each range that goes on with the group of the one before: range, totals and values."""
    first = {r["_range"]: r for r in marks if r["_mark"] & FIRST}
    last = {r["_range"]: r for r in marks if r["_mark"] & LAST}
    out, key, totals, values = [], None, [], []
    for at in sorted(first):
        goes_on = key is not None and key == [first[at][k] for k in keys]
        if goes_on:
            out.append((at, *totals, *values))
        end = last[at]
        whole = goes_on and end["_begun"]
        totals = [end[n] + (t if whole else 0) for n, t in zip(sums, totals or [0] * len(sums))]
        values = [v if end[n] is None and whole else end[n] for n, v in zip(carried, values or [None] * len(carried))]
        key = [end[k] for k in keys]
    return out


def running_sum(frame: DataFrame, keys: list[str], order: str, value: Column, name: str,
                ties: list[str] | None = None) -> DataFrame:
    """Sum of `value` over the group's rows up to and including this one, NULL counting 0."""
    return running_values(frame, keys, order, {name: value}, None, ties)


def running_number(frame: DataFrame, keys: list[str], order: str, name: str, ties: list[str] | None = None) -> DataFrame:
    """1, 2, 3 … within the group in `order`."""
    return running_sum(frame, keys, order, F.lit(1), name, ties)


def carry_forward(frame: DataFrame, keys: list[str], order: str, carried: dict[str, Column],
                  ties: list[str] | None = None) -> DataFrame:
    """For each name, the latest non-NULL value at or before this row in the group."""
    return running_values(frame, keys, order, None, carried, ties)


SALTS = 64


def top_per_group(frame: DataFrame, keys: list[str], order: list, limit: int, name: str) -> DataFrame:
    """The first `limit` rows per group with their place.

    A group is first cut into salted parts, of which each keeps `limit` rows, so that no task
    ranks more than its share of a group and `SALTS` times the limit.
    """
    salt = F.pmod(F.xxhash64(*frame.columns), F.lit(SALTS))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    rows = (frame.withColumn("_salt", salt).withColumn("_p", F.row_number().over(part))
            .where(F.col("_p") <= limit).drop("_salt", "_p"))
    whole = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(whole)).where(F.col(name) <= limit)
