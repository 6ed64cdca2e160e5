"""Exact k-means over integer vectors by an incremental distance matrix.

A vector is kept with its dot products with all centroids, as exact integers. When centroids
move, only the components that changed are multiplied and added; the squared distances
|v|^2 - 2 v.c + |c|^2 then follow from the dot products, and the smallest is chosen anew.

The matrix is a table in the shared folder, one row per vector with `k` numbers, written once a
round; the table of the round before is deleted as soon as the next one stands. No step needs a
shuffle but the sums per cluster, which are added in every task first. The driver holds `k`
centroids and `k` rows of sums, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.tables import drop_path, new_path

SCALE = 256
DIMENSION = 64
CENTROIDS = 40
ROUNDS = 5
SEED = 2
LARGEST = 1 << 27  # components below this keep distances of 64 of them within 64 bits

STATE = "vec_id long, v array<int>, dots array<long>, cluster int, distance long"
RESULT = ("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
          "centroid_sha256 string")


def integer_vectors(vectors: DataFrame, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component x, for the vectors that have exactly
    `dimension` components, none NULL, NaN or infinite. Others are left out."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long"), x.cast("array<double>").alias("embedding")).where(
        (F.size("embedding") == dimension) & ~bad)
    large = F.raise_error(F.lit(f"a component of {LARGEST} or more after scaling"))
    whole = F.transform("embedding", lambda c: F.when(F.abs(c * scale) >= LARGEST, large.cast("int")).otherwise(
        F.floor(c * scale).cast("int")))
    return kept.select("vec_id", whole.alias("v"))


def added_dots(v: np.ndarray, dots: np.ndarray, change: np.ndarray) -> np.ndarray:
    """The dot products after centroid c moved by change[c]: only components that changed count."""
    for c, delta in enumerate(change):
        moved = np.flatnonzero(delta)
        if len(moved):
            dots[:, c] += v[:, moved] @ delta[moved]
    return dots


def nearest(v: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller of equal ones, and the squared distance."""
    distances = (v * v).sum(axis=1)[:, None] - 2 * dots + (centroids * centroids).sum(axis=1)
    chosen = distances.argmin(axis=1)
    return chosen, distances[np.arange(len(v)), chosen]


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).reshape(-1), kind))


def _advanced(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """The state after the centroids moved from `old` to `new`; a state without dots begins at 0."""
    k, dimension = new.shape
    first = "dots" not in state.columns

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dimension)
            dots = np.zeros((n, k), np.int64) if first else np.array(
                batch.column("dots").flatten().to_numpy(zero_copy_only=False), np.int64).reshape(n, k)
            dots = added_dots(v, dots, new - old)
            cluster, distance = nearest(v, dots, new)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), _lists(v, pa.int32()), _lists(dots, pa.int64()),
                 pa.array(cluster.astype(np.int32)), pa.array(distance)],
                names=["vec_id", "v", "dots", "cluster", "distance"])

    return state.mapInArrow(move, STATE)


def seeds(kept: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors whose id hashes lowest, in order of the hash. Rows of equal ids go by their
    components; a NULL id is hashed as an empty text."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimension: int = DIMENSION,
                    scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, v, dots, cluster, distance) after `rounds` rounds and a last assignment, and
    the final centroids.

    Each kept row is a vector of its own, also where its vec_id is repeated or NULL. With fewer
    than `k` vectors every one is a centroid; without any there are no rows and no centroids.
    Equal distances go to the smaller number; a centroid without vectors stays. A component of
    2^27 or more in size after scaling is an error, as distances would leave 64 bits.
    """
    spark = vectors.sparkSession
    kept_path = new_path(spark, "vectors")
    integer_vectors(vectors, dimension, scale).write.parquet(kept_path)
    state = spark.read.schema("vec_id long, v array<int>").parquet(kept_path)
    new = seeds(state, k, seed)
    if not len(new):
        return spark.createDataFrame([], STATE), new
    old, path = np.zeros_like(new), kept_path
    sums = [F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(dimension)]
    for last in [False] * rounds + [True]:
        before, path = path, new_path(spark, "distances")
        _advanced(state, old, new).write.parquet(path)
        state = spark.read.schema(STATE).parquet(path)
        drop_path(spark, before)
        if last:
            break
        old, new = new, new.copy()
        for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # k rows at most
            new[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dimension)]
    return state, new


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimension: int = DIMENSION,
             scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every
    kept vector; see `cluster_vectors` for edge cases. An empty table gives no rows."""
    spark = vectors.sparkSession
    state, final = cluster_vectors(vectors, k, rounds, dimension, scale, seed)
    if not len(final):
        return spark.createDataFrame([], RESULT)
    by_cluster = state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()  # k rows at most
    total = sum(r["d"] for r in by_cluster)
    facts = [(r["cluster"], r["d"], total, digest(final[r["cluster"]])) for r in by_cluster]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(known), "cluster").select(*[c.split()[0] for c in RESULT.split(", ")])


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()
