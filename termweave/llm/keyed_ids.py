"""Token ids of documents in binary files, with keyed access by minimal perfect hashing.

An archive is a folder of the shared store:

* `shards/`  binary files: 16 bytes of header (magic, width of an id), then the raw ids of
  documents one after another, as unsigned little-endian integers. Shards follow each other in
  ascending order of doc_id (NULL first; rows of one doc_id in the order of the table).
* `keys`     (doc_id, copy, part, start, n_tokens) as written; copy counts rows of one doc_id.
* `manifest` one row per shard: part, file, start (ids in all shards before it).
* `index`    buckets of the keys: a minimal perfect hash of a bucket's keys, and for each slot
  a fingerprint, the shard, the place and the number of ids.

To write, the table is dealt by ranges of (doc_id, place), so that neither a frequent doc_id nor
many copies make a large task, and every task streams its rows into one shard. A lost or repeated
task writes a file of another name; only files that its committed rows name belong to the archive.
Keyed access hashes the keys, finds each one's slot in its bucket in constant time, drops foreign
keys by the fingerprint, and reads exactly those ids; reads are sorted by shard and place.

The driver holds one row per shard, never one per document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.perfect_hash import NONE, PerfectHash, fingerprints
from termweave.llm.tables import written
from termweave.llm.word_ids import word_ids

MAGIC = b"TWIDS\x00\x01"
HEADER = 16
END_ID = 2
BUCKET = 4096  # keys of a bucket, about
FLUSH = 8 << 20  # bytes of ids handed on at once

KEYS = "doc_id long, copy long, part int, file string, start long, n_tokens long"
SLOT = np.dtype([("fingerprint", "<u4"), ("part", "<i4"), ("start", "<i8"), ("n_tokens", "<i8")])


@cache
def _store(folder: str):
    """File system and path of a folder, by its URI; a path without scheme is a local one."""
    from pyarrow import fs

    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:"):]
    return fs.FileSystem.from_uri(folder)


def _created(folder: str, name: str):
    files, base = _store(folder)
    files.create_dir(f"{base}/shards", recursive=True)
    return files.open_output_stream(f"{base}/shards/{name}", buffer_size=1 << 20)


def _opened(folder: str, name: str):
    files, base = _store(folder)
    return files.open_input_file(f"{base}/shards/{name}")


def write_archive(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> None:
    """Write the ids of every whole text, each with `end_id` after it.

    NULL and empty texts have the end id only. Rows with the same or a NULL doc_id are documents
    of their own, told apart by `copy` (0, 1, ...). An empty table gives an archive without
    shards. Other columns of `docs` are not read.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, out, at, last, copy = word_ids(tokenizer), None, 0, (), 0
        end = np.array([end_id], ids.kind).tobytes()
        part, name = TaskContext.get().partitionId(), f"ids-{uuid.uuid4().hex}"
        for batch in batches:
            rows = []
            if out is None and batch.num_rows:
                out = _created(folder, name)
                out.write((MAGIC + bytes([ids.width])).ljust(HEADER, b"\0"))
            for i in range(batch.num_rows):
                doc = batch["doc_id"][i].as_py()
                data = ids.ids(batch["text"][i].as_py() or "") + end
                copy, last = (copy + 1, last) if last == (doc,) else (0, (doc,))
                rows.append((doc, copy, at, len(data) // ids.width))
                at += len(data) // ids.width
                out.write(data)
            if rows:
                doc_id, copies, starts, sizes = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_id, pa.int64()), pa.array(copies, pa.int64()), pa.array([part] * len(rows), pa.int32()),
                     pa.array([name] * len(rows)), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())],
                    names=[f.split()[0] for f in KEYS.split(", ")])
        if out is not None:
            out.close()

    placed = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("place"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("place").asc()]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    entries = written(dealt.mapInArrow(run, KEYS))
    manifest = _manifest(entries)
    spark.createDataFrame(manifest, "part int, file string, start long, first_id long, carried long").write.parquet(f"{folder}/manifest")
    # Copies go on from the shard before where a doc_id does.
    shards = spark.read.parquet(f"{folder}/manifest").select("part", "first_id", "carried")
    goes_on = F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.col("carried")).otherwise(0)
    keys = entries.join(shards, "part").select("doc_id", (F.col("copy") + goes_on).alias("copy"), "part", "start", "n_tokens")
    keys.write.parquet(f"{folder}/keys")
    _build_index(spark.read.parquet(f"{folder}/keys"), folder)


def _manifest(entries: DataFrame) -> list[tuple]:
    """Of each shard: part, file, ids before it, its first doc_id, and how many rows of that
    doc_id lie in the shards before it. One row per shard comes to the driver."""
    ends = entries.groupBy("part", "file").agg(
        F.sum("n_tokens").alias("tokens"), F.min_by("doc_id", "start").alias("first"),
        F.max(F.struct("start", "doc_id", "copy")).alias("last"))
    out, start, before, carried = [], 0, (), 0
    for r in sorted(ends.collect(), key=lambda r: r["part"]):
        carried = carried if before == (r["first"],) else 0
        out.append((r["part"], r["file"], start, r["first"], carried))
        start += r["tokens"]
        rows = r["last"]["copy"] + 1
        carried = rows + (carried if r["last"]["doc_id"] == r["first"] else 0)
        before = (r["last"]["doc_id"],)
    return out


def _hashed(keys: DataFrame, buckets: int) -> DataFrame:
    """The key's two hashes and its bucket. NULL is a key of its own."""
    parts: list[Column] = [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("copy")]
    first = F.xxhash64(*parts)
    return keys.withColumns({"h1": first, "h2": F.xxhash64(F.lit("second"), *parts),
                             "bucket": F.pmod(F.xxhash64(F.lit("bucket"), first), F.lit(buckets))})


def _unsigned(column: pd.Series) -> np.ndarray:
    return np.ascontiguousarray(column.to_numpy(np.int64)).view(np.uint64)


def _build_index(keys: DataFrame, folder: str) -> None:
    buckets = max(1, -(-keys.count() // BUCKET))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = _unsigned(rows.h1), _unsigned(rows.h2)
        made = PerfectHash.build(h1, h2)
        slots = np.empty(len(rows), SLOT)
        at = made.slots(h1, h2)
        for name in ("part", "start", "n_tokens"):
            slots[name][at] = rows[name].to_numpy()
        slots["fingerprint"][at] = fingerprints(h1, h2)
        return pd.DataFrame({"bucket": [key[0]], "buckets": [buckets], "hash": [made.to_bytes()], "slots": [slots.tobytes()]})

    hashed = _hashed(keys, buckets).select("bucket", "h1", "h2", "part", "start", "n_tokens")
    hashed.groupBy("bucket").applyInPandas(build, "bucket long, buckets long, hash binary, slots binary").write.parquet(f"{folder}/index")


def locate(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """(doc_id, copy, part, start, n_tokens) of the keys (doc_id, copy) that the archive holds,
    from the index. A foreign key passes with a chance of one in 2^32. Keys must be distinct."""
    index = spark.read.parquet(f"{folder}/index")
    buckets = index.agg(F.max("buckets").alias("n")).first()["n"] or 1
    asked = _hashed(keys.select(F.col("doc_id").cast("long"), F.col("copy").cast("long")), buckets).select(
        "bucket", "h1", "h2", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "copy")

    def probe(rows: pd.DataFrame, blobs: pd.DataFrame) -> pd.DataFrame:
        out = rows[["none", "doc_id", "copy"]].copy()
        if not len(blobs) or not len(rows):
            return out.iloc[:0].assign(part=0, start=0, n_tokens=0)
        h1, h2 = _unsigned(rows.h1), _unsigned(rows.h2)
        slots = np.frombuffer(blobs["slots"].iloc[0], SLOT)
        at = PerfectHash.from_bytes(blobs["hash"].iloc[0]).slots(h1, h2)
        known = at != NONE
        known[known] = slots["fingerprint"][at[known]] == fingerprints(h1[known], h2[known])
        found = slots[at[known]]
        return out[known].assign(**{n: found[n].astype(np.int64) for n in ("part", "start", "n_tokens")})

    found = asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(
        probe, "none boolean, doc_id long, copy long, part int, start long, n_tokens long")
    return found.select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "copy", "part", "start", "n_tokens")


def read_ids(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """(doc_id, copy, start, n_tokens, ids) of the distinct keys that the archive holds: start
    counts the ids of all documents before, ids are little-endian unsigned 32-bit integers."""
    manifest = spark.read.parquet(f"{folder}/manifest").select("part", "file", F.col("start").alias("before"))
    wanted = locate(spark, folder, keys).join(manifest, "part").repartition("part").sortWithinPartitions("part", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source, width = None, None, 0
        for batch in batches:
            files, starts, sizes = (batch[c].to_pylist() for c in ("file", "start", "n_tokens"))
            held, size, first = [], 0, 0
            for i, (file, start, n) in enumerate(zip(files, starts, sizes)):
                if file != name:
                    name, source = file, _opened(folder, file)
                    head = source.read_at(HEADER, 0)
                    if head[:len(MAGIC)] != MAGIC:
                        raise ValueError(f"{file} is no shard of ids")
                    width = head[len(MAGIC)]
                data = np.frombuffer(source.read_at(n * width, HEADER + start * width), f"<u{width}").astype("<u4")
                held.append(data.tobytes())
                size += len(held[-1])
                if size > FLUSH or i == len(files) - 1:
                    rows = batch.slice(first, len(held))
                    starts_ = pa.compute.add(rows["start"], rows["before"])
                    yield pa.RecordBatch.from_arrays(
                        [rows["doc_id"], rows["copy"], starts_, rows["n_tokens"], pa.array(held, pa.binary())],
                        names=["doc_id", "copy", "start", "n_tokens", "ids"])
                    held, size, first = [], 0, i + 1

    return wanted.select("doc_id", "copy", "file", "before", "start", "n_tokens").mapInArrow(
        run, "doc_id long, copy long, start long, n_tokens long, ids binary")


def all_keys(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, copy) of every document of an archive."""
    return spark.read.parquet(f"{folder}/keys").select("doc_id", "copy")


def round_trip(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Write an archive, then read every document back by its key; see `write_archive`."""
    write_archive(docs, tokenizer, folder, end_id)
    return read_ids(docs.sparkSession, folder, all_keys(docs.sparkSession, folder))
