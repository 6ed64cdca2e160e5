"""SimHash near-duplicates: an inverted index on byte positions with count filtering.

Two 64-bit fingerprints that differ in at most four bits differ in at most four of their eight
bytes, so they share at least four positional bytes. The index lists fingerprints under what
they hold at three byte positions. The twenty triples in `TRIPLES` are such that every four of
the eight positions contain at least one of them, so every pair that shares four positional
bytes meets in some list. There the shared positional bytes of a pair are tallied, pairs that
reach four are retained, and their bits are compared.

Lists are compared in blocks of bounded size, and a block gives back a spanning forest of the
links it found, never all its pairs: what a fingerprint shared by a third of all documents or a
thousand near copies cost is bounded in every task, and the components are the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm.components import components
from termweave.llm.tables import boxed, tidied, unboxed, written

SHINGLE = 4
SEED = 42
RADIUS = 4
LEAST_SHARED = 8 - RADIUS
BLOCK = 1024


def cover(size: int, within: int, of: int) -> list[tuple[int, ...]]:
    """Sets of `size` places such that every `within` of the `of` places contain one of them:
    the sets that lie in one part, or two in a part and one in the next, of three parts."""
    part = [p * 3 // of for p in range(of)]

    def taken(c: tuple[int, ...]) -> bool:
        k = [sum(part[p] == q for p in c) for q in range(3)]
        return 3 in k or any(k[q] == 2 and k[(q + 1) % 3] == 1 for q in range(3))

    chosen = [c for c in combinations(range(of), size) if taken(c)]
    assert all(any(set(c) <= set(w) for c in chosen) for w in combinations(range(of), within))
    return chosen


TRIPLES = cover(3, LEAST_SHARED, 8)


def fingerprint(text: str | None) -> int:
    """SimHash of the 4-word shingles of a text, repeats included; 0 for a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles: Iterable[bytes] = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) per row of `docs`, fp as a signed long."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = np.array([fingerprint(t) for t in batch["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": prints.view(np.int64)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(tidied(run), "doc_id long, fp long")


def postings(prints: DataFrame) -> DataFrame:
    """(key, fp): each distinct fingerprint under its three bytes at each triple of positions."""
    def byte(p: int):
        return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))

    keys = [F.lit(n << 24) + F.shiftleft(byte(a), 16) + F.shiftleft(byte(b), 8) + byte(c)
            for n, (a, b, c) in enumerate(TRIPLES)]
    return prints.select("fp", F.explode(F.array(*keys)).alias("key"))


def _linked(prints: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links within a block; with two sides, links across them."""
    n = len(prints)
    diff = prints[:, None] ^ prints[None, :]
    octets = np.ascontiguousarray(diff).view(np.uint8).reshape(n, n, 8) if n <= 64 else None
    if octets is not None:
        shared = (octets == 0).sum(axis=2)
    else:
        shared = sum(((diff >> np.uint64(8 * p)) & np.uint64(255)) == 0 for p in range(8))
    near = (shared >= LEAST_SHARED) & (np.bitwise_count(diff) <= RADIUS)
    if side.any() and not side.all():
        near &= side[:, None] != side[None, :]
    out, seen = [], np.zeros(n, bool)
    for start in np.flatnonzero(near.any(axis=1)):
        front = [] if seen[start] else [start]
        seen[start] = True
        while front:
            i = front.pop()
            new = np.flatnonzero(near[i] & ~seen)
            seen[new] = True
            out += [(int(i), int(j)) for j in new]
            front.extend(new)
    return out


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by block; a block may run over the end of a batch."""
    rest: pd.DataFrame | None = None

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        key = frame[["key", "lo", "hi"]].to_numpy()
        prints, side = frame["fp"].to_numpy(np.int64).view(np.uint64), (frame["own"] != frame["lo"]).to_numpy()
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(frame)])
        pairs: list[tuple[int, int]] = []
        two = starts[sizes == 2]
        a, b = prints[two], prints[two + 1]
        ok = np.bitwise_count(a ^ b) <= RADIUS
        left, right = [a[ok]], [b[ok]]
        for at, size in zip(starts[sizes > 2], sizes[sizes > 2]):
            pairs += [(at + i, at + j) for i, j in _linked(prints[at:at + size], side[at:at + size])]
        if pairs:
            places = np.array(pairs)
            left.append(prints[places[:, 0]])
            right.append(prints[places[:, 1]])
        return pd.DataFrame({"a": np.concatenate(left).view(np.int64), "b": np.concatenate(right).view(np.int64)})

    for batch in batches:
        if len(batch) == 0:
            continue
        frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        last = frame[["key", "lo", "hi"]].iloc[-1]
        open_ = ((frame["key"] == last["key"]) & (frame["lo"] == last["lo"]) & (frame["hi"] == last["hi"])).to_numpy()
        first = int(np.argmax(open_))
        rest, done = frame.iloc[first:].reset_index(drop=True), frame.iloc[:first]
        if len(done):
            yield links(done)
    if rest is not None:
        yield links(rest)


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between the distinct fingerprints of `prints` (column fp, unique) whose
    components are those of all pairs within the radius."""
    listed = postings(prints)
    # Most lists hold one fingerprint and are dropped here; a list longer than a block is split
    # into blocks by hash, and every two of its blocks are compared.
    counted = listed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(
        "key", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks"))
    met = listed.join(counted, "key").withColumn("own", F.pmod(F.hash("fp"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = met.select("key", "fp", "own", other.alias("_o")).select(
        "key", "fp", "own", F.least("own", "_o").alias("lo"), F.greatest("own", "_o").alias("hi"))
    sorted_ = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return sorted_.mapInPandas(tidied(_compare), "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed long) and component_id, the least doc_id reachable over links.

    Texts are lower-cased in A-Z only. NULL, empty and blank texts have fingerprint 0 and are
    linked like any other. Repeated rows each get a row; a NULL doc_id has a component but
    never names one, unless all of the component are NULL. An empty table gives no rows. Other
    columns are not returned.
    """
    marked = written(fingerprints(docs))
    least = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = written(components(written(links(least.select("fp")))))
    root = F.coalesce("root", "fp")
    named = written(least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", root.alias("root")))
    lead = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = written(named.join(lead, "root").select("fp", "component_id"))
    return marked.join(of_print, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates: of each component the row with the least doc_id.

    Among rows that repeat that doc_id, one stays: the one with the greatest text hash, and of
    equal rows any. Rows with a NULL doc_id stay, as they can't be named by a component. The
    columns are those of `docs`.
    """
    groups = near_duplicates(docs)
    lead = written(groups.where("doc_id = component_id").select(F.col("doc_id").alias("lead")).distinct())
    rows = boxed(docs, "doc_id", "text")
    kept = rows.where("doc_id is not null").join(lead, F.col("doc_id") == F.col("lead"), "left_semi")
    place = Window.partitionBy("doc_id").orderBy(F.xxhash64(F.coalesce("text", F.lit(""))).desc())
    once = kept.withColumn("place", F.row_number().over(place)).where("place = 1").drop("place")
    return unboxed(once.unionByName(rows.where("doc_id is null")), docs.columns)
