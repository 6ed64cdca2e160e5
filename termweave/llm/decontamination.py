"""Benchmark passages in documents: SimHash of item-sized windows, Hamming blocks, exact check.

Native: DataFrame functions only. Words are runs of letters and digits in lower case, so case
and punctuation do not hide a passage. The similarity of a window and an item is the weighted
Jaccard similarity of their shingles of five words, each weighted by how often it occurs.

1. Windows. For an item of L words the windows of a document are its runs of L words. A window
   can reach the similarity only if it shares enough shingles with items of that length (of two
   sets of n shingles, 8n/9 for 0.8). Windows that hold fewer are never fingerprinted; this
   drops nothing that the last step would keep.
2. Fingerprints. SimHash over the shingles of each such window, and of each item.
3. Blocks. 64 bits are cut into `RADIUS` + 1 blocks; fingerprints within the radius agree in one
   block at least, so a join on (length, block, its bits) finds every pair within the radius.
   At the least similarity two fingerprints differ in about 10 bits (deviation 3); the radius of
   24 lies five deviations beyond that.
4. Verification compares the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm.tables import boxed, unboxed, written
from termweave.llm.words import let, plain_words, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 24


def _simhash(hashes: Column) -> Column:
    """64 bits; bit b is 1 if it is set in more than half the hashes."""
    def bits(h: Column) -> Column:
        ones = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(
            2 * F.aggregate(h, F.lit(0), lambda n, x: n + F.getbit(x, b).cast("int")) > F.size(h),
            F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(ones, F.lit(0).cast("bigint"), lambda n, x: n.bitwiseOR(x))

    return let(hashes, bits)


def _numbered(hashes: Column) -> Column:
    """Each hash joined with how often it came before, so that sets of these are multisets."""
    return let(hashes, lambda a: F.transform(a, lambda h, i: F.xxhash64(
        h, F.size(F.filter(F.slice(a, 1, i), lambda x: x == h)))))


def _blocks(fp: Column, radius: int) -> Column:
    """The bits of each of radius + 1 blocks of nearly equal length, one entry for each block."""
    count = radius + 1
    cuts = [64 * k // count for k in range(count + 1)]
    return F.array(*[F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).cast("int")
                     for lo, hi in zip(cuts, cuts[1:])])


def _needed(a: Column, b: Column, similarity: float) -> Column:
    """Shingles that multisets of a and b must share for the similarity."""
    return F.ceil((a + b) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9)).cast("int")


def item_prints(items: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(item_id, length, size, n, marks, ifp) per item with a word; the shingle is as long as
    the item where that is shorter than `size`."""
    own = written(items.select("item_id", plain_words(F.col("text")).alias("_w"))).where(F.size("_w") > 0)
    length = F.size("_w")
    made = F.coalesce(*[F.when(length == s, shingle_hashes(F.col("_w"), s)) for s in range(1, size)],
                      shingle_hashes(F.col("_w"), size))
    own = written(own.select("item_id", length.alias("length"), F.least(F.lit(size), length).alias("size"), made.alias("_h")))
    return own.select("item_id", "length", "size", F.size("_h").alias("n"), "_h",
                      _numbered(F.col("_h")).alias("marks"), _simhash(F.col("_h")).alias("ifp"))


def _doc_shingles(docs: DataFrame, size: int) -> DataFrame:
    """Per row of `docs`: _id, _th and the hashes of all its shingles, in order."""
    return docs.select(F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"),
                       shingle_hashes(plain_words(F.col("text")), size).alias("_h"))


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE,
                 radius: int = RADIUS) -> DataFrame:
    """Pairs (doc_id, item_id) with the greatest similarity of a window, the place of that
    window in words, and the bits by which its fingerprint differs.

    Of windows that tie the first is given. A document shorter than an item is one window.
    NULL, empty and blank texts, of documents or items, match nothing. Items shorter than five
    words match where all their words occur in a row. Rows with the same doc_id, or the same
    item_id, count as one in the result; NULL ids are kept as ids. Empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id"), F.col("text"))
    prints = written(item_prints(items, size))
    # At most five sizes: 1 to `size` words.
    sizes = [r["size"] for r in prints.select("size").distinct().collect()]
    found = None
    for s in sorted(sizes):
        part = _matches(docs, prints.where(F.col("size") == s), s, similarity, radius)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = _matches(docs, prints, size, similarity, radius)
    best = F.struct(F.col("similarity"), (-F.col("start")).alias("s"), (-F.col("bits")).alias("b"))
    return (found.groupBy("doc_id", "item_id").agg(F.max(best).alias("m"))
            .select("doc_id", "item_id", F.col("m.similarity").alias("similarity"),
                    (-F.col("m.s")).alias("start"), (-F.col("m.b")).alias("bits")))


def _matches(docs: DataFrame, prints: DataFrame, size: int, similarity: float, radius: int) -> DataFrame:
    # 1. Places of the documents that hold a shingle of an item, by length of the item.
    lists = written(prints.select("length", "n", F.explode_outer("_h").alias("h")).distinct())
    places = _doc_shingles(docs, size).select("_id", "_th", F.size("_h").alias("_k"), F.posexplode_outer("_h").alias("pos", "h"))
    hits = places.join(lists, "h")
    runs = hits.groupBy("_id", "_th", "_k", "length", "n").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    # A window has as many shingles as the item, or all that a shorter document has.
    own = F.least(F.col("n"), F.col("_k"))
    runs = runs.withColumn("m", own).withColumn("need", _needed(F.col("n"), F.col("m"), similarity)).where(
        (F.size("p") >= F.col("need")) & (F.col("need") <= F.col("m")))
    # The need-th place from p[i] on must lie in the window too.
    spans = let(F.col("p"), lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - F.col("need")), lambda i: F.struct(
        F.greatest(F.get(p, i + F.col("need") - 1) - F.col("m") + 1, F.lit(0)).alias("lo"),
        F.least(F.get(p, i), F.col("_k") - F.col("m")).alias("hi"))))
    spans = F.filter(spans, lambda s: s["lo"] <= s["hi"])
    starts = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["lo"], s["hi"]))))
    wanted = written(runs.select("_id", "_th", "length", "n", "m", starts.alias("starts"))).where(F.size("starts") > 0)
    # 2. The few documents with such windows are read again for their shingles.
    ids = wanted.select("_id", "_th").distinct()
    again = docs.withColumn("_th", F.xxhash64(F.coalesce("text", F.lit("")))).join(
        ids.withColumnRenamed("_id", "_i").withColumnRenamed("_th", "_t"),
        F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")), "left_semi").select("doc_id", "text")
    held = _doc_shingles(again, size).select("_id", "_th", "_h")
    windows = wanted.alias("w").join(held.alias("d"), F.col("w._id").eqNullSafe(F.col("d._id")) & (F.col("w._th") == F.col("d._th")))
    windows = windows.select("w._id", "length", "m", F.explode_outer("starts").alias("start"), F.col("_h")).select(
        "_id", "length", "start", F.slice("_h", F.col("start") + 1, F.col("m")).alias("wh"))
    windows = written(windows.select("_id", "length", "start", _numbered(F.col("wh")).alias("wm"), _simhash(F.col("wh")).alias("wfp")))
    # 3. Blocks, then the radius; a pair that agrees in several blocks is looked at once.
    left = windows.select("*", F.posexplode_outer(_blocks(F.col("wfp"), radius)).alias("block", "v"))
    right = prints.select("item_id", F.col("length"), "marks", "ifp", F.posexplode_outer(_blocks(F.col("ifp"), radius)).alias("block", "v"))
    pairs = left.join(right, ["length", "block", "v"])
    equal = F.zip_with(_blocks(F.col("wfp"), radius), _blocks(F.col("ifp"), radius), lambda x, y: x == y)
    bits = F.bit_count(F.col("wfp").bitwiseXOR(F.col("ifp")))
    pairs = pairs.where(bits <= radius).where(F.array_position(equal, F.lit(True)) == F.col("block") + 1)
    # 4. Exact similarity.
    both = F.size(F.array_intersect("wm", "marks"))
    share = both / (F.size("wm") + F.size("marks") - both)
    return pairs.select(F.col("_id").alias("doc_id"), "item_id", share.alias("similarity"), F.col("start").cast("long").alias("start"),
                        bits.cast("long").alias("bits")).where(F.col("similarity") >= similarity - 1e-12)


def decontaminate(docs: DataFrame, items: DataFrame, **options: object) -> DataFrame:
    """The documents without those that hold a benchmark passage; rows with a NULL doc_id that
    hold one go too. Columns are those of `docs`."""
    bad = contaminated(docs, items, **options).select(F.col("doc_id").alias("bad")).distinct()
    rows = boxed(docs, "doc_id").join(bad, F.col("doc_id").eqNullSafe(F.col("bad")), "left_anti")
    return unboxed(rows, docs.columns)
