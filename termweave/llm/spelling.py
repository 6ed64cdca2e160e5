"""Spelling variants: words one edit apart, grouped under their most frequent form.

Words one edit apart agree in the first or in the last half of either. So every word is dealt to
blocks by its halves, and also by the shorter or longer beginning and end that a word one symbol
shorter or longer would call its half. Each block builds a bidirectional FM-index of its words
(`fm_index`) and searches it for the words that ask there. The number of blocks grows with the
vocabulary, and the rows of a block are bounded: a half that many words share is cut into parts,
and its words ask in every part.

Words are counted by Spark alone; the vocabulary is never in one place.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm.fm_index import LEFT, RIGHT, WordIndex
from termweave.llm.tables import written
from termweave.llm.words import lower_ascii

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
BLOCK = 8192  # rows of a block, about
PART = 2048  # words of a half that are not cut further
NOISE = 199  # one in so many (document, run) pairs loses a symbol

RESULT = ["word", "form", "root", "n", "n_near", "form_n"]


def noisy_run(doc_id: Column, run: Column, every: int = NOISE) -> Column:
    """The run without its symbol crc32 % length, where `every` divides crc32 of `doc_id:run`."""
    h = F.crc32(F.concat_ws(":", doc_id.cast("string"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n): how often each word of whole texts occurs. A NULL text has no words; a NULL
    doc_id counts as an empty one in the crc32. Shorter and rarer words are left out."""
    runs = F.filter(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0)), lambda r: F.length(r) >= least_length)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(runs).alias("run"))
    lower = F.when(F.col("run").rlike("[A-Z]"), lower_ascii(F.col("run"))).otherwise(F.col("run"))
    words = rows.select(noisy_run(F.col("doc_id"), lower, noise).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _places(least_length: int) -> Column:
    """Where a word is looked for: (side, half, asks). It asks by its own halves."""
    size = F.length("word")
    sizes = [F.greatest(size - 1, F.lit(least_length)), size, size + 1]

    def at(side: int, length: Column, asks: Column) -> Column:
        half = F.substring("word", F.lit(1), length) if side == LEFT else F.substring("word", size - length + 1, length)
        return F.struct(F.lit(side).alias("side"), half.alias("half"), asks.alias("asks"))

    def half_length(side: int, of: Column) -> Column:
        return F.floor(of / 2).cast("int") if side == LEFT else F.ceil(of / 2).cast("int")

    every = [at(side, half_length(side, s), half_length(side, s) == half_length(side, size)) for side in (LEFT, RIGHT) for s in sizes]
    return F.array_distinct(F.array(*every))


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(word, near, near_n): all pairs of words (word, n; distinct, of `least_length` symbols or
    more) that differ by one inserted, deleted or replaced symbol, in both directions."""
    total = words.count()
    blocks = max(1, -(-4 * total // block))
    placed = words.select("word", "n", F.inline(_places(least_length)))
    crowded = placed.groupBy("side", "half").agg(F.count("*").alias("rows")).where(F.col("rows") > part)
    crowded = written(crowded.select("side", "half", F.ceil(F.col("rows") / part).cast("int").alias("parts")))
    held = placed.join(crowded, ["side", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    held = held.withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    # Part a of those that are found and part b of those that ask meet in one block.
    found = held.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "side", "half", F.col("own").alias("a"), "b", "word", "n", (F.col("asks") & (F.col("parts") == 1)).alias("asks"), F.lit(True).alias("held"))
    asking = held.where("asks and parts > 1").withColumn("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "side", "half", "a", F.col("own").alias("b"), "word", "n", F.lit(True).alias("asks"), F.lit(False).alias("held"))
    rows = found.unionByName(asking).withColumn("block", F.pmod(F.xxhash64("side", "half", "a", "b"), F.lit(blocks)))

    def search(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(group.word[group.held], group.n[group.held]))
        index, queries = WordIndex(list(counts)), list(dict.fromkeys(group.word[group.asks]))
        q, w = index.near(queries, int(key[0]))
        near = [index.words[i] for i in w]
        return pd.DataFrame({"word": [queries[i] for i in q], "near": near, "near_n": [counts[x] for x in near]}).astype(
            {"word": object, "near": object, "near_n": "int64"})

    pairs = rows.select("side", "block", "word", "n", "asks", "held").groupBy("side", "block").applyInPandas(
        search, "word string, near string, near_n long")
    return pairs.dropDuplicates(["word", "near"])


def forms(words: DataFrame, ratio: int = RATIO, least_length: int = LEAST_LENGTH, block: int = BLOCK, part: int = PART) -> DataFrame:
    """word, n, n_near, form and form_n of (word, n): the form is the near word that occurs most,
    of equal ones the first in code-point order, if it occurs `ratio` times as often or more."""
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near")))
    near = near_words(words, least_length, block, part).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.rank") >= ratio * F.col("n")
    return words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.rank")).alias("form_n"))


def with_roots(formed: DataFrame) -> DataFrame:
    """The rows of `forms` with root: where following the forms ends, the word itself if it has
    none. Each round doubles the distance; a form occurs more often than its word, so it ends."""
    links = written(formed.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = written(links.join(ahead, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return formed.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO,
             noise: int = NOISE) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of whole texts. NULL and empty texts
    add no words; repeated rows count each; an empty table gives no rows. A word may have any
    length, and other columns of `docs` are not read."""
    words = written(vocabulary(docs, least_length, least_count, noise))
    return with_roots(written(forms(words, ratio, least_length))).select(*RESULT)
