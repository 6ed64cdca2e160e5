"""Repeated passages: winnowing over line hashes, positions joined, matches extended.

Newlines of crawled text are arbitrary and a passage may begin in the middle of a text line, so
a line is here a run of LINE words, and one begins at every word: every run of whole text lines
of PASSAGE words or more is found, and so is a passage that shares no newline with its copy.

1. Fingerprints. In every run of PASSAGE words the least of its line hashes is selected. Two
   equal runs select the same one, so a repeated passage of PASSAGE words is guaranteed to share
   a fingerprint, while only about one line in sixteen is selected.
2. Join. Fingerprints that occur in two texts, or twice in one, are looked up; all others go.
3. Extension. A match at an occurrence is extended to the left and right over all runs of
   PASSAGE words that selected it. These are compared by 128-bit hashes of their words, first
   all together and then, where only some can match, one by one. A run that occurs at an
   earlier place (doc_id, then position) is repeated.
4. Later repeated runs that touch are merged and deleted; the first occurrence stays.

So a word is deleted exactly if it lies in a run of PASSAGE words that occurs earlier.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm.tables import tidied, unused, written

LINE = 20
PASSAGE = 50
SLICE = 256  # texts
HELD = 500_000  # numbers handed on at once
WORDS = 1 << 14  # hashed at a time
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """A hash of each word, for each text. All texts are hashed at once: a polynomial of the word's
    bytes, each byte a random number, is the difference of two running sums, brought to the
    power at which a word begins."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)
    # A word begins after white space and ends before it; both are places in `inside`.
    inside = _IS_WORD[joined]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    if not len(starts):
        return [np.empty(0, np.uint64) for _ in raw]
    out = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(starts), WORDS):
            a, b = starts[at:at + WORDS], ends[at:at + WORDS]
            low, high = int(a[0]), int(b[-1])
            power, inverse = _powers(high - low)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_VALUES[joined[low:high]] * power[:high - low], out=sums[1:])
            out[at:at + WORDS] = (sums[b - low] - sums[a - low]) * inverse[a - low]
        out = _mixed(out)
    # Texts lie one after the other, with a newline before each.
    begins = np.cumsum([1, *(len(r) + 1 for r in raw)])
    return np.split(out, np.searchsorted(starts, begins[1:-1]))


_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_VALUES = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
_POWERS: list[np.ndarray] = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and of its inverse, from 0 up."""
    if not _POWERS or len(_POWERS[0]) < size:
        base, count = 0xD6E8FEB86659FD93, max(1 << 16, 2 * size)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(count - 1, b, np.uint64)], dtype=np.uint64)
                          for b in (base, pow(base, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(words: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """A hash of each run of `length` words: polynomials of runs of doubling length."""
    if len(words) < length:
        return words[:0]
    out, have, run, size, left = None, 0, words, 1, length
    with np.errstate(over="ignore"):
        power = base
        while left:
            if left & 1:
                if out is None:
                    out = run
                else:
                    end = len(words) - have - size + 1
                    out = out[:end] * power + run[have:have + end]
                have += size
            left >>= 1
            if left:
                run = run[:-size] * power + run[size:]
                size, power = 2 * size, power * power
        return _mixed(out)


def window_minima(lines: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` successive values."""
    if len(lines) < width:
        return lines[:0]
    size, least = 1, lines
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


def _of_all(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of a row of hashes."""
    import xxhash

    value = xxhash.xxh3_64_intdigest(hashes.tobytes())
    return value - (1 << 64) * (value >> 63)


def selected(words: np.ndarray, line: int, passage: int) -> np.ndarray:
    """For each run of `passage` words the line hash it selects."""
    return window_minima(run_hashes(words, line, _BASES[0]), passage - line + 1)


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Few texts at a time, so that what is made of them stays small beside the texts."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.iloc[at:at + SLICE]


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def repeated_runs(docs: DataFrame, line: int = LINE, passage: int = PASSAGE) -> DataFrame:
    """Runs to delete: doc_id, start and words (places and length in words), first_doc and
    first_start (where the run's first words occur earliest), text_key.

    NULL, empty and short texts (under `passage` words) have none. Rows that repeat doc_id and
    text count as one. A NULL doc_id comes before all others. Words are compared exactly.
    """
    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            sizes, prints, twice = [], [], []
            for words in word_hashes(batch["text"].tolist()):
                lines = run_hashes(words, line, _BASES[0])
                least = window_minima(lines, passage - line + 1)
                # Windows in a row mostly select the same line.
                values = np.unique(least[np.r_[True, least[1:] != least[:-1]]] if len(least) else least)
                ordered = np.sort(lines)
                again = ordered[1:][ordered[1:] == ordered[:-1]]
                counts = np.isin(values, again) if len(again) else np.zeros(len(values), bool)
                sizes.append(len(words))
                prints.append(values.view(np.int64))
                twice.append(counts)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text_key": batch["text_key"], "n_words": sizes,
                                "prints": prints, "twice": twice})

    keyed = docs.select(F.col("doc_id").cast("long"), _text_key().alias("text_key"), "text")
    marks = written(keyed.mapInPandas(tidied(mark), "doc_id long, text_key long, n_words long, prints array<long>, twice array<boolean>"))
    # Equal texts: the first keeps its words, later ones are repeated as a whole.
    rows = marks.select("doc_id", "text_key", "n_words")
    firsts = rows.groupBy("text_key").agg(F.min(F.struct("doc_id")).alias("f"), F.max("n_words").alias("n_words"))
    firsts = written(firsts.select("text_key", F.col("f.doc_id").alias("first"), "n_words"))
    later = rows.distinct().join(firsts.select("text_key", "first"), "text_key").where(
        (F.col("n_words") >= passage) & ~F.col("doc_id").eqNullSafe(F.col("first")))
    copies = later.select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("words"),
                          F.col("first").alias("first_doc"), F.lit(0).cast("long").alias("first_start"), "text_key")
    # Fingerprints of two different texts, or found twice in one.
    prints = marks.where(F.size("prints") > 0).select("text_key", F.inline(F.arrays_zip("prints", "twice")))
    common = written(prints.groupBy("prints").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b"), F.max("twice").alias("t"))
                     .where("t or a <> b").select("prints"))
    wanted = prints.select("text_key", "prints").join(common, "prints").groupBy("text_key").agg(
        F.collect_set("prints").alias("prints"))
    wanted = written(wanted.join(firsts.select("text_key", "first"), "text_key"))
    # Texts are dealt by key at any size: what they meet grows with the corpus, too.
    again = keyed.join(wanted.select(F.col("text_key").alias("_k"), F.col("first").alias("_f"), "prints").hint("merge"),
                       (F.col("text_key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_f")))

    def rows_of(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["print", "a", "b", "doc_id", "text_key", "start", "last", "inner", "wa", "wb"])
        return frame.astype({"doc_id": "Int64"})

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            out, size = [], 0
            for doc, key, words, held in zip(batch["doc_id"].astype("Int64"), batch["text_key"], word_hashes(batch["text"].tolist()),
                                             batch["prints"]):
                least = selected(words, line, passage)
                heads = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
                ends = np.r_[heads[1:], len(least)]
                wanted = np.isin(least[heads], np.asarray(held).view(np.uint64))
                runs_ = [run_hashes(words, passage, base) for base in _BASES]
                for h, e in zip(heads[wanted].tolist(), ends[wanted].tolist()):
                    a, b = (r[h:e] for r in runs_)
                    # Copies, so that the hashes of a whole text go when the text is done.
                    out.append((int(least[h]) - (1 << 64) * (int(least[h]) >> 63), _of_all(a), _of_all(b), doc, key, h, e - 1,
                                len(np.unique(a)) < len(a), a.view(np.int64).copy(), b.view(np.int64).copy()))
                    size += 2 * (e - h)
                    if size > HELD:
                        yield rows_of(out)
                        out, size = [], 0
            yield rows_of(out)

    # A span is what the runs around one occurrence cover: all runs in a row that selected it.
    spans = written(again.select("doc_id", "text_key", "text", "prints").mapInPandas(tidied(extend), "print long, a long, b long, doc_id long, text_key long, start long, last long, inner boolean, wa array<long>, wb array<long>"))
    place = F.struct("doc_id", "text_key", "start")
    earliest = written(spans.groupBy("a", "b").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f <> l").select("a", "b", "f"))
    same = spans.join(earliest, ["a", "b"], "left")
    repeated = written(same.where(F.col("f") < place).select(
        "doc_id", "text_key", "start", "last", F.col("f.doc_id").alias("first_doc"), F.col("f.start").alias("first_start")))
    # The earliest place of a run lies in a span that is the first of its kind, so only these are
    # compared run by run, and only where different spans hold the same fingerprint or one holds
    # a run twice.
    leading = written(same.where(F.col("f").isNull() | (F.col("f") == place)).select(
        "print", "doc_id", "text_key", "start", "inner", F.arrays_zip("wa", "wb").alias("w")))
    shared = written(leading.groupBy("print").agg(F.count("*").alias("n"), F.max("inner").alias("i"))
                     .where("n > 1 or i").select("print"))
    runs = written(leading.join(shared, "print").select("doc_id", "text_key", F.col("start").alias("from"), F.posexplode("w").alias("k", "w"))
                   .select("doc_id", "text_key", (F.col("from") + F.col("k")).alias("start"), "w.wa", "w.wb"))
    before = written(runs.groupBy("wa", "wb").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f <> l").select("wa", "wb", "f"))
    single = runs.join(before, ["wa", "wb"]).where(F.col("f") < place).select(
        "doc_id", "text_key", "start", F.col("start").alias("last"), F.col("f.doc_id").alias("first_doc"),
        F.col("f.start").alias("first_start"))
    by_doc = repeated.unionByName(single).groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("start", "last", "first_doc", "first_start"))).alias("r"))
    by_doc = by_doc.select("doc_id", "text_key", F.col("r.start").alias("starts"), F.col("r.last").alias("lasts"),
                           F.col("r.first_doc").alias("docs"), F.col("r.first_start").alias("places"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, key, starts, lasts, docs_, places in zip(batch["doc_id"].astype("Int64"), batch["text_key"], batch["starts"],
                                                              batch["lasts"], batch["docs"], batch["places"]):
                upto = np.maximum.accumulate(lasts)
                heads = np.flatnonzero(np.r_[True, starts[1:] - upto[:-1] > passage])
                ends = np.r_[heads[1:] - 1, len(starts) - 1]
                out += [(doc, int(starts[h]), int(upto[e] - starts[h] + passage), docs_[h], int(places[h]), key)
                        for h, e in zip(heads, ends)]
            frame = pd.DataFrame(out, columns=["doc_id", "start", "words", "first_doc", "first_start", "text_key"])
            yield frame.astype({"doc_id": "Int64", "first_doc": "Int64"})

    merged = by_doc.mapInPandas(tidied(merge), "doc_id long, start long, words long, first_doc long, first_start long, text_key long")
    return copies.unionByName(merged)


def cut_text(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the runs of words (start, length); white space around them stays once."""
    spans = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for start, length in sorted(runs):
        out.append(text[at:spans[start][0]])
        at = spans[start + length - 1][1]
        if out[-1] == "" or out[-1][-1].isspace():
            at += len(text[at:]) - len(text[at:].lstrip(" "))
    out.append(text[at:])
    return "".join(out)


def delete_repeats(docs: DataFrame, line: int = LINE, passage: int = PASSAGE) -> DataFrame:
    """The documents with later repeated runs deleted from their texts; documents of which no
    word is left are dropped. The columns are those of `docs`; `n_chars` is counted anew where
    the text changed. Documents without repeats pass as they are, NULL and empty texts too."""
    runs = repeated_runs(docs, line, passage)
    id_, key, cut = unused(docs.columns, "_doc", "_key", "_runs")
    cuts = written(runs.groupBy(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).agg(
        F.array_sort(F.collect_set(F.struct("start", "words"))).alias(cut)))
    joined = docs.join(cuts.hint("merge"), F.col("doc_id").eqNullSafe(F.col(id_)) & (_text_key() == F.col(key)), "left")

    @F.pandas_udf("string")
    def remaining(texts: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut_text(t, [(int(a), int(n)) for a, n in zip(s, k)])
                          for t, s, k in zip(texts, starts, lengths)], dtype=object)

    # One join for all: texts without runs do not go to Python, and stay as they are.
    new, = unused([*joined.columns], "_new")
    changed = F.col(cut).isNotNull()
    out = joined.withColumn(new, remaining(F.when(changed, F.col("text")), F.col(cut)["start"], F.col(cut)["words"]))
    out = out.where(~changed | F.col(new).rlike(r"[^\x20\x09-\x0D]"))
    values = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": F.when(changed, F.col(new)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        counted = F.length(F.col(new)).cast(docs.schema["n_chars"].dataType)
        values["n_chars"] = F.when(changed, counted).otherwise(F.col("n_chars"))
    return out.select(*[v.alias(c) for c, v in values.items()])
