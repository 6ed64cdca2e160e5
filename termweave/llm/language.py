"""Language identification with a string kernel.

The kernel of two texts is the blended-spectrum presence kernel: the number of character
n-grams (of one to `NGRAM` characters) that occur in both, whatever how often, divided by the
root of the product of their own numbers. A Nyström map takes a text to its kernels with
landmark texts, whitened by their own kernel matrix; on it stands one ridge regression for each
language against the rest. Text is lower-cased, and what is not a letter counts as a space.

The score of a text is linear in its n-grams, so landmarks, whitening and weights are multiplied
once into one matrix (n-gram, language); a batch of texts is scored by the product of its sparse
presence matrix with that one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm.tables import boxed, tidied, unused

NGRAM = 4
BITS = 18  # n-grams are told apart by a hash of so many bits
SAMPLE = 400  # labelled texts of a language that are learnt from, at most
LANDMARKS = 48  # of these, per language
RIDGE = 1e-3
FOLDS, HELD_OUT = 5, 0
BLOCK = 64  # texts scored at a time
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(text: str) -> np.ndarray:
    """The distinct n-grams of a text, as places in the hashed space; none without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    codes = np.where(letter, codes, 32).astype(np.uint64)
    keep = np.r_[True, letter[1:] | letter[:-1]]
    codes = np.r_[np.uint64(32), codes[keep], np.uint64(32)]
    seen = np.zeros(1 << BITS, bool)
    run = codes
    with np.errstate(over="ignore"):
        for n in range(1, NGRAM + 1):
            if n > 1:
                run = run[:-1] * np.uint64(0x100000001B3) + codes[n - 1:]
            seen[((run + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)] = True
    return np.flatnonzero(seen)


class KernelClassifier:
    """Languages, the folded matrix and the intercepts."""

    def __init__(self, texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        grams = [ngrams(t) for t in texts]
        self.langs = sorted(set(langs))
        self.matrix = np.zeros((1 << BITS, len(self.langs)), np.float32)
        self.bias = np.full(len(self.langs), 1 / max(len(self.langs), 1))
        usable = [i for i, g in enumerate(grams) if len(g)]
        if not usable:
            return
        chosen, taken = [], {}
        for i in usable:
            taken[langs[i]] = taken.get(langs[i], 0) + 1
            if taken[langs[i]] <= landmarks:
                chosen.append(i)
        present = np.unique(np.concatenate([grams[i] for i in chosen]))
        marks = np.zeros((len(chosen), len(present)), np.float32)
        for row, i in enumerate(chosen):
            marks[row, np.searchsorted(present, grams[i])] = len(grams[i]) ** -0.5
        # Kernels of all texts with the landmarks, a block of texts at a time.
        kernels = np.zeros((len(usable), len(chosen)))
        for row, i in enumerate(usable):
            own = np.searchsorted(present, grams[i])
            own = own[(own < len(present)) & (present[np.minimum(own, len(present) - 1)] == grams[i])]
            kernels[row] = marks[:, own].sum(axis=1) / len(grams[i]) ** 0.5
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
        good = values > 1e-6 * values.max()
        whiten = vectors[:, good] / np.sqrt(values[good])
        features = kernels @ whiten
        target = (np.array([langs[i] for i in usable])[:, None] == np.array(self.langs)).astype(float)
        self.bias = target.mean(axis=0)
        mean = features.mean(axis=0)
        centred = features - mean
        weights = np.linalg.solve(centred.T @ centred + ridge * len(usable) * np.eye(centred.shape[1]), centred.T @ (target - self.bias))
        self.bias = self.bias - mean @ weights
        self.matrix[present] = marks.T @ (whiten @ weights)

    def scores(self, grams: list[np.ndarray]) -> np.ndarray:
        """Values of all languages for a batch of texts that have n-grams."""
        ends = np.cumsum([len(g) for g in grams])
        rows = self.matrix[np.concatenate(grams)]
        sums = np.add.reduceat(rows, np.r_[0, ends[:-1]], axis=0, dtype=np.float64)
        return sums / np.sqrt([[len(g)] for g in grams]) + self.bias


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """Whether crc32 of the id as text leaves that remainder; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> KernelClassifier:
    """Learnt from the `sample` distinct texts of each language that come first by hash, among rows
    that are not held out and have text and language: a bounded sample, the same however rows lie
    and however often a text is repeated."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # The rank limit is applied in every task before rows of a language meet.
    first = Window.partitionBy("lang").orderBy("_h")
    rows = rows.select("doc_id", "lang", "text", F.xxhash64("text").alias("_h"))
    distinct = rows.groupBy("lang", "_h").agg(F.min("doc_id").alias("doc_id"))
    ids = (distinct.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= sample)
           .select(F.col("doc_id").alias("_d"), F.col("lang").alias("_l"), F.col("_h").alias("_g"), "_n"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("lang") == F.col("_l")) & (F.col("_h") == F.col("_g"))
    taken = rows.join(F.broadcast(ids), same).select("lang", "_n", "text")
    got = sorted((r["lang"], r["_n"], r["text"]) for r in taken.dropDuplicates(["lang", "_n"]).collect())
    return KernelClassifier([g[2] for g in got], [g[0] for g in got], landmarks)


def predictor(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS):
    """A column function of a text, learnt from `docs`: a struct of lang_pred and score."""
    model = fit(docs, sample, landmarks)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    # Arrow arrays, so that only the texts of a block are Python strings at a time.
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in parts:
            langs, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            for at in range(0, len(texts), BLOCK):
                block = texts.slice(at, BLOCK).to_pylist()
                grams = {i: g for i, t in enumerate(block, at) if t and len(g := ngrams(t))}
                if grams and own.langs:
                    values = own.scores(list(grams.values()))
                    best, rows = values.argmax(axis=1), list(grams)
                    langs[rows] = np.array(own.langs, object)[best]
                    scores[rows] = np.clip(values[np.arange(len(rows)), best], 0, 1)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidied(predict)(parts)

    return F.arrow_udf(scored, "lang_pred string, score double")


def identify(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> DataFrame:
    """Per row: row_ (its columns as a struct), doc_id, held_out, lang_pred and score.

    The prediction uses the text alone. `und` with score 0 if the text is NULL or has no letter,
    or if there was nothing to learn from. The score is the regression's value for the predicted
    language, cut to 0 to 1; of languages that tie the first by name is predicted. Repeated rows
    each get a row, an empty table gives none.
    """
    predict = predictor(docs, sample, landmarks)
    marked = boxed(docs, "doc_id", "text").select("row_", F.col("doc_id").cast("long").alias("doc_id"),
                                                  held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p"))
    return marked.select("row_", "doc_id", "held_out", "p.lang_pred", "p.score")


LEAST_SCORE = 0.2


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents whose language is found with a score of `least` or more; others go. The
    columns are those of `docs`."""
    # The rows wait beside the Python worker for their verdict: they hold their text once.
    name, = unused(docs.columns, "_language")
    found = docs.withColumn(name, predictor(docs)("text"))
    return found.where((F.col(name)["lang_pred"] != UNKNOWN) & (F.col(name)["score"] >= least)).select(
        *[F.col(f"`{c}`") for c in docs.columns])
