"""Hidden Markov language model over the words of a text.

A state emits words. Every training word has expected counts of its own in every state, whatever
the size of the corpus; they lie in a table (word, state) that grows with the vocabulary and that
no task and not the driver holds as a whole: words are dealt to bins by their hash, and a row of
the table is a bin. One end follows each text, and one symbol stands for
words that training has not seen. Emissions are the expected counts plus a prior that is shared
out by the smoothed unigram model, so they add up to one over all training words, the end and the
unseen word.

Texts are dealt to blocks of bounded size, each with a list of its own distinct words. Training is
Baum-Welch: in every round each bin tells each block the emissions of the words they share, forward
and backward run over the block's training texts, and the expected counts of all blocks are added
per bin. What a bin and a block tell each other is one row of packed numbers; only the first
pass sees words. Scores come from the scaled forward recursion, which is exact.
"""

from __future__ import annotations

import gc
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.tables import drop_path, new_path, written

STATES = 8
ROUNDS = 4
SEEDS = 256  # texts that the first states are drawn from
FOLDS, HELD_OUT = 7, 2
CELLS = 200_000  # tokens that texts computed at a time may have, padding included
BLOCK = 1 << 22  # tokens after which a block of texts is closed
BIN = 1 << 24  # bytes of text per bin of words
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
CODED = "block long, doc_id string, held_out boolean, symbols binary, bin long, words binary, places binary, counts binary"
TABLE = "bin long, counts binary, shares binary, sums array<double>"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _packed(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes, then all second ones and so on, compressed."""
    planes = _planes(values)
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return _of_planes(pa.decompress(data[8:], size, "zstd", asbytes=True), kind)


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).reshape(-1, 1).view(np.uint8).T.tobytes()


def _of_planes(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


class Model:
    """Start, transitions and emissions."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit


@dataclass
class Chain:
    """What every task knows of the model: all but the expected counts of words."""

    start: np.ndarray
    move: np.ndarray
    end: np.ndarray  # expected counts of the end
    total: np.ndarray  # of all words and the end
    prior: float  # weight of the unigram model in each state
    ends: int  # training texts
    whole: float  # training tokens, their kinds and one

    def emissions(self, expected: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Emissions (word, state) of words with these expected and training counts."""
        share = (seen + 1.0)[:, None] / self.whole
        return ((expected.reshape(-1, len(self.start)) + self.prior * share) / (self.total + self.prior)).astype("<f4")

    def of_block(self, texts: list[np.ndarray], told: pd.DataFrame) -> Model:
        """The model over the symbols of a block. Symbols that `told` does not place are unseen words."""
        states = len(self.start)
        places = [_unpacked(p, "<u4") for p in told["places"]]
        emit = np.empty((1 + max(int(x.max()) for x in [*texts, *places] if len(x)), states))
        emit[:] = self.emissions(np.zeros(states), np.zeros(1))
        emit[0] = self.emissions(self.end, np.array([self.ends]))
        for at, given in zip(places, told["emissions"]):
            emit[at] = _unpacked(given, "<f4").reshape(-1, states)
        return Model(self.start, self.move, emit.T)


def _blocks(texts: list[np.ndarray]) -> Iterator[list[int]]:
    """Texts of like length together, up to CELLS tokens with padding."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        size = max(1, CELLS // len(texts[order[at]]))
        yield order[at:at + size]
        at += size


def _grid(texts: list[np.ndarray], rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(texts[i]) for i in rows])
    grid = np.zeros((lengths[0], len(rows)), np.int64)
    for k, i in enumerate(rows):
        grid[:len(texts[i]), k] = texts[i]
    return grid, lengths


def _live(lengths: np.ndarray, steps: int) -> list[int]:
    """At each step, how many texts have not ended; texts are sorted, longest first."""
    return np.searchsorted(-lengths, -np.arange(steps)).tolist()


def _forward(model: Model, seen: np.ndarray, live: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward values for emissions (step, text, state), and the scales."""
    alphas, scales = np.zeros_like(seen), np.ones(seen.shape[:2], seen.dtype)
    move, ones = model.move.astype(seen.dtype), np.ones(seen.shape[2], seen.dtype)
    for t, many in enumerate(live):
        now = alphas[t, :many]
        if t:
            np.dot(alphas[t - 1, :many], move, out=now)
        else:
            now[:] = model.start
        now *= seen[t, :many]
        scale = scales[t, :many]
        np.dot(now, ones, out=scale)
        now /= scale[:, None]
    return alphas, scales


def log_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of the probability of each sequence of symbols."""
    out = np.zeros(len(texts))
    by_symbol = np.ascontiguousarray(model.emit.T)
    for rows in _blocks(texts):
        grid, lengths = _grid(texts, rows)
        _alphas, scales = _forward(model, by_symbol[grid], _live(lengths, len(grid)))
        out[rows] = np.log(scales).sum(axis=0)
    return out


def expected_counts(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions over the texts; values of a text in single
    precision, sums over texts in double."""
    states, symbols = model.emit.shape
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((states, symbols))
    by_symbol = np.ascontiguousarray(model.emit.T).astype(np.float32)
    back = np.ascontiguousarray(model.move.T).astype(np.float32)
    for rows in _blocks(texts):
        grid, lengths = _grid(texts, rows)
        live, onward = _live(lengths, len(grid)), by_symbol[grid]
        alphas, scales = _forward(model, onward, live)
        betas = np.ones_like(alphas)
        onward /= scales[:, :, None]
        for t in range(len(grid) - 1, 0, -1):
            many = live[t]
            now = onward[t, :many]
            now *= betas[t, :many]
            np.dot(now, back, out=betas[t - 1, :many])
        for t, many in enumerate(live):
            onward[t, many:] = 0
        move += alphas[:-1].reshape(-1, states).T @ onward[1:].reshape(-1, states)
        alphas *= betas
        start += alphas[0].sum(axis=0)
        flat, weights = grid.ravel(), np.ascontiguousarray(alphas.reshape(-1, states).T)
        for k in range(states):
            emit[k] += np.bincount(flat, weights[k], minlength=symbols)
    return start, move * model.move, emit


def _bins(docs: DataFrame) -> int:
    """How many bins the words are dealt to; they grow with the texts, so that a bin does not."""
    return 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BIN


def _coded(docs: DataFrame, bins: int) -> DataFrame:
    """Rows of two kinds. A text: its block, id, whether held out, and its symbols, which are places
    in the list of words of the block, 0 the end. A bin of a block: its words, their places and
    their counts in the training texts of the block."""
    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places: defaultdict = defaultdict()
        places.default_factory = places.__len__
        texts, tokens, number = [], 0, 0

        def closed() -> pd.DataFrame:
            # Frequent words come first, so that high bytes of symbols are few.
            spoken = np.bincount(np.concatenate([ids for _, _, ids in texts]), minlength=len(places))
            order = np.r_[0, 1 + np.argsort(-spoken[1:], kind="stable")]
            place = np.empty(len(order), "<u4")
            place[order] = np.arange(len(order))
            trained = [place[ids] for _, held, ids in texts if not held]
            counts = np.bincount(np.concatenate([np.empty(0, np.int64), *trained]), minlength=len(places))
            frame = pd.DataFrame([(d, held, _planes(place[ids])) for d, held, ids in texts], columns=["doc_id", "held_out", "symbols"])
            names = list(places)
            names = [names[i] for i in order]
            dealt = np.array([0, *(zlib.crc32(w) % bins for w in names[1:])])
            order = 1 + np.argsort(dealt[1:], kind="stable")
            listed = pd.DataFrame([(int(dealt[of[0]]), b"\n".join([names[i] for i in of]), _packed(of.astype("<u4")), _packed(counts[of].astype("<u4")))
                                   for of in np.split(order, 1 + np.flatnonzero(np.diff(dealt[order]))) if len(of)],
                                  columns=["bin", "words", "places", "counts"])
            out = pd.concat([frame, listed], ignore_index=True).assign(block=(part << 32) + number, kind=["text"] * len(frame) + ["words"] * len(listed))
            return out.astype(object).where(out.notna(), None)[["block", "doc_id", "held_out", "symbols", "bin", "words", "places", "counts", "kind"]]

        part = 0
        for batch in batches:
            for part, doc, held, text in zip(batch["part"], batch["doc_id"], batch["held_out"], batch["text"]):
                if not places:
                    places[b""] = 0
                found = _words(text)
                found.append(b"")
                texts.append((doc, held, np.fromiter(map(places.__getitem__, found), np.uint32, len(found))))
                tokens += len(found)
                if tokens >= BLOCK:
                    yield closed()
                    places.clear()
                    texts, tokens, number = [], 0, number + 1
        if texts:
            yield closed()

    rows = docs.select(F.spark_partition_id().cast("long").alias("part"), F.col("doc_id").cast("long").cast("string").alias("doc_id"),
                       held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInPandas(code, f"{CODED}, kind string")


def _decoded(texts: pd.DataFrame) -> list[np.ndarray]:
    return [_of_planes(s, "<u4").astype(np.int64) for s in texts["symbols"]]


def _linked(listed: DataFrame, seeds: tuple[dict, np.ndarray]) -> DataFrame:
    """Training words numbered within their bin. Rows of two kinds. A link (with a block): places in
    the block and numbers of its words that are in the bin. A bin (no block): the words' counts and
    their shares in the first states."""
    shared = listed.sparkSession.sparkContext.broadcast(seeds)
    columns = ["bin", "block", "places", "numbers", "counts", "shares"]

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        numbers: defaultdict = defaultdict()
        numbers.default_factory = numbers.__len__
        found = [np.fromiter(map(numbers.__getitem__, words.split(b"\n")), np.int64) for words in rows["words"]]
        total = np.zeros(len(numbers), np.int64)
        for ids, counts in zip(found, rows["counts"]):
            total[ids] += _unpacked(counts, "<u4")
        kept, (of, vectors) = total > 0, shared.value
        number = np.cumsum(kept) - 1
        out = []
        for block, ids, places in zip(rows["block"], found, rows["places"]):
            known = kept[ids]
            out.append((block, _packed(_unpacked(places, "<u4")[known]), _packed(number[ids[known]].astype("<u4")), None, None))
        own = np.fromiter((of.get(w, -1) for w in numbers), np.int64, len(numbers))[kept]
        shares = np.where(own[:, None] >= 0, vectors[own], 0).astype("<f4")
        out.append((None, None, None, _packed(total[kept]), _packed(shares)))
        return pd.DataFrame(out, columns=columns[1:]).astype(object).assign(bin=rows["bin"].iloc[0])[columns]

    return listed.groupBy("bin").applyInPandas(link, "bin long, block long, places binary, numbers binary, counts binary, shares binary")


def _seeded(docs: DataFrame, states: int) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Shares of words and of the end in the first states: the row of each word, the rows, and that
    of the end. Each state leans to a text unlike those of the other states (farthest first), among
    the training texts that come first by hash, copies counted once."""
    texts = docs.where(~held_out(F.col("doc_id"))).select(F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    first = [r["h"] for r in texts.select("h").distinct().orderBy("h").limit(SEEDS).collect()]
    found = texts.where(F.col("h").isin(first)).groupBy("h").agg(F.min("text").alias("text")).collect() if first else []
    seeds = [[*_words(r["text"]), b""] for r in sorted(found, key=lambda r: r["h"])]
    kinds = sorted({w for text in seeds for w in text} | {b""})
    places = {w: i for i, w in enumerate(kinds)}
    histograms = np.zeros((len(seeds), len(kinds)))
    for row, text in zip(histograms, seeds):
        np.add.at(row, [places[w] for w in text], 1)
    own = np.tile(histograms.sum(axis=0) + (0 if seeds else 1), (states, 1))
    own *= 1 + 0.1 * np.cos(np.arange(len(kinds)) * np.arange(1.0, states + 1)[:, None])
    if seeds:
        unit = np.sqrt(histograms / histograms.sum(axis=1, keepdims=True))
        picked = [int(np.argmax(histograms.sum(axis=1)))]
        while len(picked) < min(states, len(unit)):
            picked.append(int(np.argmin((unit @ unit[picked].T).max(axis=1))))
        group = (unit @ unit[picked].T).argmax(axis=1)
        for k in range(len(picked)):
            if (group == k).any():
                own[k] = histograms[group == k].sum(axis=0)
    own /= own.sum(axis=1, keepdims=True)
    return places, own.T.astype(np.float32), own[:, places[b""]]


def _told(linked: DataFrame, table: DataFrame, chain: Chain, counted: bool = False) -> DataFrame:
    """The emissions of the words of each block, and if `counted` their training counts, a row for
    each bin."""
    shared = linked.sparkSession.sparkContext.broadcast(chain)

    def tell(links: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        columns = ["bin", "block", "places", "emissions", "counts"]
        if not len(links) or not len(given):
            return pd.DataFrame(columns=columns)
        counts = _unpacked(given["counts"].iloc[0], "<i8")
        emissions = shared.value.emissions(_unpacked(given["shares"].iloc[0], "<f4"), counts)
        numbers = [_unpacked(n, "<u4") for n in links["numbers"]]
        return links[["bin", "block", "places"]].assign(
            emissions=[_packed(emissions[n]) for n in numbers], counts=[_packed(counts[n]) if counted else b"" for n in numbers])[columns]

    return linked.where("block is not null").select("bin", "block", "places", "numbers").groupBy("bin").cogroup(
        table.where("bin >= 0").select("bin", "counts", "shares").groupBy("bin")).applyInPandas(
            tell, "bin long, block long, places binary, emissions binary, counts binary")


def _next(spoken: DataFrame, linked: DataFrame, table: DataFrame, chain: Chain) -> DataFrame:
    """A row per bin: counts and expected counts (shares) of its words, and their sum per state; and
    one, of bin -1, whose sums are starts, ends and moves."""
    states = len(chain.start)
    shared = spoken.sparkSession.sparkContext.broadcast(chain)

    def count(texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        columns = ["bin", "block", "found"]
        if not len(texts):
            return pd.DataFrame(columns=columns)
        decoded = _decoded(texts)
        start, move, emit = expected_counts(shared.value.of_block(decoded, told), decoded)
        by_word = np.ascontiguousarray(emit.T, "<f4")
        found = [_packed(by_word[_unpacked(p, "<u4")]) for p in told["places"]]
        out = told[["bin", "block"]].assign(found=found)
        out.loc[len(out)] = [-1, texts["block"].iloc[0], _packed(np.r_[start, emit[:, 0], move.ravel()])]
        return out[columns]

    def add(links: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        columns = ["bin", "counts", "shares", "sums"]
        if not len(links):
            if not len(counted):
                return pd.DataFrame(columns=columns)
            return pd.DataFrame([(-1, None, None, sum(_unpacked(f, "<f8") for f in counted["found"]))], columns=columns)
        own = links["block"].isna()
        counts = links["counts"][own].iloc[0]
        sums = np.zeros((len(_unpacked(counts, "<i8")), states))
        numbers = dict(zip(links["block"][~own].astype(np.int64), links["numbers"][~own]))
        for block, found in zip(counted["block"], counted["found"]):
            sums[_unpacked(numbers[block], "<u4")] += _unpacked(found, "<f4").reshape(-1, states)
        return pd.DataFrame([(links["bin"].iloc[0], counts, _packed(sums.astype("<f4")), sums.sum(axis=0))], columns=columns)

    counted = _joined(spoken.select("block", "symbols"), _told(linked, table, chain)).applyInPandas(
        count, "bin long, block long, found binary")
    return linked.select("bin", "block", "numbers", "counts").groupBy("bin").cogroup(counted.groupBy("bin")).applyInPandas(
        add, TABLE)


def _joined(texts: DataFrame, told: DataFrame):
    """Texts of a block beside the emissions of its words."""
    return texts.groupBy("block").cogroup(told.groupBy("block"))


def score_texts(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, prior: float | None = None) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the text in lower case (A-Z) and one end. base_score is the unigram
    score with one added to every count; score is the model's log10 probability of the tokens.
    NULL, empty and blank texts are an end alone. Rows with a NULL doc_id are training texts.
    Repeated rows each get a row; an empty table gives none. The unigram model has the weight
    `prior` in each state, the mean number of kinds a state has if it is not given.
    """
    spark = docs.sparkSession
    coded = new_path(spark, "coded")
    _coded(docs, _bins(docs)).write.partitionBy("kind").option("compression", "zstd").parquet(coded)
    texts, listed = (spark.read.schema(f"{CODED}, kind string").parquet(coded).where(F.col("kind") == kind) for kind in ("text", "words"))
    spoken = texts.where("not held_out")
    rows, vectors, end = _seeded(docs, states)
    linked = written(_linked(listed.select("bin", "block", "words", "places", "counts"), (rows, vectors)))
    drop_path(spark, f"{coded}/kind=words")
    _sweep(spark)
    ends = spoken.count()
    counts = _counted(linked)
    tokens, kinds = counts[0] + ends, counts[1] + (ends > 0)

    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    table, path = linked.where("block is null"), None
    chain = Chain(np.full(states, 1 / states), move, end, np.ones(states), 1.0, ends, float(tokens + kinds + 1))
    for _ in range(rounds):
        before, path = path, new_path(spark, "table")
        _next(spoken, linked, table, chain).write.parquet(path)
        if before:
            drop_path(spark, before)
        table = spark.read.schema(TABLE).parquet(path)
        chain = _updated(table, chain, (kinds + 1) / states if prior is None else prior)
        _sweep(spark)
    return _scored(texts, linked, table, chain, tokens)


def _counted(linked: DataFrame) -> tuple[int, int]:
    """Training tokens and kinds, without the end."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = [_unpacked(c, "<i8") for c in batch["counts"]]
            yield pd.DataFrame({"n": [int(c.sum()) for c in counts], "v": [len(c) for c in counts]})

    found = linked.where("block is null").select("counts").mapInPandas(count, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return found[0] or 0, found[1] or 0


def _sweep(spark: SparkSession) -> None:
    """Shuffle files of what is written go once the JVM finds that nothing refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _updated(table: DataFrame, chain: Chain, prior: float) -> Chain:
    states = len(chain.start)
    size = states * (2 + states)
    few = table.where("bin < 0").select("sums").first()
    few = np.array(few["sums"]) if few else np.zeros(size)
    of_words = table.where("bin >= 0").agg(*[F.sum(F.get("sums", F.lit(k))) for k in range(states)]).first()
    end = few[states:2 * states]
    start = few[:states] + 0.1
    # A row of moves that is kept is that of the state that is left.
    move = few[2 * states:].reshape(states, states) + 0.1
    return Chain(start / start.sum(), move / move.sum(axis=1, keepdims=True), end,
                 end + np.array([x or 0.0 for x in of_words]), prior, chain.ends, chain.whole)


def _scored(texts: DataFrame, linked: DataFrame, table: DataFrame, chain: Chain, tokens: int) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(chain)

    def score(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        if not len(own):
            return pd.DataFrame(columns=columns)
        decoded = _decoded(own)
        model = shared.value.of_block(decoded, told)
        seen = np.zeros(model.emit.shape[1])
        seen[0] = shared.value.ends
        for places, counts in zip(told["places"], told["counts"]):
            seen[_unpacked(places, "<u4")] = _unpacked(counts, "<i8")
        lengths, known, logs = np.array([len(t) for t in decoded]), seen > 0, np.log10(seen + 1.0)
        base = np.array([logs[t].sum() for t in decoded]) - lengths * np.log10(shared.value.whole)
        return pd.DataFrame({"doc_id": own["doc_id"], "held_out": own["held_out"], "n_tokens": lengths,
                             "n_known": [int(known[t].sum()) for t in decoded], "base_score": base,
                             "score": log_likelihoods(model, decoded) / np.log(10)})[columns]

    rows = _joined(texts.select("block", "doc_id", "held_out", "symbols"), _told(linked, table, chain, True)).applyInPandas(
        score, "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "n_tokens", "n_known",
                       F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
