"""Bounded-space online packing of token ids into sequences of a fixed length.

A task keeps a fixed number of open windows. What is left of a document after whole sequences
were cut from it is placed into the window that it fills best; when none has room, the fullest
window takes as much as it can (the piece is cut there) and is emitted, and the rest goes on.
Windows still open at the end of a task are merged in rounds: those of `GROUP` tasks at a time
are packed by the same rule, until one task is left. No step holds more than its open windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.tables import tidied, written

LENGTH = 2048
OPEN = 16
GROUP = 32
LEAST_PIECE = 16  # a window with less room than this is not topped up with a cut piece
END_ID = 1
CACHED = 500_000  # words of a generation whose ids a task keeps; there are two
CACHED_SYMBOLS = 12_000_000

PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, "
          "sequence_id long, offset long, open boolean")
COLUMNS = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "open"]


class WordTokenizer:
    """Ids of a text as bytes (little-endian, 32 bit) by a tokenizer that never joins characters
    across white space, nor letters with the punctuation after them, so that the ids of a word
    can be kept for the next time."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # every word it gets is new
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.size = 0
        self.mark = np.array(self.tokenizer.encode(MARK, add_special_tokens=False).ids, "<u4")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if ODD.search(text) or len(self.mark) != 1:
            return self.whole(text)
        if len(self.known) > CACHED or self.size > CACHED_SYMBOLS:
            # Words in use move over from the old store; those not seen again go with it.
            self.old, self.known, self.size = self.known, {}, 0
        words = text.split()
        missing = set(words).difference(self.known)
        if missing:
            self._learn(missing)
        return b"".join(map(self.known.__getitem__, words))

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _keep(self, words: list[str], data: bytes, starts: list[int], ends: list[int]) -> None:
        self.known.update(zip(words, map(data.__getitem__, map(slice, starts, ends))))
        self.size += sum(map(len, words))

    def _learn(self, words: set[str]) -> None:
        known, old, new, split = self.known, self.old, set(), []
        for word in words:
            held = old.get(word)
            if held is not None:
                known[word] = held
                continue
            stem = word.rstrip(PUNCTUATION) if word[-1] in ENDS else word
            # The lower case of a letter may end in a mark, which meets the punctuation after it.
            if stem.isalpha() and (stem.isascii() or stem.lower().isalpha()):
                low = stem.lower() if stem.isascii() else stem
                if low != word:
                    split.append((word, low, word[len(stem):]))
            else:
                low = word
            if low not in known:
                held = old.get(low)
                if held is not None:
                    known[low] = held
                else:
                    new.add(low)
        letters = [w for w in new if w.isalpha()]
        for at in range(0, len(letters), 1024):
            part = letters[at:at + 1024]
            # Letters in a row are one piece, and only its last id ends a piece.
            ids = self._encoded(" ".join(part))
            ends = 4 * np.flatnonzero(self.closes[ids]) + 4
            if len(ends) == len(part):
                self._keep(part, ids.tobytes(), [0, *ends[:-1].tolist()], ends.tolist())
            else:
                known.update((w, self.whole(w)) for w in part)
        others = [w for w in new if not w.isalpha()]
        for at in range(0, len(others), 1024):
            part = others[at:at + 1024]
            # One text, with a mark between the parts whose id no part can have.
            ids = self._encoded(f" {MARK} ".join(part))
            cuts = 4 * np.flatnonzero(ids == self.mark[0])
            self._keep(part, ids.tobytes(), [0, *(cuts + 4).tolist()], [*cuts.tolist(), 4 * len(ids)])
        for word, stem, tail in split:
            if tail not in self.tails:
                if len(self.tails) > CACHED:
                    self.tails = {}
                self.tails[tail] = self.whole(tail) if tail else b""
            known[word] = known[stem] + self.tails[tail]
            self.size += len(word)


MARK = "\x01"
WORD_END = "</w>"  # how the vocabulary spells the end of a piece
# Characters that str.split() takes for white space and the tokenizer does not, and the mark.
ODD = re.compile("[\x01\x1c-\x1f]")
PUNCTUATION = ".,!?;:|*#$%&-\"()"
ENDS = frozenset(PUNCTUATION)


@cache
def _tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


class Packer:
    """Open windows of one task; `out` collects placed pieces."""

    def __init__(self, first_id: int, length: int = LENGTH, open_windows: int = OPEN):
        self.next_id, self.length, self.most = first_id, length, open_windows
        self.windows: dict[int, list[tuple]] = {}
        self.used: dict[int, int] = {}
        self.out: list[tuple] = []

    def _new(self) -> int:
        self.next_id += 1
        self.windows[self.next_id], self.used[self.next_id] = [], 0
        return self.next_id

    def _put(self, window: int, piece: tuple) -> None:
        doc, start, ids, total = piece
        self.windows[window].append((doc, start, len(ids) // 4, ids, total, window, self.used[window]))
        self.used[window] += len(ids) // 4

    def _emit(self, window: int, open_: bool = False) -> None:
        self.out += [(*p, open_) for p in self.windows.pop(window)]
        del self.used[window]

    def add(self, doc: Any, start: int, ids: bytes, total: int) -> None:
        size = len(ids) // 4
        while size >= self.length:
            window = self._new()
            self._put(window, (doc, start, ids[:4 * self.length], total))
            self._emit(window)
            ids, start, size = ids[4 * self.length:], start + self.length, size - self.length
        while size:
            fits = [w for w, u in self.used.items() if u + size <= self.length]
            if fits:
                window = max(fits, key=self.used.__getitem__)
                self._put(window, (doc, start, ids, total))
                if self.used[window] == self.length:
                    self._emit(window)
                return
            if len(self.used) < self.most:
                self._put(self._new(), (doc, start, ids, total))
                return
            window = max(self.used, key=self.used.__getitem__)
            room = self.length - self.used[window]
            if LEAST_PIECE <= room <= size - LEAST_PIECE:
                self._put(window, (doc, start, ids[:4 * room], total))
                ids, start, size = ids[4 * room:], start + room, size - room
            self._emit(window)

    def close(self) -> None:
        for window in list(self.windows):
            self._emit(window, True)

    def taken(self) -> pd.DataFrame:
        rows, self.out = self.out, []
        return pd.DataFrame(rows, columns=COLUMNS).astype({"doc_id": "Int64"})


def _task_base() -> int:
    """First id of a task: room for 2^32 windows each, told apart by partition."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 32


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, open_windows: int = OPEN, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids (little-endian unsigned 32 bit, as bytes),
    doc_tokens, sequence_id, offset.

    Every id of a document, its end id last, lies in one piece; NULL and empty texts have the end
    id only. Rows with the same or a NULL doc_id are documents of their own. An empty table gives
    no rows. Sequences are `length` ids but for those that stay short when all tasks are merged.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, words = Packer(_task_base(), length, open_windows), _tokenizer(tokenizer)
        for batch in batches:
            for doc, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                ids = words.ids(text or "") + end
                packer.add(doc, 0, ids, len(ids) // 4)
                if len(packer.out) >= 2000:
                    yield packer.taken()
            yield packer.taken()
        packer.close()
        yield packer.taken()

    placed = written(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(tidied(run), PIECES))
    done, level, rest = [placed.where("not open")], 0, placed.where("open")
    parts = docs.sparkSession.sparkContext.defaultParallelism
    if not placed.isEmpty():
        parts = placed.agg(F.max(F.shiftright("sequence_id", 32)).alias("p")).first()["p"] + 1
    while parts > 1:
        level += 1
        rest = written(_merged(rest, level, length, open_windows))
        done.append(rest.where("not open"))
        rest, parts = rest.where("open"), -(-parts // GROUP)
    out = done[0]
    for more in [*done[1:], rest]:
        out = out.unionByName(more)
    return out.drop("open")


def _merged(rest: DataFrame, level: int, length: int, open_windows: int) -> DataFrame:
    """Open windows of GROUP tasks packed again; a group holds at most GROUP × OPEN windows."""
    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        # Ids of a level lie above those of the levels before.
        packer = Packer((level << 58) | (int(key[0]) << 32), length, open_windows)
        pieces = pieces.sort_values(["sequence_id", "offset"])
        for row in pieces.itertuples(index=False):
            packer.add(row.doc_id, int(row.start), bytes(row.ids), int(row.doc_tokens))
        packer.close()
        return packer.taken()

    task = F.shiftright("sequence_id", 32).bitwiseAND(F.lit((1 << 26) - 1))
    return rest.groupBy(F.floor(task / GROUP).alias("task")).applyInPandas(run, PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence in order; sequences are of bounded length."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"))
