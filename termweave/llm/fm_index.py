"""A bidirectional FM-index over delimited words, and search schemes for one error.

The text is `$w1$w2...$` over the sorted words of a block. The index holds the suffix array, and
for the text and for its reverse how often each symbol occurs before each rank. An interval of
suffix ranks is kept for both at once, so a match can be extended by a symbol on either side in
constant time. Many queries are searched together, as arrays.

A word and one that differs by one edit agree in the first or in the last half of the word:

* scheme LEFT matches `$` and the first half exactly, then extends to the right through the rest,
  allowing one error, up to the closing `$`;
* scheme RIGHT matches the last half and `$` exactly, then extends to the left likewise.

Each state that has made its error is extended exactly, so it can only die or end.
"""

from __future__ import annotations

import numpy as np

LEFT, RIGHT = 0, 1


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order, by ranks of prefixes of doubling length."""
    n = len(codes)
    rank, length = codes.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[:n - length] = rank[length:] + 1
        key = rank * (max(n, int(rank.max())) + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        length *= 2
        if rank[order[-1]] == n - 1 or length >= n:
            return order


class Ranks:
    """Occurrences of each symbol in the Burrows-Wheeler transform before each rank."""

    def __init__(self, codes: np.ndarray, symbols: int):
        self.order = suffix_array(codes)
        last = codes[self.order - 1]
        self.before = np.zeros((len(codes) + 1, symbols), np.int32)
        self.before[np.arange(1, len(codes) + 1), last] = 1
        np.cumsum(self.before, axis=0, out=self.before)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=symbols))))[:-1]


class Interval:
    """Ranks of queries' matches: `at` where they are extended, `other` in the opposite index."""

    def __init__(self, at: np.ndarray, other: np.ndarray, size: np.ndarray):
        self.at, self.other, self.size = at, other, size

    def take(self, rows: np.ndarray) -> Interval:
        return Interval(self.at[rows], self.other[rows], self.size[rows])


class WordIndex:
    """The index of a block of distinct words; `words` are kept in code-point order."""

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        text = np.frombuffer(("\0" + "".join(w + "\0" for w in self.words)).encode("utf-32-le"), "<u4")
        self.alphabet = np.unique(text)  # the delimiter is 0 and so the least symbol
        codes = np.searchsorted(self.alphabet, text)
        self.codes, self.symbols = codes, len(self.alphabet)
        self.starts = np.flatnonzero(codes == 0)
        self.forward, self.reverse = Ranks(codes, self.symbols), Ranks(codes[::-1], self.symbols)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words in a row, -1 for symbols the index lacks, and where each begins."""
        text = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        at = np.minimum(np.searchsorted(self.alphabet, text), self.symbols - 1)
        starts = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        return np.where(self.alphabet[at] == text, at, -1), starts

    def _counts(self, ranks: Ranks, found: Interval) -> np.ndarray:
        return ranks.before[found.at + found.size] - ranks.before[found.at]

    def _child(self, ranks: Ranks, found: Interval, counts: np.ndarray, symbol: np.ndarray) -> Interval:
        """The matches extended by one symbol each (at least one occurrence each)."""
        rows = np.arange(len(symbol))
        upto = np.cumsum(counts, axis=1)[rows, symbol]
        size = counts[rows, symbol]
        return Interval(ranks.first[symbol] + ranks.before[found.at, symbol], found.other + upto - size, size)

    def near(self, queries: list[str], scheme: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word), by their places in `queries` and `self.words`, that differ by one
        inserted, deleted or replaced symbol and agree in the half that `scheme` matches exactly:
        the first len // 2 symbols, or the others."""
        ranks = self.reverse if scheme == LEFT else self.forward
        text, starts = self.encode(queries if scheme == LEFT else [q[::-1] for q in queries])
        lengths = np.diff(starts)
        exact = lengths // 2 if scheme == LEFT else lengths - lengths // 2
        query = np.arange(len(queries))
        n = len(self.codes)
        whole = np.zeros(len(queries), np.int64)
        found = Interval(whole, whole, np.full(len(queries), n))
        query, found = self._extended(ranks, query, found, np.zeros(len(query), np.int64))
        for step in range(int(exact.max(initial=0))):
            going = exact[query] > step
            kept, rest = np.flatnonzero(~going), np.flatnonzero(going)
            more, longer = self._extended(ranks, query[rest], found.take(rest), text[starts[query[rest]] + step])
            query = np.concatenate((query[kept], more))
            found = Interval(*(np.concatenate((getattr(found, f)[kept], getattr(longer, f))) for f in ("at", "other", "size")))
        return self._one_error(ranks, text, starts, lengths, query, exact[query], found, scheme)

    def _extended(self, ranks: Ranks, query: np.ndarray, found: Interval, symbol: np.ndarray) -> tuple[np.ndarray, Interval]:
        """Extension by one symbol; those without an occurrence go."""
        counts = self._counts(ranks, found)
        alive = np.flatnonzero((symbol >= 0) & (counts[np.arange(len(symbol)), symbol] > 0))
        return query[alive], self._child(ranks, found.take(alive), counts[alive], symbol[alive])

    def _one_error(self, ranks: Ranks, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, query: np.ndarray,
                   place: np.ndarray, found: Interval, scheme: int) -> tuple[np.ndarray, np.ndarray]:
        erred = np.zeros(len(query), bool)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        while len(query):
            counts = self._counts(ranks, found)
            ended = place == lengths[query]
            here = np.where(ended, 0, text[np.minimum(starts[query] + place, max(len(text) - 1, 0))])
            matches = np.flatnonzero((here >= 0) & (counts[np.arange(len(query)), here] > 0))
            closed = matches[ended[matches] & erred[matches]]
            if len(closed):
                end = self._child(ranks, found.take(closed), counts[closed], here[closed])
                pairs.append((query[closed], self._word(end, scheme, len(closed))))
            onward = matches[~ended[matches]]
            fresh = np.flatnonzero(~erred)
            row, symbol = np.nonzero(counts[fresh, 1:])
            row, symbol = fresh[row], symbol + 1
            other = (symbol != here[row]) & ~ended[row]
            skipped = fresh[~ended[fresh]]
            # Matched, replaced, inserted; skipped keep their interval.
            rows = np.concatenate((onward, row[other], row))
            symbols = np.concatenate((here[onward], symbol[other], symbol))
            made = self._child(ranks, found.take(rows), counts[rows], symbols)
            move = np.concatenate((np.ones(len(onward), np.int64), np.ones(int(other.sum()), np.int64), np.zeros(len(row), np.int64)))
            error = np.concatenate((erred[onward], np.ones(len(rows) - len(onward), bool), np.ones(len(skipped), bool)))
            last = found.take(skipped)
            query, place = np.concatenate((query[rows], query[skipped])), np.concatenate((place[rows] + move, place[skipped] + 1))
            found = Interval(*(np.concatenate((getattr(made, f), getattr(last, f))) for f in ("at", "other", "size")))
            erred = error
        if not pairs:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.unique(np.stack([np.concatenate(side) for side in zip(*pairs)]), axis=1)
        both = both[:, both[1] < len(self.words)]  # the last delimiter meets the first: no word
        return both[0], both[1]

    def _word(self, end: Interval, scheme: int, count: int) -> np.ndarray:
        """Which word a closed match is: its rank in the text's own suffix array tells the place."""
        rank = end.other if scheme == LEFT else end.at
        return np.searchsorted(self.starts, self.forward.order[rank])
