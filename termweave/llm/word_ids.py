"""Ids of whole texts by a byte-level tokenizer, word by word from a bounded store.

Such a tokenizer splits a text before it merges bytes, and it always splits before a single space
that has no white space on either side, so what lies between two such spaces has the same ids in
every text. The ids of a word with its space are kept; of words with punctuation at their end, the
stem's and the punctuation's. All other stretches are encoded as they stand.
"""

from __future__ import annotations

from functools import cache

import numpy as np

WORDS = 600_000  # of a generation; two are kept
SYMBOLS = 12_000_000
SPACE = "Ġ"  # how a byte-level vocabulary spells a space
PUNCTUATION = ".,!?;:|*#$%&-\"()<>[]{}/=+~"
ENDS = frozenset(PUNCTUATION)


class WordIds:
    """`ids(text)`: little-endian unsigned integers of `width` bytes, as the tokenizer gives them
    without special tokens."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # every word it gets is new
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocabulary.values(), default=0) < 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Ids that begin with a space: the first of each word, and of no other part of a word.
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith(SPACE)]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.size = 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if any(a in text for a in self.added):
            return self.whole(text)
        if len(self.young) > WORDS or self.size > SYMBOLS:
            self.old, self.young, self.size = self.young, {}, 0
        words = text.split(" ")
        new = set(words).difference(self.young)
        if new and not self._learn(new):
            return b"".join(map(self._stretch, stretches(words)))
        return self.whole(words[0]) + b"".join(map(self.young.__getitem__, words[1:]))

    def _stretch(self, text: str) -> bytes:
        held = self.young.get(text[1:]) if text[:1] == " " else None
        return self.whole(text) if held is None else held

    def _learn(self, new: set[str]) -> bool:
        """Keep the ids of these words; False if one of them touches white space or is empty."""
        young, old, plain, unknown, cut = self.young, self.old, True, set(), []
        for word in new:
            if not word or word[0].isspace() or word[-1].isspace():
                plain = False
                continue
            held = old.get(word)
            if held is not None:
                young[word] = held
                continue
            if word[-1] in ENDS:
                stem = word.rstrip(PUNCTUATION)
                if stem and stem[-1].isalnum():
                    cut.append((word, stem))
                    word = stem
                    if stem in young:
                        continue
                    held = old.get(stem)
                    if held is not None:
                        young[stem] = held
                        continue
            unknown.add(word)
        stems = list(unknown)
        for at in range(0, len(stems), 1024):
            part = stems[at:at + 1024]
            text = " " + " ".join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            cuts = (self.width * np.flatnonzero(self.opens[ids])).tolist()
            data = ids.tobytes()
            young.update(zip(part, map(data.__getitem__, map(slice, cuts, [*cuts[1:], len(data)]))))
            self.size += len(text)
        for word, stem in cut:
            tail = word[len(stem):]
            if tail not in self.tails:
                if len(self.tails) > WORDS:
                    self.tails = {}
                self.tails[tail] = self.whole(tail)
            young[word] = young[stem] + self.tails[tail]
            self.size += len(word)
        return plain


def stretches(words: list[str]) -> list[str]:
    """The pieces of a text split at single spaces, joined again where white space meets."""
    out, last = [words[0]], words[0]
    for word in words[1:]:
        if word and last and not word[0].isspace() and not last[-1].isspace():
            out.append(f" {word}")
        else:
            out[-1] += f" {word}"
        last = word
    return out


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)
