"""Hashes of words, many texts at once."""

from termweave.llm import lines

ODD = ["", None, "  ", "a", "\x0b x\x0c y ", "\ud800 z", "é ü 日本", "\n\n", "b" * 70_000 + " a", "x\x00y \x00 \x00\x00", "a\x85b c", "ab ba a b"]


def test_words_of_many_texts_are_hashed_at_once(monkeypatch):
    monkeypatch.setattr(lines, "WORDS", 3)
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in ODD]
    found = lines.word_hashes(ODD)
    assert [len(f) for f in found] == [len(w) for w in words]
    seen = {}
    for of, hashes in zip(words, found):
        for word, h in zip(of, hashes.tolist()):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    assert [lines.word_hashes([t])[0].tolist() for t in ODD] == [f.tolist() for f in found]
