"""The language classifier against kernel ridge regression on explicit sets of n-grams."""

import random

import numpy as np

from termweave.llm import language


def grams(text):
    """Distinct n-grams of the letters; of a run of other characters the first is a space."""
    text = text.lower()
    plain = "".join(c if c.isalpha() else " " for i, c in enumerate(text) if i == 0 or c.isalpha() or text[i - 1].isalpha())
    plain = f" {plain} "
    return {plain[i:i + n] for n in range(1, language.NGRAM + 1) for i in range(len(plain) - n + 1)}


def kernel(a, b):
    return np.array([[len(x & y) / (len(x) * len(y)) ** 0.5 for y in b] for x in a])


def texts_of(dice, words, count):
    return [" ".join(dice.choice(words) for _ in range(dice.randint(4, 25))) + dice.choice([".", "!", " 12", ", ..."]) for _ in range(count)]


def test_scores_equal_kernel_ridge(monkeypatch):
    """In a space where hardly any n-grams share a place; the explicit sets share none."""
    monkeypatch.setattr(language, "BITS", 23)
    dice = random.Random(2)
    words = {"de": "über der Straße geht ein großer Hund nach Hause und schläft".split(), "en": "the old dog walks over this street and sleeps at home".split(),
             "fr": "le vieux chien marche dans la rue et dort à la maison".split()}
    train = [(lang, t) for lang, w in words.items() for t in texts_of(dice, w, 14)]
    probes = [t for w in words.values() for t in texts_of(dice, w, 10)] + ["der dog dans the Haus", "zzz qqq", "ß"]
    model = language.KernelClassifier([t for _, t in train], [lang for lang, _ in train], landmarks=14)
    sets = [grams(t) for _, t in train]
    k = kernel(sets, sets)
    n = len(train)
    target = (np.array([lang for lang, _ in train])[:, None] == np.array(model.langs)).astype(float)
    centre = np.eye(n) - 1 / n
    weights = np.linalg.solve(centre @ k @ centre + language.RIDGE * n * np.eye(n), centre @ target)
    cross = kernel([grams(t) for t in probes], sets)
    want = target.mean(axis=0) + (cross - k.mean(axis=0)) @ centre @ weights
    got = model.scores([language.ngrams(t) for t in probes])
    assert np.abs(got - want).max() < 5e-3
    assert (got.argmax(axis=1) == want.argmax(axis=1)).all()
    assert [model.langs[i] for i in got.argmax(axis=1)][:30] == ["de"] * 10 + ["en"] * 10 + ["fr"] * 10


def test_ngrams_are_the_explicit_ones():
    for text in ["Über 12 Straßen!", "a", "a  b", "  x-y ", "ÀÉ"]:
        assert len(language.ngrams(text)) == len(grams(text))
    assert len(language.ngrams("12 !")) == 0
