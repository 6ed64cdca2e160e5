import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, row_ string, _k string"
LONG = " ".join(f"wort{i % 997} und{i % 31}" for i in range(20_000))
PARA = " ".join(f"shared{i}" for i in range(60))


@pytest.fixture(scope="session")
def spark():
    import compare

    session = compare.session(4)
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return session


def rows():
    texts = [(1, "The quick brown fox jumps over the lazy dog and runs on.", "en", "a"), (2, None, "en", "a"), (3, "", None, None),
             (4, LONG, "de", "b"), (5, LONG, "de", "b"), (5, LONG, "de", "b"), (6, " \t\n ", "en", None),
             (7, f"Before it {PARA} after that.", "en", "a"), (8, f"Other words, {PARA} and more", "en", "a"),
             (9, "same same same same same same same same same same same same", "en", "a"), (None, "no id here at all", "en", "a"),
             (10, "mail me at a.b@c-d.example.org or +1 (017) 555-7713, 10.0.0.1 and 4111 1111 1111 1111", "en", "a"),
             (11, "üñí ÇÉ " * 30, "fr", "a"), (12, "123 456 !!", "en", "a")]
    return [(d, t, la, s, len(t or ""), "x", "y", "z", "k") for d, t, la, s in texts]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
