import os

import numpy as np

from termweave.llm import hidden_markov
from termweave.llm.tables import shared_folder


def test_packed_numbers_come_back():
    for values in (np.arange(70_000, dtype="<u4"), np.array([], "<f4"), np.linspace(-1, 1, 24).astype("<f4"), np.array([1 << 40], "<i8")):
        back = hidden_markov._unpacked(hidden_markov._packed(values), values.dtype.str)
        assert back.dtype == values.dtype and (back == values).all()


def test_rounds_leave_one_table_with_a_row_per_bin(spark):
    """Texts, links and the last table stay; words of texts and tables of earlier rounds go."""
    texts = [(i, " ".join(f"w{i * 7 % 50}x{k}" for k in range(40))) for i in range(100)]
    before = set(os.listdir(shared_folder(spark).removeprefix("file:")))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert hidden_markov.score_texts(docs).count() == 100
    left = [p for p in os.listdir(shared_folder(spark).removeprefix("file:")) if p not in before]
    assert len(left) == 3
    folder = shared_folder(spark)
    tables = [spark.read.parquet(f"{folder}/{p}") for p in left]
    assert [t.where("bin >= 0").count() for t in tables if "sums" in t.columns] == [1]
    assert sum("words" in t.columns and t.where("words is not null").count() for t in tables) == 0
