"""Ordered text files come back in order, however many files and splits there are."""

import random

import pytest
from pyspark.sql import functions as F

from termweave.sources import sinks


@pytest.fixture(autouse=True)
def many_files(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_lines_come_back_in_order(spark, tmp_path):
    rows = [("ab c/ü"[i % 3], n, f"{n} " + "x" * (n % 90)) for i in range(3) for n in range(1, 4001)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "doc string, line long, text string")
    sinks.write_lines(frame, str(tmp_path / "o"), ["doc"])
    assert len(list((tmp_path / "o").rglob("part-*.txt"))) > 6
    back = sinks.read_lines_back(spark, str(tmp_path / "o"), ["doc"])
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_tables_as_text(spark, tmp_path):
    frame = spark.range(300).select(F.col("id").alias("n"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("a\tb\n"), F.col("id").cast("string"))).alias("t"))
    sinks.write_tsv(frame, str(tmp_path / "t"), ["n"])
    got = [r.text for r in sorted(sinks.read_lines_back(spark, str(tmp_path / "t")).collect(), key=lambda r: r.line)]
    assert got == ["n\tt", *[f"{n}\t" + (f"a b / {n}" if n % 3 else "") for n in range(300)]]
    sinks.write_json(frame, str(tmp_path / "j"), ["n"])
    assert [r.text for r in sorted(sinks.read_lines_back(spark, str(tmp_path / "j")).collect(), key=lambda r: r.line)][:2] == [
        '{"n":0,"t":null}', '{"n":1,"t":"a\\tb\\n1"}']
