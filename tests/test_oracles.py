"""Every registered query against an independent engine, on the smallest tables."""

import os

import compare
import pytest

import catalog

catalog.load_all()
SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    ok, note = compare.check(spark, duck, name, catalog.QUERIES[name], catalog.ORACLES.get(name), SF)
    assert ok, note
    assert "TYPES" not in note, note


def test_entry(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["token", "doc", "kind", "label"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
