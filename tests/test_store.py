"""A stored index kept up to date from a folder of files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from termweave.operators import store as W
from termweave.operators import versions as V


def statuses(frame):
    return {r.source.rsplit("/", 1)[1]: (r.status, r.entities) for r in frame.collect()}


def test_folder_is_registered_and_refreshed(spark, tmp_path):
    folder, path = tmp_path / "in", str(tmp_path / "index")
    folder.mkdir()
    (folder / "a.csv").write_text("id,label,kind\nex:a,A,thing\nex:b,B,thing\n")
    (folder / "b.json").write_text(json.dumps({"ex:c": "C", "ex:d": {"label": "D", "n": 3}}))
    (folder / "c.xyz").write_text("?")
    W.create_index(spark, path)
    assert statuses(W.register_folder(spark, path, str(folder))) == {
        "a.csv": ("registered", 2), "b.json": ("registered", 2), "c.xyz": ("failed", 0)}
    assert statuses(W.register_folder(spark, path, str(folder)))["a.csv"] == ("up to date", 2)
    (folder / "a.csv").write_text("id,label,kind\nex:a,A2,\n")
    later = os.stat(folder / "a.csv").st_mtime + 100
    os.utime(folder / "a.csv", (later, later))
    assert statuses(W.register_folder(spark, path, str(folder))) == {
        "a.csv": ("refreshed", 1), "b.json": ("up to date", 2), "c.xyz": ("failed", 0)}
    index = W.load_index(spark, path)
    assert {(r.id, r.label, r.kind) for r in index.entities.collect()} == {
        ("ex:a", "A2", "curie"), ("ex:c", "C", "curie"), ("ex:d", "D", "curie")}
    assert {(r.id, r.prop, r.value) for r in index.attributes.collect()} == {("ex:d", "n", "3")}
    assert index.global_prefixes.count() == 10
    assert {(r.type, r.entities) for r in W.list_sources(index).collect()} == {("csv", 1), ("json", 2)}
    assert statuses(W.register_folder(spark, path, str(folder), force=True))["b.json"] == ("refreshed", 2)


def test_emptied_source_leaves_no_rows(spark, tmp_path):
    folder, path = tmp_path / "in", str(tmp_path / "index")
    folder.mkdir()
    (folder / "a.csv").write_text("id,label\nex:a,A\n")
    W.create_index(spark, path)
    W.register_folder(spark, path, str(folder))
    (folder / "a.csv").write_text("id,label\n")
    assert statuses(W.register_folder(spark, path, str(folder), force=True)) == {"a.csv": ("refreshed", 0)}
    assert W.load_index(spark, path).entities.count() == 0


def test_pattern_removal_is_guarded(spark, tmp_path):
    rows = spark.createDataFrame([("part", "", "t", 1.0, 1.0), ("parts", "x", "t", 1.0, 1.0)], W.SCHEMAS["sources"])
    assert W.matching_sources(rows, "part").count() == 1
    assert W.matching_sources(rows, "PART%", like=True).count() == 2
    assert W.matching_sources(rows, "part_", like=True).count() == 1
    try:
        W.matching_sources(rows, "%", like=True)
    except ValueError:
        pass
    else:
        raise AssertionError("a pattern for every source must be refused")
    assert W.matching_sources(rows, "%", like=True, allow_all=True).count() == 2


def terms(*rows):
    return [(s, "", i, lab, "p", v, "", n, 0) for n, (s, i, lab, v) in enumerate(rows)]


LONG = "source string, data_source string, id string, label string, prop string, value string, lang string, ord long, seq int"


def batch_of(spark, mtime, *rows):
    frame = spark.createDataFrame(terms(*rows), LONG)
    times = frame.select("source", "data_source").distinct().withColumn("last_modified", F.lit(float(mtime)))
    return W.source_batch(frame, "t", times, F.lit(0.0))


def content(spark, path, version=None):
    index = V.load_index(spark, path, version)
    return sorted((r.source, r.id, r.label) for r in index.entities.collect()), sorted(
        (r.source, r.id, r.value) for r in index.attributes.collect())


OLD = [("a", "x:1", "A1", "old"), ("a", "x:2", "A2", "old"), ("b", "x:1", "B1", "old")]


@pytest.mark.parametrize("table", ["entities", "attributes", "prefixes", "manifest"])
def test_a_dead_update_leaves_the_old_version(spark, tmp_path, monkeypatch, table):
    """An update that dies between two tables changes nothing, and can be made again."""
    path = str(tmp_path / "index")
    V.save_index(batch_of(spark, 1, *OLD), path)
    before = content(spark, path)
    new = batch_of(spark, 2, ("a", "x:1", "A1", "new"))

    def dies(*args, **kwargs):
        raise OSError("the writer died")

    with monkeypatch.context() as patch:
        if table == "manifest":
            patch.setattr(V, "_manifest_written", dies)
        else:
            write = V._rows_written
            patch.setattr(V, "_rows_written", lambda rows, at, name, *a: dies() if name == table else write(rows, at, name, *a))
        with pytest.raises(OSError):
            V.update_stored(spark, path, new, "commit-2")
    assert content(spark, path) == before and V.current_version(spark, path) == 1
    assert V.update_stored(spark, path, new, "commit-2")
    assert content(spark, path) == ([("a", "x:1", "A1"), ("b", "x:1", "B1")], [("a", "x:1", "new"), ("b", "x:1", "old")])
    assert not V.update_stored(spark, path, new, "commit-2")


def test_an_update_writes_its_own_rows_only(spark, tmp_path):
    path = str(tmp_path / "index")
    V.save_index(batch_of(spark, 1, *OLD), path)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "index" / "data").rglob("*.parquet")}
    V.update_stored(spark, path, batch_of(spark, 2, ("b", "x:9", "B9", "new")), "second")
    assert {p: p.stat().st_mtime_ns for p in files} == files
    assert {r.source for r in spark.read.parquet(f"{path}/data/entities/commit=second").collect()} == {"b"}
    assert content(spark, path, 1)[0] == [("a", "x:1", "A1"), ("a", "x:2", "A2"), ("b", "x:1", "B1")]
    assert content(spark, path)[0] == [("a", "x:1", "A1"), ("a", "x:2", "A2"), ("b", "x:9", "B9")]


def test_removal_compaction_and_vacuum(spark, tmp_path):
    path = str(tmp_path / "index")
    V.save_index(batch_of(spark, 1, *OLD), path)
    V.update_stored(spark, path, batch_of(spark, 2, ("b", "x:9", "B9", "new")))
    V.remove_stored(spark, path, spark.createDataFrame([("a", "")], "source string, data_source string"))
    left = content(spark, path)
    assert left == ([("b", "x:9", "B9")], [("b", "x:9", "new")])
    V.compact(spark, path)
    assert content(spark, path) == left and content(spark, path, 1)[0][0] == ("a", "x:1", "A1")
    assert V.vacuum(spark, path) and content(spark, path) == left
    assert len(list((tmp_path / "index" / "data" / "entities").iterdir())) == 1
    with pytest.raises(ValueError):
        V.vacuum(spark, path, keep=0)


def test_a_late_writer_gives_up(spark, tmp_path, monkeypatch):
    """Two updates from one version: the second to finish is refused, none is lost silently."""
    path = str(tmp_path / "index")
    V.save_index(batch_of(spark, 1, *OLD), path)
    write, inner = V._write_rows, []

    def overtaken(*args):
        write(*args)
        if not inner:
            inner.append(1)
            V.update_stored(spark, path, batch_of(spark, 3, ("b", "x:3", "B3", "first")))

    monkeypatch.setattr(V, "_write_rows", overtaken)
    with pytest.raises(RuntimeError, match="came first"):
        V.update_stored(spark, path, batch_of(spark, 2, ("a", "x:2", "A2", "late")))
    assert ("b", "x:3", "B3") in content(spark, path)[0]


def test_nothing_stored(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        V.load_index(spark, str(tmp_path / "none"))
    assert V.update_stored(spark, str(tmp_path / "new"), batch_of(spark, 1, *OLD))
    assert len(content(spark, str(tmp_path / "new"))[0]) == 3


def test_rows_are_sorted_in_even_tasks(spark, tmp_path):
    """Rows of one file and one source are dealt to several tasks before they are sorted."""
    rows = spark.range(40_000).coalesce(1).selectExpr("concat('ex:', id) AS id", "'p' AS prop", "concat('value ', id * 7919 % 40009) AS value",
                                                      "'' AS lang", "'s' AS source", "'' AS data_source", "id AS ord")
    small = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize"]
    before = {name: spark.conf.get(name) for name in small}
    try:
        for name in small:
            spark.conf.set(name, "20k")
        V._rows_written(rows, str(tmp_path), "attributes", "c1")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    back = spark.read.parquet(f"{tmp_path}/data/attributes/commit=c1")
    assert back.exceptAll(rows).isEmpty() and back.count() == 40_000
    sizes = [spark.read.parquet(str(p)).count() for p in (tmp_path / "data/attributes/commit=c1").glob("part-*.parquet")]
    assert len(sizes) > 2 and max(sizes) < 20_000
