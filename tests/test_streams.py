"""Streams into a stored index: failed batches, replays, files of every kind."""

import pytest

from test_records import write_folder
from termweave.operators import store as W
from termweave.operators import versions as V
from termweave.streaming import live

ROW = "source string, data_source string, version long, id string, label string, prop string, value string, lang string, ord long, seq int"


def rows_of(spark, version, *terms):
    return spark.createDataFrame([("s", "", version, t, t.upper(), "p", v, "", n, 0) for n, (t, v) in enumerate(terms)], ROW)


def content(spark, path):
    index = W.load_index(spark, path)
    return sorted((r.id, r.value) for r in index.attributes.collect()), sorted((r.id, r.label) for r in index.entities.collect())


@pytest.mark.parametrize("table", ["entities", "attributes", "prefixes", "manifest"])
def test_a_batch_that_dies_is_replayed_whole(spark, tmp_path, monkeypatch, table):
    """Version 1 holds a and b; the batch of version 2, which has a only, dies between two tables.
    After the restart the index holds version 2 and nothing of version 1."""
    path, files, checkpoint = (str(tmp_path / n) for n in ("index", "in", "checkpoint"))
    W.create_index(spark, path)
    rows_of(spark, 1, ("a", "old"), ("b", "old")).coalesce(1).write.parquet(files)
    stream = lambda: live.index_stream(spark.readStream.schema(ROW).parquet(files), path, checkpoint)
    stream().awaitTermination()
    one = content(spark, path)
    assert one == ([("a", "old"), ("b", "old")], [("a", "A"), ("b", "B")])
    rows_of(spark, 2, ("a", "new")).coalesce(1).write.mode("append").parquet(files)

    def dies(*args, **kwargs):
        raise OSError("the writer died")

    with monkeypatch.context() as patch:
        if table == "manifest":
            patch.setattr(V, "_manifest_written", dies)
        else:
            write = V._rows_written
            patch.setattr(V, "_rows_written", lambda rows, at, name, *a: dies() if name == table else write(rows, at, name, *a))
        with pytest.raises(Exception, match="died"):
            stream().awaitTermination()
    assert content(spark, path) == one
    stream().awaitTermination()
    assert content(spark, path) == ([("a", "new")], [("a", "A")])


def test_a_stored_batch_is_not_stored_twice(spark, tmp_path):
    """The index was written, but the stream died before it noted the batch."""
    path = str(tmp_path / "index")
    W.create_index(spark, path)
    batch = W.source_batch(rows_of(spark, 1, ("a", "x")).drop("version"), "t", rows_of(spark, 1, ("a", "x")).selectExpr(
        "source", "data_source", "1.0D AS last_modified"), live.F.lit(0.0))
    assert V.update_stored(spark, path, batch, live._commit("c", 0))
    version = V.current_version(spark, path)
    assert not V.update_stored(spark, path, batch, live._commit("c", 0))
    assert V.current_version(spark, path) == version


def test_versions_in_several_batches(spark, tmp_path):
    """Rows of the stored version are added, older ones left out."""
    path, files, checkpoint = (str(tmp_path / n) for n in ("index", "in", "checkpoint"))
    W.create_index(spark, path)
    for version, terms in ((2, [("a", "1")]), (2, [("b", "2")]), (1, [("c", "3")])):
        rows_of(spark, version, *terms).coalesce(1).write.mode("append").parquet(files)
        live.index_stream(spark.readStream.schema(ROW).parquet(files), path, checkpoint).awaitTermination()
    assert content(spark, path)[0] == [("a", "1"), ("b", "2")]


def test_files_are_indexed_as_they_arrive(spark, tmp_path):
    folder, path, checkpoint = tmp_path / "in", str(tmp_path / "index"), str(tmp_path / "checkpoint")
    W.create_index(spark, path)
    write_folder(folder)
    run = lambda: live.index_files(spark, str(folder), path, checkpoint, per_trigger=4).awaitTermination()
    run()
    ids = {r.id for r in W.load_index(spark, path).entities.collect()}
    assert ids == {"ex:a", "ex:c", "ex:t", "ex:widget", "http://x/1", "http://x/3", "ex:g"}
    (folder / "new.tsv").write_text("id\tlabel\nex:n\tN\n")
    (folder / "broken.json").write_text("{")
    run()
    assert {r.id for r in W.load_index(spark, path).entities.collect()} == ids | {"ex:n"}
    assert {r.prefix for r in W.load_index(spark, path).prefixes.collect()} == {"ex", "z"}


def test_stream_files_grow_in_number(spark, monkeypatch):
    """The stream comes in two batches, but no task writes or reads half of all rows."""
    from catalog import files
    from catalog.streams import index_stream

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    monkeypatch.setattr(files, "_WRITTEN", {})
    try:
        index_stream(spark, "/root/testdata/sf0.001").count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    folder, = files._WRITTEN.values()
    assert spark.read.parquet(folder).select("_metadata.file_path").distinct().count() > 4


def test_newest_versions_shuffle_no_rows(spark):
    """However many rows there are: their sources are few."""
    one = rows_of(spark, 1, ("a", "x"))
    rows = spark.range(1_000_000).select("id").crossJoin(one.drop("id", "version")).selectExpr(
        "source", "data_source", "id % 2 AS version", "CAST(id AS string) AS id", "label", "prop", "value", "lang", "ord", "seq")
    newest = live.latest_versions(rows)
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert newest.count() == 500_000
