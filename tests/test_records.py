"""Delimited text with quoted line breaks, and folders of files of every kind."""

import csv
import io
import json
import random

import duckdb
import pytest

from termweave.sources import readers
from termweave.sources.records import delimited_records, split_delimited


def parsed(spark, text, sep, parts=1):
    lines = [("d", i << 30, t) for i, t in enumerate(text.rstrip("\n").split("\n"))]
    frame = spark.createDataFrame(lines, "doc string, ord long, text string").repartition(parts, "ord")
    records, unclosed = delimited_records(frame, sep)
    rows = records.select("ord", split_delimited(records.text, sep).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.ord)], unclosed.count()


CELLS = ["", "a", "b c", 'say "hi"', "x,y", "x|y", "x\ty", "line\nbreak", 'two\n\n"quoted"\nbreaks', '"', '""', "\n", "end\n", ' "', "5", "ü\n|,é"]


@pytest.mark.parametrize("sep", [",", "|", "\t", ";"])
def test_records_equal_other_readers(spark, tmp_path, sep):
    """What a writer of RFC 4180 wrote comes back, as by DuckDB's reader and Python's."""
    dice = random.Random(2)
    rows = [[dice.choice(CELLS) for _ in range(3)] for _ in range(150)]
    out = io.StringIO()
    csv.writer(out, delimiter=sep, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows(rows)
    text = out.getvalue()
    found, unclosed = parsed(spark, text, sep, 7)
    assert found == rows and unclosed == 0
    path = tmp_path / "t.csv"
    path.write_text(text)
    theirs = duckdb.connect().execute(
        "SELECT * FROM read_csv(?, delim = ?, quote = '\"', escape = '\"', header = false, all_varchar = true, auto_detect = false, "
        "columns = {'a': 'VARCHAR', 'b': 'VARCHAR', 'c': 'VARCHAR'})", [str(path), sep]).fetchall()
    assert [[c or "" for c in r] for r in theirs] == rows


def test_quotes_inside_plain_fields_open_nothing(spark):
    assert parsed(spark, 'a,5" disk,x\nb,c"d"e,"f"\n', ",")[0] == [["a", '5" disk', "x"], ["b", 'c"d"e', "f"]]
    assert parsed(spark, '"a""b,"c\nd,"e\nf",g\n', ",")[0][-1] == ["d", "e\nf", "g"]


def test_an_unclosed_field_is_reported(spark):
    found, unclosed = parsed(spark, 'a,b\n"x\ny",z\nc,"d\ne\nf\n', ",", 3)
    assert found == [["a", "b"], ["x\ny", "z"]] and unclosed == 1


def test_long_fields(spark):
    """Fields of very many characters and quotes do not exhaust the stack."""
    cell = 'x""' * 60_000
    assert parsed(spark, f'"{cell}",b\n', ",")[0] == [['x"' * 60_000, "b"]]


def test_a_file_of_several_splits(spark, tmp_path):
    """Records go on across the splits of a file."""
    rows = [[f"x:{i}", f"label {i}\nsecond, line {i}" + " pad" * 400, f'say "{i}"'] for i in range(3000)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["id", "label", "ex:note"], *rows])
    (tmp_path / "t.csv").write_text(out.getvalue())
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        found = readers.read_delimited(spark, str(tmp_path / "t.csv"), ",").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert {(r.id, r.label, r.prop, r.value) for r in found} == {(a, b, "ex:note", c) for a, b, c in rows}


OUTLINE = """* Terms
:PROPERTIES:
:ID: d-class-hierarchy
:resourcedefs: yes
:END:
** "widget"@en (ex:widget)
 - skos:definition :: A thing.
* Prefixes
:PROPERTIES:
:prefixdefs: yes
:END:
| prefix | uri |
| ex: | http://ex.example.org/ |
"""
LABEL = "<http://www.w3.org/2000/01/rdf-schema#label>"


def write_folder(folder):
    folder.mkdir()
    (folder / "a.csv").write_text('id,label,kind\nex:a,"A\nB",thing\n')
    (folder / "b.json").write_text(json.dumps({"ex:c": "C"}))
    (folder / "c.json").write_text(json.dumps({"source": "s", "data": [{"id": "ex:t", "label": "T", "attrs": [["p", "v"], ["q", {"value": "w", "lang": "de"}]]}],
                                               "prefixes": [["ex", "http://t.example.org/"], ["ex", "http://no/"]]}))
    (folder / "d.org").write_text(OUTLINE)
    (folder / "e.nt").write_text(f'<http://x/1> {LABEL} "One"@en .\n# note\n\n<http://x/1> <http://x/p> <http://x/2> .\n')
    (folder / "f.ttl").write_text(f'@prefix z: <http://z.example.org/> .\n<http://x/3> {LABEL} "Three" .\n')
    (folder / "g.tsv").write_text("id\tlabel\nex:g\tG\n")


def test_every_kind_of_file_is_registered(spark, tmp_path):
    from termweave.operators import store as W

    write_folder(tmp_path / "in")
    path = str(tmp_path / "index")
    W.create_index(spark, path)
    got = {r.source.rsplit("/", 1)[1]: (r.status, r.entities, r.error) for r in W.register_folder(spark, path, str(tmp_path / "in")).collect()}
    assert got == {f: ("registered", 1, None) for f in ("a.csv", "b.json", "c.json", "d.org", "e.nt", "f.ttl", "g.tsv")}
    index = W.load_index(spark, path)
    assert {(r.id, r.label) for r in index.entities.collect()} == {
        ("ex:a", "A\nB"), ("ex:c", "C"), ("ex:t", "T"), ("ex:widget", "widget"), ("http://x/1", "One"), ("http://x/3", "Three"), ("ex:g", "G")}
    assert {(r.prefix, r.expansion) for r in index.prefixes.collect()} == {
        ("ex", "http://t.example.org/"), ("ex", "http://ex.example.org/"), ("z", "http://z.example.org/")}
    assert ("ex:t", "q", "w", "de") in {(r.id, r.prop, r.value, r.lang) for r in index.attributes.collect()}


def test_a_damaged_file_keeps_its_old_rows(spark, tmp_path):
    from termweave.operators import store as W

    folder, path = tmp_path / "in", str(tmp_path / "index")
    write_folder(folder)
    W.create_index(spark, path)
    W.register_folder(spark, path, str(folder))
    before = {(r.id, r.label) for r in W.load_index(spark, path).entities.collect()}
    (folder / "b.json").write_text('{"ex:c": "changed", "ex:')
    (folder / "a.csv").write_text('id,label\nex:a,changed\nex:b,"never closed\n')
    (folder / "e.nt").write_text("<http://x/1> no statement\n")
    (folder / "g.tsv").write_text("id\tlabel\nex:g\tG2\n")
    (folder / "h.xyz").write_text("?")
    got = {r.source.rsplit("/", 1)[1]: (r.status, r.entities, r.error) for r in W.register_folder(spark, path, str(folder), force=True).collect()}
    assert got["b.json"] == ("failed", 1, 'no JSON object: {"ex:c": "changed", "ex:')
    assert got["a.csv"] == ("failed", 1, "a quoted field is not closed")
    assert got["e.nt"] == ("failed", 1, "no statement: <http://x/1> no statement")
    assert got["h.xyz"] == ("failed", 0, "unknown extension 'xyz'") and got["g.tsv"] == ("refreshed", 1, None)
    after = {(r.id, r.label) for r in W.load_index(spark, path).entities.collect()}
    assert after == before - {("ex:g", "G")} | {("ex:g", "G2")}
    rows, errors = readers.ingest_dir(spark, str(folder))
    assert {r.path.rsplit("/", 1)[1] for r in errors.collect()} == {"a.csv", "b.json", "e.nt", "h.xyz"}
    assert "ex:b" not in {r.id for r in rows.collect()}
