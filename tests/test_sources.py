from __future__ import annotations

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from tarnfold.operators.joins import apply_mappings, unmatched_mappings
from tarnfold.sources import readers, writers
from tarnfold.streaming.streams import stream_upsert

NOTE = "<note><title>{0}</title><content><![CDATA[<en-note>body {0}</en-note>]]></content><created>20240102T030405Z</created><tag>t1</tag><tag>t2</tag><note-attributes><author>me</author></note-attributes><resource><data>QUJD</data><mime>image/png</mime><resource-attributes><file-name>f.png</file-name></resource-attributes></resource></note>"


def test_read_enex_isolates_damage(spark, tmp_path):
    damaged = "<note><title>bad</title><content>oops</note>"
    (tmp_path / "Stack@@@Book.enex").write_text("<?xml version='1.0'?><en-export>" + NOTE.format("one") + damaged + NOTE.format("three") + "</en-export>")
    notes, issues = readers.read_enex(spark, str(tmp_path))
    rows = {r["ordinal"]: r for r in notes.collect()}
    assert set(rows) == {1, 3} and [r["ordinal"] for r in issues.collect()] == [2]
    assert rows[3]["title"] == "three" and rows[3]["tags"] == ["t1", "t2"] and rows[1]["attributes"]["author"] == "me"
    assert rows[1]["resources"][0]["file_name"] == "f.png" and "body one" in rows[1]["content"]


def test_read_enex_over_many_splits(spark, tmp_path):
    (tmp_path / "big.enex").write_text("<en-export>" + "".join(NOTE.format(f"n{i}") for i in range(2000)) + "</en-export>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        notes, issues = readers.read_enex(spark, str(tmp_path))
        assert issues.count() == 0
        assert [(r["ordinal"], r["title"]) for r in notes.select("ordinal", "title").orderBy("ordinal").collect()] == [(i + 1, f"n{i}") for i in range(2000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_html_export_and_inventory(spark, tmp_path):
    book = tmp_path / "Book"
    (book / "n.resources").mkdir(parents=True)
    (book / "n.html").write_text("<html><title> My note </title><p>x</p></html>")
    for shelf in ("a", "b c"):
        (tmp_path / shelf / "n").mkdir(parents=True)
        (tmp_path / shelf / "n" / "x.html").write_text(f"<title>{shelf}</title>")
    (tmp_path / "top.html").write_text("<p>no title</p>")
    (book / "n.resources" / "i.html").write_text("x")
    (book / "e.enex").write_text("<en-export></en-export>")
    (book / "x.txt").write_text("x")
    r = readers.read_html_export(spark, str(tmp_path)).collect()
    assert sorted((x["relative_path"], x["title"], x["notebook"]) for x in r) == [("Book/n.html", "My note", "Book"), ("a/n/x.html", "a", "n"), ("b c/n/x.html", "b c", "n"), ("top.html", "top", tmp_path.name)]
    found = {x["path"].rsplit("/", 1)[1]: (x["kind"], x["reason"]) for x in readers.inventory_inputs(spark, [str(tmp_path), str(book)]).collect()}
    assert found == {"x.html": ("html", None), "top.html": ("html", None), "n.html": ("html", None), "i.html": ("skipped", "resource_folder"), "e.enex": ("enex", None), "x.txt": ("skipped", "unknown_extension")}
    (book / "old.notes").write_text("x")
    with pytest.raises(ValueError, match="proprietary"):
        readers.inventory_inputs(spark, [str(tmp_path)])


def test_csv_report_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("=1", 'say "hi"', None, [1]), ("a,b", "two\nlines", -5, None)], "a string, b string, n int, l array<int>")
    writers.write_csv_report(df.coalesce(1), str(tmp_path / "r"))
    (part,) = glob.glob(f"{tmp_path}/r/part-*")
    assert list(csv.reader(open(part, newline=""))) == [["a", "b", "n", "l"], ["'=1", 'say "hi"', "", "[1]"], ["a,b", "two\nlines", "-5", ""]]
    writers.write_csv_report(df.limit(0), str(tmp_path / "e"))
    assert all(open(p).read() == "" for p in glob.glob(f"{tmp_path}/e/part-*"))


def test_summary_keeps_nulls(spark, tmp_path):
    writers.write_summary(spark.range(1).select(F.lit(1).alias("n"), F.lit(None).cast("string").alias("x")), str(tmp_path / "s"))
    (part,) = glob.glob(f"{tmp_path}/s/part-*")
    assert json.loads(open(part).read()) == {"n": 1, "x": None}


def test_state_versions(spark, tmp_path):
    root = str(tmp_path)
    assert readers.read_state(spark, root, "cleanup_jobs").count() == 0
    for status in ("running", "completed"):
        writers.write_state(spark.createDataFrame([("j", status)], "job_id string, status string"), root, "cleanup_jobs")
    assert [tuple(r) for r in readers.read_state(spark, root, "cleanup_jobs").select("job_id", "plan_id", "status").collect()] == [("j", None, "completed")]


def test_mappings(spark):
    files = spark.createDataFrame([("A.enex", "s", "n"), ("B.enex", "s", "n")], "name string, stack string, notebook string")
    m = spark.createDataFrame([("A", "S1", None), ("A.enex", "S2", "N2"), ("C", "x", "y")], "name string, stack string, notebook string")
    assert sorted((r["name"], r["stack"], r["notebook"]) for r in apply_mappings(files, m).collect()) == [("A.enex", "S1", "n"), ("B.enex", "s", "n")]
    assert [r["name"] for r in unmatched_mappings(m, files).collect()] == ["C"]


def test_stream_upsert_takes_late_rows_once(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "state")
    schema = "item_id long, status string, quality string, position long"
    for i, rows in enumerate([[(1, "queued", None, 1), (2, "queued", "full", 2)], [(1, "verified", "full", 5), (1, "writing", None, 4)], [(2, "verified", None, 3), (3, "queued", None, 6)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream_upsert(spark.readStream.schema(schema).parquet(str(src)), root, "source_items", "item_id", ["status", "quality"], str(tmp_path / "cp"), "position").awaitTermination()
    out = {r["item_id"]: (r["status"], r["quality"]) for r in readers.read_state(spark, root, "source_items").collect()}
    assert out == {1: ("verified", "full"), 2: ("verified", "full"), 3: ("queued", None)}


def test_a_second_run_stores_only_new_contents(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda *contents: spark.createDataFrame([(bytearray(c) if c is not None else None,) for c in contents], "content binary")
    told = lambda df: tuple(df.first())
    assert told(writers.write_assets(rows(), root)) == (0, 0, 0) and writers.read_assets(spark, root).count() == 0
    assert told(writers.write_assets(rows(b"a", b"b", b"a", None, b""), root)) == (4, 3, 3)
    version = writers.versions.snapshot(spark, root).version
    assert told(writers.write_assets(rows(b"b", b"a"), root)) == (2, 2, 0) and writers.versions.snapshot(spark, root).version == version
    assert told(writers.write_assets(rows(b"b", b"c", b"c"), root)) == (3, 2, 1)
    held = writers.read_assets(spark, root).withColumn("fits", F.col("sha256") == F.sha2("content", 256)).collect()
    assert sorted(bytes(r["content"]) for r in held) == [b"", b"a", b"b", b"c"] and all(r["fits"] for r in held)


def test_folders_of_files_lie_on_shelves(spark, tmp_path):
    from tarnfold.plans.text_queries import _SHELVES, _write_folders

    _write_folders(spark.range(300).selectExpr("id as book", "'t' || id as html"), "book", f"file://{tmp_path}/out")
    shelves = [p for p in (tmp_path / "out").iterdir() if p.is_dir()]
    assert 32 < len(shelves) <= _SHELVES and sum(1 for _ in (tmp_path / "out").rglob("*.txt")) == 300
    told = readers.read_html_export(spark, f"file://{tmp_path}/out", "*.txt").select("notebook").collect()
    assert sorted(r[0] for r in told) == sorted(f"book={i}" for i in range(300))
