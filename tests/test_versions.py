"""Commits, ordered upserts, the store of notes, and jobs that follow each other."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tarnfold.operators import migration
from tarnfold.operators.windows import latest_values
from tarnfold.sources import readers, versions, writers
from tarnfold.sources.writers import read_assets
from tarnfold.streaming.streams import stream_upsert

JOBS = "job_id string, status string"


def jobs(spark, root):
    return sorted((r["job_id"], r["status"]) for r in readers.read_state(spark, root, "cleanup_jobs").collect())


@pytest.mark.parametrize("step", ["write_parts", "_parts", "_stage", "_publish", "published"])
def test_a_stop_between_any_two_steps_leaves_a_whole_table(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path)
    writers.write_state(spark.createDataFrame([("j", "running"), ("k", "running")], JOBS), root, "cleanup_jobs")
    done = getattr(versions, step, versions._publish)

    def stop(*args):
        if step in ("_publish",):
            raise RuntimeError("stopped")
        done(*args)  # the step itself ends, and then the writer stops
        raise RuntimeError("stopped")

    monkeypatch.setattr(versions, "_publish" if step == "published" else step, stop)
    new = spark.createDataFrame([("j", "completed")], JOBS)
    whole, some = lambda: writers.write_state(new, root, "cleanup_jobs"), lambda: writers.upsert_state(new, root, "cleanup_jobs")
    for write in {"write_parts": [whole], "_parts": [some]}.get(step, [whole, some]):
        with pytest.raises(RuntimeError, match="stopped"):
            write()
        monkeypatch.undo()
        if step == "published":
            assert jobs(spark, root) == [("j", "completed")]
            break
        assert jobs(spark, root) == [("j", "running"), ("k", "running")]
        monkeypatch.setattr(versions, step, stop)
    monkeypatch.undo()
    writers.upsert_state(new, root, "cleanup_jobs")  # and the table goes on
    assert ("j", "completed") in jobs(spark, root)


def test_of_two_writers_one_is_refused(spark, tmp_path):
    root = str(tmp_path)
    base = writers.write_state(spark.createDataFrame([("j", "running")], JOBS), root, "cleanup_jobs")
    assert base == writers.state_version(spark, root, "cleanup_jobs") == 1
    writers.write_state(spark.createDataFrame([("j", "paused")], JOBS), root, "cleanup_jobs", base)
    with pytest.raises(versions.CommitConflict):
        writers.write_state(spark.createDataFrame([("j", "failed")], JOBS), root, "cleanup_jobs", base)
    assert jobs(spark, root) == [("j", "paused")]
    assert [r["status"] for r in readers.read_state(spark, root, "cleanup_jobs", 1).collect()] == ["running"]


def test_writers_of_other_buckets_both_succeed(spark, tmp_path):
    root, schema = str(tmp_path), "k long, v string"
    versions.merge(spark.range(100).select(F.col("id").alias("k"), F.lit("old").alias("v")), root, schema, ["k"], 8)
    base = versions.snapshot(spark, root)
    of = {b: [r["k"] for r in spark.range(100).select(F.col("id").alias("k")).filter(versions.bucket_of(["k"], 8) == b).collect()] for b in (0, 1)}
    for b, v in ((0, "first"), (1, "second")):
        new = spark.createDataFrame([(k, v) for k in of[b]], schema)
        versions.commit(spark, root, base, versions.write_parts(new, root, ("k",), 8), [str(b)])
    with pytest.raises(versions.CommitConflict):
        versions.commit(spark, root, base, {}, ["1"])
    got = {r["k"]: r["v"] for r in versions.rows(spark, root, versions.snapshot(spark, root), schema).collect()}
    assert len(got) == 100 and {got[k] for k in of[0]} == {"first"} and {got[k] for k in of[1]} == {"second"}


def test_clean_keeps_the_last_versions_and_refuses_the_late(spark, tmp_path):
    root = str(tmp_path)
    for i in range(5):
        writers.write_state(spark.createDataFrame([("j", str(i))], JOBS), root, "cleanup_jobs")
    where = f"{root}/cleanup_jobs"
    first = versions.snapshot(spark, where, 1)
    assert versions.clean(spark, where, 2) == 3 and versions.clean(spark, where, 2) == 0
    assert jobs(spark, root) == [("j", "4")] and len(list((tmp_path / "cleanup_jobs" / "data").iterdir())) == 2
    for base in (first, versions.Snapshot()):  # their next numbers are free again, but nothing may be committed there
        with pytest.raises(versions.CommitConflict):
            versions.commit(spark, where, base, {})
    assert jobs(spark, root) == [("j", "4")] and writers.state_version(spark, root, "cleanup_jobs") == 5
    (tmp_path / "cleanup_jobs" / "data" / "orphan").mkdir()
    assert versions.clean(spark, where, 2) == 0 and versions.clean(spark, where, 2, hours=-1) == 1


def test_merge_compares_nulls_and_removes(spark, tmp_path):
    root, schema = str(tmp_path), "k string, v string"
    versions.merge(spark.createDataFrame([(None, "a"), ("x", "b"), ("y", "c")], schema), root, schema, ["k"], 4)
    versions.merge(spark.createDataFrame([(None, "A")], schema), root, schema, ["k"], 4, spark.createDataFrame([("y",)], "k string"))
    assert versions.merge(spark.createDataFrame([], schema), root, schema, ["k"], 4).version == 2
    read = lambda: sorted(((r["k"], r["v"]) for r in versions.rows(spark, root, versions.snapshot(spark, root), schema).collect()), key=str)
    assert read() == sorted([(None, "A"), ("x", "b")], key=str)
    versions.merge(spark.createDataFrame([("z", "d")], schema), root, schema, ["k"], 16)  # dealt anew
    assert read() == sorted([(None, "A"), ("x", "b"), ("z", "d")], key=str)


def test_merge_writes_only_folders_that_hold_its_keys(spark, tmp_path):
    root, schema = str(tmp_path), "k long, v string"
    some = lambda a, b, v: spark.range(a, b).select(F.col("id").alias("k"), F.lit(v).alias("v"))
    parts = lambda: {p for each in versions.snapshot(spark, root).parts.values() for p in each}
    read = lambda: {r["k"]: r["v"] for r in versions.rows(spark, root, versions.snapshot(spark, root), schema).collect()}
    versions.merge(some(0, 100, "old"), root, schema, ["k"], 4)
    first = parts()
    versions.merge(some(100, 200, "new"), root, schema, ["k"], 4)
    second = parts() - first
    assert first < parts() and len(second) == 4
    versions.merge(some(150, 250, "newer"), root, schema, ["k"], 4, some(120, 130, "").select("k"))
    assert first < parts() and not second & parts()
    want = {k: "old" if k < 100 else "new" if k < 150 else "newer" for k in range(250) if not 120 <= k < 130}
    assert read() == want and versions.rows(spark, root, versions.snapshot(spark, root), schema).count() == len(want)
    twice = some(300, 310, "a").unionByName(some(300, 310, "b"))
    versions.merge(twice, root, schema, ["k"], 4)
    assert read() == want | dict.fromkeys(range(300, 310), "b") and versions.rows(spark, root, versions.snapshot(spark, root), schema).count() == len(want) + 10
    for i in range(versions.PARTS + 1):  # folders of a bucket stay bounded
        versions.merge(some(1000 + 40 * i, 1040 + 40 * i, "x"), root, schema, ["k"], 4)
    assert all(len(p) <= versions.PARTS for p in versions.snapshot(spark, root).parts.values()) and len(read()) == len(want) + 10 + 40 * (versions.PARTS + 1)


ROWS = "item_id long, status string, quality string, position long"


def test_late_rows_lose(spark, tmp_path):
    root = str(tmp_path)
    for number, row in enumerate([(1, "verified", "full", 10), (1, "pending", None, 5), (1, None, "degraded", 7), (2, "queued", None, None)]):
        writers.merge_ordered(spark.createDataFrame([row], ROWS), root, "source_items", "item_id", ["status", "quality"], "position", "s", number)
    at = writers.state_version(spark, root, "source_items")
    writers.merge_ordered(spark.createDataFrame([(1, "failed", "none", 99)], ROWS), root, "source_items", "item_id", ["status", "quality"], "position", "s", 3)  # a batch that was committed already
    assert writers.state_version(spark, root, "source_items") == at
    assert sorted((r["item_id"], r["status"], r["quality"]) for r in readers.read_state(spark, root, "source_items").collect()) == [(1, "verified", "full"), (2, "queued", None)]


def test_any_cutting_and_order_of_batches_gives_the_batch_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(12), rng.choice(["a", "b", None]), rng.choice(["full", None]), rng.choice([*range(20), None])) for _ in range(60)]
    want = sorted(map(tuple, latest_values(spark.createDataFrame(rows, ROWS), "item_id", ["status", "quality"], "position").collect()), key=str)
    for turn in range(3):
        rng.shuffle(rows)
        cuts = sorted(rng.sample(range(1, 60), 3))
        root = str(tmp_path / str(turn))
        for a, b in itertools.pairwise([0, *cuts, 60]):
            writers.merge_ordered(spark.createDataFrame(rows[a:b], ROWS), root, "source_items", "item_id", ["status", "quality"], "position", buckets=4)
        got = sorted((tuple(r) for r in readers.read_state(spark, root, "source_items").select("item_id", "status", "quality").collect()), key=str)
        assert got == want


def test_upsert_touches_only_its_buckets_and_keeps_other_columns(spark, tmp_path):
    root = str(tmp_path)
    old = spark.range(40).select(F.col("id").alias("item_id"), F.concat(F.lit("t"), "id").alias("title"), F.lit("queued").alias("status"))
    writers.write_state(old, root, "source_items")
    one = lambda i, status, position: spark.createDataFrame([(i, status, None, position)], ROWS)
    writers.merge_ordered(one(1, "verified", 1), root, "source_items", "item_id", ["status"], "position", buckets=8)
    before = versions.snapshot(spark, f"{root}/source_items").parts
    writers.merge_ordered(one(2, "failed", 1), root, "source_items", "item_id", ["status"], "position", buckets=8)
    after = versions.snapshot(spark, f"{root}/source_items").parts
    assert sum(before[b] != after[b] for b in before) == 1
    got = {r["item_id"]: (r["title"], r["status"]) for r in readers.read_state(spark, root, "source_items").collect()}
    assert len(got) == 40 and got[1] == ("t1", "verified") and got[2] == ("t2", "failed") and got[3] == ("t3", "queued")
    writers.write_state(readers.read_state(spark, root, "source_items").filter("item_id < 10"), root, "source_items")  # the layout stays
    assert readers.read_state(spark, root, "source_items").count() == 10 and versions.snapshot(spark, f"{root}/source_items").buckets == 8


def test_stream_upsert_cleans_up(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "state")
    for i in range(6):
        spark.createDataFrame([(1, str(i), None, 10 - i)], ROWS).coalesce(1).write.mode("append").parquet(str(src))
    stream_upsert(spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(src)), root, "source_items", "item_id", ["status"], str(tmp_path / "cp"), "position").awaitTermination()
    assert [r["status"] for r in readers.read_state(spark, root, "source_items").collect()] == ["0"]
    assert len(list((tmp_path / "state" / "source_items" / "data").iterdir())) == 3


NOTE = "relative_path string, text string, shard string"


def files(spark, root):
    return {r["relative_path"]: r["text"] for r in readers.read_notes(spark, root).collect()}


def test_notes_of_others_stay(spark, tmp_path):
    root = str(tmp_path)
    assert files(spark, root) == {}
    writers.write_notes(spark.createDataFrame([("Mine.md", "mine", "a"), ("One.md", "1", "a")], NOTE), root)
    writers.write_notes(spark.createDataFrame([("Two.md", "2", "b"), ("One.md", "one", "b"), ("Two.md", "2", "b"), (None, "x", "b"), ("Empty.md", None, None)], NOTE), root)
    assert files(spark, root) == {"Mine.md": "mine", "One.md": "one", "Two.md": "2", "Empty.md": ""}
    writers.write_notes(spark.createDataFrame([], NOTE), root)
    assert len(files(spark, root)) == 4


PAGES = "source_instance_id string, source_position long, original_url string, html string"


def pages(spark, *rows):
    return migration.PageSource(spark.createDataFrame([("web", i, f"https://example.com/en/{i}", h) for i, h in rows], PAGES), ("example.com",))


def page(title, body):
    return f"<article><h1>{title}</h1><p>{body}</p></article>"


def ended(states):
    return sorted((r["relative_path"].rsplit("/", 1)[-1] if r["relative_path"] else None, r["action"], r["state"]) for r in states.collect())


def test_a_second_job_keeps_edited_and_foreign_notes(spark, tmp_path):
    root, state = str(tmp_path / "notes"), str(tmp_path / "state")
    at = "Imports/web/article/"
    writers.write_notes(spark.createDataFrame([(at + "Theirs.md", "theirs", "x"), ("Mine.md", "mine", "x")], NOTE), root)
    first = pages(spark, (1, page("One", "a")), (2, page("Two", "b")), (3, page("Theirs", "c")))
    states, report = migration.migrate(spark, first, migration.NoteFolder(root), "j1", state)
    assert ended(states) == [("One.md", "write_canonical", "verified"), ("Theirs.md", "mark_conflict", "conflict"), ("Two.md", "write_canonical", "verified")] and report.first()["ok"]
    writers.write_notes(spark.createDataFrame([(at + "One.md", "edited", "web")], NOTE), root, removed=spark.createDataFrame([(at + "Two.md",)], "relative_path string"))
    # a verified item is left alone while its file is there; a removed one is written again; a new item never takes another's path
    second = pages(spark, (1, page("One", "a")), (2, page("Two", "b")), (3, page("Theirs", "c")), (4, page("One", "other")))
    states, report = migration.migrate(spark, second, migration.NoteFolder(root, policy="write-new"), "j2", state)
    got = ended(states)
    assert report.first()["ok"] and report.first()["final_items"] == 4
    assert ("One.md", "skip_verified", "verified") in got and ("Two.md", "write_canonical", "verified") in got and ("Theirs.imported-new.md", "write_new_variant", "verified") in got
    (new,) = [x for x in got if x[0].startswith("One-")]
    assert new[1:] == ("write_canonical", "verified")
    held = files(spark, root)
    assert held["Mine.md"] == "mine" and held[at + "Theirs.md"] == "theirs" and held[at + "One.md"] == "edited" and "other" in held[at + new[0]] and "# Two" in held[at + "Two.md"]
    items = {r["title"] + str(r["item_id"]): r["status"] for r in readers.read_state(spark, state, "source_items").collect()}
    assert len(items) == 4 and set(items.values()) == {"verified"}
    tries = sorted((r["job_id"], r["attempt_no"], r["success"], r["error_code"]) for r in readers.read_state(spark, state, "migration_attempts").collect())
    assert tries == [("j1", 1, False, "CONFLICT_PRESERVED"), ("j1", 1, True, None), ("j1", 1, True, None), ("j2", 1, True, None), ("j2", 1, True, None), ("j2", 1, True, None)]
    assert sorted((r["job_id"], r["status"]) for r in readers.read_state(spark, state, "migration_jobs").collect()) == [("j1", "completed"), ("j2", "completed")]
    # a third job of the conflict finds its variant and leaves it
    states, _ = migration.migrate(spark, second, migration.NoteFolder(root, policy="write-new"), "j3", state)
    assert {x[1] for x in ended(states)} == {"skip_verified"} and len(files(spark, root)) == len(held)


def test_degraded_items_are_redone_and_edits_end_in_conflict(spark, tmp_path):
    root, state = str(tmp_path / "notes"), str(tmp_path / "state")
    lossy = "<article><h1>{}</h1><p>a</p><iframe src='x'></iframe></article>"
    first = pages(spark, (1, lossy.format("One")), (2, lossy.format("Two")))
    states, _ = migration.migrate(spark, first, migration.NoteFolder(root), "j1", state)
    assert {x[2] for x in ended(states)} == {"degraded"}
    path = next(p for p in files(spark, root) if p.endswith("One.md"))
    writers.write_notes(spark.createDataFrame([(path, "edited", "web")], NOTE), root)
    better = pages(spark, (1, page("One", "a")), (2, page("Two", "b")))
    states, _ = migration.migrate(spark, better, migration.NoteFolder(root), "j2", state)
    assert ended(states) == [("One.md", "mark_conflict", "conflict"), ("Two.md", "write_canonical", "verified")] and files(spark, root)[path] == "edited"
    assert {r["action"] for r in readers.read_state(spark, state, "migration_attempts").filter("job_id = 'j2'").collect()} == {"quality_upgrade"}
    states, _ = migration.migrate(spark, better, migration.NoteFolder(root, policy="replace"), "j3", state)
    assert ("One.md", "forced_overwrite", "verified") in ended(states) and "edited" not in files(spark, root)[path]


def test_a_stopped_job_goes_on(spark, tmp_path, monkeypatch):
    root, state = str(tmp_path / "notes"), str(tmp_path / "state")
    source = pages(spark, (1, page("One", "a")), (2, ""))
    monkeypatch.setattr(migration, "_save", lambda *args: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError, match="stopped"):
        migration.migrate(spark, source, migration.NoteFolder(root), "j", state)
    monkeypatch.undo()
    states, report = migration.migrate(spark, source, migration.NoteFolder(root), "j", state)
    assert {x[2] for x in ended(states)} <= {"verified", "degraded"} and report.first()["ok"]


def test_an_edited_index_is_kept(spark, tmp_path):
    root = str(tmp_path)
    target = migration.NoteFolder(root)
    writers.write_notes(spark.createDataFrame([(f"n{i}.md", "x", "web") for i in range(3)], NOTE), root)
    paths = spark.createDataFrame([(f"n{i}.md",) for i in range(3)], "relative_path string")
    listed = {r["relative_path"]: r["action"] for r in target.write_index(paths).collect()}
    assert set(listed.values()) == {"write_canonical"}
    edited = sorted(listed)[0]
    writers.write_notes(spark.createDataFrame([(edited, "my index", "web")], NOTE), root)
    again = {r["relative_path"]: r["action"] for r in target.write_index(paths).collect()}
    assert again == {p: "mark_conflict" if p == edited else "unchanged" for p in listed} and files(spark, root)[edited] == "my index"


def test_note_exports_bring_their_attachments_and_links(spark, tmp_path):
    guid = "0a1b2c3d-0000-4000-8000-{:012d}".format
    resource = "<resource><data>{}</data><mime>{}</mime><resource-attributes><file-name>{}</file-name></resource-attributes></resource>".format
    media = '<en-media type="image/png" hash="{}"/>'.format
    md5 = "902fbdd2b1df0c4f70b4a5d23525e932"  # of ABC

    def note(n, title, body, *resources):
        return f"<note><title>{title}</title><content><![CDATA[<en-note>{body}</en-note>]]></content><created>20240102T030405Z</created><guid>{guid(n)}</guid>{''.join(resources)}</note>"

    one = note(1, "One", f'<div>see <a href="evernote:///view/1/s1/{guid(2)}/{guid(2)}/">two</a> and <a href="evernote:///view/1/s1/{guid(9)}/{guid(9)}/">none</a></div>{media(md5)}', resource("QUJD", "image/png", "pic.png"), resource("REVG", "text/plain", "pic.png"))
    two = note(2, "Two", f"<div>text</div>{media('00')}", resource("QUJD", "image/png", ""))
    (tmp_path / "a.enex").write_text(f"<en-export>{one}{two}</en-export>")
    (tmp_path / "b.enex").write_text(f"<en-export>{note(2, 'Two', 'a later copy')}</en-export>")
    source, target = migration.NoteExportSource(str(tmp_path / "*.enex")), migration.NoteFolder(str(tmp_path / "notes"))
    states, report = migration.migrate(spark, source, target, state=str(tmp_path / "state"))
    assert ended(states) == [("One.md", "write_canonical", "verified"), ("Two.md", "write_canonical", "degraded")] and report.first()["ok"]
    held = {p.rsplit("/", 1)[-1]: t for p, t in files(spark, str(tmp_path / "notes")).items()}
    assert "[[Two|two]]" in held["One.md"] and f"[none](note:{guid(9)})" in held["One.md"] and "text" in held["Two.md"] and "missing attachment 00" in held["Two.md"]
    stored = {r["relative_path"]: bytes(r["content"]) for r in target.assets(spark).collect()}
    assert sorted(p.rsplit("/", 1)[-1] for p in stored)[-2:] == ["pic-2.png", "pic.png"] and len(stored) == 3 and sorted(stored.values()) == [b"ABC", b"ABC", b"DEF"]
    (picture,) = [p for p in stored if p.endswith("/pic.png")]
    assert f"![[{picture}]]" in held["One.md"] and read_assets(spark, str(tmp_path / "notes-assets")).count() == 2
