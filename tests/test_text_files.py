"""Files are written all or not at all."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quarrywise.operators import formats, notes
from quarrywise.sources import files, text_files


def below(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def test_notes_queues_and_front_matter_come_back(spark, tmp_path):
    folder = str(tmp_path / "out")
    books = spark.createDataFrame([(i, f"T{i}", ["a", "b"][: i % 3]) for i in range(20)], "book_id long, title string, topics array<string>")
    parts = notes.note_parts(books).join(books, "book_id")
    note = parts.select(F.format_string("shelf/%02d.md", "book_id").alias("path"), formats.with_front_matter(F.to_json(F.struct("title", "topics")), F.concat(F.lit("# "), "title", F.lit("\n\n"), "thesis", F.lit("\n"))).alias("content"))
    queue = books.groupBy((F.col("book_id") % 2).alias("k")).agg(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct("book_id", "title")))), "\n").alias("content")).select(F.format_string("queue/%d.jsonl", "k").alias("path"), "content")
    text_files.write_text_files(note.unionByName(queue).repartition(5), folder)
    assert below(folder) == sorted([f"shelf/{i:02d}.md" for i in range(20)] + ["queue/0.jsonl", "queue/1.jsonl"])
    read = files.read_markdown(spark, folder)
    assert read.count() == 20
    lines = [json.loads(x) for x in open(f"{folder}/queue/1.jsonl").read().split("\n")]
    assert sorted(x["book_id"] for x in lines) == list(range(1, 20, 2))
    got = {r.path: r.content for r in note.collect()}
    assert all(open(f"{folder}/{p}").read() == c for p, c in got.items())


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    text_files.write_text_files(spark.createDataFrame([("a", "old")], "path string, content string"), folder)
    rows = spark.range(40).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") == 37, F.raise_error(F.lit("broken"))).otherwise("x").alias("content")).repartition(4)
    with pytest.raises(Exception, match="broken"):
        text_files.write_text_files(rows, folder)
    assert below(folder) == ["a"]
    for bad in ("../out2", "/etc/x", "", None, "_staged/x"):
        with pytest.raises(Exception, match="no path below"):
            text_files.write_text_files(spark.createDataFrame([("b", "y"), (bad, "x")], "path string, content string"), folder)
    assert below(folder) == ["a"]


def test_files_that_are_there(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([("a/b", "one"), ("c", None)], "path string, content string")
    text_files.write_text_files(rows, folder)
    with pytest.raises(Exception, match="there already"):
        text_files.write_text_files(spark.createDataFrame([("new", "x"), ("a/b", "two")], "path string, content string"), folder)
    assert below(folder) == ["a/b", "c"] and open(f"{folder}/a/b").read() == "one"
    text_files.write_text_files(spark.createDataFrame([("a/b", "two")], "path string, content string"), folder, overwrite=True)
    assert open(f"{folder}/a/b").read() == "two" and open(f"{folder}/c").read() == ""
    with pytest.raises(Exception, match="there already|two rows"):
        text_files.write_text_files(spark.createDataFrame([("t", "1"), ("t", "2")], "path string, content string").repartition(2), folder)
    assert below(folder) == ["a/b", "c"]


def test_a_killed_commit_is_ended(tmp_path, monkeypatch):
    folder = tmp_path / "out"
    staged = folder / "_staged/j/0-0"
    staged.mkdir(parents=True)
    for i in range(3):
        (staged / str(i)).write_text(f"text {i}")
    (staged / "list").write_text("".join(json.dumps([str(staged / str(i)), f"n/{i}"]) + "\n" for i in range(3)))
    w = text_files.TextFilesWriter(str(folder), False, type("S", (), {"names": ["path", "content"]})())
    w.job = "j"
    with monkeypatch.context() as m:
        m.setattr(text_files, "_finish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            w.commit([text_files.Staged(str(staged / "list"), 3)])
    assert not (folder / "n").exists()
    assert text_files.recover(str(folder)) == 3 and below(str(folder)) == ["n/0", "n/1", "n/2"] and text_files.recover(str(folder)) == 0
