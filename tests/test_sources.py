import time
import zipfile

from quarrywise.sources import files
from quarrywise.streaming.ingest import ingest_documents


def test_markdown_epub_and_log(spark, tmp_path):
    (tmp_path / "b/658-management").mkdir(parents=True)
    (tmp_path / "b/notes").mkdir()
    (tmp_path / "b/658-management/Deep Work - Cal N - 1.md").write_text("---\ntitle: Deep\nclassification: {topics: [a, b]}\n---\nBody")
    (tmp_path / "b/658-management/Plain - Someone.md").write_text("No front matter")
    (tmp_path / "b/README.md").write_text("x")
    (tmp_path / "b/notes/n.md").write_text("x")
    got = files.books_of(files.read_markdown(spark, str(tmp_path / "b"))).orderBy("title").collect()
    assert [(r.title, r.author, r.primary_class, r.topics, r.text) for r in got] == [("Deep", "Cal N", "658", ["a", "b"], "Body"), ("Plain", "Someone", "658", [], "No front matter")]
    with zipfile.ZipFile(tmp_path / "x.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="c"><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", '<package xmlns="p"><manifest><item id="a" href="a.html"/><item id="b" href="b.html"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("o/a.html", "<p>first</p>")
        z.writestr("o/b.html", "<h1>second</h1>")
    assert [r.text for r in files.read_epub(spark, str(tmp_path)).orderBy("place").collect()] == ["# second", "first"]
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    read = files.read_epub(spark, str(tmp_path))
    assert read.where("problem IS NULL").count() == 2 and [r.path.endswith("bad.epub") for r in read.where("problem IS NOT NULL").collect()] == [True]
    (tmp_path / "log.jsonl").write_text('{"action": "a"}\nbroken\n')
    assert sorted(r.action for r in files.read_log(spark, str(tmp_path / "log.jsonl"), "action string").collect()) == ["a", "parse_error"]


def test_streamed_books_replace_their_chunks(spark, tmp_path):
    schema = "book_id long, title string, author string, source_path string, text string"
    put = lambda rows: spark.createDataFrame([(i, "T", "A", "p", t) for i, t in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: ingest_documents(spark, str(tmp_path / "in"), schema, str(tmp_path / "index"), str(tmp_path / "progress"), 4).awaitTermination()
    put([(1, "old"), (2, "two"), (3, "three")])
    run()
    put([(1, "older")])
    time.sleep(1.1)
    put([(1, "new")])
    run()
    assert sorted((r.book_id, r.text) for r in spark.read.parquet(str(tmp_path / "index")).collect()) == [(1, "new"), (2, "two"), (3, "three")]
