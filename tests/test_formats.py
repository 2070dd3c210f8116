import json
import sqlite3
from xml.etree import ElementTree

import yaml
from pyspark.sql import functions as F

from quarrywise.operators import formats, knowledge
from quarrywise.sources import files, libraries

BOOKS = [("b1", "Deep {Work} & \"more\"", "Newport, Cal", "2016 ed.", "Grand", "NY", "2nd", "0306406152", "158"), ("b2", "Plain", None, None, None, None, None, None, None)]
SCHEMA = "book_id string, title string, author string, year string, publisher string, place string, edition string, isbn string, primary_class string"
TEXT = {"engine": "text_records", "record": {"header": "TY  - BOOK", "fields": [{"when": "title", "template": "TI  - {title}"}, {"when": "year_raw", "template": "PY  - {year_raw}"}, {"all_when": ["isbn", "place"], "template": "X {isbn}@{place}"}, {"none_when": ["isbn"], "template": "no isbn"}, {"any_when": ["isbn", "title"], "template": "N {{{book_id}}}"}], "footer": "ER  -"}}
JSON = {"engine": "json_records", "fields": [{"key": "id", "source": "book_id"}, {"key": "type", "literal": "book"}, {"key": "title", "source": "title"}, {"key": "author", "source": "author_csl", "when": "author"}, {"key": "issued", "source": "issued_csl", "when": "year_raw"}, {"key": "publisher", "source": "publisher"}]}
XML = {"engine": "xml_records", "record_element": "record", "fields": [{"path": "ref-type", "literal": "6", "attributes": {"name": "Book"}}, {"path": "contributors/authors/author", "source": "author_raw", "when": "author"}, {"path": "titles/title", "source": "title"}, {"path": "titles/short", "template": "s {title}"}, {"path": "isbn", "source": "isbn", "when": "isbn"}]}


def test_three_engines(spark):
    df = spark.createDataFrame(BOOKS, SCHEMA)
    get = lambda form: [r.record for r in formats.records(df, form).orderBy("book_id").collect()]
    assert get(TEXT) == ["TY  - BOOK\nTI  - " + BOOKS[0][1] + "\nPY  - 2016\nX 0306406152@NY\nN {b1}\nER  -", "TY  - BOOK\nTI  - Plain\nno isbn\nN {b2}\nER  -"]
    one, two = map(json.loads, get(JSON))
    assert one == {"id": "b1", "type": "book", "title": BOOKS[0][1], "author": [{"family": "Newport", "given": "Cal"}], "issued": {"date-parts": [[2016]]}, "publisher": "Grand"} and two == {"id": "b2", "type": "book", "title": "Plain"}
    x, y = map(ElementTree.fromstring, get(XML))
    assert x.find("ref-type").attrib == {"name": "Book"} and x.findtext("titles/title") == BOOKS[0][1] and x.findtext("contributors/authors/author") == "Newport, Cal" and len(x.findall("titles")) == 1
    assert [e.tag for e in y] == ["ref-type", "titles"]


def test_yaml_notes_and_drawings(spark):
    df = spark.createDataFrame([(i, f"T{i}", None if i == 1 else "Ann", "158", ["a", "b"], "p.md" if i == 2 else None, "Thesis", ["i1", "i2"] if i else None, None) for i in range(4)], "book_id long, title string, author string, primary_class string, topics array<string>, path string, thesis string, ideas array<string>, best_for array<string>")
    nodes = [json.loads(r.node) for r in formats.canvas_nodes(df.repartition(3)).orderBy("book_id").collect()]
    assert [(n["x"], n["y"]) for n in nodes] == [(600, 0), (0, 600), (-600, 0), (0, -600)] and nodes[2]["file"] == "p.md" and nodes[1]["text"].split("\n")[2] == "Author: Unknown"
    edges = spark.createDataFrame([(2, 3, 0.5), (0, 1, 0.2)], "book_id long, other_id long, score double")
    assert [json.loads(r.edge)["id"] for r in formats.canvas_edges(edges).orderBy("book_id").collect()] == ["edge-1", "edge-2"]
    assert [r.nth for r in formats.numbered(spark.range(1000).repartition(7), "id").orderBy("id").collect()] == list(range(1000)) and formats.numbered(spark.range(0), "id").count() == 0
    note = df.where("book_id = 0").select(formats.book_note().alias("n")).first().n
    assert list(yaml.safe_load(note.split("---")[1])) == ["book_id", "title", "author", "primary_class", "type"] and "- None recorded." in note
    file = df.where("book_id = 0").select(formats.with_front_matter(F.lit('{"title": "é", "b": [1]}'), F.lit("\n\nBody")).alias("f")).first().f
    assert file == "---\ntitle: é\nb:\n- 1\n---\n\nBody"
    assert [r.line for r in formats.index_lines(df.limit(2)).collect()][0] == "- 158: 2"
    p = spark.createDataFrame([("p1", "b", "T", "A", "q\nr", "c", ["x y"])], "passage_id string, book_id string, title string, author string, quote string, citation string, tags array<string>")
    got = p.select(*[formats.passage_record(k).alias(k) for k in ("jsonl", "yaml", "markdown")]).first()
    assert json.loads(got.jsonl)["quote"] == "q\nr" and yaml.safe_load(got.yaml)["tags"] == ["x y"] and got.markdown == "# T\n\n> q\n> r\n\nSource: c\n#x-y"
    assert json.loads(spark.createDataFrame([("T", "A and B; C", None, ["t"], None)], "title string, author string, isbn string, topics array<string>, description string").select(formats.sidecar().alias("s")).first().s)["metadata"]["authors"] == ["A", "B", "C"]


def test_calibre_is_joined_and_found(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    db = sqlite3.connect(tmp_path / "lib/metadata.db")
    db.executescript("""
        CREATE TABLE books (id INTEGER, title TEXT, path TEXT, pubdate TEXT); CREATE TABLE authors (id INTEGER, name TEXT); CREATE TABLE tags (id INTEGER, name TEXT);
        CREATE TABLE books_authors_link (id INTEGER, book INTEGER, author INTEGER); CREATE TABLE books_tags_link (id INTEGER, book INTEGER, tag INTEGER);
        CREATE TABLE identifiers (id INTEGER, book INTEGER, type TEXT, val TEXT); CREATE TABLE data (id INTEGER, book INTEGER, format TEXT); CREATE TABLE comments (book INTEGER, text TEXT);
        INSERT INTO books VALUES (1, 'Deep Work', 'a/b', '2016-01-05'), (2, 'Other', 'c', NULL); INSERT INTO authors VALUES (7, 'Cal N'), (8, 'Bob');
        INSERT INTO tags VALUES (1, 'focus'); INSERT INTO books_authors_link VALUES (1, 1, 8), (2, 1, 7); INSERT INTO books_tags_link VALUES (1, 1, 1);
        INSERT INTO identifiers VALUES (1, 1, 'isbn', '0306406152'), (2, 1, 'isbn', 'bad'), (3, 1, 'doi', 'x'); INSERT INTO data VALUES (1, 1, 'EPUB'); INSERT INTO comments VALUES (1, '<p>Hi</p>');""")
    db.commit()
    db.close()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/metadata.db").write_text("no database")
    c = libraries.read_calibre(spark, str(tmp_path))
    rows = c.orderBy("calibre_id").collect()
    assert [(r.title, r.authors, r.tags, r.isbns, r.formats, r.published) for r in rows] == [("Deep Work", ["Bob", "Cal N"], ["focus"], ["0306406152"], ["EPUB"], "2016"), ("Other", [], [], [], [], "")]
    assert libraries.calibre_find(c, "CAL  n").count() == 1 and libraries.read_sqlite(spark, str(tmp_path), "books", "id long").where("problem IS NOT NULL").count() == 1
    assert c.where("calibre_id = 1").select(libraries.calibre_stub(F.col("title"), F.col("authors")[0], F.col("comment")).alias("s")).first().s == "# Deep Work\n\nAuthor: Bob\n\nHi\n"
    b = spark.createDataFrame([("x", "Nope", None, ["0306406152"], [], None), ("y", "deep work", "Bob", [], ["own"], "1999"), ("z", "Q", None, [], None, None)], "book_id string, title string, author string, isbns array<string>, topics array<string>, published string")
    assert {(r.book_id, r.calibre_id, r.matched_by, tuple(r.topics or ()), r.published) for r in libraries.enriched(b, c).collect()} == {("x", 1, "isbn", ("focus",), "2016"), ("y", 1, "title_author", ("own",), "1999"), ("z", None, None, (), None)}


def test_other_readers(spark, tmp_path):
    rec = lambda *f: "<record>" + "".join(f'<datafield tag="{t}"><subfield code="a">{v}</subfield></datafield>' for t, v in f) + "</record>"
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.xml").write_text('<?xml version="1.0"?><r xmlns="http://x">' + rec(("245", "First /")) + rec(("245", "Second :"), ("100", "Ann,"), ("082", "332.6/4")) + "</r>")
    (tmp_path / "m/b.xml").write_text("<r>" + rec(("245", "One")) + rec(("245", "Two"), ("083", "158")) + "</r>")
    got = {(r.title, r.author, r.class_number, r.class_tag) for r in libraries.read_marc(spark, str(tmp_path / "m")).collect()}
    assert got == {("Second", "Ann", "332.6", "082"), ("Two", None, "158", "083")}
    (tmp_path / "y/d").mkdir(parents=True)
    (tmp_path / "y/base.yaml").write_text("formats: {a: {x: 1}, b: 2}")
    (tmp_path / "y/d/1.yaml").write_text("formats: {b: 3}")
    (tmp_path / "y/d/2.yaml").write_text("formats: {c: 4, a: 5}")
    assert libraries.layered(spark, str(tmp_path / "y/base.yaml"), str(tmp_path / "y/d"), "formats") == {"a": 5, "b": 3, "c": 4}
    assert libraries.layered(spark, str(tmp_path / "y/base.yaml"), str(tmp_path / "none"), "formats") == {"a": {"x": 1}, "b": 2}
    (tmp_path / "s/b1").mkdir(parents=True)
    (tmp_path / "s/b1/book.yaml").write_text("book_id: b1\nkeywords: [k]\n")
    assert [(r.book_id, r.keywords) for r in libraries.read_yaml(spark, str(tmp_path / "s"), "book.yaml", "book_id string, keywords array<string>").collect()] == [("b1", ["k"])]
    (tmp_path / "man.json").write_text('{"books": [{"book_id": "a", "canonical_path": "p"}, {"book_id": "b"}]}')
    assert libraries.read_manifest(spark, str(tmp_path / "man.json"), "book_id string, canonical_path string").count() == 2
    for d, n in (("c", "One.md"), ("r", "Two.md")):
        (tmp_path / d).mkdir()
        (tmp_path / d / n).write_text("x")
    both = libraries.read_both(spark, str(tmp_path / "c"), str(tmp_path / "r")).collect()
    assert {(r.path.rsplit("/", 1)[1], r.collection) for r in both} == {("One.md", "canonical"), ("Two.md", "raw")}
    (tmp_path / "p").mkdir()
    (tmp_path / "p/x.pdf").write_bytes(b"no pdf")
    assert [r.problem is not None and r.text is None for r in libraries.read_pdf(spark, str(tmp_path / "p")).collect()] == [True]


def test_yaml_briefs_and_validators(spark, tmp_path):
    df = spark.createDataFrame([("t", ["a"], [("e1\ne2", "c1")], None, ["c1"]), ("u", [], None, ["x"], None)], "text string, aliases array<string>, passages array<struct<excerpt:string,citation:string>>, themes array<string>, citations array<string>")
    one, two = [r.b for r in df.select(formats.brief().alias("b")).collect()]
    assert one == "# t\n\n## Route\n\n- a\n\n## Passages\n\n> e1\n> e2\n> — c1\n\n## Themes\n\n- None.\n\n## Citations\n\n- c1\n" and "No passages." in two
    assert df.limit(1).select(formats.yaml_record("text", "aliases").alias("y")).first().y == "text: t\naliases:\n- a\n"
    assert [formats.format_problems(f) for f in (TEXT, JSON, XML)] == [[], [], []]
    assert formats.format_problems({"engine": "x"}) == ["unknown engine: x"] and formats.format_problems({"engine": "json_records", "fields": [{"key": "a"}, {"literal": "b"}]}) == ["field 1 has no key", "field 0 says nothing"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.md").write_bytes(b"abc")
    assert [(r.length, r.sha256) for r in files.file_hashes(spark, str(tmp_path / "f")).collect()] == [(3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")]
    a, b = spark.range(50).repartition(3), spark.range(50)
    assert knowledge.table_fingerprint(a).first() == knowledge.table_fingerprint(b).first() != knowledge.table_fingerprint(spark.range(51)).first()
