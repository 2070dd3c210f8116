"""Small parts that the queries don't reach: readers of HTML, citations, formats of references and graphs, chapters."""

import json

from pyspark.sql import functions as F

from quarrywise.functions import strings
from quarrywise.operators import chunks, exports, extract
from quarrywise.sources import files

TEXT = "# Chapter 1\n## Small steps\nOne two.\n\n# Chapter 2\nThree."


def test_html_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<style>x</style><h2>Title &amp; more</h2><p>One<br>two&nbsp;three</p><script>y</script>")
    row = files.read_html(spark, str(tmp_path)).first()
    assert row.text == "## Title & more\n\nOne\n\ntwo three" and row.path.endswith("a.html")


def test_citations_and_chapters(spark):
    c = chunks.chunk_documents(spark.createDataFrame([(7, "T", None, "p.md", TEXT), (8, "U", "Ann", "q.md", "plain")], "book_id int, title string, author string, source_path string, text string"))
    got = c.select("chunk_id", chunks.markdown_citation().alias("m"), chunks.source_location().alias("s")).orderBy("chunk_id").collect()
    assert got[0].m == "*T*; Unknown author; Chapter 1 > Small steps; lines 2-4; chunk `7_000000`; p.md" and got[0].s == "T — Unknown author — Chapter 1 · Small steps · lines 2-4 — p.md"
    assert got[2].m == "*U*; Ann; Body; lines 1-1; chunk `8_000000`; q.md"
    assert [(r.chapter_title, r.n_chunks) for r in chunks.chapters(c).where("book_id = 7").orderBy("first_index").collect()] == [("Chapter 1", 1), ("Chapter 2", 1)]
    assert [r.chunk_id for r in chunks.of_chapter(c, "T", "chapter 2").collect()] == ["7_000001"] and [r.chunk_id for r in chunks.of_chapter(c, "7", "small").collect()] == ["7_000000"]
    assert json.loads(exports.page_documents(c).where("page_content LIKE '%plain%'").first().metadata)["chunk_id"] == "8_000000"


def test_lines_of_windows_are_those_of_their_text(spark):
    text = "\n".join("word " * (i % 7) for i in range(400)) + "\n\n  \n tail"
    rows = chunks.chunk_documents(spark.createDataFrame([(1, "T", "A", "p", text)], "book_id int, title string, author string, source_path string, text string"), 130, 40).orderBy("chunk_index").collect()
    lines = text.split("\n")
    assert len(rows) > 20
    for r in rows:
        assert "\n".join(lines[r.start_line - 1 : r.end_line]).find(r.text) >= 0 and r.text.count("\n") == r.end_line - r.start_line


def test_references_and_graph_nodes(spark):
    b = spark.createDataFrame([("b", "A <Title>", "Newport, Cal", "2016", None, "1", "158")], "book_id string, title string, author string, year string, publisher string, isbn string, primary_class string")
    r = b.select(exports.csl_json().alias("c"), exports.graphml_nodes().alias("g"), strings.author_display(F.col("author")).alias("d"), strings.is_revised(F.lit("X, revised")).alias("r"), strings.normal_without_the(F.lit("The Book!")).alias("n")).first()
    assert json.loads(r.c) == {"id": "b", "type": "book", "title": "A <Title>", "author": [{"family": "Newport", "given": "Cal"}], "issued": {"date-parts": [[2016]]}, "ISBN": "1"}
    assert '<data key="title">A &lt;Title&gt;</data>' in r.g and (r.d, r.r, r.n) == ("Newport, Cal", True, "book")


def test_quotes_paragraphs_and_terms(spark):
    long = "word " * 40
    df = spark.createDataFrame([(f"short\n\nCopyright {long}\n\n{long}last",), ("tiny",)], "t string")
    got = [r.p for r in df.select(extract.first_paragraph(F.col("t"), 150).alias("p")).collect()]
    assert got[0] == (long + "last")[:150].rstrip() and got[1] == "tiny"
    assert spark.range(1).select(strings.quote_summary(F.lit("a b, c"), 2).alias("q")).first().q == "a b..."
    assert spark.range(1).select(extract.keyword_score(F.lit("Goals and systems"), F.lit("goal and")).alias("s")).first().s == 2
