import pytest
from pyspark.sql import functions as F

from quarrywise.functions.markdown import EPUB, heading_levels, profile_of, without_noise
from quarrywise.operators import reviews, taxonomy
from quarrywise.plans import packs


def test_issues(spark):
    schema = "path string, title string, author string, isbns array<string>, primary_class string, classification_source string, classification_confidence string, reviewed boolean, review_required boolean, external_class string"
    rows = [
        ("a", "T", "X", ["1", "2"], "332", "folder_path", None, None, None, "158.1"), ("b", "t ", " x", ["2"], "158", "filename/content keyword", None, None, None, "158"), ("c", None, None, [], "999", "unclassified", None, None, None, None),
        ("d", "U", "Y", [], "158", "filename/content keyword", "0.9", None, True, None), ("e", "V", "Z", [], "158", "x", "bad", True, None, None), ("f", "W", "Z", ["9", "9"], "1", None, None, None, None, None),
    ]
    got = {(r.path, r.issue) for r in reviews.issues(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        ("a", "multiple_isbns_found"), ("a", "duplicate_isbn"), ("b", "duplicate_isbn"), ("a", "duplicate_title_author"), ("b", "duplicate_title_author"), ("a", "loc_class_conflict"),
        ("b", "classification_confidence_below_threshold"), ("c", "no_author"), ("c", "no_title"), ("c", "unclassified"), ("d", "classification_review_required"),
        ("f", "multiple_isbns_found"), ("f", "classification_confidence_below_threshold"),
    }


def test_editions(spark):
    schema = "book_id int, title string, author string, isbn string, work_id string, edition_number int, edition_year int, published string"
    rows = [(1, "Deep Work", "Cal", "1", None, None, None, "2016"), (2, "Deep Work, Second Edition", "Cal", "2", None, None, None, None), (3, "Deep Work", "Cal", "1", None, None, None, "2016"), (4, "Deep Work", "Cal", None, None, None, None, None), (5, "Other", None, None, "given", 3, None, None)]
    r = reviews.edition_records(spark.createDataFrame(rows, schema))
    assert {(x.book_id, x.work_id, x.edition_number, x.edition_year) for x in r.collect()} == {(1, "cal_deep_work", None, 2016), (2, "cal_deep_work", 2, None), (3, "cal_deep_work", None, 2016), (4, "cal_deep_work", None, None), (5, "given", 3, None)}
    assert {(x.other_id, x.relationship) for x in reviews.edition_pairs(r).collect()} == {(2, "same work, possible duplicate"), (3, "same ISBN, duplicate"), (4, "same work, possible duplicate")}
    pair = r.where("book_id = 2").crossJoin(r.where("book_id = 4").withColumn("edition_number", F.lit(1)).select(F.struct("*").alias("b"))).select(F.struct(*r.columns).alias("a"), "b")
    assert pair.select(reviews.relationship("a", "b")).first()[0] == "same work, different edition"
    assert [x.book_id for x in reviews.editions_like(r, "deep work").collect()][-1] in (1, 3) and reviews.editions_like(r, "zzz").count() == 0


def test_drafts_decisions_and_merges(spark):
    s = spark.createDataFrame([("a", None), ("b", "human_reviewed"), ("c", "rejected")], "id string, status string")
    assert {(r.kind, r.id) for r in reviews.drafts(s, s.where("id <> 'a'").withColumn("status", F.lit("needs_human_review"))).collect()} == {("concept", "b"), ("concept", "c")}
    t = reviews.transitioned(s, spark.createDataFrame([("a", "human_reviewed"), ("b", "what")], "id string, to string"))
    assert {(r.id, r.status, r.refused) for r in t.collect()} == {("a", "human_reviewed", None), ("b", "human_reviewed", "no status: what"), ("c", "rejected", None)}
    books = spark.createDataFrame([("p", "T", None, {"filename": "1"}, "999", None), ("q", "U", "A", None, "1", "L"), ("r", "V", "A", None, "1", "L")], "path string, title string, author string, isbn map<string,string>, primary_class string, primary_label string")
    d = spark.createDataFrame([("p", "approved", None, "Ann", "2", "332", "Money"), ("q", "approved", " ", None, None, None, None), ("r", "pending", "X", None, None, None, None)], "path string, status string, suggested_title string, suggested_author string, canonical_isbn string, approved_primary_class string, approved_primary_label string")
    got = {r.path: r for r in reviews.decided(books, d).collect()}
    assert (got["p"].author, got["p"].isbn, got["p"].primary_class, got["p"].outcome) == ("Ann", {"filename": "1", "reviewed": "2"}, "332", "applied") and (got["q"].outcome, got["r"].outcome, got["r"].title) == ("no_change", None, "V")
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"), spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int")
    assert {tuple(r) for r in reviews.merged_by_id(old, new).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    src = spark.createDataFrame([("x", "loc", "A"), ("x", "ol", "A"), ("x", "gb", "B"), ("x", "zz", None)], "id string, source string, value string")
    assert [(r.value, r.sources) for r in reviews.merged_sources(src).orderBy("rank").collect()] == [("A", ["loc", "ol"]), ("B", ["gb"])]
    q = spark.createDataFrame([("p", "duplicate_isbn"), ("p", "no_author")], "path string, issue string")
    assert reviews.isbn_conflicts(q, q).count() == 2


def test_integrity_health_and_hashes(spark):
    m = spark.createDataFrame([("1", "a.md", "s1"), ("2", "gone.md", "s2")], "book_id string, canonical_path string, source_path string")
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "book_id string")
    got = reviews.integrity(m, spark.createDataFrame([("a.md",)], "path string"), ids("1", "7"), spark.createDataFrame([("k", "c1"), ("k2", "c9")], "concept_id string, chunk_id string"), spark.createDataFrame([("c1",)], "chunk_id string"), ids("2", "8"))
    assert {tuple(r) for r in got.collect()} == {("manifest_path_missing", "2"), ("summary_without_book", "7"), ("concept_source_missing", "k2"), ("node_without_book", "8")}
    assert {tuple(r) for r in reviews.health(a=m, b=m.limit(0)).collect()} == {("a", 2, "OK"), ("b", 0, "WARN")}
    r = reviews.record_for(m, spark.createDataFrame([("a.md",), ("s2",), ("none",)], "path string"))
    assert {(x.path, x.book_id) for x in r.collect()} == {("a.md", "1"), ("s2", "2"), ("none", None)}
    h = spark.createDataFrame([("# A\n### B\n## C",), ("### A\n#### B",), ("none",), ("# A\n## B\n# C",), ("# A",)], "t string").select(reviews.heading_report(heading_levels(F.col("t"))).alias("h")).collect()
    assert [(r.h.n, r.h.n_top, r.h.issues, r.h.status) for r in h] == [(3, 1, ["heading_level_jump"], "WARN"), (2, 1, ["first_heading_is_deep"], "WARN"), (0, 0, ["no_markdown_headings"], "WARN"), (3, 2, [], "OK"), (1, 1, [], "WARN")]


def test_spans_go_however_deep(spark):
    rows = ["[a [b [c [d [e [f]{.x}]{.x}]{.x}]{.x}]{.x}]{.x}", "[a]{.x} and [b]", "[[open [x]{.y}", "]]] [a [b]{.c}]{.d}"]
    got = [r.c for r in spark.createDataFrame(list(enumerate(rows)), "i int, t string").orderBy("i").select(without_noise(F.col("t"), EPUB).alias("c")).collect()]
    assert got == ["a b c d e f", "a and [b]", "[[open x", "]]] a b"]


def test_answer_packs_route_and_fall_back(spark):
    classes, aliases = taxonomy.taxonomy_tables(spark, "classes: {'1': {label: money matters}, '2': {label: sleep well}}\nrouting_aliases: {cash: {primary_class: ['1'], secondary_class: ['2']}}")
    rows = [("b1_0", None, "b1_1", "b1", "One", "1", "cash flow and bonds"), ("b1_1", "b1_0", None, "b1", "One", "1", "bonds cash cash"), ("b2_0", None, None, "b2", "Two", "2", "cash in beds"), ("b3_0", None, None, "b3", "Three", None, "cash " * 5)]
    chunks = spark.createDataFrame([(c, p, n, b, t, "Ann", k, f"cite {c}", "Sec", "Chap", "Chap > Sec", x) for c, p, n, b, t, k, x in rows], "chunk_id string, previous_chunk_id string, next_chunk_id string, book_id string, title string, author string, primary_class string, citation string, section_title string, chapter_title string, heading_path string, text string")
    q = spark.createDataFrame([(1, "cash"), (2, "beds"), (3, "zzz")], "query_id int, text string")
    got = {r.query_id: r for r in packs.answer_packs(chunks, q, classes, aliases, spark.createDataFrame([("b9", "all about cash")], "book_id string, text string"), spark.createDataFrame([("b1", "b7", 0.5), ("b2", "b1", 0.9)], "book_id string, other_id string, score double"), 3).collect()}
    one = got[1]
    assert (one.aliases, one.class_codes) == (["cash"], ["1"]) and [p.chunk_id for p in one.passages] == ["b1_1", "b1_0", "b3_0"]
    assert one.books == ["b1", "b3"] and one.themes == ["Sec", "Chap", "Chap > Sec"] and one.citations == ["cite b1_1", "cite b1_0", "cite b3_0"]
    assert one.summary_books == ["b9"] and one.related_books == ["b2", "b7"] and [p.chunk_id for p in got[2].passages] == ["b2_0"] and got[3].passages is None
    w = spark.createDataFrame([("w", ["1"], [], ["saving", "bonds"])], "workspace string, class_codes array<string>, aliases array<string>, topics array<string>")
    asked = packs.workspace_queries(w, spark.createDataFrame([(1, "w", "cash"), (2, "x", "y")], "query_id int, workspace string, text string"))
    assert {(r.query_id, r.text) for r in asked.collect()} == {(1, "cash saving bonds"), (2, "y ")} or {(r.query_id, r.text.strip()) for r in asked.collect()} == {(1, "cash saving bonds"), (2, "y")}
    now, before = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, id string, rank int"), spark.createDataFrame([(1, "a", 1), (1, "c", 2), (1, "d", 3)], "query_id int, id string, rank int")
    assert {(r.id, r.change) for r in packs.changed_since(now, before).collect()} == {("a", "same"), ("b", "added"), ("c", "moved"), ("d", "gone")}


def test_profiles_extend_each_other():
    settings = {"epub": {}, "light": {"extends": "epub", "images": False, "links": False}, "plain": {"extends": "light", "links": True, "quotes": True}, "a": {"extends": "b"}, "b": {"extends": "a"}}
    p = profile_of(settings, "plain")
    assert (p.images, p.links, p.quotes, p.tags) == (False, True, True, True) and profile_of(settings, "epub") == EPUB
    for bad in ("none", "a"):
        with pytest.raises(ValueError, match="no cleaning profile"):
            profile_of(settings, bad)
