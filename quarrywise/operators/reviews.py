"""What people should look at: review issues, editions of works, drafts and decisions, integrity and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import canonical_title, edition_label, edition_number, is_revised, slug, text, year

#: Fixed: how sure a class is by where it comes from, and from when on it needs no look.
CONFIDENCE = {
    "manual_review": 1.0, "existing_frontmatter": 0.9, "library_of_congress_sru_isbn": 0.88, "folder_path": 0.72, "filename/content keyword": 0.55,
    "unclassified": 0.0, "unknown": 0.25, "missing_frontmatter": 0.0,
}
LOW = 0.7
#: Fixed: statuses of what is reviewed, and those of drafts.
STATUSES = ("machine_draft", "needs_human_review", "human_reviewed", "rejected", "superseded")
DRAFTS = ("machine_draft", "needs_human_review")


def class_confidence(source: Column, explicit: Column, reviewed: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    return F.when(F.coalesce(reviewed, F.lit(False)), 1.0).otherwise(F.coalesce(explicit.try_cast("double"), F.try_element_at(table, F.coalesce(source, F.lit("unknown"))), F.lit(0.25)))


def base_class(code: Column) -> Column:
    return F.nullif(F.regexp_extract(text(code), r"\d{3}", 0), F.lit(""))


def issues(books: DataFrame) -> DataFrame:
    """books (path, title, author, isbns, primary_class, classification_source, classification_confidence, reviewed, review_required, external_class): (path, queue, issue, severity, detail).

    Nine kinds: no_author, no_title, multiple_isbns_found, duplicate_isbn, duplicate_title_author,
    loc_class_conflict, unclassified, classification_confidence_below_threshold, classification_review_required. Duplicates are told by
    counts of keys joined back, so no group is gathered; detail is the key.
    """
    b = books.withColumn("__sure", class_confidence(F.col("classification_source"), F.col("classification_confidence"), F.col("reviewed")))
    open_class = (F.coalesce("primary_class", F.lit("999")) == "999") | F.coalesce("classification_source", F.lit("unknown")).isin("unclassified", "missing_frontmatter")
    outer, inner = base_class(F.col("external_class")), base_class(F.coalesce("primary_class", F.lit("999")))
    one = lambda when, queue, issue, severity, detail=None: F.when(when, F.struct(F.lit(queue).alias("queue"), F.lit(issue).alias("issue"), F.lit(severity).alias("severity"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail")))
    own = F.array_compact(
        F.array(
            one(text(F.col("author")) == "", "metadata", "no_author", "medium"), one(text(F.col("title")) == "", "metadata", "no_title", "high"),
            one(F.size("isbns") > 1, "metadata", "multiple_isbns_found", "low", F.array_join("isbns", ",")), one(outer != inner, "classification", "loc_class_conflict", "high", outer),
            one(open_class, "classification", "unclassified", "high"), one(~open_class & (F.col("__sure") < LOW), "low_confidence", "classification_confidence_below_threshold", "medium", F.round("__sure", 2)),
            one(F.coalesce("review_required", F.lit(False)), "low_confidence", "classification_review_required", "medium"),
        )
    )
    mine = b.select("path", F.explode(own).alias("x")).select("path", "x.*")
    names = F.concat(F.lower(F.trim(text(F.col("title")))), F.lit("|"), F.lower(F.trim(text(F.col("author")))))
    keyed = b.select("path", F.explode("isbns").alias("detail"), F.lit("duplicate_isbn").alias("issue")).unionByName(
        b.where((F.trim(text(F.col("title"))) != "") & (F.trim(text(F.col("author"))) != "")).select("path", names.alias("detail"), F.lit("duplicate_title_author").alias("issue"))
    )
    shared = keyed.groupBy("issue", "detail").agg(F.min("path").alias("lo"), F.max("path").alias("hi")).where("lo < hi").select("issue", "detail")
    return mine.unionByName(keyed.join(shared, ["issue", "detail"]).select("path", F.lit("metadata").alias("queue"), "issue", F.lit("high").alias("severity"), "detail").distinct())


def known_again(reviewed: DataFrame, books: DataFrame) -> DataFrame:
    """reviewed rows (isbns, title, author) of which books (isbns, title, author) have an ISBN, or the title and author whatever their case."""
    key = F.concat(F.lower(F.trim(text(F.col("title")))), F.lit("|"), F.lower(F.trim(text(F.col("author")))))
    rows = reviewed.withColumn("__row", F.monotonically_increasing_id()).withColumn("__key", key)
    names = books.select(key.alias("__key")).where("__key <> '|'").distinct()
    by_isbn = rows.select("__row", F.explode("isbns").alias("isbn")).join(books.select(F.explode("isbns").alias("isbn")).distinct(), "isbn", "left_semi").select("__row")
    return rows.join(by_isbn.unionByName(rows.join(names, "__key", "left_semi").select("__row")).distinct(), "__row", "left_semi").drop("__row", "__key")


def edition_records(books: DataFrame) -> DataFrame:
    """books (book_id, title, author, isbn, work_id, edition_number, edition_year, published) with work and edition; what is there isn't replaced."""
    wid = F.coalesce(F.nullif("work_id", F.lit("")), slug(F.concat(F.when(text(F.col("author")) != "", F.concat("author", F.lit("_"))).otherwise(""), canonical_title(F.col("title")))))
    return books.withColumns(
        {
            "canonical_title": canonical_title(F.col("title")), "work_id": wid, "edition_label": edition_label(F.col("title")), "edition_number": F.coalesce("edition_number", edition_number(F.col("title"))),
            "edition_year": F.coalesce("edition_year", year(F.concat_ws(" ", text(F.col("published")), "title")).cast("int")), "is_revised": is_revised(F.col("title")),
        }
    )


def relationship(a: str, b: str) -> Column:
    """What two edition records, structs a and b, are to each other."""
    x, y = F.col(a), F.col(b)
    differ = lambda f: (F.coalesce(x[f], F.lit(0)) != 0) & (F.coalesce(y[f], F.lit(0)) != 0) & (x[f] != y[f])
    named = (slug(x["title"]) == slug(y["title"])) & (slug(text(x["author"])) == slug(text(y["author"])))
    return (
        F.when((text(x["isbn"]) != "") & (x["isbn"] == y["isbn"]), "same ISBN, duplicate")
        .when((x["work_id"] == y["work_id"]) & (differ("edition_number") | differ("edition_year")), "same work, different edition")
        .when(x["work_id"] == y["work_id"], "same work, possible duplicate").when(named, "same title/author, maybe duplicate").otherwise("different work")
    )


def edition_pairs(records: DataFrame) -> DataFrame:
    """(work_id, book_id, other_id, relationship): each edition record of a work beside the work's first one, so that a work of many records gives no pairs of all."""
    kinds = ("book_id", "title", "author", "isbn", "work_id", "edition_number", "edition_year")
    first = records.groupBy("work_id").agg(F.min_by(F.struct(*kinds), "book_id").alias("a"))
    return records.select("work_id", F.struct(*kinds).alias("b")).join(first, "work_id").where("a.book_id < b.book_id").select("work_id", F.col("a.book_id").alias("book_id"), F.col("b.book_id").alias("other_id"), relationship("a", "b").alias("relationship"))


def editions_like(records: DataFrame, query: str | None) -> DataFrame:
    """Edition records whose names, work or ISBN contain a query, as slugs, in order of work, year, number and title."""
    said = slug(F.concat_ws(" ", "title", text(F.col("author")), "canonical_title", "work_id", text(F.col("isbn"))))
    rows = records if not query else records.where(F.contains(said, slug(F.lit(query))))
    return rows.orderBy(F.lower("canonical_title"), F.coalesce("edition_year", F.lit(0)), F.coalesce("edition_number", F.lit(0)), F.lower("title"))


def drafts(summaries: DataFrame, concepts: DataFrame) -> DataFrame:
    """(kind, id, status) of summaries and concepts (id, status) that no person has approved."""
    rows = summaries.select(F.lit("summary").alias("kind"), "id", "status").unionByName(concepts.select(F.lit("concept").alias("kind"), "id", "status"))
    return rows.where(F.col("status").isin(*DRAFTS))


def transitioned(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows (id, status) under decisions (id, to): those to a known status take effect, others leave the status and say why in `refused`. Of several for one id the last by letter counts."""
    met = rows.join(wanted.groupBy("id").agg(F.max("to").alias("to")), "id", "left")
    ok = F.col("to").isin(*STATUSES)
    return met.select("id", F.when(ok, F.col("to")).otherwise(F.col("status")).alias("status"), F.when(~ok, F.concat(F.lit("no status: "), "to")).alias("refused"))


def decided(books: DataFrame, decisions: DataFrame) -> DataFrame:
    """books (path, title, author, isbn map, primary_class, primary_label) under approved decisions (path, status, suggested_title, suggested_author, canonical_isbn, approved_primary_class, approved_primary_label); outcome is applied, no_change or null without a decision."""
    d = decisions.where("status = 'approved'").groupBy("path").agg(*[F.max(c).alias(f"__{c}") for c in ("suggested_title", "suggested_author", "canonical_isbn", "approved_primary_class", "approved_primary_label")], F.lit(True).alias("__met"))
    rows = books.join(d, "path", "left")
    some = lambda c: F.nullif(F.trim(F.col(f"__{c}")), F.lit(""))
    new = {"title": some("suggested_title"), "author": some("suggested_author"), "primary_class": some("approved_primary_class"), "primary_label": some("approved_primary_label")}
    isbn = F.when(some("canonical_isbn").isNotNull(), F.map_concat(F.map_filter(F.coalesce("isbn", F.create_map().cast("map<string,string>")), lambda k, v: k != "reviewed"), F.create_map(F.lit("reviewed"), some("canonical_isbn")))).otherwise(F.col("isbn"))
    changed = F.greatest(*[v.isNotNull() for v in (*new.values(), some("canonical_isbn"))])
    outcome = F.when(F.col("__met"), F.when(changed, "applied").otherwise("no_change"))
    return rows.select("path", *[F.coalesce(v, F.col(c)).alias(c) for c, v in new.items()], isbn.alias("isbn"), outcome.alias("outcome"))


def isbn_conflicts(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows about ISBNs of two queues (path, issue, isbns)."""
    return first.unionByName(second).where(F.col("issue").isin("duplicate_isbn", "multiple_isbns_found", "isbn_conflict"))


def merged_by_id(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """All rows; of one id those of the new table win, and of several of it the last by their content."""
    rows = old.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__side"), F.desc(F.xxhash64(*[F.col(c) for c in old.columns if c != key]))))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__side", "__nth")


def merged_sources(rows: DataFrame) -> DataFrame:
    """rows (id, source, value): for each id the values with the sources that say them, in order of how many do and then by value."""
    said = rows.where(text(F.col("value")) != "").groupBy("id", "value").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.size("sources")), "value"))
    return said.withColumn("rank", rank)


def integrity(manifest: DataFrame, files: DataFrame, summaries: DataFrame, concept_sources: DataFrame, chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(check, id) of what refers to nothing: manifest rows (book_id, canonical_path) without a file (path), summaries and graph nodes (book_id) without a manifest row, concept sources (concept_id, chunk_id) without a chunk."""
    books = manifest.select("book_id").distinct()
    return (
        manifest.join(files.select(F.col("path").alias("canonical_path")).distinct(), "canonical_path", "left_anti").select(F.lit("manifest_path_missing").alias("check"), F.col("book_id").cast("string").alias("id"))
        .unionByName(summaries.join(books, "book_id", "left_anti").select(F.lit("summary_without_book").alias("check"), F.col("book_id").cast("string").alias("id")))
        .unionByName(concept_sources.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti").select(F.lit("concept_source_missing").alias("check"), F.col("concept_id").cast("string").alias("id")))
        .unionByName(nodes.join(books, "book_id", "left_anti").select(F.lit("node_without_book").alias("check"), F.col("book_id").cast("string").alias("id")))
    )


def health(**tables: DataFrame) -> DataFrame:
    """(name, n, status): rows of each table; an empty one is a warning."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("status", F.when(F.col("n") == 0, "WARN").otherwise("OK"))


def record_for(manifest: DataFrame, paths: DataFrame) -> DataFrame:
    """paths (path) with the manifest row whose canonical path it is, else whose source path it is."""
    rest = [c for c in manifest.columns if c not in ("canonical_path", "source_path")]
    by = lambda c: paths.join(manifest.select(F.col(c).alias("path"), F.struct(*rest).alias(f"__{c}")).where("path IS NOT NULL").dropDuplicates(["path"]), "path", "left")
    found = by("canonical_path").join(by("source_path"), "path").withColumn("__r", F.coalesce("__canonical_path", "__source_path"))
    return found.select("path", "__r.*")


def triple_hash(raw: Column, block: Column, body: Column) -> Column:
    """struct of SHA-256 of the body, the front matter and the whole file."""
    return F.struct(F.sha2(text(body), 256).alias("content_hash"), F.sha2(text(block), 256).alias("frontmatter_hash"), F.sha2(text(raw), 256).alias("full_hash"))


def heading_report(levels: Column) -> Column:
    """struct<n, n_top, issues, status> of the levels of a text's headings, in order: none at all, a first one below the second level, or a jump of more than one level down."""
    jump = F.exists(F.sequence(F.lit(1), F.size(levels)), lambda i: (i < F.size(levels)) & (F.coalesce(F.try_element_at(levels, i + 1), F.lit(0)) > F.coalesce(F.try_element_at(levels, i), F.lit(9)) + 1))
    some = F.size(levels) > 0
    top = F.array_min(levels)
    found = F.array_compact(F.array(F.when(some & (F.coalesce(F.try_element_at(levels, F.lit(1)), F.lit(0)) > 2), F.lit("first_heading_is_deep")), F.when(some & jump, F.lit("heading_level_jump")), F.when(~some, F.lit("no_markdown_headings"))))
    return F.struct(F.size(levels).cast("long").alias("n"), F.size(F.filter(levels, lambda x: x == top)).cast("long").alias("n_top"), found.alias("issues"), F.when((F.size(found) > 0) | (F.size(levels) < 2), "WARN").otherwise("OK").alias("status"))


def line_count(x: Column) -> Column:
    """How many lines a text has: ends of lines, and what follows the last of them."""
    lines = F.split(text(x), r"\r\n|[\n\r\x0B\f\x1C-\x1E\u0085\u2028\u2029]", -1)
    return F.size(lines) - F.when(F.element_at(lines, -1) == "", 1).otherwise(0)


def parse_check(files: DataFrame, name: str, empty_is_wrong: bool = False) -> DataFrame:
    """(check, status, checked, broken, first): whether all of files (path, text), JSON ones, parse. FAIL if one doesn't, WARN if there are none.

    If empty_is_wrong, a file must hold a mapping or a list, as a configuration does. first is the least path of those
    that are broken. Files are judged where they are; only sums meet.
    """
    bare = F.trim(text(F.col("text")))
    parsed = F.try_parse_json(bare)
    wrong = parsed.isNull()
    if empty_is_wrong:
        wrong = wrong | ~F.substring(bare, 1, 1).isin("{", "[")
    rows = files.select("path", F.coalesce(wrong, F.lit(True)).alias("wrong"))
    sums = rows.agg(F.count("*").alias("checked"), F.count_if("wrong").alias("broken"), F.min(F.when(F.col("wrong"), F.col("path"))).alias("first"))
    status = F.when(F.col("checked") == 0, "WARN").when(F.col("broken") > 0, "FAIL").otherwise("OK")
    return sums.select(F.lit(name).alias("check"), status.alias("status"), "checked", "broken", "first")
