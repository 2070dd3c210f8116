"""Readers of other libraries' files: SQLite catalogues of Calibre, PDF pages, MARC XML records, YAML artefacts and layered settings."""

from __future__ import annotations

import io
import json
import sqlite3
import tempfile
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.isbn import normal_isbn
from ..functions.strings import normal, normal_author, normal_title, text
from .files import read_markdown, yaml_json


def read_sqlite(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    """(library, schema's columns): a table of each SQLite file named metadata.db below root. A file is opened in the task that reads it; one that is no database, or lacks the table, gives a row of nulls with its `problem`."""
    names = [c.split()[0] for c in schema.split(",")]

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                with tempfile.NamedTemporaryFile(suffix=".db") as file:  # sqlite reads files alone; it lives as long as this task's row
                    file.write(content)
                    file.flush()
                    try:
                        with sqlite3.connect(file.name) as db:
                            rows += [(path, *r, None) for r in db.execute(f"SELECT {', '.join(names)} FROM {table}")]  # noqa: S608
                    except sqlite3.Error as e:
                        rows.append((path, *[None] * len(names), str(e)))
            yield pd.DataFrame(rows, columns=["library", *names, "problem"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.db").load(root).select("path", "content")
    return files.mapInPandas(unpack, f"library string, {schema}, problem string")


def read_calibre(spark: SparkSession, root: str) -> DataFrame:
    """(library, calibre_id, title, path, published, authors, tags, isbns, formats, comment): books with what left joins find for them, in order of ids."""
    get = lambda table, schema: read_sqlite(spark, root, table, schema).where("problem IS NULL").drop("problem")
    books = get("books", "id long, title string, path string, pubdate string").withColumnRenamed("id", "book")
    listed = lambda rows, value, out: rows.groupBy("library", "book").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias(out))
    linked = lambda link, column, name: get(link, f"id long, book long, {column} long").withColumnRenamed("id", "at").join(get(name, "id long, name string").withColumnRenamed("id", column), ["library", column])
    out = books.join(listed(linked("books_authors_link", "author", "authors"), "name", "authors"), ["library", "book"], "left")
    out = out.join(listed(linked("books_tags_link", "tag", "tags"), "name", "tags"), ["library", "book"], "left")
    codes = get("identifiers", "id long, book long, type string, val string").where("lower(type) IN ('isbn', 'isbn10', 'isbn13')").withColumn("isbn", normal_isbn(F.col("val"))).where("isbn IS NOT NULL").withColumnRenamed("id", "at")
    out = out.join(listed(codes, "isbn", "isbns"), ["library", "book"], "left")
    out = out.join(listed(get("data", "id long, book long, format string").withColumnRenamed("id", "at"), "format", "formats"), ["library", "book"], "left")
    out = out.join(get("comments", "book long, text string").withColumnRenamed("text", "comment"), ["library", "book"], "left")
    none = F.array().cast("array<string>")
    return out.select("library", F.col("book").alias("calibre_id"), "title", "path", F.left(text(F.col("pubdate")), F.lit(4)).alias("published"), *[F.coalesce(c, none).alias(c) for c in ("authors", "tags", "isbns", "formats")], "comment")


def calibre_find(books: DataFrame, query: str) -> DataFrame:
    """Books whose title, authors, tags or ISBNs contain a query, both in normal form."""
    said = normal(F.concat_ws(" ", "title", F.array_join("authors", " "), F.array_join("tags", " "), F.array_join("isbns", " ")))
    return books.where(F.contains(said, normal(F.lit(query))))


def calibre_stub(title: Column, author: Column, comment: Column) -> Column:
    """A book's Markdown stub."""
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.coalesce(F.concat(F.lit("Author: "), F.nullif(author, F.lit("")), F.lit("\n\n")), F.lit("")), F.regexp_replace(text(comment), r"<[^>]+>", ""), F.lit("\n"))


def enriched(books: DataFrame, calibre: DataFrame) -> DataFrame:
    """books (book_id, title, author, isbns, topics, published) with what a matching Calibre book adds where they have nothing: by ISBN first, else by title and author, of several matches the least id. matched_by says how."""
    c = calibre.select("calibre_id", "tags", F.col("published").alias("c_published"), "isbns", F.concat(normal_title(F.col("title")), F.lit("|"), normal_author(F.coalesce(F.try_element_at("authors", F.lit(1)), F.lit("")))).alias("key"))
    b = books.withColumn("key", F.concat(normal_title(F.col("title")), F.lit("|"), normal_author(F.col("author"))))
    by_isbn = b.select("book_id", F.explode("isbns").alias("isbn")).join(c.select(F.explode("isbns").alias("isbn"), "calibre_id"), "isbn").groupBy("book_id").agg(F.min("calibre_id").alias("i"))
    by_key = b.where("key <> '|'").select("book_id", "key").join(c.groupBy("key").agg(F.min("calibre_id").alias("k")), "key").select("book_id", "k")
    met = b.drop("key").join(by_isbn, "book_id", "left").join(by_key, "book_id", "left").withColumn("calibre_id", F.coalesce("i", "k"))
    met = met.withColumn("matched_by", F.when(F.col("i").isNotNull(), "isbn").when(F.col("k").isNotNull(), "title_author")).drop("i", "k")
    full = met.join(c.select("calibre_id", "tags", "c_published").dropDuplicates(["calibre_id"]), "calibre_id", "left")
    topics = F.when(F.coalesce(F.size("topics"), F.lit(0)) > 0, F.col("topics")).otherwise(F.coalesce("tags", "topics"))
    return full.select("book_id", "title", "author", "isbns", topics.alias("topics"), F.coalesce(F.nullif("published", F.lit("")), F.nullif("c_published", F.lit(""))).alias("published"), "calibre_id", "matched_by")


def read_pdf(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, problem): PDF files as Markdown, a `## Page n` section for each page that has text. The reader, pypdf, is needed where tasks run; without it, or for a file that it can't read, text is null and `problem` says why."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    from pypdf import PdfReader

                    pages = [(i, (p.extract_text() or "").strip()) for i, p in enumerate(PdfReader(io.BytesIO(content)).pages, 1)]
                    rows.append((path, "\n\n".join(f"## Page {i}\n\n{t}" for i, t in pages if t), None))
                except Exception as e:  # noqa: BLE001  one bad file mustn't end the read
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "problem"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(root).select("path", "content")
    return files.mapInPandas(unpack, "path string, text string, problem string")


def marc_fields(xml: Column) -> Column:
    """struct<title, author, class_number, class_tag> of a MARC XML answer: of its records the first with 082$a, else the first with 083$a, else the first."""
    has = lambda tag: f'.//*[local-name()="datafield"][@tag="{tag}"]/*[local-name()="subfield"][@code="a"]'
    record = '//*[local-name()="record"][.//*[local-name()="datafield"]]'
    first = lambda test: f'({record}[{test}])[1]'
    chosen = [first(has("082")), first(has("083")), f"({record})[1]"]
    n = [F.expr(f"xpath_number(__x, 'count({c})')") for c in chosen]
    pick = lambda path: F.when(n[0] > 0, _xpath(f"{chosen[0]}/{path}")).when(n[1] > 0, _xpath(f"{chosen[1]}/{path}")).otherwise(_xpath(f"{chosen[2]}/{path}"))
    sub = lambda tag, code: f'*[local-name()="datafield"][@tag="{tag}"]/*[local-name()="subfield"][@code="{code}"]'
    clean = lambda c: F.nullif(F.btrim(c, F.lit(" /:;,.")), F.lit(""))
    number = F.when(n[0] > 0, pick(sub("082", "a"))).when(n[1] > 0, pick(sub("083", "a")))
    return F.struct(clean(pick(sub("245", "a"))).alias("title"), clean(F.coalesce(F.nullif(pick(sub("100", "a")), F.lit("")), pick(sub("700", "a")))).alias("author"), F.nullif(F.regexp_extract(number, r"\d{3}(?:\.\d+)?", 0), F.lit("")).alias("class_number"), F.when(n[0] > 0, "082").when(n[1] > 0, "083").alias("class_tag"))


def _xpath(path: str) -> Column:
    return F.expr(f"xpath_string(__x, '{path}')")


def read_marc(spark: SparkSession, root: str) -> DataFrame:
    """(path, title, author, class_number, class_tag) of MARC XML files."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\A\s*<\?xml[^>]*\?>", "").alias("__x"))
    return rows.select("path", marc_fields(F.col("__x")).alias("m")).select("path", "m.*")


def read_yaml(spark: SparkSession, root: str, pattern: str, schema: str) -> DataFrame:
    """(path, schema's columns): YAML files such as summaries, concepts, claims and passages, read by a schema; what is no mapping gives nulls."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.from_json(yaml_json(F.col("value")), schema).alias("d")).select("path", "d.*")


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records under `books` of a manifest in JSON."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"books array<struct<{', '.join(':'.join(c.split()) for c in schema.split(','))}>>").alias("d"))
    return rows.select(F.inline("d.books"))


def layered(spark: SparkSession, base: str, folder: str, key: str) -> dict:
    """The mapping under `key` of a YAML file, with what the YAML files of a folder, by name, put over it; the last wins. Settings are small and used by the driver."""
    texts = [r.value for r in spark.read.text(base, wholetext=True).collect()]
    try:
        more = spark.read.option("pathGlobFilter", "*.{yaml,yml}").text(folder, wholetext=True)
        texts += [r.value for r in more.select(F.col("_metadata.file_path").alias("p"), "value").orderBy("p").collect()]
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    out: dict = {}
    for t in texts:
        data = yaml.safe_load(t)
        out.update((data or {}).get(key) or {} if isinstance(data, dict) else {})
    return out


def read_both(spark: SparkSession, canonical: str, raw: str) -> DataFrame:
    """Markdown below two roots with the collection that each file is of; a file below both counts as canonical."""
    rows = read_markdown(spark, canonical, "canonical").unionByName(read_markdown(spark, raw, "raw")).where(~F.contains("path", F.lit("/.staging/")))
    first = rows.groupBy("path").agg(F.min("collection").alias("collection"))
    return rows.join(first, ["path", "collection"]).dropDuplicates(["path"])


@F.pandas_udf(StringType())
def json_safe(x: pd.Series) -> pd.Series:
    """YAML or JSON as JSON, with dates and other values as text."""
    return x.map(lambda raw: json.dumps(yaml.safe_load(raw or ""), default=str, ensure_ascii=False))
