"""Readers of book files: Markdown with front matter, HTML pages, EPUB archives, JSON-lines logs."""

from __future__ import annotations

import io
import json
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.markdown import front_matter
from ..operators.cleaning import html_to_markdown

#: Fixed: files and folders that hold no books.
NOT_BOOKS = ("README.md", "CHANGELOG.md", "LICENSE.md", "CONTRIBUTING.md", "CODE_OF_CONDUCT.md", "SECURITY.md")
NOT_BOOK_FOLDERS = (
    "__pycache__", "summaries", "notes", "manifests", "review", "graphs", "concepts", "claims", "passages", "queries", "briefs", "reading-lists", "restore-points", "jobs",
)


@F.pandas_udf(StringType())
def yaml_json(x: pd.Series) -> pd.Series:
    """YAML as JSON; what is no mapping, or no YAML, is an empty one."""

    def one(raw: str | None) -> str:
        try:
            data = yaml.safe_load(raw or "")
        except yaml.YAMLError:
            data = None
        return json.dumps(data if isinstance(data, dict) else {}, default=str, ensure_ascii=False)

    return x.map(one)


def is_book(path: Column, root: str) -> Column:
    """A Markdown file under root that no excluded or dotted name leads to."""
    parts = F.split(F.substring_index(path, root.rstrip("/") + "/", -1), "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return ~F.element_at(parts, -1).isin(*NOT_BOOKS) & ~F.arrays_overlap(folders, F.array(*[F.lit(f) for f in NOT_BOOK_FOLDERS])) & ~F.exists(parts, lambda p: F.startswith(p, F.lit(".")))


def read_markdown(spark: SparkSession, root: str, collection: str = "books") -> DataFrame:
    """(path, collection, meta, text, had_meta): Markdown files below root; meta is the front matter as JSON."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw")).where(is_book(F.col("path"), root))
    block, body = front_matter(F.col("raw"))
    return rows.select("path", F.lit(collection).alias("collection"), yaml_json(block).alias("meta"), body.alias("text"), (block != "").alias("had_meta"))


def books_of(files: DataFrame) -> DataFrame:
    """book_id, title, author, primary_class, topics and source_path from front matter, with the file name where it says nothing."""
    get = lambda p: F.nullif(F.get_json_object("meta", p), F.lit(""))
    stem = F.regexp_replace(F.url_decode(F.element_at(F.split("path", "/"), -1)), r"\.md\z", "")
    parts = F.split(stem, " - ")
    title = F.coalesce(get("$.title"), parts[0])
    author = F.coalesce(get("$.author"), F.when(F.size(parts) > 1, parts[1]))
    topics = F.coalesce(F.from_json(get("$.classification.topics"), "array<string>"), F.array().cast("array<string>"))
    folder = F.nullif(F.regexp_extract("path", r"/(\d{3})-[^/]*/[^/]*\z", 1), F.lit(""))
    return files.select(
        F.coalesce(get("$.book_id"), stem).alias("book_id"), title.alias("title"), author.alias("author"),
        F.coalesce(get("$.classification.primary_class"), folder, F.lit("999")).alias("primary_class"), topics.alias("topics"), F.col("path").alias("source_path"), "text",
    )


def file_hashes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of files below root, by their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_html(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{html,htm,xhtml}").text(root, wholetext=True)
    return html_to_markdown(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw")), "raw", "text").drop("raw")


def read_epub(spark: SparkSession, root: str) -> DataFrame:
    """(path, place, text, problem): the documents of each archive's spine, in order, as Markdown. An archive that can't be read gives one row whose `problem` says why."""

    def spine(content: bytes) -> Iterator[tuple[int, str]]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            where = ElementTree.fromstring(z.read("META-INF/container.xml")).find(".//{*}rootfile").get("full-path")
            book = ElementTree.fromstring(z.read(where))
            hrefs = {i.get("id"): i.get("href") for i in book.iterfind(".//{*}item")}
            for place, ref in enumerate(book.iterfind(".//{*}itemref")):
                name = posixpath.normpath(posixpath.join(posixpath.dirname(where), hrefs.get(ref.get("idref"), "")))
                if name in z.namelist():
                    yield place, z.read(name).decode("utf-8", "replace")

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    rows += [(path, place, html, None) for place, html in spine(content)]
                except (zipfile.BadZipFile, KeyError, AttributeError, ElementTree.ParseError) as e:
                    rows.append((path, 0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "place", "html", "problem"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(root).select("path", "content")
    return html_to_markdown(files.mapInPandas(unpack, "path string, place int, html string, problem string"), "html", "text").drop("html")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line that is no JSON becomes a record with the action parse_error and its text."""
    rows = spark.read.schema(f"{schema}, _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.withColumn("action", F.when(F.col("_broken").isNotNull(), "parse_error").otherwise(F.col("action")))
