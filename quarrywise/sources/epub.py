"""Books in archives as a data source: a row for each document of a spine, of which only those asked for are unpacked.

    register(spark)
    spark.read.format("epub").load(folder).where("place = 3")

Conditions on path and place go down to the reader: archives whose path isn't asked for are not opened, and of
the others the directory and the entries of the places asked for are read, not the whole file.
"""

from __future__ import annotations

import fnmatch
import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..operators.cleaning import html_to_markdown

SCHEMA = "path string, place int, name string, html string, problem string"
#: Conditions that the reader takes on, by how a value of a row must stand to theirs.
TAKEN = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
}


@dataclass
class Archive(InputPartition):
    path: str


@dataclass
class Condition:
    """A condition on a column, as it can be sent to tasks."""

    column: str
    kind: type
    value: object

    def holds(self, x: object) -> bool:
        return TAKEN[self.kind](x, self.value)


def spine(archive: zipfile.ZipFile) -> Iterator[tuple[int, str]]:
    """(place, name) of the documents of a book, in the order of its spine; names that the archive hasn't leave."""
    where = ElementTree.fromstring(archive.read("META-INF/container.xml")).find(".//{*}rootfile").get("full-path")
    book, there = ElementTree.fromstring(archive.read(where)), set(archive.namelist())
    hrefs = {i.get("id"): i.get("href") for i in book.iterfind(".//{*}item")}
    for place, ref in enumerate(book.iterfind(".//{*}itemref")):
        name = posixpath.normpath(posixpath.join(posixpath.dirname(where), hrefs.get(ref.get("idref"), "")))
        if name in there:
            yield place, name


class EpubReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.conditions = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TAKEN and f.attribute in (("path",), ("place",)):
                self.conditions.append(Condition(f.attribute[0], type(f), f.value))
            else:
                yield f

    def _asked(self, column: str, x: object) -> bool:
        return all(c.holds(x) for c in self.conditions if c.column == column)

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)

    def partitions(self) -> list[Archive]:
        files, root = self._open()
        found = files.get_file_info(fs.FileSelector(root, recursive=True))
        paths = sorted(i.path for i in found if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, "*.epub"))
        return [Archive(p) for p in paths if self._asked("path", p)] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[tuple]:
        if not partition.path:
            return
        try:
            with self._open()[0].open_input_file(partition.path) as f, zipfile.ZipFile(f) as z:
                rows = [(partition.path, place, name, z.read(name).decode("utf-8", "replace"), None) for place, name in spine(z) if self._asked("place", place)]
        except (zipfile.BadZipFile, KeyError, AttributeError, ValueError, ElementTree.ParseError) as e:  # a file too short for an archive is a ValueError
            rows = [(partition.path, 0, None, None, f"{type(e).__name__}: {e}")] if self._asked("place", 0) else []
        yield from rows


class Epub(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> EpubReader:
        return EpubReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets conditions go down to sources of its kind."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Epub)


def read_books(spark: SparkSession, folder: str, condition: str | None = None) -> DataFrame:
    """(path, place, name, text, problem): the documents of all archives below folder as Markdown, of those that a condition on path and place asks for. An archive that can't be read gives a row at place 0 whose problem says why."""
    register(spark)
    rows = spark.read.format("epub").load(folder)
    rows = rows if condition is None else rows.where(condition)
    return html_to_markdown(rows, "html", "text").drop("html")
