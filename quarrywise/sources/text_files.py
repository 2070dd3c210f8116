"""A sink of text files that commits in two steps: notes, queues, passages and front matter, a file for each row.

    register(spark)
    rows.write.format("text_files").option("overwrite", "true").mode("append").save(folder)

rows have (path, content). A task writes its files below a folder of its own that nobody reads. Once all tasks
are done, what is to be moved where is written down in one file, whose renaming is the commit, and then
the files are moved. A job that fails before it leaves the folder as it was; after it, recover() moves what wasn't yet.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


#: Names, below the folder that is written to, of what is not yet in its place and of what is to be moved.
STAGED, COMMITS = "_staged", "_commits"


@dataclass
class Staged(WriterCommitMessage):
    """What a task has written: the list of its files, which is a file itself."""

    listed: str
    n: int


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there. Driver and executors must see the same one."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _write(files: fs.FileSystem, path: str, content: bytes) -> None:
    with files.open_output_stream(path) as out:
        out.write(content)


def _read(files: fs.FileSystem, path: str) -> bytes:
    with files.open_input_stream(path) as f:
        return f.read()


def _there(files: fs.FileSystem, path: str) -> bool:
    return files.get_file_info(path).type != fs.FileType.NotFound


def safe(path: str | None) -> str:
    """A path below the folder; one that leaves it, names nothing or is the sink's own is refused."""
    clean = posixpath.normpath(path or "")
    if not path or clean.startswith(("/", "..", STAGED, COMMITS)) or clean == ".":
        raise ValueError(f"no path below the folder: {path!r}")
    return clean


class TextFilesWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool, schema: StructType):
        if {"path", "content"} - set(schema.names):
            raise ValueError("rows need columns path and content")
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex
        files, root = _open(folder)
        files.create_dir(f"{root}/{STAGED}/{self.job}", recursive=True)

    def write(self, iterator) -> Staged:
        files, root = _open(self.folder)
        mine = f"{root}/{STAGED}/{self.job}/{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
        files.create_dir(mine, recursive=False)  # fails in a task that outlives its job, whose folder is gone
        n, seen = 0, set()
        with files.open_output_stream(f"{mine}/list") as listed:
            for row in iterator:
                path = safe(row["path"])
                if path in seen:
                    raise ValueError(f"two rows for {path}")
                seen.add(path)
                _write(files, f"{mine}/{n}", (row["content"] or "").encode())
                listed.write(json.dumps([f"{mine}/{n}", path]).encode() + b"\n")
                n += 1
        return Staged(f"{mine}/list", n)

    def commit(self, messages) -> None:
        files, root = _open(self.folder)
        lists = [m.listed for m in messages if m and m.n]
        seen: set[str] = set()
        for at in lists:
            for line in _read(files, at).splitlines():
                path = json.loads(line)[1]
                if path in seen or (not self.overwrite and _there(files, f"{root}/{path}")):
                    self.abort(messages)
                    raise ValueError(f"{path} is there already")
                seen.add(path)
        files.create_dir(f"{root}/{COMMITS}", recursive=True)
        beside = f"{root}/{STAGED}/{self.job}/commit"
        _write(files, beside, json.dumps(lists).encode())
        files.move(beside, f"{root}/{COMMITS}/{self.job}.json")
        _finish(files, root, self.job)

    def abort(self, messages) -> None:
        files, root = _open(self.folder)
        if _there(files, f"{root}/{STAGED}/{self.job}"):
            files.delete_dir(f"{root}/{STAGED}/{self.job}")


def _finish(files: fs.FileSystem, root: str, job: str) -> int:
    """Moves what a commit names and is not in its place yet; how many files."""
    n = 0
    for listed in json.loads(_read(files, f"{root}/{COMMITS}/{job}.json")):
        for line in _read(files, listed).splitlines():
            staged, path = json.loads(line)
            if _there(files, staged):
                files.create_dir(posixpath.dirname(f"{root}/{path}"), recursive=True)
                files.move(staged, f"{root}/{path}")
                n += 1
    files.delete_file(f"{root}/{COMMITS}/{job}.json")
    if _there(files, f"{root}/{STAGED}/{job}"):
        files.delete_dir(f"{root}/{STAGED}/{job}")
    return n


def recover(folder: str) -> int:
    """Ends the commits that a driver was killed in; how many files were still to be moved. Files of jobs that never committed stay staged."""
    files, root = _open(folder)
    found = files.get_file_info(fs.FileSelector(f"{root}/{COMMITS}", allow_not_found=True))
    return sum(_finish(files, root, i.base_name.removesuffix(".json")) for i in found if i.base_name.endswith(".json"))


class TextFiles(DataSource):
    """The sink's name and options: path, and overwrite (false if not given)."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def writer(self, schema: StructType, overwrite: bool) -> TextFilesWriter:
        return TextFilesWriter(self.options["path"], overwrite or self.options.get("overwrite", "false").lower() == "true", schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TextFiles)


def write_text_files(rows: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Writes rows (path, content) as files below folder, all of them or none."""
    register(rows.sparkSession)
    rows.select("path", "content").write.format("text_files").option("overwrite", str(overwrite).lower()).mode("append").save(folder)
