"""Exact dedup: Grace hash deduplication.

Map tasks fold equal texts first, so that a text costs one record per task however often it
occurs. The records are then partitioned by content hash; a bucket that doesn't fit memory is
partitioned again to spill files by the next bits of the hash, and so on, until it fits an
open-addressing table that compares complete contents. Spill files belong to the task and go
with it: a task that is run again on another executor needs none of them.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, with_row

#: Bytes of text that one table may hold, and sub-buckets for each spilled bucket.
MEMORY_BYTES, FAN_OUT_BITS = 48 << 20, 4

_FOLDED = "h long, text binary, keep_id long, n long, n_keep long"
_GROUPS = "text_sha256 string, n_bytes long, h long, keep_id long, group_size long, n_keep long"


class ContentTable:
    """Open addressing with linear probing; a record equals another if the complete contents are equal."""

    def __init__(self):
        self.slots, self.mask, self.bytes = np.full(1024, -1, np.int64), 1023, 0
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.stats: list[list] = []  # [keep_id, n, n_keep]

    def __len__(self) -> int:
        return len(self.texts)

    def _slot(self, h: int, text: bytes | None) -> tuple[int, int]:
        at = h & self.mask
        while (i := self.slots[at]) >= 0:
            if text is not None and self.hashes[i] == h and self.texts[i] == text:
                return at, int(i)
            at = (at + 1) & self.mask
        return at, -1

    def add(self, h: int, text: bytes, keep_id: int | None, n: int, n_keep: int) -> None:
        at, i = self._slot(h, text)
        if i < 0:
            self.slots[at] = len(self.texts)
            self.hashes.append(h)
            self.texts.append(text)
            self.stats.append([keep_id, n, n_keep])
            self.bytes += len(text) + 200
            if 2 * len(self.texts) > self.mask:
                self._grow()
            return
        s = self.stats[i]
        s[1] += n
        if s[0] == keep_id:
            s[2] += n_keep
        elif s[0] is None or (keep_id is not None and keep_id > s[0]):
            s[0], s[2] = keep_id, n_keep

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = np.full(self.mask + 1, -1, np.int64)
        for i, h in enumerate(self.hashes):
            self.slots[self._slot(h, None)[0]] = i

    def records(self) -> Iterator[tuple]:
        return ((h, t, *s) for h, t, s in zip(self.hashes, self.texts, self.stats))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: equal texts of a task become one record; a full table is handed on."""
    table = ContentTable()

    def out():
        r = list(zip(*table.records())) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(r, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["h", "text", "keep_id", "n", "n_keep"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            table.add(xxhash.xxh3_64_intdigest(text) >> 1, text, doc_id, 1, 1)
            if table.bytes > MEMORY_BYTES // 4:
                yield out()
                table = ContentTable()
    yield out()


def grace_groups(records: Iterable[tuple], memory_bytes: int = MEMORY_BYTES, depth: int = 0) -> Iterator[tuple]:
    """Groups (h, text, keep_id, n, n_keep) of records of that form; a bucket that's too large goes to spill files by its next hash bits."""
    table, files, folder = ContentTable(), None, None
    shift = 63 - FAN_OUT_BITS * (depth + 1)
    try:
        for r in records:
            if files is None:
                table.add(*r)
                # With no hash bits left all of a bucket has one hash, which is one text but for a collision.
                if table.bytes > memory_bytes and shift >= 0:
                    folder = tempfile.TemporaryDirectory(prefix="grace-")
                    files = [open(f"{folder.name}/{i}", "w+b") for i in range(1 << FAN_OUT_BITS)]
                    for x in table.records():
                        pickle.dump(x, files[(x[0] >> shift) & ((1 << FAN_OUT_BITS) - 1)], -1)
                    table = None
            else:
                pickle.dump(r, files[(r[0] >> shift) & ((1 << FAN_OUT_BITS) - 1)], -1)
        if files is None:
            yield from table.records()
        else:
            for f in files:
                f.seek(0)
                yield from grace_groups(_spilled(f), memory_bytes, depth + 1)
                f.truncate(0)
    finally:
        for f in files or ():
            f.close()
        if folder:
            folder.cleanup()


def _spilled(f) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: the groups of one partition."""
    records = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = ["text_sha256", "n_bytes", "h", "keep_id", "group_size", "n_keep"]
    rows: list[tuple] = []
    for h, text, keep_id, n, n_keep in grace_groups(records):
        rows.append((hashlib.sha256(text).hexdigest(), len(text), h, keep_id, n, n_keep))
        if len(rows) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text: its digest, keep_id, group_size and n_keep (rows that have keep_id)."""
    pairs = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))
    return pairs.mapInArrow(_fold, _FOLDED).repartition("h").mapInArrow(_bucket, _GROUPS)


def _with_groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text_sha256, n_bytes, keep_id, group_size): docs' rows with their groups. A hot text makes one key hot; the adaptive skew join splits it, as no later step needs a key's rows together."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = with_row(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text_sha256=F.sha2(text, 256), n_bytes=F.octet_length(text).cast("long"))
    return own.join(copy_groups(docs, id_col, text_col).select("text_sha256", "n_bytes", "keep_id", "group_size"), ["text_sha256", "n_bytes"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical byte for byte; a null text is an empty one. The row with the
    largest id of a group stays (a null id is below all others); of rows that repeat that id, one
    stays. Any other column of docs is left out, so that no name clashes. No rows give no rows.
    """
    rows = _with_groups(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text").drop("row")
    # Ids are distinct, so a partition of this window is a row, but for rows that repeat an id.
    nth = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("keep_id"))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (nth == 1)).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with docs' own columns, whatever their names."""
    rows = _with_groups(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # Only rows that hold their group's keep_id are left: one per text, but for rows that repeat an id.
    nth = F.row_number().over(Window.partitionBy("text_sha256", "n_bytes").orderBy(F.lit(0)))
    return rows.withColumn("nth", nth).where("nth = 1").select("row.*")
