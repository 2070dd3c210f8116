"""Substring dedup: Rabin-Karp hashes of every fixed-length window of words, counted in Spark.

A window can only repeat if its anchor does: the least Rabin-Karp hash among the shorter runs of
ANCHOR words inside it, which equal windows share. So anchors, some 6 % as many as windows, are
counted first; windows whose anchor is in one document only are known to be there once, and only
the others' hashes travel. No window that repeats is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordPairs, as_bytes, materialize, whole_text

#: Words in a window, and in the runs of which the least hash is the window's anchor.
WINDOW, ANCHOR = 50, 20
#: Windows that a task folds at a time.
FOLDED = 1_000_000

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Rabin-Karp hashes modulo 2**64 of all runs of a length: sum of word[i + j] * base**-j, from prefix sums."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.up):
            n = 2 * n
            steps = np.ones((2, n), np.uint64)
            steps[0, 1:], steps[1, 1:] = self.base, self.inverse
            self.up, self.down = np.multiply.accumulate(steps, axis=1)

    def hashes(self, words: np.ndarray, length: int) -> np.ndarray:
        n = len(words)
        if n < length:
            return np.empty(0, np.uint64)
        self._powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.down[:n], out=sums[1:])
        return _mixed((sums[length:] - sums[:-length]) * self.up[: n - length + 1])


class Windows:
    """The windows of one document and their anchors."""

    def __init__(self, window: int = WINDOW, anchor: int = ANCHOR):
        self.window, self.anchor = window, min(anchor, window)
        self.words, self.rolling = WordPairs(), [Rolling(b) for b in _BASES]

    def anchors(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor of each window, its place). words: two hashes of each."""
        w = words[0]
        if len(w) < self.window:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        runs = self.rolling[0].hashes(w, self.anchor)
        n = len(w) - self.window + 1
        at = np.lib.stride_tricks.sliding_window_view(runs, self.window - self.anchor + 1).argmin(1) + np.arange(n)
        return runs[at], at

    def hashes(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.rolling[0].hashes(words[0], self.window), self.rolling[1].hashes(words[1], self.window)


def merged(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals [first, end) that windows at the sorted starts cover."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.r_[True, np.diff(starts) > width])
    return starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1]] + width


def _described(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Windows(window, anchor)
        for batch in batches:
            n_words, keys, offsets, anchors = [], [], [0], []
            for text in as_bytes(batch.column(2)):
                words = text.split()
                values, at = find.anchors(find.words.of(words))
                values = values[np.flatnonzero(np.r_[True, at[1:] != at[:-1]])] if len(at) else values
                n_words.append(len(words))
                keys.append(hashlib.sha256(b" ".join(words)).digest())
                anchors.append(values)
                offsets.append(offsets[-1] + len(values))
            values = np.concatenate([np.empty(0, np.uint64), *anchors]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))],
                ["doc_id", "text_key", "n_words", "words_key", "anchors"],
            )

    return run


def _folded(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Windows that a task has seen. Of equal ones those in the smallest document stay open; the others are repeats for sure, so a hot window costs a task one document's rows."""
    h1, h2, doc, text_key, start = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((doc, h2, h1))
    h1, h2, doc, text_key, start = (x[order] for x in (h1, h2, doc, text_key, start))
    new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
    least = doc[new][np.cumsum(new) - 1]
    sure = doc > least
    return pa.RecordBatch.from_arrays([pa.array(h1, mask=sure), pa.array(h2, mask=sure), pa.array(doc), pa.array(text_key), pa.array(start), pa.array(sure)], ["h1", "h2", "doc_id", "text_key", "start", "sure"])


def _candidates(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, parts, n = Windows(window, anchor), [], 0
        for batch in batches:
            for doc_id, text_key, text, shared in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3)):
                w = find.words.of(text.split())
                values, _ = find.anchors(w)
                at = np.flatnonzero(np.isin(values, np.asarray(shared.values).view(np.uint64)))
                h1, h2 = (h[at].view(np.int64) for h in find.hashes(w))
                if len(at):
                    parts.append((h1, h2, np.full(len(at), doc_id, np.int64), np.full(len(at), text_key, np.int64), at.astype(np.int32)))
                    n += len(at)
                if n > FOLDED:
                    yield _folded(parts)
                    parts, n = [], 0
        if parts:
            yield _folded(parts)

    return run


def _intervals(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [merged(np.sort(np.asarray(s.values)), window) for s in batch.column(2)]
            spans = [[{"start": int(a), "end": int(b)} for a, b in zip(*f)] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "text_key", "removed"])

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, text): a row is told by its id and a hash of its text, so that rows that repeat an id with other texts stay apart."""
    return whole_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def removal_intervals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, text_key (Spark's xxhash64 of the text) and removed array<struct<start,end>>: the maximal runs of words to remove; texts that lose nothing have no row.

    A word goes if it is in a window whose words also start in a document with a smaller id. Words are
    runs of anything but ASCII white space. Documents of one word sequence are folded into the first of
    them, of which each later copy is wholly a repeat. Windows of the same id don't count against each
    other, whether in one text or in several. A row with a null id, or with fewer words than a window,
    loses and takes nothing.
    """
    described = _keyed(docs, id_col, text_col).where("doc_id IS NOT NULL").mapInArrow(_described(window, anchor), "doc_id long, text_key long, n_words long, words_key binary, anchors array<long>")
    base = materialize(described.where(F.col("n_words") >= window))
    # Written first, so that the join has two plain shuffles, of which the adaptive skew join can split a hot key's.
    first = materialize(base.groupBy("words_key").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").select("words_key", "first_id"))
    placed = base.join(first, "words_key", "left")
    copies = placed.where("doc_id > first_id").select("doc_id", "text_key", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"))).alias("removed")).dropDuplicates(["doc_id", "text_key"])
    anchors = placed.where("first_id IS NULL OR doc_id = first_id").select("doc_id", "text_key", F.explode("anchors").alias("anchor"))
    shared = materialize(anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor"))
    wanted = materialize(anchors.join(shared, "anchor").groupBy("doc_id", "text_key").agg(F.collect_set("anchor").alias("shared")))
    found = _keyed(docs, id_col, text_col).join(wanted, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "shared")
    windows = materialize(found.mapInArrow(_candidates(window, anchor), "h1 long, h2 long, doc_id long, text_key long, start int, sure boolean"))
    # The least document of a window is found by partial sums and joined back, so that a hot window is never gathered in one task.
    still = windows.where("NOT sure")
    least = materialize(still.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h1", "h2", "lo"))
    later = still.join(least, ["h1", "h2"]).where("doc_id > lo")
    repeats = windows.where("sure").select("doc_id", "text_key", "start").unionByName(later.select("doc_id", "text_key", "start"))
    starts = repeats.groupBy("doc_id", "text_key").agg(F.collect_set("start").alias("starts"))
    spans = "doc_id long, text_key long, removed array<struct<start:long,end:long>>"
    return materialize(starts.mapInArrow(_intervals(window), spans).unionByName(copies))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()):
            words = text.split()
            left, at = [], 0
            for s in spans or ():
                left += words[at : s["start"]]
                at = s["end"]
            left += words[at:]
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), batch.column(2)], ["doc_id", "n_words", "n_removed", "kept_text", "removed"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text (kept words joined by one space), removed (null if nothing goes).

    See removal_intervals for what goes. Null and empty texts have no words and an empty kept_text.
    Rows that repeat an id with the same text have the same result; with other texts each has its own.
    Other columns are left out.
    """
    spans = removal_intervals(docs, id_col, text_col, window, anchor)
    # Merged at any size: the plan for a small table is the plan for a large one.
    rows = _keyed(docs, id_col, text_col).join(spans.hint("merge"), ["doc_id", "text_key"], "left").select("doc_id", "text", "removed")
    return rows.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>")
