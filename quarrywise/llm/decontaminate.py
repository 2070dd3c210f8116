"""Benchmark decontamination: one Aho-Corasick automaton over the windows of normalised test items.

A text is scanned once, word by word, and every hit is mapped back to its place in the original.
Only the benchmark is broadcast. Its size is checked: past PART_BYTES of text the items go to
further automata, scanned in the same task without a shuffle; past PARTS automata they are broadcast
in turn, a group at a time, so that no size is refused and none fills the workers.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize, with_row

#: Words in a window, and a twentieth of the words hit makes a text contaminated.
WINDOW, SHARE = 13, 20
#: Benchmark text that one automaton takes, and automata that a worker holds at once.
PART_BYTES, PARTS = 4 << 20, 8

#: A-Z to a-z; 00-2F, 3A-60 and 7B-7F (after lowering) to a space; digits, a-z and all bytes of non-ASCII characters stay. Byte for byte, so offsets stay too.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_SCHEMA = "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows_of(words: list[bytes], width: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    """All windows of an item; a shorter item that isn't empty is one window."""
    if words:
        for i in range(max(1, len(words) - width + 1)):
            yield tuple(words[i : i + width])


class Scanner:
    """The automaton reads word numbers; a word that no item has is 0, which no window holds."""

    def __init__(self, items: list[tuple[str, bytes]], width: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item_id, text in items:
            for window in windows_of(words_of(text), width):
                owners[tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in window)].add(item_id)
        self.automaton = None
        if owners:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for window, ids in owners.items():
                self.automaton.add_word(window, (len(window), sorted(ids)))
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> list[tuple[int, int, list[str]]]:
        """(first word, end, items) of every occurrence of a window."""
        if self.automaton is None or not words:
            return []
        get = self.vocabulary.get
        ids = tuple([get(w, 0) for w in words])
        return [(end + 1 - n, end + 1, items) for end, (n, items) in self.automaton.iter(ids)]


def _covered(hits: list[tuple[int, int, list[str]]], n: int) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    for a, b, _ in hits:
        edges[a] += 1
        edges[b] -= 1
    return np.cumsum(edges[:-1]) > 0


def _spans(text: bytes, covered: np.ndarray) -> list[dict]:
    """Runs of hit words as character offsets in the original text."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(NORMAL))]
    runs = np.flatnonzero(np.diff(np.r_[0, covered.astype(np.int8), 0]))
    out = []
    for a, b in zip(runs[::2], runs[1::2]):
        start, end = places[a][0], places[b - 1][1]
        first = len(text[:start].decode("utf-8", "replace"))
        out.append({"start": first, "end": first + len(text[start:end].decode("utf-8", "replace"))})
    return out


def _groups(benchmark: DataFrame) -> Iterator[list[list[tuple[str, bytes]]]]:
    """The items in parts of PART_BYTES at most, PARTS parts at a time; the driver holds one such group. Null items and ids are left out."""
    parts: list[list[tuple[str, bytes]]] = [[]]
    filled = 0
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("t is not null and i is not null")
    for r in items.toLocalIterator():
        text = r.t.encode()
        if filled and filled + len(text) > PART_BYTES:
            if len(parts) == PARTS:
                yield parts
                parts = []
            parts.append([])
            filled = 0
        parts[-1].append((r.i, text))
        filled += len(text)
    yield parts


def _hits(docs: DataFrame, benchmark: DataFrame, text_col: str, width: int) -> tuple[list, DataFrame | None]:
    """(broadcasts, None) if the items are one group, which is scanned where texts are used. Else ([], hits): each group is broadcast in turn, all texts are scanned with it, and only texts with hits are written.

    hits: text_sha256, hits array<struct<a,b>>, item_ids array<string>; what is in a text depends on the text alone.
    """
    sc, groups = docs.sparkSession.sparkContext, _groups(benchmark)
    group, after = next(groups), next(groups, None)
    if after is None:
        return [sc.broadcast(p) for p in group], None
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).select(F.sha2("text", 256).alias("text_sha256"), "text")
    found = None
    while group is not None:
        sent = [sc.broadcast(p) for p in group]

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            scanners = [_scanner(b, width) for b in sent]
            for batch in batches:
                rows = [(key, hits) for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))) if (hits := _found(text, scanners)[1])]
                spans = [[{"a": a, "b": b} for a, b in sorted({h[:2] for h in hits})] for _, hits in rows]
                ids = [sorted({i for h in hits for i in h[2]}) for _, hits in rows]
                kinds = (pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([k for k, _ in rows], spans, ids), kinds)], ["text_sha256", "hits", "item_ids"])

        part = materialize(texts.mapInArrow(scan, "text_sha256 string, hits array<struct<a:long,b:long>>, item_ids array<string>").dropDuplicates(["text_sha256"]))
        found = part if found is None else found.unionByName(part)
        for b in sent:
            b.destroy()
        group, after = after, next(groups, None)
    gathered = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    return [], materialize(found.groupBy("text_sha256").agg(gathered("hits").alias("hits"), gathered("item_ids").alias("item_ids")))


def _found(text: bytes, scanners: list[Scanner]) -> tuple[list[bytes], list, np.ndarray | None]:
    """A text's words, the hits among them, and which words are hit."""
    words = words_of(text)
    hits = [h for s in scanners for h in s.scan(words)]
    return words, hits, _covered(hits, len(words)) if hits else None


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, share: int = SHARE) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, spans.

    A word inside any occurrence of an item's window is hit; contaminated: n_hit > 0 and share *
    n_hit >= n_words. Null and empty texts have no words and are clean; null and empty items have no
    windows. Repeated items count once. item_ids are sorted as strings; spans are character offsets
    in the original text. Any other column of docs is left out, so that no name clashes.
    """
    sent, hits = _hits(docs, benchmark, text_col, width)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    if hits is not None:
        rows = rows.join(hits, F.sha2("text", 256) == F.col("text_sha256"), "left").select("doc_id", "text", "hits", "item_ids")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = [_scanner(b, width) for b in sent]
        for batch in batches:
            n_words, n_hit, ids, spans = [], [], [], []
            known = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()) if batch.num_columns > 2 else repeat(None)
            for text, given in zip(as_bytes(batch.column(1)), known):
                if given is None:
                    words, found, covered = _found(text, scanners)
                    items = sorted({i for h in found for i in h[2]})
                else:
                    words, items = words_of(text), sorted(given[1] or ())
                    covered = _covered([(h["a"], h["b"], ()) for h in given[0] or ()], len(words))
                n_words.append(len(words))
                n_hit.append(int(covered.sum()) if items else 0)
                ids.append(items)
                spans.append(_spans(text, covered) if items else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "n_words", "n_hit", "item_ids", "spans"],
            )

    return rows.mapInArrow(scan, _SCHEMA).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "item_ids", "spans",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The rows of docs that decontaminate finds clean, with docs' own columns, whatever their names. Items of one group are looked for where texts are read; those of many are found first, and contaminated texts leave by an anti-join."""
    sent, hits = _hits(docs, benchmark, text_col, width)
    if hits is not None:
        rows = with_row(docs, text=F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).withColumn("text_sha256", F.sha2("text", 256))

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = []
                for key, text, spans in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                    n = len(words_of(text))
                    if share * int(_covered([(h["a"], h["b"], ()) for h in spans], n).sum()) >= n:
                        keys.append(key)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], ["text_sha256"])

        bad = materialize(rows.join(hits, "text_sha256").select("text_sha256", "text", "hits").mapInArrow(judged, "text_sha256 string").distinct())
        return rows.join(bad, "text_sha256", "left_anti").select("row.*")

    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = [_scanner(b, width) for b in sent]
        for batch in batches:
            keep = []
            for text in as_bytes(batch.column(at)):
                words, hits, covered = _found(text, scanners)
                keep.append(not hits or share * int(covered.sum()) < len(words))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


_built: dict[int, tuple[object, Scanner]] = {}


def _scanner(sent, width: int) -> Scanner:
    """One automaton for each worker process, not for each task. The items are held, so that their id stays theirs."""
    items = sent.value
    if id(items) not in _built:
        if len(_built) >= PARTS:
            _built.clear()
        _built[id(items)] = (items, Scanner(items, width))
    return _built[id(items)][1]
