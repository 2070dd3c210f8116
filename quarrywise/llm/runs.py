"""Periodic runs of words: stretches that repeat a block of words three times or more.

Scale-tiled: for each octave of periods a document explodes into overlapping tiles, as wide as the
octave needs, which are solved independently of each other wherever they are. In a tile,
Z-functions at boundaries tell how far the words before and after a boundary agree with those a
period on. The fragments meet by document and period and are stitched where tiles cut them.

A tile leaves its document only if words of the octave's length at some place in it occur again
within the octave's distance, which every run of the octave does, so most text sends none.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, materialize, packed, unpacked, whole_text

#: Words in the shortest run, and periods in any.
LEAST, TIMES = 24, 3
#: Periods below this are one octave: for each of them words that agree in a run are SHORT in a row at least, as max(24 - q, 2 q) is 16 or more.
SHORT = 16
#: Words that a tile advances at least.
ADVANCE = 4096

_TILES = "array<struct<step:int,origin:bigint,low:bigint,high:bigint,words:binary>>"
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_TILE = pa.struct([("step", pa.int32()), ("origin", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("words", pa.binary())])

#: Odd multiplier of the hashes by which tiles are told from plain text; what they say is verified by Z-functions.
_BASE = 0x9E3779B97F4A7C15


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document of which a tenth, told by a hash of the id, end in a planted run; a null id has none."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (-(-(n - a) // p)))[: n - a]


def z_function(x: list[int]) -> list[int]:
    """How many elements from each place on agree with the beginning; at 0, all."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of all stretches of a length, from prefix sums modulo 2**64."""

    def __init__(self, words: np.ndarray):
        n = len(words) + 1
        powers = np.full((2, n), 1, np.uint64)
        powers[0, 1:], powers[1, 1:] = _BASE, pow(_BASE, -1, 1 << 64)
        self.up, down = np.multiply.accumulate(powers, axis=1)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_mixed(words) * down[:-1], out=self.sums[1:])

    def of(self, length: int) -> np.ndarray:
        return (self.sums[length:] - self.sums[:-length]) * self.up[: len(self.sums) - length]


def _open_places(words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(step, places) of each octave: where stretches that agree with those a period of the octave on may be. Boundaries are `step` words apart and periods below it; a run has such a place at each of its boundaries, or half a step before."""
    n = len(words)
    if n < LEAST:
        return
    found = []
    for q in range(1, min(SHORT, n)):
        same = np.zeros(n - q + 2, np.int8)
        same[1:-1] = words[:-q] == words[q:]
        edge = np.flatnonzero(np.diff(same))
        begins, ends = edge[::2], edge[1::2]
        for a, b in zip(begins[long := ends - begins >= SHORT].tolist(), ends[long].tolist()):
            found.append(np.arange(-(-a // SHORT) * SHORT, b, SHORT))
    if found:
        yield SHORT, np.unique(np.concatenate(found))
    hashes, half = None, SHORT
    while TIMES * half <= n:
        hashes = hashes or Hashes(words)
        own = hashes.of(half)
        ahead = np.lib.stride_tricks.sliding_window_view(own[half:], half)[::half] if len(own) >= 2 * half else np.empty((0, half), np.uint64)
        # Near the end not all of the octave's distances fit; the rest is looked at with what there is.
        rows = [np.flatnonzero((ahead == own[: len(ahead) * half : half, None]).any(1)) * half]
        c = len(ahead) * half
        while c + half < len(own):
            if (own[c + half : c + 2 * half] == own[c]).any():
                rows.append(np.array([c]))
            c += half
        at = np.concatenate(rows)
        if len(at):
            yield 2 * half, at
        half *= 2


def tiles(words: np.ndarray, advance: int = ADVANCE) -> list[tuple]:
    """(step, origin, low, high, words) of each tile that may hold part of a run: the boundaries from low to high are its own, and its words begin at origin."""
    out, n = [], len(words)
    for step, places in _open_places(words):
        stride = step * max(1, advance // step, 8)
        # A run's boundary has an open place at itself or half a step before.
        for t in np.unique(np.concatenate([places // stride, (places + step // 2) // stride])).tolist():
            low, high = t * stride, min(n, (t + 1) * stride)
            if low < n:
                origin = max(0, low - step)
                out.append((step, origin, low, high, packed(np.unique(words[origin : high + 2 * step], return_inverse=True)[1])))
    return out


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] if n > 1 else out


def solve(step: int, origin: int, low: int, high: int, words: list[int]) -> list[tuple[int, int, int]]:
    """(period, from, to): within a step of the tile's boundaries, where words agree with those a period on, periods that are repeats of shorter ones left out."""
    least, found = 1 if step == SHORT else step // 2, {}
    for c in range(low - origin, high - origin, step):
        after = z_function(words[c : c + 2 * step])
        before = words[max(0, c - step) : c][::-1]
        around = words[max(0, c - step) : c + step][::-1]
        back, width = z_function([*before, -1, *around]), len(before) + 1
        top = min(step, len(words) - c)
        for q in range(least, top):
            right = min(step, after[q])
            if not right:
                continue
            # around ends where the document does, which may be before c + q.
            at = len(around) - len(before) - q
            left = back[width + at] if at >= 0 else 0
            if left + right >= step and not any(after[q // p] >= q - q // p for p in _primes(q)):
                a, b = origin + c - left, origin + c + right
                mine = found.setdefault(q, [])
                if mine and a <= mine[-1][1]:
                    mine[-1][1] = max(b, mine[-1][1])
                else:
                    mine.append([a, b])
    return [(q, a, b) for q, spans in found.items() for a, b in spans]


def _exploded(docs: DataFrame, plant: Callable | None, with_text: bool, advance: int) -> DataFrame:
    """(row, doc_id, n_words, kept_sha256, text, tiles): a document that has no tile is done with; of the others the text goes along."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(_TILE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = text.split()
                words = words if plant is None else plant(doc_id, words)
                seen: dict[bytes, int] = {}
                found = tiles(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)), advance)
                said = b" ".join(words)
                rows.append((part + nth, doc_id, len(words), None if found else hashlib.sha256(said).hexdigest(), said if found or with_text else None, [dict(zip(("step", "origin", "low", "high", "words"), t)) for t in found] or None))
                nth += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["row", "doc_id", "n_words", "kept_sha256", "text", "tiles"])

    return docs.mapInArrow(run, f"row long, doc_id long, n_words long, kept_sha256 string, text binary, tiles {_TILES}")


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row, *tile, words in zip(*(c.to_pylist() for c in batch.columns)):
            rows += [(row, *f) for f in solve(*tile, unpacked(words).tolist())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["row", "period", "low", "high"])


def stitched(fragments: DataFrame) -> DataFrame:
    """(row, start, length, period): fragments (row, period, low, high) that touch are one; those long enough are runs."""
    w = Window.partitionBy("row", "period").orderBy("low", "high")
    reach = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = fragments.withColumn("begins", F.coalesce((F.col("low") > reach).cast("int"), F.lit(1))).withColumn("nth", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = parts.groupBy("row", "period", "nth").agg(F.min("low").alias("start"), F.max("high").alias("high"))
    runs = spans.select("row", "start", (F.col("high") - F.col("start") + F.col("period")).alias("length"), "period")
    return runs.where(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text without the words that a run has after its first period."""
    for batch in batches:
        shas, texts = [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
            words = text.split(b" ") if text else []
            keep = np.ones(len(words), bool)
            for r in runs:
                keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
            said = b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])
            shas.append(hashlib.sha256(said).hexdigest())
            texts.append(said)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("runs"), pa.array(shas, pa.string()), pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "kept_sha256", "kept_text"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: Callable | None = None, with_text: bool = False, advance: int = ADVANCE) -> DataFrame:
    """One row per input row: doc_id, n_words, runs (array of start, length, period by start and period), kept_sha256, and kept_text if asked for.

    Words are parted by ASCII blanks. A run is a stretch of at least 24 words, and three of its smallest period, in which
    words a period apart are equal and which no neighbouring word extends. Words that a run has after its first period are not kept;
    kept ones are joined by one blank. A null or empty text has no words. Rows are told apart by where they are read, so repeated rows and null ids are rows of their
    own; other columns are left out; no rows give no rows. plant(doc_id, words) may change words before they are looked at.
    """
    rows = materialize(_exploded(whole_text(docs, id_col, text_col), plant, with_text, advance))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = rows.where("tiles IS NOT NULL").select("row", F.explode("tiles").alias("t")).select("row", "t.*").repartition(n, "row", "step", "origin")
    runs = stitched(each.mapInArrow(_solved, "row long, period long, low long, high long"))
    # A document has fewer runs than words, so they fit where its text does.
    per_row = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    none = F.array().cast(_RUNS)
    open_rows = rows.where("tiles IS NOT NULL").select("row", "doc_id", "n_words", "text").join(per_row, "row", "left").select("doc_id", "n_words", "text", F.coalesce("runs", none).alias("runs"))
    done = open_rows.mapInArrow(_collapsed, f"doc_id long, n_words long, runs {_RUNS}, kept_sha256 string, kept_text binary")
    plain = rows.where("tiles IS NULL").select("doc_id", "n_words", none.alias("runs"), "kept_sha256", F.col("text").alias("kept_text"))
    out = done.unionByName(plain)
    return out.withColumn("kept_text", F.decode("kept_text", "UTF-8")) if with_text else out.drop("kept_text")


def _better(a: Column, b: Column) -> Column:
    """Whether run a has the greater exact exponent than b, or the smaller start, or the smaller period."""
    x, y = a["length"] * b["period"], b["length"] * a["period"]
    return (x > y) | ((x == y) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))


def run_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs; start, length, period and exponent_milli of the run of the greatest exponent; runs_sha256, collapsed_sha256, of periodic_runs' rows."""
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda acc, x: F.when(_better(x, acc), x).otherwise(acc))
    said = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(said, 256).alias("runs_sha256"), F.col("kept_sha256").alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
