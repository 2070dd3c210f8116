"""Best-fit packing: a configuration linear program over the histogram of lengths.

A configuration says how many pieces of each length fill one sequence. The program is solved by
multiplicative weights: lengths that are covered lose weight, and the next configuration is the
dearest by a knapsack over lengths. What is left after rounding down is packed by best fit, and the
result is held against a bound from the dual. All of this reads only the histogram, which has at most as many bins as a sequence has tokens; pieces get
their places in parallel, by their rank among the pieces of their length.
"""

from __future__ import annotations

import math
import os
import re
import struct
import zlib
from bisect import insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, whole_text

#: Tokens in a sequence, and the id that ends a document.
CAPACITY, END_ID = 1024, 2
#: How much prices rise for long pieces and for the weights of lengths, tried in this order, and the gap to the dual bound that ends it.
PRICINGS, GAP = ((0.1, 0.02), (0.02, 0.02), (0.1, 0.1)), 1e-4
#: Pieces that one task ranks at a time.
RANKED = 50_000
#: Texts tokenised together, in characters, and parts of texts remembered in each of two generations.
TOGETHER, REMEMBERED = 1 << 20, 300_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Fixed: the characters of Unicode's White_Space property.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed: letters and digits that no neighbour but an apostrophe draws into a token of its own, and ASCII punctuation without the apostrophe.
_WORD, _MARK = "A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-&(-/:-@\[-`{-~"
#: Byte-level BPE never merges across these parts: a word or a run of marks with one space before it, where plain letters and marks meet; what else there is up to the next white space; white space up to the last.
_PARTS = re.compile(f" ?[{_WORD}]+(?=[{_MARK}{_SPACE}]|\\Z)| ?[{_MARK}]+(?=[{_WORD}{_SPACE}]|\\Z)| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, as the tokenizer gives them without adding special tokens. Parts that were seen lately aren't tokenised again: those of the last generation that recur move to the next, so frequent ones stay."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The tokenizer's own added tokens are found in a text before it is parted, so a text that holds one is encoded whole.
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join(added) or r"(?!)")
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.seen: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def each(self, parts: list[str]) -> list[bytes]:
        """Ids of parts. Those without line ends are encoded as one text of a part a line, as a line end is always a token of its own beside them; its ids are cut at the line ends."""
        lines = [p for p in parts if "\n" not in p and not p.isspace()]
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(ids == self.line_end[0]) if len(self.line_end) == 1 else np.empty(0, np.int64)
        found = {}
        if len(lines) and len(cuts) == len(lines) - 1:
            data, edges = ids.tobytes(), (4 * np.r_[-1, cuts, len(ids)]).tolist()
            found = {p: data[a + 4 : b] for p, a, b in zip(lines, edges, edges[1:])}
        rest = [p for p in parts if p not in found]
        for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            found[p] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        return [found[p] for p in parts]

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [[t] if self.whole.search(t) else _PARTS.findall(t) for t in texts]
        if len(self.seen) > REMEMBERED:
            self.before, self.seen = self.seen, {}
        missed = list(set(chain.from_iterable(split)).difference(self.seen))
        self.seen.update({p: self.before[p] for p in missed if p in self.before})
        new = [p for p in missed if p not in self.seen]
        self.seen.update(zip(new, self.each(new)))
        return [b"".join(map(self.seen.__getitem__, parts)) for parts in split]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, so that what it remembers serves the next task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole if it fits, else full pieces after a first that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows, at = [], 0
            while at < len(ids):
                to, size = at, 0
                while to < len(ids) and (to == at or size + len(texts[to]) <= TOGETHER):
                    size += len(texts[to])
                    to += 1
                for doc_id, data in zip(ids[at:to], tokens.ids(texts[at:to])):
                    data = memoryview(data + end)
                    for k, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                        rows.append((doc_id, k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
                at = to
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return whole_text(docs, id_col, text_col).mapInArrow(run, _PIECES)


def dearest(prices: np.ndarray) -> list[int]:
    """Lengths of the dearest multiset that fits: an unbounded knapsack. prices: by length from 0 to the capacity; a length that isn't offered has the price -inf."""
    capacity = len(prices) - 1
    worth, choice, each = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64), prices[1:]
    for c in range(1, capacity + 1):
        got = worth[c - 1 :: -1] + each[:c]
        i = int(got.argmax())
        worth[c], choice[c] = (got[i], i + 1) if got[i] > worth[c - 1] else (worth[c - 1], 0)
    out, c = [], capacity
    while c > 0:
        if choice[c]:
            out.append(int(choice[c]))
        c -= int(choice[c]) or 1
    return out


def fractional(histogram: dict[int, int], capacity: int, long_share: float, weight_share: float) -> list[tuple[tuple[int, ...], float]]:
    """(configuration, how often) of a solution of the program that covers each length exactly.

    A length's weight begins at one and is multiplied by exp(-share of its pieces) when a configuration takes
    them. Its price is its share of the capacity, which is the program's dual where sequences can be
    filled, raised by long_share for long pieces, so that they choose their complements while there are any,
    and by weight_share for its weight. The dearest configuration is used until one of its lengths is gone,
    so there are no more rounds than lengths.
    """
    sizes = np.arange(capacity + 1) / capacity
    counts = np.zeros(capacity + 1)
    for k, n in histogram.items():
        counts[k] = n
    left, log_weights, used = counts.copy(), np.zeros(capacity + 1), defaultdict(float)
    while left.any():
        prices = np.where(left > 0, sizes * (1 + long_share * sizes + weight_share * np.exp(log_weights)), -np.inf)
        config = Counter(dearest(prices))
        times = min(left[k] / c for k, c in config.items())
        used[tuple(sorted(config.elements(), reverse=True))] += times
        for k, c in config.items():
            left[k] -= c * times
            left[k] = 0 if left[k] < 1e-9 else left[k]
            log_weights[k] -= c * times / counts[k]
    return list(used.items())


def dual_bound(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """Sequences that no packing can go below: the best of a family of solutions of the dual, in which lengths over capacity - a cost a sequence, those under a nothing, and others their share."""
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[k] for k in lengths.tolist()])
    best = 0.0
    for a in range(capacity // 2 + 1):
        best = max(best, float(np.where(lengths > capacity - a, capacity, np.where(lengths < a, 0, lengths)) @ counts) / capacity)
    return math.ceil(best - 1e-9)


def best_fit(left: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """Sequences (as tuples of lengths, longest first) of counts of lengths: each piece, longest first, to the fullest sequence that has room."""
    rooms: dict[int, Counter] = defaultdict(Counter)
    sizes: list[int] = []

    def put(room: int, seq: tuple, n: int) -> None:
        if not rooms[room]:
            insort(sizes, room)
        rooms[room][seq] += n

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = next((r for r in sizes if r >= length), None)
            if at is None:
                each = capacity // length  # pieces of one length that find no room share new sequences
                if n >= each:
                    put(capacity - each * length, (length,) * each, n // each)
                    n %= each
                if n:
                    put(capacity - n * length, (length,) * n, 1)
                    n = 0
                continue
            seq = next(iter(rooms[at]))
            k = min(n, rooms[at][seq])
            rooms[at][seq] -= k
            if not rooms[at][seq]:
                del rooms[at][seq]
            if not rooms[at]:
                sizes.remove(at)
            put(at - length, (*seq, length), k)
            n -= k
    out: Counter = Counter()
    for r in rooms.values():
        out.update(r)
    return out


def rounded(solution: list[tuple[tuple[int, ...], float]], histogram: dict[int, int], capacity: int) -> Counter:
    """A solution rounded down, fullest configurations first, and the rest by best fit."""
    left, plan = dict(histogram), Counter()
    for config, x in sorted(solution, key=lambda c: (-sum(c[0]), c[0])):
        need = Counter(config)
        times = min(int(x + 1e-9), *(left[k] // c for k, c in need.items()))
        if times > 0:
            plan[config] += times
            for k, c in need.items():
                left[k] -= c * times
    plan.update(best_fit({k: n for k, n in left.items() if n}, capacity))
    return plan


def configurations(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), which together hold each length as often as the histogram says.

    The program is always solved, with one of PRICINGS after another until the rounded solution is within
    GAP of the dual bound; the fewest sequences win. Best fit alone is what it is held against: its plan is
    taken only if every rounded solution has more sequences.
    """
    histogram = {k: n for k, n in histogram.items() if n}
    if not histogram:
        return []
    least, plans = dual_bound(histogram, capacity), []
    for long_share, weight_share in PRICINGS:
        plans.append(rounded(fractional(histogram, capacity, long_share, weight_share), histogram, capacity))
        if plans[-1].total() <= least * (1 + GAP):
            break
    best = min([*plans, best_fit(histogram, capacity)], key=lambda p: p.total())
    return sorted(best.items())


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, pieces of the length in a sequence, first sequence, offset of the first such piece)."""
    out: dict[int, list] = defaultdict(list)
    ranks: Counter = Counter()
    first = 0
    for config, times in plan:
        at = 0
        for length, k in sorted(Counter(config).items(), reverse=True):
            out[length].append((ranks[length], k, first, at))
            ranks[length] += k * times
            at += k * length
        first += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and END_ID; a null or empty text is END_ID alone. Only a document longer
    than a sequence is cut. Repeated rows are documents of their own, and so are rows without an id.
    Other columns are left out. No rows give no rows. path: a tokenizer file that executors can read.
    """
    pieces = materialize(token_pieces(docs, path, id_col, text_col, capacity))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    sent = docs.sparkSession.sparkContext.broadcast(slots(configurations(histogram, capacity)))
    parts = max(1, -(-sum(histogram.values()) // RANKED))
    rows = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("c"))
    first = counts.select("length", "part", (F.sum("c").over(Window.partitionBy("length").orderBy("part")) - F.col("c")).alias("first"))
    nth = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = rows.join(first, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + nth - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                mine = np.flatnonzero(length == k)
                table = sent.value[int(k)]
                row = table[np.searchsorted(table[:, 0], rank[mine], "right") - 1]
                nth = rank[mine] - row[:, 0]
                sequence[mine], offset[mine] = row[:, 2] + nth // row[:, 1], row[:, 3] + nth % row[:, 1] * k
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, _PIECES + ", sequence_id long, offset long")
