"""Near copies by SimHash: pairs that share four fifths of their five-word shingles, found by a self-join of the sketches' binary trie.

A sketch is a SimHash of 192 bits, PIECES pieces of 32. Two sketches meet if some piece differs in at most
PIECE_ERRORS bits, and go on if all bits differ in at most the budget; a text's edits change all pieces alike, so
the work grows little faster than the sketches do, where a budget as wide on one word of bits would meet all pairs.
Each trie has one piece on top, with runs of its bits that must agree first, so that it falls into subtrees for tasks.

It is done twice. First pairs within SURE bits span a forest inside each task, and the forest's own pairs are held
against the exact similarity; what they connect is one component. Then pairs within BUDGET bits are
looked for between different components only. So a large group of edits of one text isn't expanded into its pairs,
and no pair is passed over for another that the exact check then refuses.

Sketches of short texts are coarse, and a text of many edits meets all of a large group that it isn't like. So a
sketch goes along with the parities of its text's shingles, dealt to FOLDS places: where two sets
differ in d shingles, at most d parities do, so a pair whose parities differ in more than its similarity allows
is left where it is found, before it is a row. No pair that is alike enough is lost by that.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, as_bytes, materialize, with_row
from .simhash import components, text_key

#: Words in a shingle of the similarity, its least value, and words in a shingle of the sketch: shorter ones, as an edit spoils fewer of them.
SHINGLE, SIMILARITY, SKETCHED = 5, 0.8, 3
#: Pieces of 32 bits, and bits that a piece may differ in; budgets of all bits. By the pigeonhole principle no pair within SURE bits is without a piece within PIECE_ERRORS.
PIECES, PIECE_ERRORS, SURE, BUDGET = 6, 3, 23, 38
#: Rows of subtrees that a task holds, node pairs expanded at a time, and leaves of two nodes that are compared directly.
SUBTREES, CHUNK, DIRECT = 200_000, 200_000, 64


#: Places of the parities of a text's shingles; they tell sets of up to twice as many shingles apart.
FOLDS = 512
#: Columns of a sketch, and those of the parities and the number of shingles.
SKETCH = [f"s{i}" for i in range(PIECES // 2)]
PARITY = [*(f"f{i}" for i in range(FOLDS // 64)), "size"]


def shingles(words: list[bytes], n: int) -> set[bytes]:
    """The different runs of n words; fewer words are one shingle, none are none."""
    if len(words) < n:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(n)))))


def similarity(a: bytes, b: bytes, shingle: int = SHINGLE) -> float:
    """Jaccard similarity of two texts' shingles; of two without words 1."""
    x, y = (shingles(t.translate(LOWER).split(), shingle) for t in (a, b))
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 1.0


def sketch(words: list[bytes]) -> bytes:
    """PIECES * 32 bits; each is 1 if set in over half of the hashes of the different shingles. No words: 0."""
    each = [xxhash.xxh128_digest(s) + xxhash.xxh64_digest(s) for s in shingles(words, SKETCHED)]
    if not each:
        return bytes(4 * PIECES)
    ones = np.unpackbits(np.frombuffer(b"".join(each), np.uint8).reshape(-1, 4 * PIECES), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(each)).tobytes()


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of the shingles is in each of FOLDS places, as 64-bit words, and how many shingles there are."""
    odd = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % FOLDS, minlength=FOLDS) & 1
    return np.r_[np.packbits(odd.astype(np.uint8)).view(np.int64), len(hashes)]


def may_be_alike(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """False for pairs of rows of parities whose sets differ in more shingles than those of a similarity of least can."""
    m, n = a[:, -1], b[:, -1]
    apart = np.bitwise_count((a[:, :-1] ^ b[:, :-1]).view(np.uint64)).sum(1, dtype=np.int64)
    return np.maximum(apart, np.abs(m - n)) <= (m + n) * (1 - least) / (1 + least) + 1e-6


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """A row per input row: doc_id, text_key, node (64 bits that texts of equal sets of shingles share), s0 and on (the sketch, 64 bits each), f0 and on (parities), size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, both, odd = [], [], []
            for text in as_bytes(batch.column(2)):
                words = text.translate(LOWER).split()
                each = shingles(words, shingle)
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, each), np.uint64, len(each))
                nodes.append(hashes.sum(dtype=np.uint64))
                both.append(sketch(words))
                odd.append(parities(hashes))
            parts = np.c_[np.frombuffer(b"".join(both), ">i8").astype(np.int64).reshape(-1, len(SKETCH)), np.array(odd, np.int64).reshape(-1, len(PARITY))]
            columns = [pa.array(np.array(nodes, np.uint64).view(np.int64)), *map(pa.array, np.ascontiguousarray(parts.T))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "text_key", "node", *SKETCH, *PARITY])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(docs, text_col).alias("text_key"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, node long, " + ", ".join(f"{c} long" for c in SKETCH + PARITY))


def layouts(n: int) -> list[tuple[np.ndarray, int]]:
    """(order of the bits, how many on top agree) for each piece and choice of its agreeing runs. More sketches get more runs on top, so that subtrees stay small."""
    blocks = 4 if n < 1 << 24 else 5 if n < 1 << 28 else 6 if n < 1 << 32 else 8
    edges = [32 * i // blocks for i in range(blocks + 1)]
    out = []
    for piece in range(PIECES):
        for agree in combinations(range(blocks), blocks - PIECE_ERRORS):
            top = [32 * piece + b for i in agree for b in range(edges[i], edges[i + 1])]
            rest = [b for b in range(32 * piece, 32 * piece + 32) if b not in top]
            out.append((np.array([*top, *rest, *(b for b in range(32 * PIECES) if b // 32 != piece)]), len(top)))
    return out


def laid_out(sketch: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Sketches (n rows of 64-bit words) with their bits in another order."""
    bits = np.unpackbits(sketch.astype(">u8").view(np.uint8).reshape(-1, 4 * PIECES), axis=1)
    return np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view(">u8").astype(np.uint64)


class Spanning:
    """Union-find that says which pairs were first to connect their ends."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def labels(self) -> np.ndarray:
        while (self.up != self.up[self.up]).any():
            self.up = self.up[self.up]
        return self.up

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        up, first = self.up, np.zeros(len(a), bool)
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)
                first[k] = True
        return first


def _products(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of leaves below node pairs, i below j where a node meets itself, some at a time."""
    width = bhi - blo
    sizes = (ahi - alo) * width
    for group in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes) // (DIRECT * CHUNK // 8))) + 1):
        n = sizes[group]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        w = np.repeat(width[group], n)
        i, j = np.repeat(alo[group], n) + k // w, np.repeat(blo[group], n) + k % w
        ok = (i < j) | np.repeat(alo[group] != blo[group], n)
        yield i[ok], j[ok]


def trie_pairs(values: np.ndarray, starts: np.ndarray, top: int, label: np.ndarray, budget: int, spanning: bool, parity: np.ndarray | None = None, least: float = SIMILARITY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Joins each subtree with itself. values: n rows of 64-bit words, sorted within the ranges that starts begins, each of which agrees in its top bits.

    Node pairs are traversed together and left once they differ in over PIECE_ERRORS of the first 32
    bits or in over budget of all. Gives places of values within both: with spanning, those that connect what
    wasn't connected yet; else all of different labels. With parity, rows of parities of the same places, pairs that can't be alike are left out, but for equal sketches of a forest.
    """
    n = len(values)
    ends = np.r_[starts[1:], n]
    many = ends - starts > 1
    stack = [(top, starts[many], ends[many], starts[many], ends[many], np.zeros(int(many.sum()), np.int64))]
    ones: dict[int, np.ndarray] = {}
    forest = Spanning(n)
    while stack:
        depth, *nodes = stack.pop()
        if len(nodes[0]) > CHUNK:
            stack.extend((depth, *(x[s : s + CHUNK] for x in nodes)) for s in range(0, len(nodes[0]), CHUNK))
            continue
        # Two nodes whose leaves are all connected already have nothing to add.
        of = forest.labels() if spanning else label
        run = np.cumsum(np.r_[0, of[1:] != of[:-1]])
        alo, ahi, blo, bhi, diff = nodes
        todo = (run[ahi - 1] != run[alo]) | (run[bhi - 1] != run[blo]) | (of[alo] != of[blo])
        small = (ahi - alo) * (bhi - blo) <= DIRECT if depth < 32 * PIECES else np.ones(len(alo), bool)
        if spanning and depth == 32 * PIECES:  # equal sketches: a chain of them is enough
            own = alo == blo
            i = np.concatenate([*map(np.arange, alo[own], ahi[own] - 1), alo[~own]])
            j = np.concatenate([*map(np.arange, alo[own] + 1, ahi[own]), blo[~own]])
            first = forest.join(i, j)
            yield i[first], j[first]
            continue
        pick = todo & small
        for i, j in _products(*(x[pick] for x in (alo, ahi, blo, bhi))) if pick.any() else ():
            x = values[i] ^ values[j]
            near = (np.bitwise_count(x[:, 0] >> np.uint64(32)) <= PIECE_ERRORS) & (np.bitwise_count(x).sum(1) <= budget)
            near &= label[i] != label[j]
            i, j = i[near], j[near]
            if parity is not None:
                near = may_be_alike(parity[i], parity[j], least)
                i, j = i[near], j[near]
            if spanning:
                first = forest.join(i, j)
                i, j = i[first], j[first]
            yield i, j
        alo, ahi, blo, bhi, diff = (x[todo & ~small] for x in nodes)
        if not len(alo):
            continue
        if depth not in ones:
            ones[depth] = np.r_[0, np.cumsum((values[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1))].astype(np.int32)
        c = ones[depth]
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        other = ~((alo == blo) & (ahi == bhi))
        most = PIECE_ERRORS if depth < 32 else budget
        parts = []
        for k0, k1, k2, k3, d, only in ((alo, amid, bmid, bhi, diff + 1, None), (amid, ahi, blo, bmid, diff + 1, other), (alo, amid, blo, bmid, diff, None), (amid, ahi, bmid, bhi, diff, None)):
            ok = (k0 < k1) & (k2 < k3) & (d <= most) & ~((k0 == k2) & (k1 - k0 == 1))
            ok = ok if only is None else ok & only
            parts.append([x[ok] for x in (k0, k1, k2, k3, d)])
        # Pairs that differ come first on the stack, so nodes are joined with themselves before with others.
        for group in (parts[:2], parts[2:]):
            if sum(len(p[0]) for p in group):
                stack.append((depth + 1, *(np.concatenate(x) for x in zip(*group))))


def candidates(nodes: DataFrame, n: int, budget: int, spanning: bool, least: float = SIMILARITY) -> DataFrame:
    """Distinct pairs (u, v), u > v, of nodes (node, label, its sketch and parities) within budget bits that may be alike. n: about how many nodes there are."""
    plan = layouts(n)
    own = [*SKETCH, *PARITY, "node", "label"]
    names, last = ["t", "key", *own], 2 + len(SKETCH)

    def top_bits(halves: np.ndarray, t: int) -> np.ndarray:
        order, top = plan[t]
        return (laid_out(halves, order)[:, 0] >> np.uint64(64 - top)).astype(np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = np.stack([batch.column(i).to_numpy() for i in range(len(SKETCH))], 1).view(np.uint64)
            for t in range(len(plan)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(halves), t, np.int32)), pa.array(top_bits(halves, t)), *batch.columns], names)

    def joined(t: int, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, top = plan[t]
        values = laid_out(np.ascontiguousarray(rows[:, 2:last]).view(np.uint64), order)
        at = np.lexsort(values.T[::-1])
        values, ids, parity = values[at], rows[at, -2], rows[at, last:-2]
        label = np.unique(rows[at, -1], return_inverse=True)[1]
        key = values[:, 0] >> np.uint64(64 - top)
        for i, j in trie_pairs(values, np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), top, label, budget, spanning, parity, least):
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(ids[i], ids[j])), pa.array(np.minimum(ids[i], ids[j]))], ["u", "v"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by table and key. Whole subtrees are joined as soon as SUBTREES rows are there; the last, which may go on, waits."""
        held, n = [], 0

        def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for part in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1):
                yield from joined(int(part[0, 0]), part)

        for b in batches:
            held.append(np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(len(names))], 1))
            n += b.num_rows
            if n > SUBTREES:
                rows = np.concatenate(held)
                cut = int(np.flatnonzero((rows[:, :2] == rows[-1, :2]).all(1))[0])
                if cut:
                    yield from flush(rows[:cut])
                held, n = [rows[cut:]], len(rows) - cut
        if n:
            yield from flush(np.concatenate(held))

    rows = nodes.select(*own).mapInArrow(spread, "t int, " + ", ".join(f"{c} long" for c in names[1:]))
    return rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(join, "u long, v long").distinct()


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, shingle: int, least: float) -> DataFrame:
    """The pairs whose texts' exact similarity is least or more. Only texts of pairs are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [similarity(x, y, shingle) >= least for x, y in zip(as_bytes(b.column(2)), as_bytes(b.column(3)))]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["u", "v"]).filter(pa.array(near, pa.bool_()))

    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes.select("node", "text_key"), "node")
    texts = docs.select(text_key(docs, text_col).alias("text_key"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    texts = materialize(texts.join(wanted, "text_key").groupBy("node").agg(F.min("text").alias("text")))
    a, b = texts.toDF("u", "a"), texts.toDF("v", "b")
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, text_key, component_id, the smallest id that is reachable by links.

    Texts are linked if they share `least` of their lower-cased word shingles or more (exact Jaccard similarity of the sets) and
    their sketches meet. Texts of one set of shingles are one node; nodes are told by 64 bits. Texts without words, null ones too, are one node.
    Ids that are null take part in no component's smallest id; component_id is null where there is no other.
    """
    rows = materialize(sketches(docs, id_col, text_col, shingle))
    nodes = materialize(rows.groupBy("node").agg(*(F.min(c).alias(c) for c in ("text_key", *SKETCH, *PARITY))))
    n = nodes.count()

    def links(labelled: DataFrame, budget: int, spanning: bool) -> DataFrame:
        return materialize(verified(materialize(candidates(labelled, n, budget, spanning, least)), nodes, docs, text_col, shingle, least))

    sure = links(nodes.withColumn("label", F.col("node")), SURE, True)
    labelled = nodes.join(components(sure).toDF("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    found = components(sure.unionByName(links(labelled, BUDGET, False))).toDF("node", "part")
    parts = materialize(rows.join(found, "node", "left").select("doc_id", "text_key", F.coalesce("part", "node").alias("part")))
    return parts.join(parts.groupBy("part").agg(F.min("doc_id").alias("component_id")), "part").select("doc_id", "text_key", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs whose id is their component's, with docs' own columns, whatever their names: one document of each group stays. Of a group's rows that repeat its id one stays; rows without an id can't stand for a group and stay."""
    kept = near_copies(docs, id_col, text_col, shingle, least).where("doc_id = component_id").groupBy("doc_id").agg(F.min("text_key").alias("text_key"))
    own = with_row(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text_key=text_key(docs, text_col))
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy(F.lit(0)))
    chosen = own.join(kept, ["doc_id", "text_key"]).withColumn("nth", nth).where("nth = 1")
    return chosen.select("row.*").unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
