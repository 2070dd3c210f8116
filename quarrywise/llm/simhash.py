"""SimHash near-dedup: fingerprints of word shingles, linked by a self-join of their binary trie.

Documents of one fingerprint are folded first, so what is joined is distinct fingerprints: copies
of a text, however many, are one leaf, and edits of one text reach only the few fingerprints
around it. Two fingerprints that differ in at most ERRORS bits agree on some of BLOCKS runs of bits, so
the trie is built once with each choice of agreeing runs on top. A node below the top is a subtree
that a task joins with itself; node pairs are traversed together, their differing bits add up, and
a pair over the budget is left. A task hands on a spanning forest of what it linked, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, as_bytes, materialize, with_row

#: Words in a shingle, seed of XXH64, and bits that linked fingerprints may differ in.
SHINGLE, SEED, ERRORS = 3, 42, 3
#: Node pairs that are expanded at a time, and rows of subtrees that a task holds before it joins those that are whole.
CHUNK, SUBTREES = 200_000, 500_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits; each is 1 if set in over half of the shingles' hashes. No words: 0."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    ones = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def text_key(docs: DataFrame, text_col: str) -> Column:
    """Tells apart the texts of rows that repeat an id."""
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, text_key, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(docs, text_col).alias("text_key"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def layouts(n: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Orders of the 64 bits, as runs (lowest bit, width), with the bits of the agreeing ones on top.

    More and shorter runs with more of them agreeing make lower, and so more and smaller, subtrees,
    for more copies of the trie; the top follows the number of fingerprints, so that a subtree stays small.
    """
    blocks = 4 if n < 1 << 24 else 5 if n < 1 << 34 else 6
    edges = [64 * i // blocks for i in range(blocks + 1)]
    runs = [(a, b - a) for a, b in zip(edges, edges[1:])]
    out = []
    for agree in combinations(range(blocks), blocks - ERRORS):
        order = [*agree, *(i for i in range(blocks) if i not in agree)]
        out.append(([runs[i] for i in order], sum(runs[i][1] for i in agree)))
    return out


def _laid_out(fps: np.ndarray, runs: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for low, width in runs:
        out = (out << np.uint64(width)) | ((fps >> np.uint64(low)) & np.uint64((1 << width) - 1))
    return out


class Forest:
    """Union-find with the least member as root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def labels(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        up = self.up
        for x, y in zip(a.tolist(), b.tolist()):
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)


def trie_components(values: np.ndarray, starts: np.ndarray, top: int, errors: int = ERRORS) -> np.ndarray:
    """Joins each subtree with itself. values: sorted within the ranges that starts begins; a range agrees in its top bits.

    A node at depth d is a range of values that agree in d bits. Returns for each value the place of
    the least one linked with it here.
    """
    n = len(values)
    forest = Forest(n)
    ends = np.r_[starts[1:], n]
    many = ends - starts > 1
    stack = [(top, starts[many], ends[many], starts[many], ends[many], np.zeros(many.sum(), np.int64))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, alo, ahi, blo, bhi, diff = stack.pop()
        if len(alo) > CHUNK:
            for s in range(0, len(alo), CHUNK):
                stack.append((depth, *(x[s : s + CHUNK] for x in (alo, ahi, blo, bhi, diff))))
            continue
        # Two nodes whose leaves are all linked already have nothing to add.
        label = forest.labels()
        run = np.cumsum(np.r_[0, label[1:] != label[:-1]])
        todo = (run[ahi - 1] != run[alo]) | (run[bhi - 1] != run[blo]) | (label[alo] != label[blo])
        alo, ahi, blo, bhi, diff = (x[todo] for x in (alo, ahi, blo, bhi, diff))
        leaves = (ahi - alo == 1) & (bhi - blo == 1)
        a, b = alo[leaves], blo[leaves]
        near = np.bitwise_count(values[a] ^ values[b]) <= errors
        forest.join(a[near], b[near])
        alo, ahi, blo, bhi, diff = (x[~leaves] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo) or depth == 64:
            continue
        if depth not in ones:
            ones[depth] = np.r_[0, np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1))].astype(np.int64)
        c = ones[depth]
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        same = (alo == blo) & (ahi == bhi)
        kids = [(alo, amid, blo, bmid, diff, None), (amid, ahi, bmid, bhi, diff, None), (alo, amid, bmid, bhi, diff + 1, None), (amid, ahi, blo, bmid, diff + 1, ~same)]
        parts = []
        for k0, k1, k2, k3, d, only in kids:
            ok = (k0 < k1) & (k2 < k3) & (d <= errors) & ~((k0 == k2) & (k1 - k0 == 1))
            ok = ok if only is None else ok & only
            parts.append([x[ok] for x in (k0, k1, k2, k3, d)])
        # Pairs that differ come first on the stack, so nodes are joined with themselves before with others.
        for group in (parts[2:], parts[:2]):
            if sum(len(p[0]) for p in group):
                stack.append((depth + 1, *(np.concatenate(x) for x in zip(*group))))
    return forest.labels()


def links(nodes: DataFrame, n: int) -> DataFrame:
    """Edges (u, v), u > v, that span the components of nodes (fp, id) under the link of fingerprints. n: about how many nodes there are."""
    plan = layouts(n)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for t, (runs, top) in enumerate(plan):
                key = _laid_out(fps, runs) >> np.uint64(64 - top)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), t, np.int32)), pa.array(key.view(np.int64)), batch.column(0), batch.column(1)], ["t", "key", "fp", "id"])

    def joined(t: int, fps: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        runs, top = plan[t]
        values = _laid_out(fps.view(np.uint64), runs)
        order = np.argsort(values)
        values, own = values[order], ids[order]
        keys = values >> np.uint64(64 - top)
        roots = trie_components(values, np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), top)
        linked = np.flatnonzero(roots != np.arange(len(roots)))
        a, b = own[linked], own[roots[linked]]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["u", "v"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by table and key. Whole subtrees are joined as soon as SUBTREES rows of one table are there; only the last, which may go on, waits."""
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray, last: bool) -> tuple[list[pa.RecordBatch], np.ndarray]:
            out = []
            while len(rows):
                same = int((rows[:, 0] == rows[0, 0]).sum())
                mine = rows[:same]
                if same == len(rows) and not last:
                    cut = int(np.flatnonzero(mine[:, 1] == mine[-1, 1])[0])
                    if cut:
                        out.append(joined(int(mine[0, 0]), mine[:cut, 2].copy(), mine[:cut, 3].copy()))
                    return out, rows[cut:]
                out.append(joined(int(mine[0, 0]), mine[:, 2].copy(), mine[:, 3].copy()))
                rows = rows[same:]
            return out, rows

        n = 0
        for b in batches:
            held.append(np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(4)], 1))
            n += b.num_rows
            if n > SUBTREES:
                out, rest = flush(np.concatenate(held), False)
                yield from out
                held, n = [rest], len(rest)
        if n:
            yield from flush(np.concatenate(held), True)[0]

    spread_rows = nodes.select("fp", "id").mapInArrow(spread, "t int, key long, fp long, id long")
    return spread_rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(join, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each end of an edge the least id it is connected with. Alternating large-star and small-star steps, each a shuffle over edges, until none changes."""
    edges = materialize(edges.where("u > v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        after = materialize(small)
        # Done when every node hangs on a root: no node is both above and below another.
        deep = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        edges = after
        if not deep and not after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _placed(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, text_key, fp, component_id), a row per input row."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle))
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("id")))
    found = components(links(nodes.where("id IS NOT NULL"), nodes.count()))
    return fps.join(nodes.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id")), "fp")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Two documents are linked if their fingerprints differ in at most ERRORS bits; component_id is the
    smallest id reachable by links. Null, empty and wordless texts have fingerprint zero and are linked
    like any other; a text of fewer words than a shingle is one shingle. Ids that are null take part
    in no component but get that of their fingerprint. Other columns are left out.
    """
    return _placed(docs, id_col, text_col, shingle).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs whose id is their component's, with docs' own columns, whatever their names: one document of each group stays. Of a group's rows that repeat its id one stays; rows without an id can't stand for a group and stay."""
    kept = _placed(docs, id_col, text_col, shingle).where("doc_id = component_id").groupBy("doc_id").agg(F.min("text_key").alias("text_key"))
    own = with_row(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text_key=text_key(docs, text_col))
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy(F.lit(0)))
    chosen = own.join(kept, ["doc_id", "text_key"]).withColumn("nth", nth).where("nth = 1")
    return chosen.select("row.*").unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
