"""Exact vector search over cells: an inverted file whose bounds lose nothing.

Vectors lie in the cell of their nearest centre, in blocks from the centre outwards. A vector x of a
cell with centre c at a distance of r at most has q.x <= q.c + |q| r, so once a query has as many scores as it
wants, cells and blocks whose bound is below the worst of them are left out, and the result is that of a search of everything.
Centres are fitted on a bounded sample; every vector is in a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .filters import Selected, bucket, has_bit
from .search import top

#: Vectors in a block, of the index and of queries; vectors that centres are fitted on, centres at most, and rounds of fitting.
BLOCK, SAMPLE, CELLS, ROUNDS = 1024, 20_000, 4096, 8

_INDEX = "cell int, block long, n int, radius double, ids array<bigint>, vecs binary"


class Cells(NamedTuple):
    """An index: its path, centres, and each cell's radius and number of vectors. The last cell has no centre: vectors that aren't finite are there, and always read."""

    path: str
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray


def fitted(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by k-means: of the sample's vectors spread over it, moved to the mean of their nearest."""
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        at = nearest(sample, centres)[0]
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each vector's nearest centre, its distance)."""
    if not len(x) or not len(centres):
        return np.zeros(len(x), int), np.zeros(len(x))
    at = np.concatenate([(np.sum(centres**2, 1) - 2 * (x[i : i + 4096] @ centres.T)).argmin(1) for i in range(0, len(x), 4096)])
    return at, np.linalg.norm(x - centres[at], axis=1)


def write_cells(rows: DataFrame, id_col: str, vec_col: str, path: str, cells: int | None = None, block: int = BLOCK) -> Cells:
    """Writes the index of rows with an id and a vector; null and empty vectors are left out. cells: as many as the root of the rows, if not given."""
    spark = rows.sparkSession
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id IS NOT NULL AND size(vec) > 0")
    n = own.count()
    finite = own.where(~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    sample = [r.vec for r in finite.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    centres = fitted(np.array(sample, float), cells or max(1, min(CELLS, int(n**0.5)))) if sample else np.empty((0, 0))
    odd = len(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = np.array([[np.nan if x is None else x for x in v] for v in b.column(1).to_pylist()], float)
            if not len(vecs):
                continue
            whole = np.isfinite(vecs).all(1)
            cell, far = np.full(len(vecs), odd), np.full(len(vecs), np.inf)
            if odd:
                cell[whole], far[whole] = nearest(vecs[whole], centres)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(far)], ["id", "vec", "cell", "far"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vecs, radius, name = None, [], [], 0.0, TaskContext.get().partitionId() << 33

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([name], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([radius], pa.float64()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.array(vecs, "<f8").tobytes()], pa.binary())],
                ["cell", "block", "n", "radius", "ids", "vecs"],
            )

        for b in batches:
            for i, v, cell, far in zip(*(c.to_pylist() for c in b.columns)):
                if ids and (cell != now or len(ids) == block):
                    yield out()
                    ids, vecs, radius, name = [], [], 0.0, name + 1
                now, radius = cell, max(radius, far)
                ids.append(i)
                vecs.append([np.nan if x is None else x for x in v])
        if ids:
            yield out()

    parts = max(1, min(-(-n // block), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # Ranges of distance, so that a cell with a third of all vectors is in as many tasks as it needs.
    dealt = own.mapInArrow(assign, "id long, vec array<double>, cell int, far double").repartitionByRange(parts, "cell", "far", "id").sortWithinPartitions("cell", "far", "id")
    dealt.mapInArrow(pack, _INDEX).write.parquet(path)
    radii, sizes = np.zeros(odd + 1), np.zeros(odd + 1, int)
    for r in spark.read.schema(_INDEX).parquet(path).groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect():  # one row for each cell
        radii[r.cell], sizes[r.cell] = r.radius, r.n
    return Cells(path, centres, radii, sizes)


def _bounds(q: np.ndarray, index: Cells) -> np.ndarray:
    """The most that each query can score in each cell; endless where a query isn't finite or a cell has no centre."""
    out = np.full((len(q), len(index.sizes)), np.inf)
    if len(index.centres):
        whole = np.isfinite(q).all(1)
        out[whole, :-1] = q[whole] @ index.centres.T + np.linalg.norm(q[whole], axis=1)[:, None] * index.radii[:-1]
    out[:, index.sizes == 0] = -np.inf
    return out


class CellSearch:
    """A search of queries (query_id, vec) in two steps. within: the rows that queries may find."""

    def __init__(self, spark: SparkSession, index: Cells, queries: DataFrame, limit: int, within: Selected | None = None):
        self.spark, self.index, self.limit, self.within = spark, index, limit, within
        rows = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec")).where("query_id IS NOT NULL AND size(vec) > 0")
        self.queries = rows.withColumn("filter", F.lit(None).cast("long")) if within is None else rows.join(within.queries, "query_id", "left")
        self.blocks = spark.read.schema(_INDEX).parquet(index.path)

    def _asked(self, floors: DataFrame | None) -> DataFrame:
        """(cell, filter, q_ids, q_vecs, q_floors): for each cell the queries that it is read for: at first those of whose likeliest it is, then those whose floor its bound reaches."""
        index, limit, second = self.index, self.limit, floors is not None
        rows = self.queries.join(floors, "query_id", "left") if second else self.queries.withColumn("floor", F.lit(None).cast("double"))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = np.array([[np.nan if x is None else x for x in v] for v in b.column(1).to_pylist()], float)
                if not len(q):
                    continue
                ids, kinds = np.array(b.column(0).to_pylist(), np.int64), np.array([0 if x is None else x for x in b.column(2).to_pylist()], np.int64)
                floor = np.array([-np.inf if x is None else x for x in b.column(3).to_pylist()], float)
                bound = _bounds(q, index)
                likely = np.zeros(bound.shape, bool)
                order = np.argsort(-bound, 1, kind="stable")
                # As many cells as have enough vectors between them.
                np.put_along_axis(likely, order, np.cumsum(index.sizes[order], 1) - index.sizes[order] < limit, 1)
                wanted = ~likely & _reaches(bound, floor[:, None]) if second else likely
                wanted &= bound > -np.inf
                for cell in np.flatnonzero(wanted.any(0)).tolist():
                    for kind in np.unique(kinds[wanted[:, cell]]).tolist():
                        mine = np.flatnonzero(wanted[:, cell] & (kinds == kind))
                        for m in (mine[i : i + BLOCK] for i in range(0, len(mine), BLOCK)):
                            sent = (ids[m].astype("<i8"), q[m].astype("<f8"), floor[m].astype("<f8"))
                            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([kind or None], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in sent)], ["cell", "filter", "q_ids", "q_vecs", "q_floors"])

        return rows.select("query_id", "vec", "filter", "floor").mapInArrow(deal, "cell int, filter long, q_ids binary, q_vecs binary, q_floors binary")

    def _masks(self) -> DataFrame:
        """(filter, block, open): the places of each block's vectors that a filter lets through."""
        each = self.blocks.select("block", F.posexplode("ids").alias("at", "id")).withColumn("bucket", bucket(F.col("id")))
        met = each.join(self.within.bits, "bucket").where(has_bit(F.col("bits"), F.col("id")))
        return met.groupBy("filter", "block").agg(F.array_sort(F.collect_list("at")).alias("open"))

    def _scored(self, asked: DataFrame) -> DataFrame:
        """(query_id, id, score, pairs): the best `limit` of each block for each of its queries; pairs, on one row of a block, counts the products made."""
        limit, index = self.limit, self.index
        pairs = self.blocks.join(asked, "cell")
        if self.within is not None:
            pairs = pairs.join(self._masks(), ["filter", "block"], "left").where("filter IS NULL OR open IS NOT NULL")
        pairs = pairs.select("cell", "radius", "ids", "vecs", "q_ids", "q_vecs", "q_floors", F.col("open") if self.within is not None else F.lit(None).cast("array<int>").alias("open"))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in (r for b in batches for r in b.to_pylist()):
                q_ids, ids = np.frombuffer(row["q_ids"], "<i8"), np.array(row["ids"], np.int64)
                q, v = np.frombuffer(row["q_vecs"], "<f8").reshape(len(q_ids), -1), np.frombuffer(row["vecs"], "<f8").reshape(len(ids), -1)
                if row["cell"] < len(index.centres):
                    best = np.where(np.isfinite(q).all(1), q @ index.centres[row["cell"]] + np.linalg.norm(q, axis=1) * row["radius"], np.inf)
                    near = _reaches(best, np.frombuffer(row["q_floors"], "<f8"))
                    q_ids, q = q_ids[near], q[near]
                if row["open"] is not None:
                    ids, v = ids[row["open"]], v[row["open"]]
                if not len(q_ids):
                    continue
                with np.errstate(invalid="ignore", over="ignore"):
                    s = np.round(np.nan_to_num(q @ v.T), 6)
                k = min(limit, len(ids))
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s))[:, :k]
                made = np.zeros(len(q_ids) * k, np.int64)
                made[0] = s.size
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, k)), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(s, order, 1).ravel()), pa.array(made)], ["query_id", "id", "score", "pairs"])

        return pairs.mapInArrow(score, "query_id long, id long, score double, pairs long")

    def scored(self) -> DataFrame:
        """Both steps' scores."""
        first = materialize(self._scored(self._asked(None)))
        floors = top(first.select("query_id", "id", "score"), self.limit).where(F.col("rank") == self.limit).select("query_id", F.col("score").alias("floor"))
        return first.unionByName(self._scored(self._asked(materialize(floors))))

    def run(self) -> DataFrame:
        """(query_id, id, score, rank)."""
        return top(self.scored().select("query_id", "id", "score"), self.limit)

    def share_skipped(self) -> float:
        """Of all pairs of a query and a vector the share that was never scored."""
        every = self.queries.count() * int(self.index.sizes.sum())
        return 1 - (self.scored().agg(F.sum("pairs")).first()[0] or 0) / every if every else 0.0


def _reaches(bound: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Whether a bound may stand for a score of floor or more: scores are rounded to six places, bounds to the machine's."""
    room = 1e-6 + 1e-9 * np.abs(np.where(np.isfinite(bound), bound, 0))
    return ~np.isfinite(bound) | (bound + room >= floor)


def cell_search(spark: SparkSession, index: Cells, queries: DataFrame, limit: int = 10, within: Selected | None = None) -> DataFrame:
    """(query_id, id, score, rank) by dot product: the rows of search.vector_search, among those within. A NaN counts as 0; ties go to the lesser id."""
    return CellSearch(spark, index, queries, limit, within).run()
