"""Keyword, vector and hybrid search of a table of queries over a table of rows, and evaluation of what they find."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .counted import small, stands_alone, with_said

K1, B, FUSION = 1.2, 0.75, 60
#: Vectors in a block of queries and of rows; scores of a pair of blocks are one small matrix.
BLOCK = 2048
#: Products of a pair of blocks that are made at a time.
SCORES = 1 << 18
#: A term of a text in lower case.
WORD = re.compile("[a-z0-9]+")
#: Rows of a query set or of names that are broadcast; more are joined by shuffle.
SMALL = 10_000


def terms(x: Column) -> Column:
    """Lower-case words of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def n_terms(x: Column) -> Column:
    return F.regexp_count(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+"))


def postings(rows: DataFrame, id_col: str, text_col: str, wanted: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, dl): how often a row has a term, and how many terms it has; of the terms of `wanted` (term) alone, if given, the others leaving before anything is counted or shuffled."""
    t = rows.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("t")).withColumn("dl", F.size("t"))
    found = t.select("id", "dl", F.explode("t").alias("term"))
    found = found if wanted is None else found.join(wanted, "term", "left_semi")
    return found.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def counted_terms(rows: DataFrame, id_col: str, text_col: str, wanted: list[str]) -> DataFrame:
    """(id, dl, said array<struct<term, tf>>), a row for each of rows: how many terms it has, and how often those wanted. They are counted in the row, so no term is a row of its own."""
    keep = frozenset(wanted)

    def say(low: str) -> dict:
        found = WORD.findall(low)
        return {"dl": len(found), "said": [{"term": t, "tf": n} for t, n in Counter(filter(keep.__contains__, found)).items()]}

    low = rows.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    return with_said(low, ["low"], say, "found", "struct<dl:int,said:array<struct<term:string,tf:bigint>>>").select("id", "found.dl", "found.said")


def keyword_search(rows: DataFrame, queries: DataFrame, id_col: str, text_col: str, limit: int = 10) -> DataFrame:
    """(query_id, id, score, rank) by BM25 for queries (query_id, text). Only terms that a query has are counted, where their row is, and texts are split once; ties go to the lesser id."""
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    few = [r.term for r in asked.select("term").distinct().limit(SMALL + 1).collect()]
    if len(few) <= SMALL:
        counted = materialize(counted_terms(rows, id_col, text_col, few))
        size = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
        wanted = counted.select("id", "dl", F.inline("said"))
        if not stands_alone(counted.select("id")):
            wanted = wanted.groupBy("id", "dl", "term").agg(F.sum("tf").alias("tf"))
    else:
        wanted = materialize(postings(rows, id_col, text_col, asked.select("term").distinct()))
        size = rows.agg(F.count("*").alias("n"), F.avg(n_terms(F.col(text_col))).alias("mean"))
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(size)).select("term", "mean", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    scored = wanted.join(F.broadcast(idf) if len(few) <= SMALL else idf, "term").select("id", "term", weight.alias("w"))
    hits = scored.join(broadcast_if_small(asked), "term").groupBy("query_id", "id").agg(F.round(F.sum("w"), 6).alias("score"))
    return top(hits, limit)


def broadcast_if_small(rows: DataFrame, most: int = SMALL) -> DataFrame:
    """rows, marked for broadcast if a count proves that there are at most so many; joined by shuffle otherwise. None are left out."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def top(hits: DataFrame, limit: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit)


def _blocks(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out(ids, vecs):
            return pa.RecordBatch.from_arrays([pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([vecs.astype("<f8").tobytes()], pa.binary())], ["ids", "vecs"])

        for b in small(batches):
            size = pc.fill_null(pc.list_value_length(b.column(1)), 0)
            b = b.filter(pc.and_(pc.is_valid(b.column(0)), pc.greater(size, 0)))
            if not b.num_rows:
                continue
            size = pc.list_value_length(b.column(1)).to_numpy()
            if (size != size[0]).any():
                raise ValueError("vectors of several lengths")
            held.append((b.column(0).to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(size), -1)))
            n += len(size)
            if n >= BLOCK:
                ids, vecs = (np.concatenate(x) for x in zip(*held))
                whole = n - n % BLOCK
                for i in range(0, whole, BLOCK):
                    yield out(ids[i : i + BLOCK], vecs[i : i + BLOCK])
                held, n = [(ids[whole:].copy(), vecs[whole:].copy())], n - whole
        if n:
            yield out(*(np.concatenate(x) for x in zip(*held)))

    return rows.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>")).mapInArrow(run, "ids binary, vecs binary")


def vector_search(rows: DataFrame, queries: DataFrame, id_col: str, vec_col: str, limit: int = 10) -> DataFrame:
    """(query_id, id, score, rank) by dot product for queries (query_id, vec): all rows, in blocks of queries and rows. A NaN counts as 0; ties go to the lesser id."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A batch has many pairs; one of them, and some of its queries, are looked at at a time.
        for b in batches:
            for i in range(b.num_rows):
                qi, qv, ri, rv = (np.frombuffer(c[i].as_buffer(), kind) for c, kind in zip(b.columns, ("<i8", "<f8", "<i8", "<f8")))
                qs, rows = qv.reshape(len(qi), -1), rv.reshape(len(ri), -1).T
                k, step = min(limit, len(ri)), max(1, SCORES // len(ri))
                for at in range(0, len(qi), step):
                    q, s = qi[at : at + step], np.round(np.nan_to_num(qs[at : at + step] @ rows), 6)
                    order = np.lexsort((np.broadcast_to(ri, s.shape), -s))[:, :k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, k)), pa.array(ri[order].ravel()), pa.array(np.take_along_axis(s, order, 1).ravel())], ["query_id", "id", "score"])

    asked = _blocks(queries, "query_id", "vec").select(F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    pairs = asked.crossJoin(_blocks(rows, id_col, vec_col)).select("q_ids", "q_vecs", "ids", "vecs")
    return top(pairs.mapInArrow(score, "query_id long, id long, score double"), limit)


def fused(*found: DataFrame, limit: int = 10, k: int = FUSION) -> DataFrame:
    """Ranked lists as one, by the sum of 1 / (k + rank)."""
    rows = found[0].select("query_id", "id", "rank")
    for f in found[1:]:
        rows = rows.unionByName(f.select("query_id", "id", "rank"))
    return top(rows.groupBy("query_id", "id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 6).alias("score")), limit)


def staged(stages: list[DataFrame], limit: int) -> DataFrame:
    """Fills each query's list from the first stage, then the next; an id comes once."""
    rows = None
    for i, s in enumerate(stages):
        part = s.select("query_id", "id", F.lit(i).alias("stage"), F.col("rank").alias("stage_rank"))
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy("query_id", "id").agg(F.min(F.struct("stage", "stage_rank")).alias("at")).select("query_id", "id", "at.stage", "at.stage_rank")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("stage", "stage_rank", "id"))
    return first.withColumn("rank", rank).where(F.col("rank") <= limit)


def evaluated(found: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, reciprocal_rank): found (query_id, item, rank) against expected (query_id, item), of which each may be hit often."""
    want = expected.distinct()
    hit = found.join(want, ["query_id", "item"], "left_semi")
    got = hit.groupBy("query_id").agg(F.countDistinct(F.when(F.col("rank") <= k, F.col("item"))).alias("n"), F.min("rank").alias("first"))
    total = want.groupBy("query_id").agg(F.count("*").alias("total"))
    return total.join(got, "query_id", "left").select("query_id", F.round(F.coalesce("n", F.lit(0)) / F.col("total"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"))


def allowed(book: str | None = None, codes: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> Column:
    """The search predicate: a title or book_id, a primary class, or a code within the piped secondary classes."""
    out = F.lit(True)
    if book is not None:
        out = (F.col("title") == book) | (F.col("book_id").cast("string") == book)
    wanted = tuple(dict.fromkeys((*codes, *also)))
    if wanted:
        fits = F.col("primary_class").isin(*wanted)
        for c in wanted:
            fits = fits | F.contains(F.coalesce("secondary_class_text", F.lit("")), F.lit(c))
        out = out & fits
    return out
