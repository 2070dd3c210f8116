"""Composite answers: a search with its neighbours and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import excerpt
from ..operators.chunks import around
from ..operators.search import keyword_search


def answer_passages(chunks: DataFrame, queries: DataFrame, limit: int = 6, context: int = 1) -> DataFrame:
    """(query_id, rank, score, chunk_id, citation, excerpt, context_ids): the best chunks for each query, each with the ids of the chunks around it, in order. chunks are read several times, so they should be a written table."""
    hits = keyword_search(chunks, queries, "chunk_id", "text", limit).withColumnRenamed("id", "chunk_id")
    found = hits.join(chunks, "chunk_id").withColumn("excerpt", excerpt(F.col("text"), 700))
    if context == 1:  # a chunk knows those beside it
        ids = F.concat_ws(",", "previous_chunk_id", "chunk_id", "next_chunk_id")
        return found.select("query_id", "rank", "score", "chunk_id", "citation", "excerpt", ids.alias("context_ids"))
    near = around(chunks.select("book_id", "chunk_index", F.col("chunk_id").alias("near_id")), found.select("book_id", "chunk_index").distinct(), context, context)
    ids = near.groupBy("book_id", "hit_index").agg(F.array_join(F.array_sort(F.collect_list("near_id")), ",").alias("context_ids")).withColumnRenamed("hit_index", "chunk_index")
    return found.join(ids, ["book_id", "chunk_index"]).select("query_id", "rank", "score", "chunk_id", "citation", "excerpt", "context_ids")
