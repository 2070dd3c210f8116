"""Answer packs and searches that route, fall back and bring their evidence along."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import excerpt, text
from ..operators.knowledge import first_seen
from ..operators.search import keyword_search, staged
from ..operators.taxonomy import route_queries


def routed_search(chunks: DataFrame, queries: DataFrame, classes: DataFrame, aliases: DataFrame, limit: int = 6, routed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, stage, stage_rank, rank): chunks (chunk_id, text, primary_class) of the first class of a query's route, then of the second and third, then of any, until there are `limit`; a chunk comes once.

    All matches are found by one search; the stages only choose among them.
    """
    route = routed if routed is not None else route_queries(queries, classes, aliases)
    hits = keyword_search(chunks, queries, "chunk_id", "text", 2**31 - 1).join(chunks.select(F.col("chunk_id").alias("id"), "primary_class"), "id")
    wanted = route.select("query_id", F.posexplode(F.slice("class_codes", 1, 3)).alias("at", "primary_class"))
    placed = hits.join(wanted, ["query_id", "primary_class"], "left")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= limit).select("query_id", "id", "rank")
    return staged([*(ranked(placed.where(F.col("at") == i)) for i in range(3)), ranked(hits)], limit)


def answer_packs(chunks: DataFrame, queries: DataFrame, classes: DataFrame, aliases: DataFrame, summaries: DataFrame | None = None, related: DataFrame | None = None, limit: int = 6) -> DataFrame:
    """One row per query: route, passages, context ids, books, themes, citations, and summaries and related books if tables of them are given.

    chunks: a written table with chunk_id, previous_chunk_id, next_chunk_id, book_id, title, author, primary_class, citation, headings and
    text. summaries (book_id, text) are searched by keyword; related (book_id, other_id, score) are edges of the book graph.
    """
    route = route_queries(queries, classes, aliases)
    found = routed_search(chunks, queries, classes, aliases, limit, route).select("query_id", F.col("id").alias("chunk_id"), "rank")
    rows = found.join(chunks, "chunk_id").withColumn("excerpt", excerpt(F.col("text"), 700))
    by_rank = lambda value, name: F.transform(F.array_sort(F.collect_list(F.struct("rank", value.alias("v")))), lambda x: x["v"]).alias(name)
    near = F.array_compact(F.array("previous_chunk_id", "chunk_id", "next_chunk_id"))
    passages = rows.groupBy("query_id").agg(by_rank(F.struct("chunk_id", "book_id", "title", "author", "citation", "excerpt"), "passages"), by_rank(near, "context_ids"))
    # Citations of passages come first, then those of the chunks around them.
    around = rows.select("query_id", (F.col("rank") + limit).alias("rank"), F.explode(near).alias("chunk_id")).join(chunks.select("chunk_id", "citation"), "chunk_id")
    cited = listed(first_seen(rows.select("query_id", "rank", "citation").unionByName(around.select("query_id", "rank", "citation")), "citation"), "citation", "citations")
    said = rows.select("query_id", "rank", F.posexplode(F.array("section_title", "chapter_title", "heading_path")).alias("at", "theme")).withColumn("rank", F.col("rank") * 10 + F.col("at"))
    out = route.join(passages, "query_id", "left").join(cited, "query_id", "left")
    out = out.join(listed(first_seen(rows.withColumn("b", F.col("book_id").cast("string")), "b"), "b", "books"), "query_id", "left").join(listed(first_seen(said, "theme").where("place <= 12"), "theme", "themes"), "query_id", "left")
    if summaries is not None:
        s = keyword_search(summaries, queries, "book_id", "text", limit)
        out = out.join(s.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("v")))), lambda x: x["v"]).alias("summary_books")), "query_id", "left")
    if related is not None:
        seeds = rows.select("query_id", "book_id").distinct()
        both = related.select("book_id", "other_id", "score").unionByName(related.select(F.col("other_id").alias("book_id"), F.col("book_id").alias("other_id"), "score"))
        near_books = seeds.join(both, "book_id").join(seeds.select("query_id", F.col("book_id").alias("other_id")), ["query_id", "other_id"], "left_anti").groupBy("query_id", "other_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "other_id"))
        top = near_books.withColumn("place", rank).where(F.col("place") <= limit).select("query_id", F.col("other_id").cast("string").alias("other_id"), "place")
        out = out.join(listed(top, "other_id", "related_books"), "query_id", "left")
    return out


def listed(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Values of each query by place, as an array."""
    return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", value))), lambda x: x[value]).alias(out))


def workspace_queries(workspaces: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (query_id, workspace, text) with the text enriched by the topics of their workspace (workspace, class_codes, aliases, topics); an unknown workspace adds nothing."""
    rows = queries.join(workspaces, "workspace", "left")
    return rows.select("query_id", F.concat_ws(" ", text(F.col("text")), F.array_join(F.slice(F.coalesce("topics", F.array().cast("array<string>")), 1, 5), " ")).alias("text"), "class_codes", "aliases")


def changed_since(now: DataFrame, before: DataFrame) -> DataFrame:
    """(query_id, id, change) of two runs of saved queries (query_id, id, rank): added, gone, moved or same."""
    a, b = now.select("query_id", "id", F.col("rank").alias("now")), before.select("query_id", "id", F.col("rank").alias("before"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("before"), "moved").otherwise("same")
    return a.join(b, ["query_id", "id"], "full").select("query_id", "id", change.alias("change"))
