"""Books by the evidence for them: topic maps and reading lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import contains_any, excerpt, normal, stripped
from ..operators.knowledge import term_hits
from ..operators.summaries import plain_text

#: Fixed: what a hit in the summary of a book and of a chapter and in a chunk is worth, and a search hit in a reading list.
SUMMARY, CHAPTER, CHUNK, SEARCH = 1.25, 1.0, 0.75, 3.0
#: Fixed: what evidence of each kind is worth in a reading plan.
KINDS = {"routed": 3.0, "broad": 2.0, "summary": 2.5, "concept": 2.0, "graph": 0.75}


def weighed(evidence: list[tuple[DataFrame, Column]], limit: int) -> DataFrame:
    """(query_id, book_id, score, n, rank): evidence (query_id, book_id and what its weight reads), summed by book; ties go to the lesser id."""
    rows = None
    for df, weight in evidence:
        part = df.select("query_id", "book_id", weight.cast("double").alias("w"))
        rows = part if rows is None else rows.unionByName(part)
    sums = rows.groupBy("query_id", "book_id").agg(F.round(F.sum("w"), 4).alias("score"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "book_id"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= limit)


def topic_map(summaries: DataFrame, chunk_hits: DataFrame, limit: int = 8) -> DataFrame:
    """Books by 1.25 of each summary's score, or the score itself if its column `level` says chapter, and 0.75 for each chunk found."""
    level = F.when(F.col("level") == "chapter", CHAPTER).otherwise(SUMMARY) if "level" in summaries.columns else F.lit(SUMMARY)
    return weighed([(summaries, F.greatest(F.lit(0.0), F.col("score")) * level), (chunk_hits, F.lit(CHUNK))], limit)


def reading_list(hits: DataFrame, mapped: DataFrame, limit: int = 8) -> DataFrame:
    """Books by 3 for each search hit, and by their place in a topic map: 2 less a tenth for each place, and a half at least."""
    return weighed([(hits, F.lit(SEARCH)), (mapped, F.greatest(F.lit(0.5), 2.0 - 0.1 * (F.col("rank") - 1)))], limit)


def reading_plan(routed: DataFrame, broad: DataFrame, summaries: DataFrame, concepts: DataFrame, mapped: DataFrame, edges: DataFrame, limit: int = 8) -> DataFrame:
    """(query_id, book_id, score, n, kinds, rank): books by five kinds of evidence, each a table (query_id, book_id).

    A routed search hit is worth 3, a summary 2.5, a concept 2, a place in a topic map (rank) 2 less a tenth for
    each place, a half at least. Broad hits, worth 2, count for queries without routed ones. The three books that then lead bring up to four
    neighbours each from edges (book_id, other_id, score), worth 0.75.
    """
    without = broad.join(routed.select("query_id").distinct(), "query_id", "left_anti")
    of = lambda df, kind, weight: df.select("query_id", "book_id", F.lit(kind).alias("kind"), weight.cast("double").alias("w"))
    rows = of(mapped, "map", F.greatest(F.lit(0.5), 2.0 - 0.1 * F.col("rank")))
    for df, kind in ((routed, "routed"), (without, "broad"), (summaries, "summary"), (concepts, "concept")):
        rows = rows.unionByName(of(df, kind, F.lit(KINDS[kind])))
    lead = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "book_id"))
    seeds = rows.groupBy("query_id", "book_id").agg(F.round(F.sum("w"), 4).alias("s")).withColumn("at", lead).where("at <= 3").select("query_id", "book_id")
    both = edges.select("book_id", "other_id", "score").unionByName(edges.select(F.col("other_id").alias("book_id"), F.col("book_id").alias("other_id"), "score"))
    nth = F.row_number().over(Window.partitionBy("query_id", "book_id").orderBy(F.desc("score"), "other_id"))
    near = seeds.join(both, "book_id").withColumn("nth", nth).where("nth <= 4").select("query_id", F.col("other_id").alias("book_id"))
    rows = rows.unionByName(of(near, "graph", F.lit(KINDS["graph"])))
    sums = rows.groupBy("query_id", "book_id").agg(F.round(F.sum("w"), 4).alias("score"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "book_id"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= limit)


def posture(rank: Column, title: Column, kinds: Column, best_read_as: Column, difficulty: Column, density: Column) -> Column:
    """How to take a book of a reading plan."""
    said = normal(F.concat_ws(" ", title, kinds))
    has = lambda *terms: contains_any(said, terms)
    return (
        F.when(rank == 1, "Start here").when(best_read_as == "reference", "Use as a reference").when(best_read_as == "skim_then_search", "Skim, then search").when(difficulty == "beginner", "Read early")
        .when((difficulty == "advanced") | (density == "dense"), "Read after the foundations").when(has("beginner", "basics", "introduction", "simple"), "Read early")
        .when(has("advanced", "dense", "technical", "systems"), "Read after the foundations").when(has("reference", "manual"), "Use as a reference").otherwise("Then read")
    )


def why(title: Column, intent: Column, kinds: Column) -> Column:
    """Why a book is in a reading plan, in a sentence."""
    has = lambda *k: F.arrays_overlap(F.split(kinds, ","), F.array(*[F.lit(x) for x in k]))
    bits = F.array_compact(F.array(F.when(has("summary"), F.lit("summary match")), F.when(has("concept"), F.lit("contains relevant reusable concepts")), F.when(has("map"), F.lit("strong topic-map match")), F.when(has("routed", "broad"), F.lit("relevant passages found")), F.when(has("graph"), F.lit("connected to other relevant books"))))
    said = F.when(F.size(bits) > 0, F.array_join(bits, ", ")).otherwise("matched the reading goal")
    return F.concat(F.coalesce(F.nullif(title, F.lit("")), F.lit("this book")), F.lit(" is recommended for "), intent, F.lit(" because it has "), said, F.lit("."))


def passage_search(passages: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """passages (id, text) for each query (query_id, text): by terms they contain, then by id."""
    scored = term_hits(passages, queries).select("query_id", "id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit)


def reasons(said: Column) -> Column:
    """Reasons without blanks around, each once, in the order in which they first come; blank ones leave."""
    return F.array_distinct(F.filter(F.transform(said, stripped), lambda r: r != ""))


def topic_map_records(summaries: DataFrame, chunk_hits: DataFrame, books: DataFrame, limit: int = 8) -> DataFrame:
    """(query_id, rank, book_id, title, score, reasons, summary_hits, chunk_hits): the books of a topic map with why they are in it.

    summaries (query_id, book_id, rank, score, level, chapter_title, text) and chunk_hits (query_id, book_id, rank, chunk_id,
    heading, citation, text) are what searches found, so their lists are as short as those searches' limits; texts are cut to excerpts before
    they are moved. books (book_id, title) name them, those that it hasn't by their id. Ties go to the title, then the id.
    """
    worth = F.greatest(F.lit(0.0), F.col("score")) * F.when(F.col("level") == "chapter", CHAPTER).otherwise(SUMMARY)
    hit = F.struct("rank", "level", F.round(F.greatest(F.lit(0.0), F.col("score")), 4).alias("score"), "chapter_title", excerpt(plain_text(F.col("text")), 500).alias("excerpt"))
    whole = summaries.select("query_id", "book_id", worth.alias("w"), hit.alias("h")).groupBy("query_id", "book_id").agg(F.sum("w").alias("w"), F.array_sort(F.collect_list("h")).alias("summary_hits"))
    part = F.struct("rank", "chunk_id", F.coalesce("heading", F.lit("")).alias("heading"), "citation", excerpt(plain_text(F.col("text")), 450).alias("excerpt"))
    parts = chunk_hits.select("query_id", "book_id", part.alias("h")).groupBy("query_id", "book_id").agg((CHUNK * F.count("*")).alias("v"), F.array_sort(F.collect_list("h")).alias("chunk_hits"))
    both = whole.join(parts, ["query_id", "book_id"], "full").withColumn("score", F.round(F.coalesce("w", F.lit(0.0)) + F.coalesce("v", F.lit(0.0)), 4))
    of = lambda hits, *say: F.flatten(F.transform(F.coalesce(hits, F.array()), lambda h: F.array(*[s(h) for s in say])))
    named = lambda before, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), c)).otherwise("")
    matched = of(F.col("summary_hits"), lambda h: F.concat(F.lit("matched "), h["level"], F.lit(" summary")), lambda h: named("chapter match: ", h["chapter_title"]))
    indexed = of(F.col("chunk_hits"), lambda h: F.lit("matched indexed chunks"), lambda h: named("chunk heading: ", h["heading"]))
    rows = both.select("query_id", "book_id", "score", reasons(F.concat(F.coalesce(matched, F.array().cast("array<string>")), F.coalesce(indexed, F.array().cast("array<string>")))).alias("reasons"), "summary_hits", "chunk_hits")
    rows = rows.join(books.select("book_id", "title"), "book_id", "left").withColumn("title", F.coalesce("title", F.col("book_id").cast("string")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.lower("title"), "book_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", "book_id", "title", "score", "reasons", "summary_hits", "chunk_hits")
