"""What a note on a book says where no summary was written: its parts, and passages found in the book itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import excerpt, once, stripped, text
from .search import K1, B, n_terms, terms

#: Fixed: names under which a summary may have each part, in order.
THESIS, IDEAS, QUESTIONS = ("core_thesis", "summary", "description"), ("major_ideas", "key_ideas", "themes"), ("best_for_questions_about", "questions", "useful_for")
#: Fixed: what a thesis says without a summary.
RELEVANT, REVIEW, PLACEHOLDER = " appears most relevant to: ", ". Review and replace this machine-draft thesis.", "Machine-draft placeholder. Review the book and add a concise core thesis."
#: Topics that a thesis and questions name, that stand for ideas, and that passages are looked up by.
NAMED, STANDING, LOOKED_UP = 8, 10, 3

_NONE = "array<string>"


def note_parts(books: DataFrame) -> DataFrame:
    """books (book_id, title, topics and, where a summary has them, columns of the names above): (book_id, thesis, ideas, questions). The first part that is there and not empty counts; without one topics stand in, and without topics a placeholder."""
    none = F.array().cast(_NONE)
    topics, title = F.coalesce("topics", none), F.coalesce(F.nullif(text(F.col("title")), F.lit("")), F.lit("Untitled"))
    written = [F.when(text(F.col(c)) != "", stripped(text(F.col(c)))) for c in THESIS if c in books.columns]
    relevant = F.when(F.size(topics) > 0, F.concat(F.lit("*"), title, F.lit("*"), F.lit(RELEVANT), F.array_join(F.slice(topics, 1, NAMED), ", "), F.lit(REVIEW)))
    lists = lambda names: [F.when(F.size(c) > 0, F.col(c)) for c in names if c in books.columns]
    asked = F.transform(F.slice(topics, 1, NAMED), lambda t: F.concat(F.lit("What does "), title, F.lit(" say about "), t, F.lit("?")))
    return books.select("book_id", F.coalesce(*written, relevant, F.lit(PLACEHOLDER)).alias("thesis"), F.coalesce(*lists(IDEAS), F.slice(topics, 1, STANDING)).alias("ideas"), F.coalesce(*lists(QUESTIONS), asked).alias("questions"))


def looked_up(topics: Column, title: Column) -> Column:
    """What passages of a book are looked up by: its first topics, else its title."""
    return F.coalesce(F.nullif(F.array_join(F.slice(F.coalesce(topics, F.array().cast(_NONE)), 1, LOOKED_UP), " "), F.lit("")), title)


def useful_passages(books: DataFrame, chunks: DataFrame, limit: int = 5) -> DataFrame:
    """(book_id, rank, chunk_id, score, passage): of each book of books (book_id, title, topics) its own chunks (book_id, chunk_id, citation, heading_path, text) that say most of its topics, by BM25 told of all chunks; ties to the lesser id.

    A chunk is held against its own book's words alone, so work follows the chunks and not books times chunks.
    """
    asked = books.select("book_id", F.explode(F.array_distinct(terms(looked_up(F.col("topics"), F.col("title"))))).alias("term"))
    size = chunks.agg(F.count("*").alias("n"), F.avg(n_terms(F.col("text"))).alias("mean")).first()
    # A chunk's terms are counted once each where it is; only its book's own are told by chunk.
    df = chunks.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    wanted = asked.groupBy("book_id").agg(F.collect_list("term").alias("wanted"))
    each = lambda t: F.transform("wanted", lambda w: F.struct(w.alias("term"), F.size(t).alias("dl"), F.size(F.filter(t, lambda x: x == w)).alias("tf")))
    told = chunks.select("book_id", F.col("chunk_id").alias("id"), "text").join(wanted, "book_id").select("book_id", "id", F.inline(once(terms(F.col("text")), each)))
    own = told.where("tf > 0")
    idf = F.log1p((size.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / (size.mean or 1.0)))
    hits = own.join(df, "term").groupBy("book_id", "id").agg(F.round(F.sum(weight), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("score"), "id"))
    best = hits.withColumn("rank", rank).where(F.col("rank") <= limit).select(F.col("id").alias("chunk_id"), "rank", "score")
    named = F.coalesce(F.nullif("citation", F.lit("")), F.nullif("heading_path", F.lit("")), "chunk_id")
    said = excerpt(F.replace(stripped(text(F.col("text"))), F.lit("\n"), F.lit(" ")), 280)
    return best.join(chunks, "chunk_id").select("book_id", "rank", "chunk_id", "score", F.concat(named, F.lit(": "), said).alias("passage"))
