"""Summaries of books and chapters, drawn from their sections, and themes of texts."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import alias, firsts, slug, stripped, text
from .chunks import unrolled, with_sections
from .counted import stands_alone, with_said
from .extract import first_paragraph, keywords, merged_keywords, with_keywords

#: Fixed: words that are no themes, and the forms of themes of several words.
THEME_STOP_WORDS = (
    "about", "after", "again", "against", "also", "almost", "among", "another", "because", "before", "being", "between", "book", "books", "chapter", "could",
    "does", "during", "each", "either", "every", "from", "have", "into", "more", "most", "other", "over", "should", "still", "summary", "than", "that", "their",
    "them", "there", "these", "they", "this", "through", "title", "under", "using", "what", "when", "where", "which", "while", "with", "would", "your",
)
THEME_FORMS = (
    r"\b[a-z][a-z]+\s+versus\s+[a-z][a-z]+\b", r"\b[a-z][a-z]+\s+vs\.?\s+[a-z][a-z]+\b", r"\b[a-z][a-z]+\s+over\s+[a-z][a-z]+\b", r"\b[a-z][a-z]+\s+and\s+[a-z][a-z]+\b",
    r"\b[a-z][a-z]+\s+of\s+[a-z][a-z]+\b", r"\b[a-z][a-z]+\s+[a-z][a-z]+\b",
)
#: Fixed: chapters that are sorted by name, and their places.
SPECIAL = {"preface": -30, "introduction": -20, "prologue": -10, "conclusion": 10_000}

_NONE = "array<string>"


def first_of_each(values: Column) -> Column:
    """Values whose alias is there for the first time; those of an empty one leave."""
    return firsts(F.filter(values, lambda v: alias(v) != ""), alias)


def path_parts(path: Column) -> Column:
    return F.filter(F.transform(F.split(path, ">"), stripped), lambda x: x != "")


def heading_ideas(paths: Column, topics: Column | None, limit: int) -> Column:
    """Topics, then the last two parts of each heading path without chapter numbers, of four characters or more; each once, whatever its case, blanks and hyphens."""
    last_two = lambda parts: F.filter(parts, lambda x, i: i >= F.size(parts) - 2)
    bare = F.filter(F.transform(F.flatten(F.transform(paths, lambda p: last_two(path_parts(p)))), lambda p: stripped(F.regexp_replace(p, r"(?i)\Achapter\s+\d+\s*[:.-]?\s*", ""))), lambda p: F.length(p) >= 4)
    every = bare if topics is None else F.concat(topics, bare)
    return F.slice(first_of_each(every), 1, limit)


def chapter_of(path: Column) -> Column:
    """The first heading of a path."""
    return F.coalesce(F.try_element_at(path_parts(path), F.lit(1)), F.lit("Unheaded content"))


def chapter_place(title: Column) -> Column:
    """Numbered chapters by number, others by their fixed places, the rest at 5,000."""
    number = F.nullif(F.regexp_extract(title, r"(?i)chapter\s+(\d+)", 1), F.lit("")).try_cast("int")
    known = F.create_map(*[F.lit(x) for pair in SPECIAL.items() for x in pair])
    return F.coalesce(number, F.try_element_at(known, F.lower(title)), F.lit(5_000))


def _chapters(books: DataFrame) -> DataFrame:
    """(book_id, at, title, paths, combined, n_sections): each book's chapters in the order in which they first come, put together in the row that holds the book. A chapter is the sections below one first heading, wherever they stand."""
    rows = with_sections(books.select("book_id", "text"), "text", "s")
    rows = rows.withColumn("__named", F.transform("s", lambda s: F.struct(chapter_of(s["heading_path"]).alias("title"), s["heading_path"].alias("path"), s["text"].alias("text")))).drop("s", "text")
    rows = rows.withColumn("__titles", F.array_distinct(F.transform("__named", lambda s: s["title"])))
    own = lambda t: F.filter("__named", lambda s: s["title"] == t)
    whole = lambda t, of: F.struct(t.alias("title"), F.transform(of, lambda s: s["path"]).alias("paths"), F.array_join(F.transform(of, lambda s: s["text"]), "\n\n").alias("combined"), F.size(of).cast("long").alias("n_sections"))
    rows = rows.withColumn("__chapters", F.transform("__titles", lambda t: F.transform(F.array(own(t)), lambda of: whole(t, of))[0]))
    return unrolled(rows, ("book_id",), "__chapters", "at").select("book_id", "at", "__chapters.*")


def _listed(words: DataFrame) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"])


def chapter_summaries(books: DataFrame) -> DataFrame:
    """books (book_id, text): for each chapter, in order, its summary, ideas, headings, keywords and sizes. Texts stay in the row that holds the book, and words are counted there; what is shuffled is what is said of a chapter."""
    rows = _chapters(books)
    heads = F.transform(F.filter("paths", lambda p: F.size(path_parts(p)) > 1), lambda p: F.element_at(path_parts(p), -1))
    order = F.row_number().over(Window.partitionBy("book_id").orderBy(chapter_place(F.col("title")), F.lower("title"), "title"))
    said = rows.select(
        "book_id", "title", slug(F.col("title")).alias("chapter_id"), first_paragraph(F.col("combined"), 550).alias("summary"), heading_ideas(F.col("paths"), None, 8).alias("ideas"),
        F.slice(F.array_distinct(heads), 1, 20).alias("headings"), "n_sections", F.length("combined").cast("long").alias("n_chars"), F.lower("combined").alias("low"),
    )
    if stands_alone(books.select("book_id")):
        whole = with_keywords(said, "low", 12).withColumn("keywords", F.col("words.word"))
    else:
        words = merged_keywords(rows.select(F.struct("book_id", "title").alias("book_id"), F.col("combined").alias("text")), 12)
        listed = words.groupBy(F.col("book_id.book_id").alias("book_id"), F.col("book_id.title").alias("title")).agg(_listed(words).alias("keywords"))
        whole = said.join(listed, ["book_id", "title"], "left")
    return whole.select(
        "book_id", order.alias("place"), "chapter_id", "title", "summary", "ideas", "headings", F.coalesce("keywords", F.array().cast(_NONE)).alias("keywords"), "n_sections", "n_chars",
    )


def book_summaries(books: DataFrame) -> DataFrame:
    """books (book_id, text, topics, routing_aliases): thesis, ideas, what the book is best for, keywords and number of chapters. Sections are put together in the row that holds the book."""
    none = F.array().cast(_NONE)
    rows = with_sections(books.select("book_id", F.coalesce("topics", none).alias("topics"), F.coalesce("routing_aliases", none).alias("routing_aliases"), "text"), "text", "s")
    rows = rows.withColumn("paths", F.transform("s", lambda s: s["heading_path"])).withColumn("combined", F.array_join(F.transform("s", lambda s: s["text"]), "\n\n")).drop("s", "text")
    listed = keywords(rows.select("book_id", F.col("combined").alias("text")), 20)
    listed = listed.groupBy("book_id").agg(_listed(listed).alias("keywords"))
    n = F.size(F.array_distinct(F.transform("paths", chapter_of))).cast("long")
    said = rows.select("book_id", "topics", "routing_aliases", first_paragraph(F.col("combined"), 750).alias("thesis"), heading_ideas(F.col("paths"), F.col("topics"), 12).alias("ideas"), n.alias("n_chapters"))
    whole = said.join(listed, "book_id", "left").withColumn("keywords", F.coalesce("keywords", none))
    named = F.transform(F.concat("routing_aliases", "topics", "ideas"), lambda x: stripped(F.translate(x, "_", " ")))
    every = F.concat(named, F.slice("keywords", 1, 10))
    best = F.slice(first_of_each(every), 1, 10)
    return whole.select("book_id", "thesis", "ideas", best.alias("best_for"), "keywords", "n_chapters")


def plain_text(x: Column) -> Column:
    """A text without marks of code, images, links and emphasis, on one line."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text(x), "`([^`]+)`", "$1"), r"!\[[^\]]*\]\([^)]*\)", " "), r"\[([^\]]+)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[*_~>#{}\[\]()]", " "), r"(?U)\s+", " "))


def best_themes(phrases: list[str], words: list[str], asked: list[str], limit: int) -> list[str]:
    """The themes of one text: see themes."""
    stop, asked, scored = set(THEME_STOP_WORDS), set(asked), []
    for p, n in Counter(phrases).items():
        own = [w for w in p.split(" ") if w not in stop]
        if len(p) >= 6 and own and not re.search("chapter|summary|unknown", p):
            scored.append((-round(n * (1.0 + 0.75 * len(asked.intersection(own))), 6), p))
    scored += [(-round(n * (1.3 if w in asked else 0.3), 6), w) for w, n in Counter(words).items() if w and w not in stop]
    taken: dict[str, str] = {}
    for _, p in sorted(scored):
        if len(taken) == limit:
            break
        if " " in p or p in asked or len(taken) < 6:
            taken.setdefault(p.replace(" ", "_").replace("-", "_"), p)
    return list(taken.values())


def themes(rows: DataFrame, limit: int = 16) -> DataFrame:
    """rows (id, text, query) as (id, themes): phrases of fixed forms, each occurrence worth 1 and 0.75 for each word of the query in it, and words, worth 0.3, or 1.3 if the query has them; the best first, ties by letter. Once six are found, words must be the query's.

    Phrases are found by expressions, counted and ranked in the row; only where an id has several rows, or none, they are put together by a shuffle.
    """
    stop, none = F.array(*[F.lit(w) for w in THEME_STOP_WORDS]), F.array().cast(_NONE)
    asked = F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text(F.col("query"))), F.lit(r"[a-z][a-z0-9\-]{2,}"), F.lit(0))), stop)
    base = rows.select("id", F.lower(plain_text(F.col("text"))).alias("low"), asked.alias("asked"))
    phrases = F.concat(*[F.regexp_extract_all("low", F.lit(f), F.lit(0)) for f in THEME_FORMS])
    found = base.select("id", "asked", phrases.alias("phrases"), F.regexp_extract_all("low", F.lit(r"[a-z][a-z\-']{3,}"), F.lit(0)).alias("words"))
    alone = stands_alone(rows.select("id"))
    if not alone:
        found = found.groupBy("id", "asked").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("phrases", "words")))
    say = lambda p, w, a: best_themes([x.strip(" -.,:;") for x in p], [x.strip("-' ") for x in w], a, limit)
    said = with_said(found, ["phrases", "words", "asked"], say, "themes", _NONE)
    return said if alone else rows.select("id").join(said, "id", "left").select("id", F.coalesce("themes", none).alias("themes"))
