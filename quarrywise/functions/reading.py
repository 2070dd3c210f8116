"""Reading metadata of a text: words, sentence length, density, difficulty, how to read it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .markdown import reading_plain
from .strings import contains_any, text

#: Fixed: a word, and terms in a title or topics.
WORD = r"(?U)\b\w+(?:['’\-]\w+)?\b"
BEGINNER = ("beginner", "introduction", "introductory", "basics", "simple", "starter", "for dummies")
ADVANCED = ("advanced", "technical", "quantitative", "mathematical", "academic", "theory", "research")
REFERENCE = ("dictionary", "encyclopedia", "reference", "manual", "handbook", "guidebook")


def words(plain: Column) -> Column:
    return F.regexp_count(plain, F.lit(WORD)).cast("long")


def headings(body: Column) -> Column:
    return F.regexp_count(text(body), F.lit(r"(?dm)^#{1,6}\s+")).cast("long")


def sentence_words(plain: Column) -> Column:
    """Mean words of the sentences that have any, to one decimal."""
    counts = F.filter(F.transform(F.split(plain, r"(?<=[.!?])\s+"), lambda s: F.regexp_count(s, F.lit(WORD))), lambda n: n > 0)
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n)
    return F.when(F.size(counts) > 0, F.bround(total / F.size(counts), 1)).otherwise(F.lit(0.0))


def density(n_words: Column, mean: Column, n_headings: Column) -> Column:
    ratio = n_headings / F.greatest(n_words / 10000, F.lit(1.0))
    return F.when((mean >= 28) | ((n_words > 90000) & (ratio < 5)), "dense").when((mean <= 18) & (ratio >= 8), "light").otherwise("medium")


def difficulty(about: Column, dense: Column, mean: Column) -> Column:
    low = F.lower(text(about))
    return (
        F.when(contains_any(low, BEGINNER), "beginner").when(contains_any(low, ADVANCED), "advanced")
        .when((dense == "dense") | (mean >= 30), "advanced").when((dense == "light") & (mean <= 18), "beginner").otherwise("intermediate")
    )


def best_read_as(about: Column, n_headings: Column, n_words: Column) -> Column:
    ratio = n_headings / F.greatest(n_words / 10000, F.lit(1.0))
    return F.when(contains_any(F.lower(text(about)), REFERENCE), "reference").when((n_headings > 80) | (ratio > 14), "skim_then_search").otherwise("cover_to_cover")


def with_reading_metadata(df: DataFrame, body: str, about: Column) -> DataFrame:
    """df with n_words, n_headings, sentence_words, pages, hours, density, difficulty and best_read_as of the text in `body`; about: its title and topics. The plain text and the counts are columns of their own, so that each is found once."""
    rows = df.withColumn("__plain", reading_plain(F.col(body)))
    rows = rows.withColumns({"n_words": words(F.col("__plain")), "n_headings": headings(F.col(body)), "sentence_words": sentence_words(F.col("__plain"))}).drop("__plain")
    n, h, mean = F.col("n_words"), F.col("n_headings"), F.col("sentence_words")
    rows = rows.withColumn("density", density(n, mean, h))
    return rows.withColumns(
        {
            "pages": F.when(n > 0, F.greatest(F.lit(1), F.bround(n / 275))).otherwise(0).cast("long"), "hours": F.bround(n / 15000, 1),
            "difficulty": difficulty(about, F.col("density"), mean), "best_read_as": best_read_as(about, h, n),
        }
    )
