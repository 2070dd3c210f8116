"""Search over what was drawn out of books: claims, concepts, summaries; what is unique in results; listings and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import normal, text
from ..sources.tables import materialize
from .contained import containing
from .search import SMALL, broadcast_if_small

#: Pairs of a word and a term that it has in it that are broadcast; more are joined by shuffle.
WORDS = 10 * SMALL


def term_hits(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """rows (id, text), queries (query_id, text): (query_id, id, score), 1 for each word of the query of more than two letters that the text contains, also inside words, and 3 for the whole query.

    A word of the query that occurs in a text occurs inside one of its words. So the distinct words of all
    texts are indexed by their runs of characters, the query's are looked up there, and texts are found by their words; whole queries are
    looked for only in texts that have all of their words. Queries without such words are looked up in the texts in
    the same way. Nothing is left out. Hits are alike, so shuffled rows look much smaller than they are; the hints keep Spark from sending them to the driver for a broadcast.
    """
    low = rows.select("id", F.lower(text(F.col("text"))).alias("low"))
    words = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(r"(?U)\w+"), F.lit(0)))
    asked = queries.select("query_id", F.lower(text(F.col("text"))).alias("asked")).withColumn("terms", F.filter(words(F.col("asked")), lambda w: F.length(w) > 2))
    terms = asked.select("query_id", F.explode("terms").alias("term"))
    posted = low.select("id", F.explode(words(F.col("low"))).alias("word"))
    vocabulary = posted.select(F.col("word").alias("id"), F.col("word").alias("low")).distinct()
    held = materialize(containing(vocabulary, terms.select(F.col("term").alias("needle")), short=True).select(F.col("id").alias("word"), F.col("needle").alias("term")))
    # A text has each of its terms once, found where the text is if words and terms are few enough to be sent there.
    near = broadcast_if_small(held, WORDS)
    said = posted.join(near if near is not held else held.hint("merge"), "word")
    found = said.select("id", "term").distinct()
    n = materialize(found.join(broadcast_if_small(terms), "term").groupBy("query_id", "id").agg(F.count("*").cast("int").alias("n")))
    full = n.join(broadcast_if_small(asked.select("query_id", "asked", F.size("terms").alias("all"))), "query_id")
    complete = full.where("n = all").select("query_id", "id", "asked")
    few = broadcast_if_small(complete)
    met = few.join(low, "id") if few is not complete else complete.join(low.hint("merge"), "id")
    whole = met.select("query_id", "id", F.when(F.contains("low", "asked"), 3).otherwise(0).alias("bonus"))
    scored = full.join(whole.hint("merge"), ["query_id", "id"], "left").select("query_id", "id", (F.col("n") + F.coalesce("bonus", F.lit(0))).alias("score"))
    short = asked.where(F.size("terms") == 0).select("query_id", "asked")
    if short.isEmpty():
        return scored
    bare = containing(low, short.select(F.col("asked").alias("needle"))).join(short, F.col("needle") == F.col("asked"))
    return scored.unionByName(bare.select("query_id", "id", F.lit(3).alias("score")))


def claim_search(claims: DataFrame, queries: DataFrame, limit: int = 20, stance: str | None = None) -> DataFrame:
    """claims (claim_id, claim, citation, title, author, heading_path, evidence, tags, stance): (query_id, claim_id, title, stance, score, rank); the best by score, then title, then id."""
    mine = claims if stance is None else claims.where(F.col("stance") == stance)
    fields = F.concat_ws(" ", *[text(F.col(c)) for c in ("claim", "citation", "title", "author", "heading_path", "evidence")], F.array_join("tags", " "))
    hits = term_hits(mine.select(F.col("claim_id").alias("id"), fields.alias("text")), queries).withColumnRenamed("id", "claim_id")
    rows = hits.join(mine.select("claim_id", text(F.col("title")).alias("title"), "stance").hint("merge"), "claim_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "title", "claim_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "claim_id", "title", "stance", "score", "rank")


#: Fixed: what tensions are named, by a part of the topic.
GOALS = "Goals may provide direction, while systems and habits may determine whether progress is sustained."
COMPOUND = "Compounding can be powerful, but outcomes depend on time horizon, consistency, risk and fees."
RISK = "Risk can be a source of return, but unmanaged risk can undermine the intended outcome."


def compared_claims(claims: DataFrame, queries: DataFrame, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """((query_id, stance, place, claim_id, score), (query_id, tensions)): of three times `limit` claims found for a topic those of each stance in order, up to `limit`, and what they disagree about."""
    found = claim_search(claims, queries, 3 * limit).withColumn("stance", F.coalesce(F.nullif("stance", F.lit("")), F.lit("neutral")))
    place = F.row_number().over(Window.partitionBy("query_id", "stance").orderBy("rank"))
    buckets = found.withColumn("place", place).where(F.col("place") <= limit).select("query_id", "stance", "place", "claim_id", "score")
    has = found.groupBy("query_id").agg(*[F.bool_or(F.col("stance") == s).alias(s) for s in ("supports", "challenges", "qualifies")])
    rows = queries.select("query_id", "text").join(has, "query_id", "left").na.fill(False, ["supports", "challenges", "qualifies"])
    both, topic, low = F.col("supports") & F.col("challenges"), F.col("text"), F.lower("text")
    said = F.array_compact(
        F.array(
            F.when(both, F.concat(F.lit("The corpus contains claims both supporting and challenging '"), topic, F.lit("'."))),
            F.when(F.col("qualifies"), F.concat(F.lit("Some claims treat '"), topic, F.lit("' as context-dependent rather than simply true or false."))),
            F.when(F.contains(low, F.lit("goal")) & (F.col("supports") | F.col("challenges")), F.lit(GOALS)),
            F.when(F.contains(low, F.lit("compound")) | F.contains(low, F.lit("interest")), F.lit(COMPOUND)), F.when(F.contains(low, F.lit("risk")), F.lit(RISK)),
        )
    )
    none = F.array(F.concat(F.lit("No strong claim-level disagreement was detected for '"), topic, F.lit("'.")))
    return buckets, rows.select("query_id", F.when(F.size(said) > 0, said).otherwise(none).alias("tensions"))


def concept_search(concepts: DataFrame, queries: DataFrame, limit: int = 20, code: str | None = None) -> DataFrame:
    """concepts (concept_id, name, said: all of its fields as one text, primary_class): (query_id, concept_id, name, score, rank); 0.7 if the fields have the whole normal query, and 0.1, 0.5 at most, for each of its words among theirs.

    Concepts with a word of the query are found by it, and those that have the whole query, as a part of words too, by the query's rarest run of characters.
    Concepts of one name and text, and queries of one text, meet once: a concept stands for those like it, of which the first `limit` by id are enough, and each query takes what was found for its text.
    """
    mine = concepts if code is None else concepts.where(F.col("primary_class") == code)
    every = mine.select("concept_id", "name", normal(F.col("said")).alias("low"))
    first = every.withColumn("place", F.row_number().over(Window.partitionBy("name", "low").orderBy("concept_id"))).where(F.col("place") <= limit)
    alike = materialize(first.groupBy("name", "low").agg(F.array_sort(F.collect_list("concept_id")).alias("ids")).withColumn("concept_id", F.col("ids")[0]))
    rows = alike.select("concept_id", "name", "low")
    wanted = materialize(queries.select(F.col("query_id").alias("own"), normal(F.col("text")).alias("asked")).where("asked <> ''"))
    asked = wanted.groupBy("asked").agg(F.min("own").alias("query_id"))
    words = lambda c: F.explode(F.array_distinct(F.split(c, " ")))
    shared = asked.select("query_id", words(F.col("asked")).alias("word")).join(rows.select("concept_id", words(F.col("low")).alias("word")), "word").groupBy("query_id", "concept_id").agg(F.count("*").alias("n"))
    held = containing(rows.select(F.col("concept_id").alias("id"), "low"), asked.select(F.col("asked").alias("needle"))).join(asked, F.col("needle") == F.col("asked"))
    met = shared.join(held.select("query_id", F.col("id").alias("concept_id"), F.lit(True).alias("whole")), ["query_id", "concept_id"], "full").join(alike.select("concept_id", "name", "ids"), "concept_id")
    score = F.round(F.least(F.lit(1.0), F.when(F.col("whole"), 0.7).otherwise(0.0) + F.least(F.lit(0.5), 0.1 * F.coalesce("n", F.lit(0)))), 3)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "name", "concept_id"))
    best = met.withColumn("score", score).where("score > 0").withColumn("rank", rank).where(F.col("rank") <= limit)
    each = best.select("query_id", "name", "score", F.explode("ids").alias("concept_id")).withColumn("rank", rank).where(F.col("rank") <= limit)
    found = each.join(asked, "query_id").drop("query_id").join(wanted.hint("merge"), "asked")
    return found.select(F.col("own").alias("query_id"), "concept_id", "name", "score", "rank")


def listed_concepts(concepts: DataFrame, code: str | None = None, kind: str | None = None, limit: int = 100) -> DataFrame:
    """Concepts of a class and a type, by class, title and name."""
    rows = concepts if code is None else concepts.where(F.col("primary_class") == code)
    rows = rows if kind is None else rows.where(F.col("type") == kind)
    return rows.orderBy(F.coalesce("primary_class", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("name", F.lit(""))).limit(limit)


def listed_books(chunks: DataFrame, code: str | None = None, author: str | None = None) -> DataFrame:
    """Books of an index with their numbers of chunks, of a class and of authors whose name has a part, whatever its case. Rows are told by all five columns, nulls among them."""
    keys = ["book_id", "title", "author", "primary_class", "source_path"]
    rows = chunks if code is None else chunks.where(F.col("primary_class") == code)
    rows = rows if not author else rows.where(F.contains(F.lower(text(F.col("author"))), F.lit(author.lower())))
    return rows.groupBy(*keys).agg(F.count("*").alias("n_chunks"))


def of_section(chunks: DataFrame, book: str, section: str) -> DataFrame:
    """Chunks of a book whose section is named by id or title, or by a part of its title or headings, whatever its case, in order."""
    low = F.lit(section.lower())
    fits = (F.lower(text(F.col("section_id"))) == low) | (F.lower(text(F.col("section_title"))) == low) | F.contains(F.lower(text(F.col("section_title"))), low) | F.contains(F.lower(text(F.col("heading_path"))), low)
    return in_order(chunks.where(((F.col("title") == book) | (F.col("book_id").cast("string") == book)) & fits))


def in_order(chunks: DataFrame) -> DataFrame:
    """By book and place."""
    return chunks.orderBy(F.coalesce(F.col("book_id").cast("string"), F.lit("")), F.coalesce("chunk_index", F.lit(0)))


def first_seen(found: DataFrame, value: str, order: str = "rank") -> DataFrame:
    """(query_id, value, place): each value of a query once, in the order in which it first came; empty ones leave."""
    first = found.where(text(F.col(value)) != "").groupBy("query_id", value).agg(F.min(order).alias("at"))
    return first.select("query_id", value, F.row_number().over(Window.partitionBy("query_id").orderBy("at", value)).alias("place"))


def sampled(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, the same for the same seed: those of the least seeded hash of their key."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.col(key)).limit(n)


def log_search(log: DataFrame, needle: str, order: tuple[str, ...], last: int = 100) -> DataFrame:
    """The last records of a log, by the columns of order, whose fields as JSON contain a text, whatever its case. Only so many rows meet in the last step."""
    said = F.lower(F.to_json(F.struct(*[F.col(c) for c in log.columns])))
    return log.where(F.contains(said, F.lit(needle.lower()))).orderBy(*[F.desc(c) for c in order]).limit(last)


def clamped(value: Column, most: int, default: int) -> Column:
    """A count within 1 and most; what is no number is the default."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.coalesce(value.try_cast("int"), F.lit(default))))


def matching_nodes(books: DataFrame, query: str) -> DataFrame:
    """Books of a graph that a query names: by id, or by a part of the title, author or topics, whatever the case."""
    low = F.lit(query.lower())
    return books.where((F.lower(F.col("book_id").cast("string")) == low) | F.contains(F.lower(F.concat_ws(" ", "title", text(F.col("author")), F.array_join(F.coalesce("topics", F.array().cast("array<string>")), " "))), low))


def assembled(books: DataFrame, summaries: DataFrame, chapters: DataFrame, manifest: DataFrame) -> DataFrame:
    """books (book_id) with the thesis of their summary, the number of their chapters and the state of their manifest row (indexed); what isn't there is null, 0 and false."""
    n = chapters.groupBy("book_id").agg(F.count("*").alias("n_chapters"))
    state = manifest.groupBy("book_id").agg(F.bool_or("indexed").alias("indexed"))
    rows = books.join(summaries.select("book_id", "thesis"), "book_id", "left").join(n, "book_id", "left").join(state, "book_id", "left")
    return rows.withColumn("n_chapters", F.coalesce("n_chapters", F.lit(0))).withColumn("indexed", F.coalesce("indexed", F.lit(False)))


def intent(goal: Column, topic: Column, query: Column) -> Column:
    """What is asked for: a goal before a topic before a query."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (goal, topic, query)], F.lit(""))


def table_fingerprint(rows: DataFrame) -> DataFrame:
    """One row (n, fingerprint) that tells a table's contents, whatever the order of its rows: sums of two hashes of each."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), *[F.col(c) for c in rows.columns]).cast("decimal(20,0)"))
    return rows.agg(F.count("*").alias("n"), h(1).alias("a"), h(2).alias("b")).select("n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.coalesce("a", F.lit(0)).cast("string"), F.coalesce("b", F.lit(0)).cast("string")), 256).alias("fingerprint"))


def statistics(books: DataFrame, most: int = 10) -> DataFrame:
    """(kind, name, books, chunks, rank): classes, authors and topics with most books, up to `most` each."""
    from .library import author_counts, class_counts, topic_counts

    parts = [("class", class_counts(books), "primary_class"), ("author", author_counts(books), "author"), ("topic", topic_counts(books), "topic")]
    out = None
    for kind, counts, name in parts:
        rows = counts.select(F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"), "books", "chunks")
        out = rows if out is None else out.unionByName(rows)
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("books"), "name"))
    return out.withColumn("rank", rank).where(F.col("rank") <= most)
