"""Books as rows: duplicates, editions, statistics, routing, graph, merges of states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import alias, canonical_title, file_name, normal, once, slug, text, title_author_key
from ..sources.tables import materialize
from .contained import said_phrases
from .search import broadcast_if_small


def body_hash(body: Column) -> Column:
    """A hash that line ends, runs of blanks and of blank lines don't change."""
    x = F.regexp_replace(F.regexp_replace(text(body), r"\r\n|\r", "\n"), r"[ \t]+", " ")
    return F.sha2(F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"(?U)\A\s+|\s+\z", ""), 256)


def fingerprint(body: Column, chars: int = 12_000) -> Column:
    """Words of a body, or the first, middle and last third of so many characters of them."""
    x = F.trim(F.regexp_replace(F.lower(text(body)), r"(?U)\W+", " "))
    third, n = chars // 3, F.length(x)
    return F.when(n <= chars, x).otherwise(F.concat_ws(" ", F.substring(x, 1, third), F.substr(x, F.floor(n / 2).cast("int") + 1, F.lit(third)), F.substr(x, n - third + 1, F.lit(third))))


#: Order of reasons why rows are duplicates.
REASONS = ("isbn", "content", "title_author")


def duplicate_groups(books: DataFrame) -> DataFrame:
    """books (book_id, title, author, isbns, text): (reason, n_books, first_id, members_hash) of rows that share a key.

    Groups are told by size, least id and an order-free checksum of ids, so that a hot group is summed
    where its rows are and never gathered. duplicate_members lists the rows.
    """
    return duplicate_members(books).groupBy("reason", "key").agg(F.count("*").alias("n_books"), F.min("book_id").alias("first_id"), F.max("book_id").alias("last_id")).where("n_books > 1").select("reason", "key", "n_books", "first_id", "last_id")


def duplicate_members(books: DataFrame) -> DataFrame:
    """(reason, key, book_id): every key of every row."""
    key = title_author_key(F.col("title"), F.col("author"))
    by = [books.select(F.lit("isbn").alias("reason"), F.explode("isbns").alias("key"), "book_id"), books.select(F.lit("content").alias("reason"), body_hash(F.col("text")).alias("key"), "book_id"), books.select(F.lit("title_author").alias("reason"), key.alias("key"), "book_id").where((F.col("key") != "|") & (F.length("key") > 3))]
    return by[0].unionByName(by[1]).unionByName(by[2]).distinct()


def work_id(title: Column, author: Column) -> Column:
    """Editions of one work share it."""
    return F.concat(slug(author), F.lit("__"), slug(canonical_title(title)))


def totals(books: DataFrame) -> DataFrame:
    """books (primary_class, author, topics, isbns, indexed, changed, n_chunks, difficulty, pages, hours) as one row of counts and sums."""
    some = lambda c: F.count_if(c)
    return books.agg(
        F.count("*").alias("books"), some(F.col("indexed")).alias("indexed_books"), some(~F.col("indexed") | F.col("changed")).alias("books_needing_index"), F.sum("n_chunks").alias("indexed_chunks"),
        some(F.col("primary_class") == "999").alias("unclassified_books"), some(text(F.col("author")) == "").alias("books_without_author"), some(F.size("topics") == 0).alias("books_without_topics"),
        some(F.size("isbns") > 0).alias("books_with_isbn"), some(F.col("difficulty").isNotNull() | (F.col("pages") > 0)).alias("books_with_reading_metadata"),
        F.sum("pages").alias("estimated_pages"), F.round(F.sum("hours"), 1).alias("estimated_reading_hours"),
    )


def class_counts(books: DataFrame) -> DataFrame:
    return books.groupBy("primary_class").agg(F.count("*").alias("books"), F.sum("n_chunks").alias("chunks"), F.countDistinct(F.when(text(F.col("author")) != "", F.col("author"))).alias("authors"))


def author_counts(books: DataFrame) -> DataFrame:
    who = F.coalesce(F.nullif(text(F.col("author")), F.lit("")), F.lit("Unknown author")).alias("author")
    return books.groupBy(who).agg(F.count("*").alias("books"), F.sum("n_chunks").alias("chunks"), F.array_join(F.array_sort(F.collect_set("primary_class")), ", ").alias("classes"))


def topic_counts(books: DataFrame) -> DataFrame:
    """A book that lists a topic twice counts twice."""
    rows = books.select(F.explode("topics").alias("t"), "n_chunks", "primary_class").select(F.replace(alias(F.col("t")), F.lit("_"), F.lit(" ")).alias("topic"), "n_chunks", "primary_class").where("topic <> ''")
    return rows.groupBy("topic").agg(F.count("*").alias("books"), F.sum("n_chunks").alias("chunks"), F.array_join(F.array_sort(F.collect_set("primary_class")), ", ").alias("classes"))


def level_counts(books: DataFrame, column: str, order: tuple[str, ...]) -> DataFrame:
    """Books, pages and hours by a level; position is its place in a given order, unknown ones last."""
    rows = books.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias(column)).agg(F.count("*").alias("books"), F.sum("pages").alias("pages"), F.round(F.sum("hours"), 1).alias("hours"))
    at = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(column))
    return rows.withColumn("position", F.when(at > 0, at - 1).otherwise(99).cast("int"))


#: Fixed: what a shared trait of two books adds to their score: for each, and at most.
EDGE = {"work": (0.95, 0.95), "author": (0.35, 0.35), "class": (0.25, 0.25), "topic": (0.12, 0.5), "alias": (0.1, 0.35), "term": (0.08, 0.45)}


#: Books of one trait that meet in a task.
HOT_BLOCK = 1000


def traits(books: DataFrame) -> DataFrame:
    """(book_id, kind, trait) of books (book_id, title, author, primary_class, topics and, if there, the arrays routing_aliases and summary_terms)."""
    one = lambda kind, c: books.select("book_id", F.lit(kind).alias("kind"), c.alias("trait"))
    rows = one("author", normal(F.col("author"))).unionByName(one("class", text(F.col("primary_class")))).unionByName(one("work", work_id(F.col("title"), F.col("author"))))
    for kind, c in (("topic", "topics"), ("alias", "routing_aliases"), ("term", "summary_terms")):
        if c in books.columns:
            rows = rows.unionByName(books.select("book_id", F.lit(kind).alias("kind"), F.explode(F.array_distinct(F.transform(c, normal))).alias("trait")))
    return rows.where("trait <> ''")


def edge_score(shared: Callable[[str], Column]) -> Column:
    """The score of two books by how many traits of a kind they share."""
    parts = [F.least(F.lit(most), each * shared(k)) for k, (each, most) in EDGE.items()]
    score = parts[0]
    for p in parts[1:]:
        score = score + p
    return F.round(F.least(F.lit(1.0), score), 3)


def keyed(books: DataFrame) -> DataFrame:
    """(book_id, keys): each book's traits as sorted `kind:trait`, found in its row."""
    named = lambda kind, c: F.when(c != "", F.concat(F.lit(f"{kind}:"), c))
    one = F.array(named("author", normal(F.col("author"))), named("class", text(F.col("primary_class"))), named("work", work_id(F.col("title"), F.col("author"))))
    every = lambda kind, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: named(kind, normal(t)))
    many = [every(kind, c) for kind, c in (("topic", "topics"), ("alias", "routing_aliases"), ("term", "summary_terms")) if c in books.columns]
    rows = books.select("book_id", F.array_compact(F.concat(one, *many)).alias("k")).groupBy("book_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("k")))).alias("keys"))
    return rows.where(F.size("keys") > 0)


def _units(books: DataFrame, block: int) -> DataFrame:
    """(unit, keys, ids): books of the same traits, up to so many in a unit, in order; a unit is told by its least id."""
    place = F.row_number().over(Window.partitionBy("keys").orderBy("book_id"))
    return keyed(books).withColumn("part", F.floor((place - 1) / block)).groupBy("keys", "part").agg(F.array_sort(F.collect_list("book_id")).alias("ids")).select(F.col("ids")[0].alias("unit"), "keys", "ids")


def trait_classes(books: DataFrame, most: int) -> DataFrame:
    """(unit, keys, ids): the books of each set of traits, by their first `most` ids."""
    place = F.row_number().over(Window.partitionBy("keys").orderBy("book_id"))
    return keyed(books).withColumn("place", place).where(F.col("place") <= most).groupBy("keys").agg(F.array_sort(F.collect_list("book_id")).alias("ids")).select(F.col("ids")[0].alias("unit"), "keys", "ids")


def _met(units: DataFrame, others: DataFrame, least: float, block: int) -> DataFrame:
    """(unit, ids, other, other_ids, score): pairs of units that share a trait and have a score of least or more.

    Units meet at the traits they share and carry all of theirs, so a pair is scored where it arises, at the least trait it shares,
    and pairs are never shuffled. A trait of many units is cut into blocks of about so many, and each pair of blocks is a key of its own.
    Traits repeat, so shuffled rows look much smaller than they are: the hints keep Spark from sending them to the driver for a broadcast, and the number of parts from
    putting all pairs into a few tasks.
    """
    parts = max(int(others.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * others.sparkSession.sparkContext.defaultParallelism)
    keys = lambda d: d.select("unit", "keys", "ids", F.explode("keys").alias("key"))
    sizes = keys(others).groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = lambda d: keys(d).join(sizes.hint("merge"), "key").withColumn("own", F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int"))
    side = lambda d, unit, has, ids, mine, theirs: placed(d).select("key", F.col("unit").alias(unit), F.col("keys").alias(has), F.col("ids").alias(ids), F.col("own").alias(mine), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(theirs)).repartition(parts, "key", "at", "to")
    pairs = side(units, "unit", "a", "ids", "at", "to").join(side(others, "other", "b", "other_ids", "to", "at").hint("merge"), ["key", "at", "to"])
    of = lambda shared: edge_score(lambda k: F.size(F.filter(shared, lambda x: F.startswith(x, F.lit(f"{k}:")))))
    score = once(F.array_intersect("a", "b"), lambda shared: F.when(F.col("key") == F.array_min(shared), of(shared)))
    # Exploded, the score is found once; a filter would be pushed below the column and find it again.
    return pairs.select("unit", "ids", "other", "other_ids", F.explode_outer(F.array(score)).alias("score")).where(F.col("score") >= least)


def _ends(pairs: DataFrame) -> DataFrame:
    """(book_id, other_id, score) of pairs of units, each unordered pair once: those between two units, and within one."""
    rows = pairs.where("unit <= other").select("unit", "other", "other_ids", "score", F.explode("ids").alias("a")).select("unit", "other", "score", "a", F.explode("other_ids").alias("b"))
    return rows.where("unit <> other OR a < b").select(F.least("a", "b").alias("book_id"), F.greatest("a", "b").alias("other_id"), "score")


def _shown_ends(pairs: DataFrame, shown: Callable[[Column], Column]) -> DataFrame:
    """As _ends, with columns `source` and `target`, what shown makes of the two ids, and `said`, the score as a string. They are made once for a pair of units, not for each pair of books."""
    each = lambda ids: F.transform(ids, lambda i: F.struct(i.alias("id"), shown(i).alias("shown")))
    rows = pairs.where("unit <= other").select("unit", "other", "score", F.col("score").cast("string").alias("said"), each("ids").alias("ids"), each("other_ids").alias("other_ids"))
    rows = rows.select("unit", "other", "other_ids", "score", "said", F.explode("ids").alias("a")).select("unit", "other", "score", "said", "a", F.explode("other_ids").alias("b")).where("unit <> other OR a.id < b.id")
    first = F.col("a.id") < F.col("b.id")
    ends = [F.when(first, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")).alias(name) for c, names in (("id", ("book_id", "other_id")), ("shown", ("source", "target"))) for name, x, y in zip(names, "ab", "ba")]
    return rows.select(*ends, "score", "said")


def edges(books: DataFrame, least: float = 0.2, block: int = HOT_BLOCK, shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """(book_id, other_id, score): all pairs of books, lesser id first, with a score of least or more; with `shown` also source, target and said (_shown_ends).

    Books of the same traits are one unit and pairs of units are scored, not pairs of books; these are only written out. They
    grow with the square of a class.
    """
    units = materialize(_units(books, block))
    met = _met(units, units, least, block)
    return _shown_ends(met, shown) if shown else _ends(met)


def best_edges(books: DataFrame, limit: int, least: float = 0.2, block: int = HOT_BLOCK) -> DataFrame:
    """The `limit` edges of the highest score, then least ids, without making the others.

    Edges between two sets of traits have one score, so of pairs of sets only `limit` can matter, those whose first edges come
    first, and in a set only its first limit + 1 books: for any later book an earlier one gives a better edge.
    """
    sets = materialize(trait_classes(books, limit + 1))
    pairs = _met(sets, sets, least, block).where("unit < other OR (unit = other AND size(ids) > 1)")
    first = pairs.withColumn("lo", F.col("unit")).withColumn("hi", F.when(F.col("unit") == F.col("other"), F.try_element_at("ids", F.lit(2))).otherwise(F.col("other")))
    chosen = materialize(first.orderBy(F.desc("score"), "lo", "hi").limit(limit).select("unit", "other", "score"))
    ids = lambda unit, name: sets.select(F.col("unit").alias(unit), F.col("ids").alias(name))
    return _ends(chosen.join(ids("unit", "ids"), "unit").join(ids("other", "other_ids"), "other")).orderBy(F.desc("score"), "book_id", "other_id").limit(limit)


def related(books: DataFrame, seeds: DataFrame, limit: int = 10, least: float = 0.2, block: int = HOT_BLOCK) -> DataFrame:
    """(book_id, other_id, score, rank): for each seed (book_id) the books it has most in common with.

    Seeds of the same traits have the same scores, and so have books of the same traits. So sets of traits are compared, each with its first
    limit + 1 books, as a seed itself may be one of them; of these the best limit + 1 are a set's answer, and each seed takes
    those that aren't itself.
    """
    sets = materialize(trait_classes(books, limit + 1))
    own = seeds.select("book_id").distinct()
    mine = materialize(keyed(books).join(own.hint("merge"), "book_id", "left_semi").join(sets.select("keys", "unit").hint("merge"), "keys").select("unit", "book_id"))
    asked = sets.join(mine.select("unit").distinct(), "unit", "left_semi").withColumn("ids", F.array("unit"))
    order = Window.partitionBy("unit").orderBy(F.desc("score"), "other")
    best = _met(asked, sets, least, block).select("unit", "other", "other_ids", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit + 1)
    each = best.select("unit", "score", F.explode("other_ids").alias("other"))
    answers = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit + 1).drop("rank")
    found = mine.join(answers.hint("merge"), "unit").where("book_id <> other").select("book_id", F.col("other").alias("other_id"), "score")
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("score"), "other_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)


def route(queries: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """queries (query_id, text), names (alias, label): the aliases each query points at.

    An alias that the query contains adds 4; words that the query shares with its label add 0.6 each, 2.5 at
    most. Kept are those with 2.5, and 0.55 of the best, at least; up to `most`, by score and then name. Aliases are looked up
    by their first word, labels by their words; an alias without words is never said.
    """
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit(r"[a-z0-9][a-z0-9'\-]{2,}"), F.lit(0))))
    plain = lambda c: F.regexp_replace(squeezed_lower(c), "[^a-z0-9]+", " ")
    asked = queries.select("query_id", F.concat(F.lit(" "), plain(F.col("text")), F.lit(" ")).alias("q"))
    known = names.select("alias", plain(F.replace("alias", F.lit("_"), F.lit(" "))).alias("phrase"))
    said = said_phrases(asked, known).join(broadcast_if_small(known), "phrase").join(asked, "query_id").where(F.contains("q", F.concat(F.lit(" "), "phrase", F.lit(" "))))
    shared = queries.select("query_id", words(F.col("text")).alias("word")).join(broadcast_if_small(names.select("alias", words(F.col("label")).alias("word"))), "word").groupBy("query_id", "alias").agg(F.count("*").alias("n"))
    parts = said.select("query_id", "alias", F.lit(4.0).alias("score")).unionByName(shared.select("query_id", "alias", F.least(F.lit(2.5), 0.6 * F.col("n")).alias("score")))
    rows = parts.groupBy("query_id", "alias").agg(F.round(F.sum("score"), 2).alias("score")).where("score > 0")
    w = Window.partitionBy("query_id")
    rows = rows.withColumn("best", F.max("score").over(w)).where(F.col("score") >= F.greatest(F.lit(2.5), 0.55 * F.col("best")))
    rows = rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "alias"))).where(F.col("rank") <= most)
    return rows.select("query_id", "alias", "score", "rank", F.round(F.least(F.lit(0.98), 0.35 + F.col("best") / 12), 2).alias("confidence"))


def squeezed_lower(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text(c)), r"\s+", " "))


def index_status(old: DataFrame, new: DataFrame, key: str, hashes: tuple[str, ...]) -> DataFrame:
    """(key, status): new, changed, unchanged or gone, by hashes of two states."""
    o, n = old.select(key, F.struct(*hashes).alias("o")), new.select(key, F.struct(*hashes).alias("n"))
    status = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "gone").when(F.col("o") == F.col("n"), "unchanged").otherwise("changed")
    return o.join(n, key, "full").select(key, status.alias("status"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old state under the new one: a value that is not null wins over the one before."""
    rest = [c for c in old.columns if c != key]
    n = new.select(key, *[F.col(c).alias(f"__{c}") for c in rest])
    return old.join(n, key, "full").select(key, *[F.coalesce(f"__{c}", c).alias(c) for c in rest])


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and rows of old whose key new hasn't."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def appended(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old, and rows of new whose key old hasn't."""
    return replaced(new, old, key)


def classified(title: Column, body: Column, rules: tuple[tuple[str, tuple[str, ...]], ...], most: int = 30_000) -> Column:
    """The class code with the best score: 8 for each of its terms in the title, 1 for each in the first characters of the body; the earlier rule wins a tie, and no hit gives null."""
    t, b = F.lower(text(title)), F.lower(F.left(text(body), F.lit(most)))
    hits = lambda x, terms: sum((F.contains(x, F.lit(term)).cast("int") for term in terms), F.lit(0))
    scored = F.array(*[F.struct((8 * hits(t, terms) + hits(b, terms)).alias("score"), F.lit(-i).alias("place"), F.lit(code).alias("code")) for i, (code, terms) in enumerate(rules)])
    best = F.array_max(scored)
    return F.when(best["score"] > 0, best["code"])


def orphans(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key no other row has."""
    return rows.join(others.select(key).distinct(), key, "left_anti")


def editions(books: DataFrame) -> DataFrame:
    """(work_id, n_editions, first_id): books of one work."""
    return books.groupBy(work_id(F.col("title"), F.col("author")).alias("work_id")).agg(F.count("*").alias("n_editions"), F.min("book_id").alias("first_id"))


def review_issues(books: DataFrame) -> DataFrame:
    """(book_id, issue) of books (author, isbns, primary_class, topics, indexed): what a person should look at."""
    rules = {
        "missing_author": text(F.col("author")) == "", "missing_isbn": F.size("isbns") == 0, "unclassified": F.col("primary_class") == "999",
        "few_topics": F.size("topics") < 2, "not_indexed": ~F.col("indexed"),
    }
    return books.select("book_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("issue"))


def shelved(books: DataFrame) -> DataFrame:
    """(book_id, path): class folder and file name; of books that would share a path the later ones get a number."""
    name = F.concat_ws(" - ", file_name(F.col("title")), F.when(text(F.col("author")) != "", file_name(F.col("author"))))
    rows = books.select("book_id", F.concat(F.coalesce(F.nullif(text(F.col("primary_class")), F.lit("")), F.lit("999")), F.lit("/"), name).alias("stem"))
    n = F.row_number().over(Window.partitionBy("stem").orderBy("book_id"))
    rows = rows.withColumn("n", n)
    return rows.select("book_id", F.concat("stem", F.when(F.col("n") > 1, F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).otherwise(""), F.lit(".md")).alias("path"))


def listed(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, n, values): the values of each key in an order, joined by commas."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v"))))
    return rows.groupBy(key).agg(F.count("*").alias("n"), pairs.alias("p")).select(key, "n", F.array_join(F.transform("p", lambda x: x["v"]), ", ").alias("values"))
