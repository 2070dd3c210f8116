"""Classes, routing aliases and what they select: taxonomies as tables, the query router, and filters of a search."""

from __future__ import annotations

from collections.abc import Iterable

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.strings import alias, text
from ..sources.tables import materialize
from .contained import RUN, containing
from .search import broadcast_if_small

#: Fixed: domains that a query's terms point at, with the aliases and classes they stand for.
HINTS = {
    "finance": (("finance", "investing"), ("332", "330"), ("compound interest", "interest rate", "portfolio", "asset allocation", "index fund", "stock market", "shares", "bonds", "etf", "pension", "isa", "sipp", "wealth", "net worth", "financial freedom", "money", "invest", "investment", "dividend", "mortgage", "inflation", "cashflow", "risk", "market crash", "financial risk")),
    "productivity": (("productivity", "personal_development"), ("158", "153", "650"), ("productivity", "focus", "deep work", "habits", "habit", "routine", "morning routine", "systems", "goals", "discipline", "procrastination", "time management", "energy", "motivation", "self improvement", "success")),
    "business": (("business",), ("338", "650", "658"), ("business", "startup", "entrepreneur", "entrepreneurship", "company", "management", "leadership", "strategy", "operations", "sales", "marketing", "customers", "pricing", "profit", "growth", "negotiation", "risk")),
    "psychology": (("psychology",), ("150", "153", "155", "158"), ("psychology", "behaviour", "behavior", "cognition", "decision making", "bias", "emotion", "personality", "attention", "memory", "thinking", "mental model", "belief", "identity", "risk")),
    "health": (("health",), ("610", "613"), ("health", "sleep", "nutrition", "exercise", "fitness", "diet", "stress", "recovery", "wellbeing", "supplements", "energy", "mental health")),
    "technology": (("technology",), ("000", "003", "004", "005", "006"), ("technology", "software", "programming", "code", "database", "ai", "agent", "automation", "machine learning", "computer", "systems", "infrastructure")),
    "education": (("education",), ("370", "371"), ("education", "school", "teaching", "learning", "student", "classroom", "curriculum", "send", "ehcp", "child development")),
    "creativity": (("creativity",), ("700", "780", "800", "808"), ("creativity", "creative", "writing", "story", "storytelling", "music", "songwriting", "art", "design", "publishing", "rhetoric")),
}
#: Fixed: words that don't route.
ROUTE_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "do", "does", "for", "from", "how", "i", "in", "is", "it", "me", "my", "of", "on", "or", "our",
    "say", "says", "should", "the", "their", "these", "this", "to", "what", "with", "about", "books", "book", "think", "tell", "explain",
)


def taxonomy_tables(spark: SparkSession, document: str) -> tuple[DataFrame, DataFrame]:
    """(classes (code, label, aliases), aliases (alias, primary_codes, secondary_codes)) of a taxonomy in YAML."""
    data = yaml.safe_load(document) or {}
    strings = lambda v: [str(x) for x in v or []]
    classes = [(str(c), str(d.get("label") or ""), strings(d.get("aliases"))) for c, d in (data.get("classes") or {}).items()]
    aliases = [(str(a), strings(d.get("primary_class")), strings(d.get("secondary_class"))) for a, d in (data.get("routing_aliases") or {}).items()]
    return spark.createDataFrame(classes, "code string, label string, aliases array<string>"), spark.createDataFrame(aliases, "alias string, primary_codes array<string>, secondary_codes array<string>")


def with_label(rows: DataFrame, classes: DataFrame, code: str = "primary_class", out: str = "label") -> DataFrame:
    """rows with the label of their class: Unclassified without one, Unknown if the taxonomy hasn't it."""
    found = rows.join(broadcast_if_small(classes.select(F.col("code").alias("__code"), F.col("label").alias("__label"))), F.col(code) == F.col("__code"), "left")
    return found.withColumn(out, F.when(text(F.col(code)) == "", "Unclassified").otherwise(F.coalesce("__label", F.lit("Unknown")))).drop("__code", "__label")


def codes_of(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, code): the primary and secondary classes of each alias that names (query_id, alias) has, whatever its case, blanks and hyphens; unknown ones give none."""
    wanted = names.select("query_id", alias(F.col("alias")).alias("alias"))
    return wanted.join(broadcast_if_small(aliases), "alias").select("query_id", F.explode(F.array_union("primary_codes", "secondary_codes")).alias("code")).distinct()


def normal_query(x: Column) -> Column:
    """Lower case, hyphens for low lines, single blanks."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text(x)), "_", "-"), r"\s+", " "))


def said_words(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text(x)), F.lit(r"[a-z0-9][a-z0-9'\-]{2,}"), F.lit(0)))


def query_words(x: Column) -> Column:
    return F.array_except(said_words(x), F.array(*[F.lit(w) for w in ROUTE_STOP_WORDS]))


def has_term(query: Column, t: Column) -> Column:
    """Whether a normal query has a normal term: one of several words, or with a hyphen, anywhere; a single word between word boundaries."""
    several = F.contains(t, F.lit(" ")) | F.contains(t, F.lit("-"))
    quoted = F.regexp_replace(t, r"([^a-z0-9 ])", r"\\$1")
    alone = F.regexp_like(query, F.concat(F.lit(r"(?U)\b"), quoted, F.lit(r"\b")))
    return (t != "") & F.when(several, F.contains(query, t) | F.contains(query, F.translate(t, "-", " "))).otherwise(alone)


def _pieces(x: Column) -> Column:
    """Each character that is none of a word's, with what of a word follows it; a hyphen is a blank."""
    return F.regexp_extract_all(F.translate(x, "-", " "), F.lit(r"(?U)\W\w*"), F.lit(0))


def terms_met(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """queries (q, a normal one, and others), terms (term and others): the other columns of both and the term, for each row of one and of the other of which has_term holds.

    Terms of one plain word are looked up by the query's words. Any other has a character that is none of a word's: it is looked up by that one
    and up to three characters of a word behind it, which a query that has the term has too, and is then tested. A term has one such key
    and a query each key once, so they meet once. Queries are read once, and shuffled only if terms are too many for a broadcast.
    """
    t, most = F.col("t"), RUN + 1
    starts = F.transform(_pieces(t), lambda p: F.left(p, F.lit(most)))
    longest = F.array_max(F.transform(starts, lambda p: F.struct(F.length(p).alias("n"), p.alias("key"))))["key"]
    known = terms.withColumn("t", normal_query(F.col("term"))).where("t <> ''").withColumn("plain", t.rlike(r"(?U)\A\w+\z"))
    known = materialize(known.withColumn("key", F.when(F.col("plain"), t).otherwise(longest)))
    lengths = sorted(r.n for r in known.where("NOT plain").select(F.length("key").alias("n")).distinct().collect())  # of 1 to 4
    keys = F.regexp_extract_all("q", F.lit(r"(?U)\w+"), F.lit(0))
    if lengths:
        keys = F.concat(keys, F.flatten(F.transform(_pieces(F.col("q")), lambda p: F.array(*[F.left(p, F.lit(n)) for n in lengths]))))
    met = queries.withColumn("key", F.explode(F.array_distinct(keys))).join(broadcast_if_small(known), "key").where(F.col("plain") | has_term(F.col("q"), t))
    return met.drop("q", "t", "plain", "key")


def route_queries(queries: DataFrame, classes: DataFrame, aliases: DataFrame, most: int = 3) -> DataFrame:
    """queries (query_id, text): query_id, aliases, class_codes, confidence, a row for each query.

    An alias gets 4 if the query has it; for each of its classes 0.6 for each word of the label, 2.5 at most, and
    2.5 for each of the class's own aliases that the query has; a domain gets 3 and 1.2 for each of
    its terms. Those with 2.5, and 0.55 of the best, stay, up to `most`; a domain brings its own aliases along. Classes are
    those of the domain, else the alias's primary ones. What a query says of the taxonomy and the domains is looked up by words and by pieces, never held against all of it.
    Only what is found is shuffled, once, by query_id; the steps after it keep that order. Scores of rows that share a query_id add up.
    """
    spark = queries.sparkSession
    said = F.when(F.col("query_id").isNotNull(), F.col("text"))
    asked = queries.select("query_id", F.monotonically_increasing_id().alias("row"), normal_query(said).alias("q"), said_words(said).alias("words"))
    spaced = lambda a: F.translate(a, "_", " ")
    known = materialize(aliases.select(F.col("alias").alias("name"), "primary_codes", F.concat("primary_codes", "secondary_codes").alias("codes")).distinct())
    # A name's classes, each as often as it has it.
    of = known.select("name", "primary_codes", F.posexplode("codes").alias("place", "code")).join(classes.select("code", "label", "aliases"), "code")
    term = lambda rows, kind: rows.select("name", F.lit(kind).alias("kind"), F.lit("").alias("slot"), "term")
    named = known.select("name", spaced(F.col("name")).alias("term"))
    own = of.select("name", F.explode("aliases").alias("a")).select("name", spaced(F.col("a")).alias("term"))
    hinted = spark.createDataFrame([(n, t) for n, (_, _, terms) in HINTS.items() for t in terms], "name string, term string")
    terms = term(named, "alias").unionByName(term(own, "own")).unionByName(term(hinted, "hint"))
    met = terms_met(asked.select("query_id", "row", "q"), terms).drop("term")
    labels = materialize(of.select("name", F.lit("label").alias("kind"), F.to_json(F.struct("place", "primary_codes")).alias("slot"), F.explode(query_words(F.col("label"))).alias("word")))
    shared = asked.select("query_id", "row", F.explode("words").alias("word")).join(broadcast_if_small(labels), "word").drop("word")
    counted = met.unionByName(shared).repartition("query_id").groupBy("query_id", "row", "name", "kind", "slot").agg(F.count("*").alias("n"))
    n, kind = F.col("n"), F.col("kind")
    score = F.when(kind == "hint", 3.0 + 1.2 * n).when(kind == "label", F.least(F.lit(2.5), 0.6 * n)).when(kind == "own", 2.5 * n).otherwise(4.0 * n)
    # Only what an alias gets is rounded: a domain's 3 + 1.2 n is added as it is, so that sums tie only where the SQL's do.
    part = lambda of: F.coalesce(F.sum(F.when(of, score)), F.lit(0.0))
    scores = counted.groupBy("query_id", "name").agg((F.round(part(kind != "hint"), 6) + part(kind == "hint")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "name")
    ranked = scores.select("query_id", "name", "score", F.first("score").over(w).alias("best"), F.row_number().over(w).alias("rank"))
    ranked = ranked.where((F.col("rank") <= most) & (F.col("score") >= F.greatest(F.lit(2.5), 0.55 * F.col("best"))))
    # What a name brings along, and its classes, are small fixed tables.
    hints = spark.createDataFrame([(n, list(a), list(c)) for n, (a, c, _) in HINTS.items()], "name string, brings array<string>, hint_codes array<string>")
    full = ranked.join(F.broadcast(hints), "name", "left").withColumn("chain", F.concat(F.array("name"), F.coalesce("brings", F.array().cast("array<string>"))))
    chosen = full.groupBy("query_id").agg(F.max("best").alias("best"), F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chain"))), lambda x: x["chain"]))), 1, most).alias("aliases"))
    placed = chosen.select("query_id", "best", "aliases", F.posexplode("aliases").alias("at", "name")).join(F.broadcast(hints), "name", "left").join(broadcast_if_small(aliases.select(F.col("alias").alias("name"), "primary_codes")), "name", "left")
    codes = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("hint_codes", "primary_codes", F.array().cast("array<string>")).alias("codes")))), lambda x: x["codes"])))
    routed = placed.groupBy("query_id").agg(F.first("best").alias("best"), F.first("aliases").alias("aliases"), codes.alias("class_codes"))
    base = F.least(F.lit(0.98), F.round(0.35 + F.col("best") / 12, 2))
    extra = F.size("aliases") - 1
    confidence = F.when(F.col("best").isNull(), 0.0).when(extra > 0, F.greatest(F.lit(0.35), F.round(base - 0.05 * extra, 2))).otherwise(base)
    none = F.array().cast("array<string>")
    return queries.select("query_id").join(routed, "query_id", "left").select("query_id", F.coalesce("aliases", none).alias("aliases"), F.coalesce("class_codes", none).alias("class_codes"), confidence.alias("confidence"))


def allowed(rows: DataFrame, filters: DataFrame) -> DataFrame:
    """(query_id and rows' columns): rows that each filter (query_id, book, codes) lets through. A book is a title or book_id; codes must be the primary class or occur in secondary_class_text. A null book, and null or no codes, let all through."""
    of = filters.select(F.col("query_id").alias("__query"), F.col("book").alias("__book"), F.when(F.size("codes") > 0, F.array_distinct("codes")).alias("__codes"))
    has = of.agg(*[F.coalesce(F.bool_or(c), F.lit(False)) for c in (F.col("__book").isNotNull(), F.col("__codes").isNotNull(), F.col("__book").isNull() & F.col("__codes").isNull())]).first()
    mine = rows.withColumn("__primary", F.coalesce("primary_class", F.lit(""))).withColumn("__second", F.coalesce("secondary_class_text", F.lit("")))
    parts, fits = [mine.withColumn("__query", F.lit(None).cast(filters.schema["query_id"].dataType)).limit(0)], None
    if has[1]:
        # The classes that fit a filter, few beside the rows that have them.
        kinds = materialize(mine.select("__primary", "__second").distinct())
        asked = of.where("__codes IS NOT NULL").select("__query", F.explode("__codes").alias("__code"))
        held = containing(kinds.select(F.col("__second").alias("id"), F.col("__second").alias("low")), asked.select(F.col("__code").alias("needle")), short=True).select(F.col("id").alias("__second"), F.col("needle").alias("__code"))
        first = kinds.join(asked, F.col("__primary") == F.col("__code")).select("__query", "__primary", "__second")
        second = kinds.join(held, "__second").join(asked, "__code").select("__query", "__primary", "__second")
        fits = materialize(first.unionByName(second).distinct())
        parts.append(mine.join(fits.join(of.where("__book IS NULL").select("__query"), "__query"), ["__primary", "__second"]))
    if has[0]:
        named = of.where("__book IS NOT NULL")
        titled = mine.join(broadcast_if_small(named), F.col("title") == F.col("__book"))
        numbered = mine.join(broadcast_if_small(named), (F.col("book_id").cast("string") == F.col("__book")) & ~F.col("title").eqNullSafe(F.col("__book")))
        books = titled.unionByName(numbered)
        parts.append(books.where("__codes IS NULL"))
        if fits is not None:
            parts.append(books.where("__codes IS NOT NULL").join(fits, ["__query", "__primary", "__second"], "left_semi"))
    if has[2]:  # these let every row through, so their pairs are the result
        parts.append(mine.join(broadcast_if_small(of.where("__book IS NULL AND __codes IS NULL").select("__query")), F.lit(True)))
    out = None
    for p in parts:
        p = p.select(F.col("__query").alias("query_id"), *rows.columns)
        out = p if out is None else out.unionByName(p)
    return out


def aliases_named(names: Iterable[str], aliases: DataFrame) -> DataFrame:
    """The rows of aliases that these names mean."""
    wanted = {n.strip().lower().replace(" ", "_").replace("-", "_") for n in names}
    return aliases.where(F.col("alias").isin(*wanted)) if wanted else aliases.limit(0)
