"""What is drawn out of texts: sentences, claims, passages, concepts, keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markdown import claim_plain, summary_plain
from ..functions.strings import clean_quote, contains_any, count_contained, firsts, normal, squeezed, stripped, text
from .chunks import unrolled
from .counted import stands_alone, top_words, with_said

# Fixed word lists. A term counts wherever its letters occur, also inside words.
CHALLENGE = ("not", "never", "less useful", "worse", "problem", "fails", "failure", "risk", "danger", "counterproductive", "instead of", "rather than", "myth")
QUALIFY = ("depends", "unless", "however", "although", "but", "context", "sometimes", "may", "can", "tradeoff", "trade-off")
SUPPORT = ("should", "must", "is", "are", "improves", "helps", "leads to", "causes", "supports", "requires", "works", "useful", "important", "essential")
MARKERS = (
    "should", "must", "because", "therefore", "leads to", "causes", "means that", "is more", "is less", "are more", "are less", "depends", "requires",
    "helps", "improves", "fails", "risk", "important", "essential", "useful", "rather than", "instead of", "not enough", "better", "worse",
)
TAG_TERMS = {
    "goals": ("goal", "goals"), "systems": ("system", "systems"), "habits": ("habit", "habits"), "risk": ("risk", "risks"),
    "finance": ("money", "invest", "investment", "finance", "market"), "energy": ("energy", "motivation", "focus"),
    "leadership": ("leader", "leadership", "team", "management"), "learning": ("learn", "learning", "skill", "practice"),
}
PASSAGE_TERMS = ("important", "therefore", "because", "principle", "system", "habit", "risk", "value", "strategy", "model", "means that")
FAVOUR = (
    "benefit", "benefits", "useful", "effective", "important", "valuable", "helpful", "supports", "improves", "works", "advantage", "strength",
    "should", "must", "essential", "positive", "success", "clarity", "focus", "direction", "motivation", "goal", "goals",
)
CRITIQUE = (
    "problem", "problems", "risk", "risks", "danger", "dangerous", "fails", "failure", "weakness", "limits", "limited", "misleading", "criticise", "criticizes",
    "criticising", "criticizing", "avoid", "trap", "drawback", "negative", "counterproductive", "worse", "instead", "rather than", "not enough", "system", "systems",
)
STOP_WORDS = (
    "the", "and", "for", "that", "with", "this", "from", "into", "your", "you", "are", "was", "were", "have", "has", "had", "not", "but", "can", "will", "what", "when",
    "where", "why", "how", "book", "chapter", "introduction", "preface", "edition", "about", "after", "before", "because", "between", "through", "there", "their", "them",
    "they", "then", "than", "also", "more", "most", "some", "such", "over", "under", "still", "almost", "everything", "second", "first", "one", "two", "three", "four",
)
CONCEPT_KINDS = "model|framework|method|principle|system|matrix|loop|cycle|law|effect|rule"
NOT_CONCEPTS = (
    "United States", "New York", "Table Of Contents", "All Rights Reserved", "Kindle Edition", "Chapter One", "Chapter Two", "Chapter Three", "Part One", "Part Two",
    "Part Three", "This Book", "The Book",
)
SENTENCE_STARTS = ("This", "That", "When", "Where", "What", "How", "Why", "There", "These", "Those")
CONCEPT_TYPES = {
    "model": ("model", "matrix", "map", "loop", "cycle", "pyramid", "ladder", "flywheel", "circle", "framework", "system", "quadrant", "curve"),
    "framework": ("framework", "method", "process", "approach", "principle", "formula", "checklist", "methodology", "protocol"),
    "principle": ("principle", "law", "rule", "habit", "effect", "bias", "heuristic", "strategy", "practice"),
    "method": ("method", "technique", "exercise", "routine", "practice", "process", "workflow", "system"),
    "warning": ("fallacy", "trap", "risk", "failure", "mistake", "bias", "problem", "warning"),
}


def sentences(body: Column) -> Column:
    """Plain sentences of eight words or more."""
    return F.filter(F.split(claim_plain(body), r"(?<=[.!?])\s+"), lambda s: F.size(F.split(s, " ")) >= 8)


def stance(sentence: Column) -> Column:
    low = F.lower(sentence)
    doubt, hedge = contains_any(low, CHALLENGE), contains_any(low, QUALIFY)
    return F.when(hedge, "qualifies").when(doubt, "challenges").when(contains_any(low, SUPPORT), "supports").otherwise("neutral")


def claims_something(sentence: Column) -> Column:
    return F.size(F.split(sentence, " ")).between(10, 45) & contains_any(F.lower(sentence), MARKERS)


def claim_tags(sentence: Column, fallback: Column | None = None) -> Column:
    low = F.lower(sentence)
    own = F.array_compact(F.array(*[F.when(contains_any(low, terms), F.lit(tag)) for tag, terms in TAG_TERMS.items()]))
    return F.slice(F.array_distinct(F.concat(own, fallback) if fallback is not None else own), 1, 8)


def claims(docs: DataFrame, limit: int = 40) -> DataFrame:
    """docs (book_id, text): the first claims of each in document order; one that recurs, whatever its case, counts once. Within the row, so nothing is shuffled."""
    found = F.filter(sentences(F.col("text")), claims_something)
    rows = unrolled(docs.select("book_id", F.slice(firsts(found, F.lower), 1, limit).alias("claim")), ("book_id",), "claim", "claim_index").withColumn("stance", stance(F.col("claim")))
    return rows.select("book_id", "claim_index", "claim", "stance", F.when(F.col("stance") == "neutral", "low").otherwise("medium").alias("confidence"), claim_tags(F.col("claim")).alias("tags"))


def passages(docs: DataFrame, limit: int = 20) -> DataFrame:
    """docs (book_id, text): the best paragraphs of 25 to 180 words, by terms in them and a colon or semicolon, then by place."""
    paras = F.filter(F.transform(F.split(text(F.col("text")), r"\n\s*\n"), stripped), lambda p: p != "")
    plain = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"(?dm)^#{1,6}\s+", ""), r"\[[^\]]+\]\([^\)]*\)", ""), "[*_`>#]+", "")
    rows = unrolled(docs.select("book_id", F.transform(paras, plain).alias("plain")), ("book_id",), "plain", "place")
    rows = rows.withColumn("n_words", F.regexp_count("plain", F.lit(r"(?U)\b\w+(?:['’\-]\w+)?\b")).cast("long")).where(F.col("n_words").between(25, 180))
    score = count_contained(F.lower("plain"), PASSAGE_TERMS) + F.col("plain").rlike("[:;]").cast("int")
    rows = rows.select("book_id", "place", "n_words", score.alias("score"), clean_quote(F.col("plain")).alias("quote"))
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("score"), "place"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)


def keywords(docs: DataFrame, limit: int = 18) -> DataFrame:
    """docs (book_id, text): the most frequent words of four letters or more, without stop words; ties by letter. Within the row, where each id has one."""
    if not stands_alone(docs.select("book_id")):
        return merged_keywords(docs, limit)
    rows = with_keywords(docs.select("book_id", F.lower(text(F.col("text"))).alias("low")), "low", limit)
    return rows.select("book_id", F.posexplode("words").alias("at", "w")).select("book_id", "w.word", "w.n", (F.col("at") + 1).alias("rank"))


def with_keywords(rows: DataFrame, low: str, limit: int) -> DataFrame:
    """rows with a column words in place of low, a text in lower case: array<struct<word, n>>."""
    stop = frozenset(STOP_WORDS)
    return with_said(rows, [low], lambda x: top_words(x, stop, limit), "words", "array<struct<word: string, n: bigint>>")


def merged_keywords(docs: DataFrame, limit: int) -> DataFrame:
    """The same where rows of one book_id count together: words are shuffled."""
    found = F.transform(F.regexp_extract_all(F.lower(text(F.col("text"))), F.lit(r"[a-z][a-z\-']{3,}"), F.lit(0)), lambda w: F.btrim(w, F.lit("-' ")))
    rows = docs.select("book_id", F.explode_outer(found).alias("word")).where((F.length("word") >= 4) & ~F.col("word").isin(*STOP_WORDS))
    counts = rows.groupBy("book_id", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("n"), "word"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= limit)


def concept_candidates(x: Column, limit: int = 20) -> Column:
    """Capitalised phrases, first those with a word for what they are, in order; each once whatever its case."""
    word = r"[A-Z][A-Za-z0-9'’\-]+"
    named = rf"\b(?:the\s+)?({word}(?:\s+{word}){{1,7}})\s+({CONCEPT_KINDS})\b"
    of = rf"\b({CONCEPT_KINDS})\s+(?:of|for)\s+({word}(?:\s+{word}){{0,7}})\b"
    bare = rf"\b({word}(?:\s+{word}){{1,7}})\b"
    both = lambda p, a, b: F.zip_with(F.regexp_extract_all(x, F.lit(p), F.lit(a)), F.regexp_extract_all(x, F.lit(p), F.lit(b)), lambda l, r: F.concat(l, F.lit(" "), r))  # noqa: E731, E741
    found = F.concat(both(named, 1, 2), both(of, 2, 1), F.regexp_extract_all(x, F.lit(bare), F.lit(1)))
    clean = F.transform(found, lambda c: F.trim(F.regexp_replace(F.btrim(squeezed(c), F.lit(" .,:;—–-()[]{}")), r"\A(The|A|An)\s+", "")))

    def good(c: Column) -> Column:
        n = F.size(F.split(c, " "))
        return ~c.isin(*NOT_CONCEPTS) & n.between(2, 8) & (F.length(c) >= 6) & ~c.rlike(r"(?i)\A(chapter|part|figure|table) ") & ~(F.split(c, " ")[0].isin(*SENTENCE_STARTS) & (n > 3))

    kept = F.filter(clean, good)
    return F.slice(firsts(F.filter(kept, lambda c: normal(c) != ""), normal), 1, limit)


def concept_type(name: Column, context: Column) -> Column:
    said = normal(F.concat(name, F.lit(" "), context))
    out = F.lit("concept")
    for kind, terms in reversed(CONCEPT_TYPES.items()):
        out = F.when(contains_any(said, terms), kind).otherwise(out)
    return out


def concepts(chunks: DataFrame, limit: int = 30, per_chunk: int = 10) -> DataFrame:
    """chunks (book_id, chunk_index, chunk_id, text): concepts of each book. The first chunk that has one names and types it; each further one adds 0.05 to its confidence; up to five chunks are its sources."""
    rows = chunks.select("book_id", "chunk_index", "chunk_id", F.col("text").alias("said"), concept_candidates(F.col("text"), per_chunk).alias("name"))
    rows = unrolled(rows, ("book_id", "chunk_index", "chunk_id", "said"), "name", "place")
    rows = rows.withColumn("concept_id", F.replace(normal(F.col("name")), F.lit(" "), F.lit("_"))).withColumn("type", concept_type(F.col("name"), F.col("said")))
    at = F.struct("chunk_index", "place")
    found = rows.groupBy("book_id", "concept_id").agg(
        F.min_by("name", at).alias("name"), F.min_by("type", at).alias("type"), F.count("*").alias("n"),
        F.slice(F.transform(F.array_sort(F.collect_set(F.struct("chunk_index", "chunk_id"))), lambda c: c["chunk_id"]), 1, 5).alias("sources"),
    )
    base = F.when(F.col("type") == "concept", 0.55).otherwise(0.70)
    found = found.withColumn("confidence", F.bround(F.least(F.lit(1.0), base + 0.05 * (F.col("n") - 1)), 3))
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("confidence"), F.lower("name"), "concept_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)


def first_paragraph(body: Column, chars: int = 700) -> Column:
    """The first paragraph of 120 characters or more that isn't a copyright line; else the beginning of the text."""
    plain = F.transform(F.split(text(body), r"\n\s*\n"), summary_plain)
    good = F.filter(plain, lambda p: (F.length(p) >= 120) & ~F.lower(p).rlike(r"\A(copyright|all rights reserved)"))
    return F.rtrim(F.left(F.coalesce(F.try_element_at(good, F.lit(1)), summary_plain(body)), F.lit(chars)))


def with_topic_stance(df: DataFrame, topic: str, said: str) -> DataFrame:
    """df with the stance and score of the text in `said` towards a topic, by terms that favour and terms that criticise. The normal text and the counts are columns of their own, so that each is found once."""
    low = F.col("__low")
    about = tuple(dict.fromkeys(t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in topic.lower()).split() if len(t) > 2))
    rows = df.withColumn("__low", normal(F.col(said)))
    counted = {"__hits": count_contained(low, about), "__fav": count_contained(low, FAVOUR), "__crit": count_contained(low, CRITIQUE) + contains_any(low, ("rather than", "instead of", "versus")).cast("int")}
    rows = rows.withColumns(counted).drop("__low")
    hits, fav, crit, name = F.col("__hits"), F.col("__fav"), F.col("__crit"), F.col("stance")
    rows = rows.withColumn("stance", F.when(fav > crit + 1, "favouring").when(crit > fav + 1, "criticising").when((fav > 0) & (crit > 0), "mixed").otherwise("neutral"))
    score = hits + F.when(name == "favouring", fav).when(name == "criticising", crit).when(name == "mixed", fav + crit).otherwise(0)
    return rows.withColumn("score", score).drop("__hits", "__fav", "__crit")


def compare_topic(topic: str, evidence: DataFrame) -> DataFrame:
    """evidence (book_id, text, bonus): the stance of each book with the largest sum of scores, each at least 1; ties by name."""
    rows = with_topic_stance(evidence, topic, "text").select("book_id", "stance", (F.greatest("score", F.lit(1)) + F.col("bonus")).cast("long").alias("s"))
    sums = rows.groupBy("book_id", "stance").agg(F.sum("s").alias("score"), F.count("*").alias("n_texts"))
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("score"), "stance"))
    return sums.withColumn("r", rank).where("r = 1").drop("r")


def keyword_score(fields: Column, query: Column) -> Column:
    """+1 for each term of more than two letters that the fields contain, +3 for the whole query."""
    said, asked = F.lower(fields), F.lower(query)
    words = F.array_distinct(F.filter(F.regexp_extract_all(asked, F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.length(w) > 2))
    return F.size(F.filter(words, lambda w: F.contains(said, w))) + F.when(F.contains(said, asked), 3).otherwise(0)
