"""Metadata of books: what file names, front matter and bodies say, and how they are put together and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.isbn import isbns, normal_isbn
from ..functions.strings import alias, file_name, firsts, once, slug, stripped, text

#: Fixed: the last part of a file name that may be an ISBN.
ISBN_PART = r"\A(?:ISBN(?:-1[03])?:?\s*)?(?:97[89][\-\s]?)?(?:\d[\-\s]?){9,12}[\dXx]\z"
#: Fixed: headings that are no topics, and words in a body that are, with their topics.
NO_TOPICS = ("introduction", "preface", "conclusion", "notes")
TOPIC_WORDS = {
    "systems": "systems", "goals": "goals", "habit": "habits", "energy": "personal energy", "failure": "failure", "finance": "finance", "invest": "investing", "money": "money",
    "productivity": "productivity", "decision": "decision-making", "psychology": "psychology", "health": "health", "sleep": "sleep", "leadership": "leadership",
    "management": "management", "writing": "writing", "creativity": "creativity", "ai": "AI", "software": "software",
}
#: Fixed: routing aliases that a class has when a book names none.
CLASS_ALIASES = {
    "004": ("technology", "computing"), "005": ("technology", "software"), "006": ("technology", "ai"), "150": ("psychology",), "153": ("psychology", "decision_making"),
    "158": ("personal_development", "productivity"), "330": ("finance", "economics"), "332": ("finance", "investing"), "338": ("business", "entrepreneurship"), "610": ("health",),
    "613": ("health", "wellbeing"), "650": ("business", "productivity"), "658": ("business", "management"), "780": ("music", "creativity"), "808": ("writing", "creativity"),
}
#: Fixed: words of fourteen classes.
CLASS_WORDS = {
    "332": ("investing", "investor", "investment", "stock", "stocks", "fund", "funds", "portfolio", "finance", "financial", "money", "wealth", "market", "markets", "banking", "compound interest", "retirement"),
    "330": ("economics", "economic", "economy", "capitalism", "inflation", "macroeconomics", "microeconomics"),
    "158": ("habit", "habits", "self improvement", "self-improvement", "personal development", "success", "motivation", "mindset", "goals", "systems", "productivity", "confidence", "discipline", "willpower", "energy", "failure"),
    "153": ("decision", "decisions", "thinking", "focus", "attention", "memory", "cognitive", "bias", "biases", "intelligence"),
    "650": ("work", "career", "productivity", "office", "time management", "business skills"),
    "658": ("leadership", "management", "manager", "operations", "strategy", "execution", "organisation", "organization"),
    "338": ("startup", "startups", "entrepreneur", "entrepreneurship", "enterprise", "industry"),
    "613": ("sleep", "nutrition", "exercise", "fitness", "wellbeing", "well-being", "supplements", "diet", "health"),
    "610": ("medicine", "medical", "doctor", "clinical", "diagnosis", "therapy"),
    "006": ("artificial intelligence", "machine learning", "llm", "agents", "ai ", " ai"),
    "005": ("programming", "software", "python", "code", "coding", "database"),
    "808": ("writing", "storytelling", "copywriting", "rhetoric"),
    "780": ("music", "songwriting", "songs", "recording", "mixing", "mastering"),
    "920": ("biography", "memoir", "autobiography", "life of"),
}
#: Fixed: keys of an ISBN mapping in the order in which one is chosen.
ISBN_KEYS = ("isbn_13", "isbn13", "isbn", "filename", "unknown", "detected_in_text", "isbn_10", "isbn10")
#: What the builder writes itself; other keys of an existing front matter are kept.
MANAGED = ("title", "author", "isbn", "classification", "metadata", "source", "ingest")


def stem(path: Column) -> Column:
    """The name of a file without folders and the last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*\z", "")


def parsed_name(name: Column) -> Column:
    """struct<title, author, isbn, confidence> of `Title - Author - ISBN`, read from the right, so that titles may hold hyphens. What looks like an ISBN but isn't valid gives none."""
    parts = F.filter(F.transform(F.split(stripped(name), " - "), stripped), lambda p: p != "")

    def split(parts: Column) -> Column:
        n = F.size(parts)
        coded = (n >= 2) & F.element_at(parts, -1).rlike(ISBN_PART)
        rest = F.when(coded, F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(parts)
        return F.struct(rest.alias("rest"), F.when(coded, normal_isbn(F.element_at(parts, -1))).alias("isbn"))

    def named(found: Column) -> Column:
        rest, isbn = found["rest"], found["isbn"]
        many = F.size(rest) >= 2
        title = F.when(many, F.array_join(F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0))), " - ")).otherwise(F.coalesce(F.try_element_at(rest, F.lit(1)), name))
        confidence = F.when(many, F.when(isbn.isNotNull(), "high").otherwise("medium")).when(isbn.isNotNull(), "medium").otherwise("low")
        return F.struct(title.alias("title"), F.when(many, F.element_at(rest, -1)).alias("author"), isbn.alias("isbn"), confidence.alias("confidence"))

    return once(once(parts, split), named)


def topics_of(body: Column, limit: int = 12, most: int = 60_000) -> Column:
    """Topics: the first 80 headings, without chapter numbers, and those whose words are in the first `most` characters; each once, whatever its case, blanks and hyphens."""
    found = F.slice(F.regexp_extract_all(text(body), F.lit(r"(?dm)^#{1,6}\s+(.+?)\s*$"), F.lit(1)), 1, 80)
    bare = F.transform(found, lambda h: F.lower(F.btrim(F.regexp_replace(stripped(h), r"(?i)\A(chapter|part|section)\s+\d+[:.\s-]*", ""), F.lit(" .:-"))))
    heads = F.filter(bare, lambda h: (h != "") & ~h.isin(*NO_TOPICS) & (F.length(h) <= 80))
    named = once(F.lower(F.left(text(body), F.lit(most))), lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(t)) for w, t in TOPIC_WORDS.items()])))
    return F.slice(firsts(F.concat(heads, named), lambda t: F.replace(alias(t), F.lit("_"), F.lit(" "))), 1, limit)


def class_scores(about: Column, body: Column, most: int = 30_000) -> dict[str, Column]:
    """For each class 8 for each of its words in the title, author and topics, and 1 for each in the first `most` characters."""
    said, low = F.lower(text(about)), F.lower(F.left(text(body), F.lit(most)))
    hits = lambda x, words: F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(x, w)))
    return {code: 8 * hits(said, words) + hits(low, words) for code, words in CLASS_WORDS.items()}


def with_class(df: DataFrame, about: Column, body: str, out: str = "guessed_class", most: int = 30_000) -> DataFrame:
    """df with the class of the highest score, the earlier on a tie, or null without any; 158 wins if it has 8 and is no more than 2 below 332. Scores are one column, found once."""
    scores = class_scores(about, F.col(body), most)
    rows = df.withColumn("__scores", F.array(*scores.values()))
    at = {code: F.col("__scores")[i] for i, code in enumerate(scores)}
    best = F.array_max("__scores")
    code = F.element_at(F.array(*[F.lit(c) for c in scores]), F.array_position("__scores", best).cast("int"))
    chosen = F.when(best == 0, F.lit(None)).when((at["158"] >= 8) & (at["158"] >= at["332"] - 2), "158").otherwise(code)
    return rows.withColumn(out, chosen).drop("__scores")


def default_aliases(code: Column) -> Column:
    table = F.create_map(*[x for c, a in CLASS_ALIASES.items() for x in (F.lit(c), F.array(*[F.lit(v) for v in a]))])
    return F.coalesce(F.try_element_at(table, code), F.array().cast("array<string>"))


def _some(meta: Column, path: str) -> Column:
    return F.nullif(F.get_json_object(meta, path), F.lit(""))


def _listed(meta: Column, path: str) -> Column:
    """A list, or a scalar as a list of one; null if there is none."""
    raw = _some(meta, path)
    return F.when(F.startswith(raw, F.lit("[")), F.nullif(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))).when(raw.isNotNull(), F.array(raw))


def inferred(files: DataFrame) -> DataFrame:
    """files (path, meta, text) with title, author, isbn map<source, ISBN> and file_name struct.

    Front matter comes before the file name. ISBNs of front matter keep their keys if they are valid; then comes the
    file name's, then up to ten found in the text, the first of them under `detected_in_text` too; one that
    is there already isn't repeated.
    """
    meta = F.col("meta")
    rows = files.withColumn("file_name", parsed_name(stem(F.col("path")))).withColumn("__found", F.slice(isbns(F.col("text")), 1, 10))
    given = _some(meta, "$.isbn")
    as_map = F.when(F.startswith(given, F.lit("{")), F.from_json(given, "map<string,string>")).when(given.isNotNull(), F.create_map(F.lit("unknown"), given))
    clean = lambda m: F.map_filter(F.transform_values(m, lambda k, v: normal_isbn(v)), lambda k, v: v.isNotNull())
    rows = rows.withColumn("__given", F.coalesce(clean(as_map), F.create_map().cast("map<string,string>")))
    add = lambda m, key, value: F.when(value.isNotNull() & ~F.map_contains_key(m, key), F.map_concat(m, F.create_map(key, value))).otherwise(m)
    rows = rows.withColumn("__isbn", add(F.col("__given"), F.lit("filename"), F.col("file_name.isbn")))
    rows = rows.withColumn("__isbn", add(F.col("__isbn"), F.lit("detected_in_text"), F.try_element_at("__found", F.lit(1))))
    entry = lambda v, i: F.struct(F.concat(F.lit("detected_in_text_"), (i + 1).cast("string")).alias("key"), v.alias("value"))
    rest = F.filter(F.transform("__found", entry), lambda e: ~F.array_contains(F.map_values("__isbn"), e["value"]) & ~F.map_contains_key("__isbn", e["key"]))
    return rows.withColumns(
        {
            "title": stripped(F.coalesce(_some(meta, "$.title"), F.col("file_name.title"))), "author": stripped(F.coalesce(_some(meta, "$.author"), F.col("file_name.author"))),
            "isbn": F.map_concat("__isbn", F.map_from_entries(rest)),
        }
    ).drop("__found", "__given", "__isbn")


def chosen_isbn(isbn: Column, keys: tuple[str, ...] = ISBN_KEYS) -> Column:
    """The ISBN under the first of the keys that is there, else the first of any."""
    return F.coalesce(*[F.try_element_at(isbn, F.lit(k)) for k in keys], F.try_element_at(F.map_values(isbn), F.lit(1)))


def described(files: DataFrame, labels: dict[str, str] | None = None, most: int = 30_000) -> DataFrame:
    """files (path, meta, text) with what a front matter holds: title, author, isbn, primary_class, primary_label, classification_source, secondary_classes, routing_aliases, topics, book_id.

    The class comes from the front matter, else from the folder (`332-finance/`), else from words, else it is 999.
    """
    meta = F.col("meta")
    topics = F.coalesce(_listed(meta, "$.classification.topics"), topics_of(F.col("text")))
    rows = inferred(files).withColumn("topics", topics)
    rows = with_class(rows, F.concat_ws(" ", "title", "author", F.array_join("topics", " ")), "text", "__words", most)
    given = F.coalesce(_some(meta, "$.classification.primary_class"), _some(meta, "$.primary_class"))
    folder = F.nullif(F.regexp_extract("path", r"(?:\A|/)(\d{3})(?:-[^/]*)?/[^/]*\z", 1), F.lit(""))
    source = F.when(given.isNotNull(), "existing_frontmatter").when(folder.isNotNull() & (folder != "999"), "folder_path").when(F.col("__words").isNotNull(), "filename/content keyword").otherwise("unclassified")
    rows = rows.withColumn("classification_source", source).withColumn("primary_class", F.coalesce(given, F.nullif(folder, F.lit("999")), "__words", F.lit("999")))
    table = F.create_map(*[F.lit(x) for pair in (labels or {"999": "Unclassified"}).items() for x in pair])
    label = F.coalesce(_some(meta, "$.classification.primary_label"), _some(meta, "$.primary_class_label"), F.try_element_at(table, "primary_class"), F.lit("Unclassified"))
    second = F.coalesce(_listed(meta, "$.classification.secondary_classes"), _listed(meta, "$.classification.secondary_class"), F.array().cast("array<string>"))
    aliases = F.transform(F.coalesce(_listed(meta, "$.classification.routing_aliases"), default_aliases(F.col("primary_class"))), alias)
    book = F.coalesce(_some(meta, "$.book_id"), slug(F.concat(text(F.col("author")), F.lit("_"), "title")))
    return rows.withColumns({"primary_label": label, "secondary_classes": second, "routing_aliases": aliases, "book_id": book}).drop("__words")


def front_matter_json(described_files: DataFrame, out: str = "front_matter") -> DataFrame:
    """described files with a front matter as JSON, in the order in which it is to be written; keys of the old one that the builder doesn't manage come last."""
    made = F.to_json(
        F.struct(
            "title", "author", F.when(F.size("isbn") > 0, F.col("isbn")).alias("isbn"),
            F.struct(F.lit("BMDC").alias("scheme"), "primary_class", "primary_label", "secondary_classes", "routing_aliases", "topics").alias("classification"),
            F.struct(
                F.col("file_name.title").alias("filename_title"), F.col("file_name.author").alias("filename_author"), F.col("file_name.isbn").alias("filename_isbn"),
                F.col("file_name.confidence").alias("filename_parse_confidence"), "classification_source",
            ).alias("metadata"),
            F.struct(F.coalesce(_some(F.col("meta"), "$.source.original_path"), F.lit("")).alias("original_path"), F.col("path").alias("cleaned_path")).alias("source"),
        )
    )
    keys = F.filter(F.coalesce(F.json_object_keys("meta"), F.array().cast("array<string>")), lambda k: ~k.isin(*MANAGED))
    kept = F.array_join(F.transform(keys, lambda k: F.concat(F.lit(","), F.to_json(F.struct(k.alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(k.alias("k")))) - 6), F.lit(":"), _value(F.col("meta"), k))), "")
    return described_files.withColumn(out, F.concat(F.substr(made, F.lit(1), F.length(made) - 1), kept, F.lit("}")))


def _value(meta: Column, key: Column) -> Column:
    """A member of a JSON object as JSON text."""
    return F.to_json(F.try_element_at(F.from_json(meta, "map<string,variant>"), key))


def problems(meta: Column, had: Column) -> Column:
    """What a front matter lacks, as an array of messages."""
    lacks = lambda f: F.when(F.coalesce(_some(meta, f"$.{f}"), F.lit("")).isin("", "{}", "[]", "false", "0"), F.lit(f"Missing required field: {f}"))
    block = F.get_json_object(meta, "$.classification")
    mapped = F.startswith(F.coalesce(block, F.lit("")), F.lit("{"))
    inside = F.array_compact(
        F.array(
            F.when(_some(meta, "$.classification.primary_class").isNull(), F.lit("Missing classification.primary_class")), F.when(_some(meta, "$.classification.primary_label").isNull(), F.lit("Missing classification.primary_label")),
            F.when(~F.coalesce(_some(meta, "$.classification.scheme"), F.lit("")).eqNullSafe(F.lit("BMDC")), F.lit("classification.scheme should be BMDC")),
        )
    )
    fields = F.array_compact(F.array(*[lacks(f) for f in ("title", "author", "classification")]))
    return F.when(~had, F.array(F.lit("Missing YAML frontmatter block"))).otherwise(F.concat(fields, F.when(mapped, inside).otherwise(F.array(F.lit("classification must be a mapping")))))


def expected_name(title: Column, author: Column, isbn: Column) -> Column:
    """The file name that a book should have: `Title - Author - ISBN.md`, of what there is."""
    some = lambda c: F.when(text(c) != "", file_name(c))
    return F.concat(F.concat_ws(" - ", file_name(title), some(author), F.nullif(text(isbn), F.lit(""))), F.lit(".md"))


def name_mismatches(described_files: DataFrame) -> DataFrame:
    """(path, expected_name, current_name) of described files whose name isn't what their metadata says."""
    rows = described_files.select("path", expected_name(F.col("title"), F.col("author"), chosen_isbn(F.col("isbn"))).alias("expected_name"), F.element_at(F.split("path", "/"), -1).alias("current_name"))
    return rows.where("expected_name <> current_name")
